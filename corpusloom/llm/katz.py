"""Language-model scores by Katz backoff.

The model is a bigram model over words and an end token, with a start history:

    P(w | u) = d(r) * r / h(u)        if u w was seen r times in training
             = alpha(u) * P(w)        else
    P(w)     = d1(c) * c / N          if w was seen c times
             = what is left           for all unseen words together

d and d1 are Good-Turing discounts in Katz's form up to K, from the counts of
counts of all training n-grams; where those are irregular (a discount outside
0..1) half a count is taken off instead. h(u) is the history's count, plus one
where it exceeds K, so that something is left for unseen followers even when all
followers are frequent. alpha(u) is computed from the exact sums over the
followers seen, so every history's probabilities add up to 1.

Texts are read once and kept as blocks of about BLOCK_TOKENS tokens: a local
vocabulary and the places in it. Counts are tables partitioned by the hash of
the word or the history. A block asks them for its distinct words and pairs and
gets counts back, so a frequent word or pair costs a row per block, not per
occurrence; histories that are very frequent are spread over several partitions
by their follower. Tokens are then scored in their block.

Defined results: null text counts as empty and scores its end token; repeated
rows count as often as they stand there; a null doc_id counts as training; with
no training document all tokens are unknown and have probability 1; an empty
table gives an empty result; further columns aren't read. Words are known by
64-bit hashes.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import importable, pack, shuffle_parts, unpack, written
from corpusloom.llm.hashing import give_back, mixed

K, BLOCK_TOKENS, SPREAD = 5, 1_500_000, 2_000_000
END, START = b" end", b" start"  # no words: words hold no blank
FLOW = "key long, kind int, block long, blob binary"
BLOCK, TOTALS, PAIRS, HELD, FOLLOWED, HISTORY, ALPHA, WORD_STATS, PAIR_STATS = range(9)


class Index(dict):
    """word to its place in a block's vocabulary, in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def word_hash(word: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(word)


def deltas(ascending: np.ndarray) -> np.ndarray:
    return np.diff(ascending, prepend=ascending.dtype.type(0))


def held_out(doc_id) -> bool:
    import zlib

    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 5 == 1


def discounts(counts_of_counts) -> np.ndarray:
    """d(0..K) from n_0 (unused), n_1 .. n_{K+1}."""
    n = np.asarray(counts_of_counts, "f8")
    out = np.ones(K + 1)
    last = (K + 1) * n[K + 1] / n[1] if n[1] else 1.0
    for r in range(1, K + 1):
        d = (((r + 1) * n[r + 1] / n[r] / r - last) / (1 - last)) if n[r] and last < 1 else 0.0
        out[r] = d if 0 < d < 1 else (r - 0.5) / r
    return out


class Unigrams:
    """P(w) by training count; n: counts of counts 1 .. K+1, of all types and tokens."""

    def __init__(self, n, types: int, tokens: int) -> None:
        self.types, self.tokens, self.d = types, tokens, discounts(n)
        low = sum(float(n[r]) * r * (1 - self.d[r]) for r in range(1, K + 1))
        # what all unseen words share; half a count where nothing is discounted
        self.scale = 1.0 if low > 0 else tokens / (tokens + 0.5)
        self.unseen = (low / tokens if low > 0 else 0.5 / (tokens + 0.5)) if tokens else 1.0

    def p(self, c: np.ndarray) -> np.ndarray:
        c = np.asarray(c, "f8")
        seen = self.d[np.minimum(c, K).astype(int)] * c
        seen = np.where(c > K, c, seen) * self.scale / max(self.tokens, 1)
        return np.where(c > 0, seen, self.unseen)

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((np.asarray(c, "f8") + 0.5) / (self.tokens + 0.5 * (self.types + 1)))


def history_count(c):
    return np.where(c > K, c + 1, c)


def groups(values: np.ndarray, n: int):
    """(bucket, positions) for each bucket that has values."""
    order = np.argsort(values, kind="stable")
    cuts = np.flatnonzero(np.diff(values[order])) + 1
    for a, b in zip([0, *cuts], [*cuts, len(order)], strict=True):
        if b > a:
            yield int(values[order[a]]), order[a:b]


def histories(n: np.ndarray, index: np.ndarray, start: int) -> np.ndarray:
    """The history of each token: the one before, the start for a document's first."""
    out = np.empty_like(index)
    out[1:] = index[:-1]
    out[np.cumsum(n) - n] = start
    return out


def pair_table(held, n, index, totals, ids, parts: int):
    """Distinct pairs of a block by bucket, history and follower: (u, v, training count, bucket, place of each token's pair)."""
    size, start = len(ids), len(ids) - 1  # the start history is the last entry
    by_id = np.argsort(ids, kind="stable")
    rank = np.empty(size, np.int64)
    rank[by_id] = np.arange(size)
    code, inverse = np.unique(rank[histories(n, index, start)] * size + rank[index], return_inverse=True)
    train = np.bincount(inverse, weights=np.repeat(held == 0, n), minlength=len(code)).astype(np.int64)
    pu, pv = by_id[code // size], by_id[code % size]
    spread = -(-totals[pu] // SPREAD)
    salt = mixed(ids[pv], 21) % np.maximum(spread, 1).astype(np.uint64)
    bucket = (mixed(ids[pu].astype(np.uint64) ^ (salt * np.uint64(0x9E3779B97F4A7C15)), 22) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return pu[order], pv[order], train[order], bucket[order], place[inverse]


def blocks(docs: DataFrame) -> DataFrame:
    """(key, kind, block, blob): documents as places in a vocabulary."""

    def read(batches):
        import pandas as pd
        from pyspark import TaskContext

        task, number = TaskContext.get().partitionId(), 0
        index, ids, null, held, sizes, flat, tokens = Index(), [], [], [], [], [], 0

        def made():
            end, start = index[END], index[START]
            flat_all = np.concatenate(flat)
            sizes_all, held_all = np.asarray(sizes, np.int32), np.asarray(held, np.uint8)
            flat_all[np.cumsum(sizes_all) - 1] = end
            own = np.bincount(flat_all, weights=np.repeat(held_all == 0, sizes_all), minlength=len(index)).astype(np.int64)
            own[start] = int((held_all == 0).sum())
            # the start history goes last
            order = np.array([i for i in range(len(index)) if i != start] + [start])
            to = np.empty(len(order), np.int32)
            to[order] = np.arange(len(order))
            vocabulary = np.asarray([word_hash(w) for w in index], np.uint64)[order]
            blob = pack(np.asarray(ids, np.int64), np.asarray(null, np.uint8), held_all, sizes_all, to[flat_all], vocabulary, own[order])
            return pd.DataFrame({"key": [(task << 24) + number], "kind": [BLOCK], "block": [(task << 24) + number], "blob": [blob]})

        for rows in batches:
            for d, missing, t in zip(rows["doc_id"], rows["missing"], rows["text"], strict=True):
                own = t.encode("utf-8", "surrogatepass").lower().split() if t else []
                place = np.zeros(len(own) + 1, np.int32)
                place[:-1] = np.fromiter(map(index.__getitem__, own), np.int32, len(own))
                flat.append(place)
                sizes.append(len(place))
                ids.append(0 if missing else int(d))
                null.append(bool(missing))
                held.append(held_out(None if missing else int(d)))
                tokens += len(place)
                if tokens >= BLOCK_TOKENS:
                    yield made()
                    number += 1
                    index, ids, null, held, sizes, flat, tokens = Index(), [], [], [], [], [], 0
        if sizes:
            yield made()
        del index, flat
        give_back()

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("missing"), "text")
    return rows.mapInPandas(read, FLOW)


def table(rows):
    import pandas as pd

    give_back()
    return pd.DataFrame(rows, columns=["key", "kind", "block", "blob"])


def asked(parts: int):
    """Each block's vocabulary to the partitions of its words."""

    def run(batches):
        for rows in batches:
            for block, blob in zip(rows["block"], rows["blob"], strict=True):
                *_, vocabulary, own = unpack(blob, 7)
                at = (mixed(vocabulary, 31) % np.uint64(parts)).astype(np.int64)
                yield table([(b, BLOCK, block, pack(vocabulary[x], own[x], x)) for b, x in groups(at, parts)])

    return run


def word_totals(start: int, parts: int):
    """One partition of the word table: totals and numbers back to the blocks, and counts of counts."""

    def run(key, rows):
        asks = [unpack(b, 3) for b in rows["blob"]]
        word, inverse = np.unique(np.concatenate([a[0] for a in asks]), return_inverse=True)
        total = np.bincount(inverse, weights=np.concatenate([a[1] for a in asks])).astype(np.int64)
        # a word's number over all partitions, small for frequent words
        number = np.empty(len(word), np.int64)
        number[np.argsort(-total, kind="stable")] = np.arange(len(word)) * parts + key[0]
        out, at = [], 0
        for block, a in zip(rows["block"], asks, strict=True):
            own = inverse[at : at + len(a[0])]
            out.append((block, TOTALS, block, pack(deltas(a[2]), total[own], number[own])))
            at += len(a[0])
        seen = total[(word != np.uint64(start)) & (total > 0)]
        out.append((-1 - key[0], WORD_STATS, -1, pack(np.array([*np.bincount(np.minimum(seen, K + 2), minlength=K + 3)[: K + 2], len(seen), seen.sum()], np.int64))))
        return table(out)

    return run


def totals_of(rows, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Training counts and numbers of a block's words."""
    total, number = np.zeros(size, np.int64), np.zeros(size, np.int64)
    for b in rows["blob"][rows["kind"] == TOTALS]:
        at, t, n = unpack(b, 3)
        at = np.cumsum(at)
        total[at], number[at] = t, n
    return total, number


def block_pairs(parts: int):
    """A block's distinct pairs to the partitions of their histories; totals and held-out histories go along."""

    def run(key, rows):
        if not (rows["kind"] == BLOCK).any():
            return rows  # counts of counts
        block = key[0]
        _, _, held, n, index, vocabulary, _ = unpack(rows["blob"][rows["kind"] == BLOCK].iloc[0], 7)
        totals, ids = totals_of(rows, len(vocabulary))
        u, v, train, bucket, _ = pair_table(held, n, index, totals, ids, parts)
        out = [(block % parts, TOTALS, block, pack(deltas(np.arange(len(totals))), totals, ids))]
        for b, x in groups(bucket, parts):
            follower, first = np.unique(ids[v[x]], return_index=True)
            cuts = np.flatnonzero(np.diff(u[x], prepend=-1))
            out.append((b, PAIRS, block, pack(deltas(ids[u[x][cuts]]), np.diff(cuts, append=len(x)), deltas(follower), totals[v[x][first]], ids[v[x]], train[x])))
        own = np.unique(histories(n, index, len(vocabulary) - 1)[np.repeat(held == 1, n)])
        at = (mixed(ids[own], 33) % np.uint64(parts)).astype(np.int64)
        out += [(b, HELD, block, pack(ids[own[x]], own[x], totals[own[x]])) for b, x in groups(at, parts)]
        return table(out)

    return run


def pair_totals(parts: int):
    """One partition of the pair table: counts back to the blocks, sums per history, and counts of counts."""

    def run(key, rows):
        own = rows["kind"] == PAIRS
        out = list(rows[~own].itertuples(index=False, name=None))
        if own.any():
            asks = [unpack(b, 6) for b in rows["blob"][own]]
            u, v = np.concatenate([np.repeat(np.cumsum(a[0]), a[1]) for a in asks]), np.concatenate([a[4] for a in asks])
            words = np.concatenate([a[3][np.searchsorted(np.cumsum(a[2]), a[4])] for a in asks])
            trained, sizes = np.concatenate([a[5] for a in asks]), [len(a[4]) for a in asks]
            del asks
            order = np.lexsort((v, u))
            first = np.ones(len(order), bool)
            first[1:] = (u[order][1:] != u[order][:-1]) | (v[order][1:] != v[order][:-1])
            inverse = np.empty(len(order), np.int64)
            inverse[order] = np.cumsum(first) - 1
            total = np.bincount(inverse, weights=trained).astype(np.int64)
            at = 0
            for block, size in zip(rows["block"][own], sizes, strict=True):
                out.append((key[0], FOLLOWED, block, pack(total[inverse[at : at + size]])))
                at += size
            seen = np.flatnonzero(total > 0)
            r, where = total[seen], order[first][seen]
            out.append((key[0], PAIR_STATS, -1, pack(np.bincount(np.minimum(r, K + 2), minlength=K + 3)[: K + 2].astype(np.int64))))
            history, place = np.unique(u[where], return_inverse=True)
            sums = [np.bincount(place, weights=r == i, minlength=len(history)) for i in range(1, K + 1)] + [np.bincount(place, weights=np.where(r > K, r, 0), minlength=len(history))]
            c = words[where]
            sums += [np.bincount(place, weights=c == i, minlength=len(history)) for i in range(1, K + 1)] + [np.bincount(place, weights=np.where(c > K, c, 0), minlength=len(history))]
            at = (mixed(history, 33) % np.uint64(parts)).astype(np.int64)
            out += [(b, HISTORY, -1, pack(history[x], *[s[x].astype(np.int64) for s in sums])) for b, x in groups(at, parts)]
        return table(out)

    return run


def alphas(unigrams: Unigrams, d: np.ndarray):
    """One partition of the history table: alpha back to the blocks that ask."""

    def run(key, rows):
        stats = [unpack(b, 2 * K + 3) for b in rows["blob"][rows["kind"] == HISTORY]]
        known = np.zeros(0, np.int64)
        if stats:
            known, inverse = np.unique(np.concatenate([s[0] for s in stats]), return_inverse=True)
            sums = np.stack([np.bincount(inverse, weights=np.concatenate([s[1 + i] for s in stats])) for i in range(2 * K + 2)])
        out = []
        for block, b in rows[rows["kind"] == HELD][["block", "blob"]].itertuples(index=False, name=None):
            word, at, count = unpack(b, 3)
            alpha = np.ones(len(word))  # nothing was seen after it
            if len(known):
                place = np.minimum(np.searchsorted(known, word), len(known) - 1)
                seen = known[place] == word
                s = sums[:, place[seen]]
                r = np.arange(1, K + 1)[:, None]
                used = ((d[1:, None] * r * s[:K]).sum(0) + s[K]) / history_count(count[seen])
                words = (unigrams.p(np.arange(1, K + 1))[:, None] * s[K + 1 : 2 * K + 1]).sum(0) + s[2 * K + 1] * unigrams.scale / max(unigrams.tokens, 1)
                alpha[seen] = (1 - used) / (1 - words)
            out.append((block, ALPHA, block, pack(at, alpha)))
        return table(out)

    return run


def scores(unigrams: Unigrams, d: np.ndarray, parts: int):
    """A block's documents, token by token: the seen pair, else the history's weight and the word."""

    def run(key, rows):
        import pandas as pd

        doc_ids, null, held, n, index, vocabulary, _ = unpack(rows["blob"][rows["kind"] == BLOCK].iloc[0], 7)
        totals, ids = totals_of(rows, len(vocabulary))
        u, v, _, bucket, place = pair_table(held, n, index, totals, ids, parts)
        answers = rows[rows["kind"] == FOLLOWED].sort_values("key")
        r = np.concatenate([unpack(b, 1)[0] for b in answers["blob"]]).astype(np.int64)
        alpha = np.ones(len(vocabulary))
        for b in rows["blob"][rows["kind"] == ALPHA]:
            at, a = unpack(b, 2)
            alpha[at] = a
        p = np.where(r > 0, np.where(r > K, 1.0, d[np.minimum(r, K)]) * r / np.maximum(history_count(totals[u]), 1), alpha[u] * unigrams.p(totals[v]))
        starts = np.cumsum(n) - n
        by_word = totals[index]
        return pd.DataFrame({
            "doc_id": pd.Series(doc_ids, dtype="Int64").mask(null.astype(bool)) if null.any() else doc_ids,
            "held_out": held.astype(bool), "n_tokens": n.astype(np.int64), "n_known": np.add.reduceat((by_word > 0).astype(np.int64), starts), "train_tokens": np.int64(unigrams.tokens),
            "base_score": np.add.reduceat(unigrams.base(totals)[index], starts), "score": np.add.reduceat(np.log10(p)[place], starts),
        })

    return run


def summed(rows: DataFrame, kind: int, n: int) -> np.ndarray:
    """Counts of counts of all partitions, one small row each."""
    total = np.zeros(n, np.int64)
    for r in rows.where(F.col("kind") == kind).select("blob").collect():
        total += unpack(bytes(r["blob"]), 1)[0]
    return total


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) per document."""
    spark = docs.sparkSession
    importable(spark)
    own = written(blocks(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))), "blocks")
    parts = max(4, 3 * shuffle_parts(spark) // 2, own.count() // 2)  # two blocks of tokens each at most, however many there are
    totals = own.mapInPandas(asked(parts), FLOW).groupBy("key").applyInPandas(word_totals(word_hash(START), parts), FLOW)
    pairs = totals.union(own).groupBy("key").applyInPandas(block_pairs(parts), FLOW)
    counts = written(pairs.groupBy("key").applyInPandas(pair_totals(parts), FLOW), "counts")
    del totals, pairs
    of_words = summed(counts, WORD_STATS, K + 4)
    unigrams, d = Unigrams(of_words[: K + 2], int(of_words[K + 2]), int(of_words[K + 3])), discounts(summed(counts, PAIR_STATS, K + 2))
    weights = counts.where(F.col("kind").isin(HELD, HISTORY)).groupBy("key").applyInPandas(alphas(unigrams, d), FLOW)
    answers = counts.where(F.col("kind").isin(TOTALS, FOLLOWED)).union(weights).union(own)
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return answers.groupBy("block").applyInPandas(scores(unigrams, d, parts), schema)
