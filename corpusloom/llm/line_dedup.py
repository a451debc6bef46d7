"""Line dedup by an exact set-similarity join.

A line is the set of its words (lower-cased, cut at white space). A line is
removed when an earlier line (by doc_id, then place) has a Jaccard similarity of
at least 4/5 with it, whether or not that earlier line stays itself. Lines
without words take no part and stay.

1. All words are counted in a table of fixed size, hashed by word; the
   counts give one global order of words, rarest first.
2. Lines with equal sets (by 128 bits made of 64-bit word hashes) are one class,
   found first within a task, so that a frequent line costs each task one row.
   Later members are removed. Sets of fewer than JOINED words match only equal
   sets, so this step decides them.
3. Each larger class sends its prefix, its n - ceil(4n/5) + 1 rarest words, to the
   tasks of these words. Lines meet there only with lines of their word, and the
   length filter, the positional filter and a parity sketch, which bounds the
   symmetric difference from below, leave the candidates. The sketch has about a
   bit per word of the line, folded where lines of unlike length meet. A line that
   has found a very near candidate looks no further in that task.
4. Each line's nearest candidate by sketch is verified on the words themselves.
   Lines for which it fails and that had others are looked up again: the lines
   that share as many prefix words with one of them as the two lengths demand go
   to the tasks of these words with their whole sets of 64-bit word hashes, and
   the overlaps are counted there. So the result is exact, and no pair but the
   nearest ones leaves a task.

Words that are frequent in prefixes are cut in chunks, each pair of chunks being
a task's group of its own; how many is estimated from a sample, as any number
gives the same result.

Defined results: a null text stays null; empty lines stay; a line with nothing
but removed neighbours stays as it is; a document that loses all lines keeps an
empty text; rows of equal id and text are decided alike, rows of one id but
different text follow each other in order of text, null ids come last; an empty
table gives an empty result; further columns pass through untouched, whatever
their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import bitmap_of, fresh, importable, numbered, pack, parts_for, ranks_of, table_rows, unpacked, written
from corpusloom.llm.hashing import AT_ONCE, STEP, WHITE, Tally, give_back, buffers, hashed_words, lowered, mixed, runs
from corpusloom.llm.parity import Shape, Sketches, partners

#: the smallest set that matches a set unlike it: four words and five
JOINED = 4
#: buckets of the word counts, bits of a hash beside line and count in a sort key
COUNTS, KEY_BITS = 1 << 22, 36
#: entries of one word that one group may hold; docs of which one is sampled to find such words, and how many get chunks (the others are one group each)
HOT, SAMPLED, MOST_HOT = 20_000, 16, 10_000
#: neighbours by length that all lines look at; pairs at once
NEIGHBOURS, PAIRS_AT_ONCE = 32, 500_000
#: lines and prefix words that a task holds before it sends them; words a group; bits of the tables of wanted lines and words
FLUSH_LINES, FLUSH_WORDS, GROUP_WORDS, BITMAP = 100_000, 1_500_000, 2_500_000, 1 << 25
#: about a cell a word
SKETCH = Shape(64, 4)


def words_of(line: str) -> set[str]:
    return set(line.lower().split())


def prefix_length(n):
    """Two sets of Jaccard 4/5 share one of this many first words in any common order."""
    return n - (4 * n + 4) // 5 + 1


def lines_of(ids, buf: np.ndarray, ends: np.ndarray, order: np.ndarray, only: np.ndarray | None = None):
    """(doc, place, size, words, starts) of all lines with words; the distinct words of a line are together, rarest first by the table order.

    only: a bitmap of words; lines without any of them are left out."""
    first, h = hashed_words(buf, WHITE, wide=True)
    line_ends = np.flatnonzero(buf == 10)
    doc_lines = np.diff(np.searchsorted(line_ends, ends - 1, side="right"), prepend=0)
    of_line = np.diff(np.searchsorted(first, line_ends), prepend=0)
    line = np.repeat(np.arange(len(line_ends)), of_line)
    if only is not None:
        some = np.zeros(len(line_ends), bool)
        some[line[marked_in(only, (h % np.uint64(BITMAP)).astype(np.int64))]] = True
        h, line = h[some[line]], line[some[line]]
    rarity = order[(h & np.uint64(COUNTS - 1)).astype(np.int64)].astype(np.uint64)
    key = (rarity << np.uint64(KEY_BITS)) | (h >> np.uint64(64 - KEY_BITS))
    if len(line_ends) < 1 << (56 - KEY_BITS):
        own = (line.astype(np.uint64) << np.uint64(KEY_BITS + 8)) | key
        by = np.argsort(own)
        same = own[by][1:] == own[by][:-1]
        if (same & (h[by][1:] != h[by][:-1])).any():
            by = np.lexsort((h, own))  # two words alike in the key
    else:
        by = np.lexsort((h, key, line))
    h, line = h[by], line[by]
    distinct = np.ones(len(h), bool)
    distinct[1:] = (h[1:] != h[:-1]) | (line[1:] != line[:-1])
    h, line = h[distinct], line[distinct]
    starts = np.flatnonzero(np.diff(line, prepend=-1))
    size = np.diff(starts, append=len(line))
    which = line[starts]
    doc = np.repeat(np.asarray(ids, np.int64), doc_lines)
    place = np.arange(len(line_ends)) - np.repeat(np.cumsum(doc_lines) - doc_lines, doc_lines)
    return doc[which], place[which].astype(np.int32), size.astype(np.int32), h, starts


def classes_of(doc, place, k1, k2) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the later and of the first members of classes with equal keys."""
    order = np.lexsort((place, doc, k2, k1))
    first = np.ones(len(order), bool)
    first[1:] = (k1[order][1:] != k1[order][:-1]) | (k2[order][1:] != k2[order][:-1])
    return order[~first], order[first]


def earlier(doc, place, doc2, place2):
    return (doc < doc2) | ((doc == doc2) & (place < place2))


def meet(word, doc, place, size, position, sketch):
    """Candidates of the entries of one task as positions (later, earlier), how far apart their sketches are in hundredths of what the bound allows, and which entries looked no further."""
    order = np.lexsort((size, word))
    word, doc, place = word[order], doc[order], place[order]
    size, position = size[order].astype(np.int64), position[order].astype(np.int64)
    known = Sketches(SKETCH, size, runs(sketch, *_spans(SKETCH.lengths(size), order)))
    found, done = [], np.zeros(len(word), bool)

    def look(i, j):
        a, b = size[i], size[j]
        need = (4 * (a + b) + 8) // 9
        room = np.minimum(position[i], position[j]) + 1 + np.minimum(a - 1 - position[i], b - 1 - position[j])
        fits = (room >= need) & ((doc[i] != doc[j]) | (place[i] != place[j]))
        i, j, most = i[fits], j[fits], (a + b - 2 * need)[fits]
        at, apart = known.near(i, j, most)
        i, j, apart = i[at], j[at], 100 * apart // np.maximum(most[at], 1)
        swap = earlier(doc[i], place[i], doc[j], place[j])
        later, before = np.where(swap, j, i), np.where(swap, i, j)
        found.append((order[later], order[before], apart))
        ended = later[apart <= 33]
        done[ended] = True
        return ended

    partners(word, size, lambda n: ((4 * n + 4) // 5, 5 * n // 4), look, NEIGHBOURS, PAIRS_AT_ONCE)
    stopped = np.zeros(len(word), bool)
    stopped[order] = done
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), stopped
    return *(np.concatenate(x) for x in zip(*found, strict=True)), stopped


def _spans(lengths: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths, in this order, of what stands in the original order; lengths come in the new one."""
    own = np.empty(len(order), np.int64)
    own[order] = lengths
    starts = np.cumsum(own) - own
    return starts[order], lengths


def counted(docs: DataFrame) -> tuple[np.ndarray, int]:
    """A rank of rarity by how often words of each bucket stand in the texts (8 steps a doubling), from a table of fixed size; and the number of words."""

    def count(batches):
        total = Tally(COUNTS)
        for _, buf, _ in buffers(batches, lowered):
            _, h = hashed_words(buf, WHITE, wide=True)
            total.add((h & np.uint64(COUNTS - 1)).astype(np.int64))
        yield table_rows(total.counts())

    return ranks_of(docs.select("lid", "text").mapInArrow(count, "chunk int, blob binary"), COUNTS)


def hot_words(docs: DataFrame, order) -> dict[int, int]:
    """The words that most prefixes above HOT hold, with the number of chunks; estimated from one of SAMPLED documents."""

    def sample(batches):
        import pyarrow as pa

        for ids, buf, ends in buffers(batches, lowered):
            _, _, size, words, starts = lines_of(ids, buf, ends, order.value)
            p = np.where(size >= JOINED, prefix_length(size), 0)
            word, n = np.unique(runs(words, starts, p), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n)], names=["word", "n"])

    some = docs.where(F.pmod(F.xxhash64("lid"), F.lit(SAMPLED)) == 0).select("lid", "text")
    found = some.mapInArrow(sample, "word long, n long").groupBy("word").agg((SAMPLED * F.sum("n")).alias("n")).where(F.col("n") > HOT)
    return {r["word"]: -(-r["n"] // HOT) for r in found.orderBy(F.desc("n"), "word").limit(MOST_HOT).collect()}


def candidates(docs: DataFrame, order, hot: dict[int, int], parts: int) -> DataFrame:
    """(x_doc, x_place, y_doc, y_place, apart, more): each line's nearest candidate in each task, and whether there may be others; y_place -1 where x is a later member of a class."""
    schema = "b int, kind int, blob binary"

    def table(rows):
        import pyarrow as pa

        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], names=["b", "kind", "blob"])

    def lines(batches):
        def sent(held):
            doc, place, size, k1, k2 = (np.concatenate(x) for x in list(zip(*held, strict=True))[:5])
            prefix, sketch = np.concatenate([x[5] for x in held]), np.concatenate([x[6] for x in held])
            p, wide = np.where(size >= JOINED, prefix_length(size), 0).astype(np.int64), SKETCH.lengths(size)
            p_starts, s_starts = np.cumsum(p) - p, np.cumsum(wide) - wide
            later, own = classes_of(doc, place, k1, k2)
            rows = [(int(later[0]) % parts, 1, pack(doc[later], place[later]))] if len(later) else []
            bucket = (k1[own] % np.uint64(parts)).astype(np.int64)
            own = own[np.lexsort((place[own], doc[own], bucket))]
            bucket = (k1[own] % np.uint64(parts)).astype(np.int64)
            cuts = np.flatnonzero(np.diff(bucket)) + 1
            for x in np.split(own, cuts):
                rows.append((int(k1[x[0]] % np.uint64(parts)), 0, pack(doc[x], place[x], size[x], k1[x], k2[x], runs(prefix, p_starts[x], p[x]), runs(sketch, s_starts[x], wide[x]))))
            return table(rows)

        held, n, words_held = [], 0, 0
        for ids, buf, ends in buffers(batches, lowered):
            doc, place, size, words, starts = lines_of(ids, buf, ends, order.value)
            if not len(size):
                continue
            with np.errstate(over="ignore"):
                k1, k2 = np.add.reduceat(mixed(words, 1), starts), np.add.reduceat(mixed(words, 2), starts)
            prefix = runs(words, starts, np.where(size >= JOINED, prefix_length(size), 0))
            held.append((doc, place, size, k1, k2, prefix, SKETCH.made(size, words)))
            n, words_held = n + len(size), words_held + len(prefix)
            if n >= FLUSH_LINES or words_held >= FLUSH_WORDS:
                yield sent(held)
                held, n, words_held = [], 0, 0
        if held:
            yield sent(held)

    def classes(key, rows):
        import pandas as pd

        out = [(key[0], 1, b) for b in rows["blob"][rows["kind"] == 1]]
        own = rows["blob"][rows["kind"] == 0]
        if len(own):
            doc, place, size, k1, k2, prefix, sketch = unpacked(own, 7)
            p, wide = np.where(size >= JOINED, prefix_length(size), 0).astype(np.int64), SKETCH.lengths(size)
            p_starts, s_starts = np.cumsum(p) - p, np.cumsum(wide) - wide
            later, first = classes_of(doc, place, k1, k2)
            if len(later):
                out.append((key[0], 1, pack(doc[later], place[later])))
            first = first[size[first] >= JOINED]
            line = np.repeat(first, p[first])
            position = np.arange(len(line)) - np.repeat(np.cumsum(p[first]) - p[first], p[first])
            word = prefix[p_starts[line] + position].view(np.int64)
            if hot:
                # a frequent word's entry goes to the cells of its chunk with every chunk
                extra, keep = [], np.ones(len(word), bool)
                for w, k in hot.items():
                    at = np.flatnonzero(word == w)
                    if len(at):
                        keep[at] = False
                        c = (mixed((doc[line[at]] * 64 + place[line[at]]).astype(np.uint64), 5) % np.uint64(k)).astype(np.int64)
                        with np.errstate(over="ignore"):
                            for j in range(k):
                                cell = np.uint64(w & (2**64 - 1)) + (np.minimum(c, j) * k + np.maximum(c, j) + 1).astype(np.uint64)
                                extra.append((line[at], position[at], mixed(cell, 7).view(np.int64)))
                line, position, word = (np.concatenate([a[keep], *x]) for a, x in zip((line, position, word), zip(*extra, strict=True) if extra else ((), (), ()), strict=True))
            bucket = (mixed(word.view(np.uint64), 9) % np.uint64(parts)).astype(np.int64)
            by = np.lexsort((word, bucket))
            line, position, word, bucket = line[by], position[by], word[by], bucket[by]
            for x in np.split(np.arange(len(by)), np.flatnonzero(np.diff(bucket)) + 1):
                if len(x):
                    own = line[x]
                    out.append((int(bucket[x[0]]), 0, pack(word[x], doc[own], place[own], size[own], position[x].astype(np.int32), runs(sketch, s_starts[own], wide[own]))))
        give_back()
        return pd.DataFrame(out, columns=["b", "kind", "blob"])

    def pairs(key, rows):
        import pandas as pd

        found = [tuple(np.zeros(0, t) for t in ("i8", "i4", "i8", "i4", "i4", "?"))]
        gone = rows["blob"][rows["kind"] == 1]
        if len(gone):
            doc, place = unpacked(gone, 2)
            n = len(doc)
            found.append((doc, place, np.zeros(n, np.int64), np.full(n, -1, np.int32), np.zeros(n, np.int32), np.zeros(n, bool)))
        entries = rows["blob"][rows["kind"] == 0]
        if len(entries):
            word, doc, place, size, position, sketch = unpacked(entries, 6)
            x, y, apart, stopped = meet(word, doc, place, size, position, sketch)
            if len(x):
                by = np.lexsort((place[y], doc[y], apart, place[x], doc[x]))
                x, y, apart = x[by], y[by], apart[by]
                first = np.flatnonzero((np.diff(doc[x], prepend=-1) != 0) | (np.diff(place[x], prepend=-1) != 0))
                more = np.maximum.reduceat(stopped[x] | (doc[y] != doc[np.repeat(y[first], np.diff(first, append=len(x)))]) | (place[y] != place[np.repeat(y[first], np.diff(first, append=len(x)))]), first)
                x, y, apart = x[first], y[first], apart[first]
                found.append((doc[x], place[x], doc[y], place[y], apart.astype(np.int32), more))
        give_back()
        return pd.DataFrame(dict(zip(("x_doc", "x_place", "y_doc", "y_place", "apart", "more"), map(np.concatenate, zip(*found, strict=True)), strict=True)))

    own = docs.select("lid", "text").mapInArrow(lines, schema).groupBy("b").applyInPandas(classes, schema)
    found = own.groupBy("b").applyInPandas(pairs, "x_doc long, x_place int, y_doc long, y_place int, apart int, more boolean")
    return written(found, "line-pairs")


def spot(doc, place):
    """The bit of a line in a bitmap of lines; the same formula for columns and arrays."""
    if isinstance(doc, np.ndarray):
        return ((doc % (1 << 31)) * 40_503 + place.astype(np.int64) * 9_973) % BITMAP
    return F.pmod(F.pmod(doc, F.lit(1 << 31)) * 40_503 + place.cast("long") * 9_973, F.lit(BITMAP))


def hits(bitmap: np.ndarray, doc: np.ndarray, place: np.ndarray) -> np.ndarray:
    return marked_in(bitmap, spot(doc, place))


def marked(lines: DataFrame):
    """A bitmap of fixed size of the lines (d, p), broadcast; it may hold others too."""
    return lines.sparkSession.sparkContext.broadcast(bitmap_of(lines.select(spot(F.col("d"), F.col("p")).alias("s")), BITMAP))


def verified(docs: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The pairs (x_doc, x_place, more, ok), ok where the words of both lines have Jaccard 4/5; and the lines (d, p, t) that this took."""
    wanted = marked(pairs.select(F.col("x_doc").alias("d"), F.col("x_place").alias("p")).union(pairs.select("y_doc", "y_place")))

    def texts(batches):
        import pyarrow as pa

        for batch in (b.slice(at, AT_ONCE) for b in batches for at in range(0, b.num_rows, AT_ONCE)):
            own = batch.column(1).cast(pa.binary()).to_pylist()
            n = np.fromiter((x.count(b"\n") + 1 if x else 0 for x in own), np.int64, len(own))
            row = np.repeat(np.arange(len(own)), n)
            place = (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32)
            doc = batch.column(0).to_numpy(zero_copy_only=False)[row]
            at = np.flatnonzero(hits(wanted.value, doc, place))
            held, last = [], -1
            for r, i in zip(row[at].tolist(), place[at].tolist(), strict=True):
                if r != last:
                    parts, last = own[r].split(b"\n"), r
                held.append(parts[i])
            yield pa.RecordBatch.from_arrays([pa.array(doc[at], pa.int64()), pa.array(place[at], pa.int32()), pa.array(held, pa.binary())], names=["d", "p", "t"])

    def compare(batches):
        for rows in batches:
            ok = []
            for a, b in zip(rows["x_text"], rows["y_text"], strict=True):
                a, b = (set(lowered(bytes(x)).decode("utf-8", "surrogateescape").split()) for x in (a, b))
                both = len(a & b)
                ok.append(5 * both >= 4 * (len(a) + len(b) - both))
            yield rows[["x_doc", "x_place", "more"]].assign(ok=ok)

    lines = written(docs.select("lid", "text").mapInArrow(texts, "d long, p int, t binary"), "lines")
    x, y = (lines.select(F.col("d").alias(f"{k}_doc"), F.col("p").alias(f"{k}_place"), F.col("t").alias(f"{k}_text")) for k in "xy")
    both = pairs.join(x, ["x_doc", "x_place"]).join(y, ["y_doc", "y_place"]).select("x_doc", "x_place", "more", "x_text", "y_text")
    return written(both.mapInPandas(compare, "x_doc long, x_place int, more boolean, ok boolean"), "verified"), lines


def least_shared(n, m):
    """Two sets of these sizes and Jaccard 4/5 share at least so many words of both prefixes: what is beyond the prefix that ends first can't make up for more."""
    return np.maximum((4 * (n + m) + 8) // 9 - np.maximum(n - prefix_length(n), m - prefix_length(m)), 1)


def sized(word: np.ndarray, size) -> np.ndarray:
    """The bit of a prefix word together with its line's size."""
    with np.errstate(over="ignore"):
        return (mixed(word + np.asarray(size).astype(np.uint64) * np.uint64(STEP), 11) % np.uint64(BITMAP)).astype(np.int64)


def marked_in(bitmap: np.ndarray, s: np.ndarray) -> np.ndarray:
    return ((bitmap[s >> 5] >> (s & 31).astype(np.uint32)) & np.uint32(1)).astype(bool)


def may_match(bitmap: np.ndarray, word: np.ndarray, line: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which of these entries, (word, line) in order of lines, are of lines that share enough prefix words with a marked line of some size."""
    first = np.flatnonzero(np.diff(line, prepend=-1))
    m = size[line[first]].astype(np.int64)
    n, most, ok = (4 * m + 4) // 5, 5 * m // 4, np.zeros(len(first), bool)
    lengths = np.diff(first, append=len(line))
    todo = np.arange(len(first))
    while len(todo):
        own = runs(word, first[todo], lengths[todo])
        hit = marked_in(bitmap, sized(own, np.repeat(n[todo], lengths[todo])))
        ends = np.cumsum(lengths[todo])
        counts = np.add.reduceat(hit, ends - lengths[todo], dtype=np.int64)
        ok[todo] = counts >= least_shared(n[todo], m[todo])
        n[todo] += 1
        todo = todo[~ok[todo] & (n[todo] <= most[todo])]
    return np.repeat(ok, lengths)


def looked_up(docs: DataFrame, order, hot: dict[int, int], parts: int, asked: DataFrame) -> DataFrame:
    """The lines among asked (d, p, t) that an earlier line matches, as (x_doc, x_place) and perhaps some others, each several times."""

    def spots(batches):
        import pyarrow as pa

        for ids, buf, ends in buffers(batches, lowered):
            _, _, size, words, starts = lines_of(ids, buf, ends, order.value)
            word = runs(words, starts, prefix_length(size))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([(word % np.uint64(BITMAP)).astype(np.int64), sized(word, np.repeat(size, prefix_length(size)))]))], names=["s"])

    rare = docs.sparkSession.sparkContext.broadcast(bitmap_of(asked.select("d", "t").mapInArrow(spots, "s long"), BITMAP))
    wanted = marked(asked)

    def entries(batches):
        import pyarrow as pa

        def sent(held):
            word, doc, place, size, x, mine = (np.concatenate([h[i] for h in held]) for i in range(6))
            flat = np.concatenate([h[6] for h in held])
            starts = np.cumsum(size) - size
            # an entry of a frequent word goes to its chunk, one that is asked for to all of them
            cell, which = [word], [np.arange(len(word))]
            for w, k in hot.items():
                at = np.flatnonzero(word == np.uint64(w & (2**64 - 1)))
                if len(at):
                    chunk = (mixed((doc[at] * 64 + place[at]).astype(np.uint64), 5) % np.uint64(k)).astype(np.int64)
                    for j in range(1, k):
                        own = at[(chunk == j) | x[at]]
                        with np.errstate(over="ignore"):
                            cell.append(mixed(word[own] + np.uint64(j), 7))
                        which.append(own)
                    mine[at[(chunk != 0) & ~x[at]]] = False
            cell, which = np.concatenate(cell), np.concatenate(which)
            keep = (which >= 0) & (mine[which] | (np.arange(len(which)) >= len(word)))
            cell, which = cell[keep], which[keep]
            bucket = (mixed(cell, 9) % np.uint64(parts)).astype(np.int64)
            by = np.argsort(bucket, kind="stable")
            rows = [(int(bucket[i[0]]), pack(cell[i], doc[which[i]], place[which[i]], size[which[i]], x[which[i]].astype(np.uint8), runs(flat, starts[which[i]], size[which[i]]))) for i in np.split(by, np.flatnonzero(np.diff(bucket[by])) + 1) if len(i)]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["b", "blob"])

        held, n = [], 0
        for ids, buf, ends in buffers(batches, lowered):
            doc, place, size, words, starts = lines_of(ids, buf, ends, order.value, rare.value)
            p = np.where(size >= JOINED, prefix_length(size), 0)
            word, line = runs(words, starts, p), np.repeat(np.arange(len(size)), p)
            own = np.flatnonzero(marked_in(rare.value, (word % np.uint64(BITMAP)).astype(np.int64)))
            if len(own):
                own = own[may_match(rare.value, word[own], line[own], size)]
            if len(own):
                line = line[own]
                held.append((word[own], doc[line], place[line], size[line], hits(wanted.value, doc[line], place[line]), np.ones(len(own), bool), runs(words, starts[line], size[line])))
                n += len(held[-1][6])
                if n > FLUSH_WORDS:
                    yield sent(held)
                    held, n = [], 0
        if held:
            yield sent(held)

    def overlaps(key, rows):
        import pandas as pd

        cell, doc, place, size, x, flat = unpacked(rows["blob"], 6)
        starts, out = np.cumsum(size) - size, set()
        by = np.lexsort((size, cell))
        for own in np.split(by, np.flatnonzero(np.diff(cell[by])) + 1):
            asks = own[x[own] > 0]
            if not len(asks) or len(own) < 2:
                continue
            n = size[own].astype(np.int64)
            number = np.unique(runs(flat, starts[own], n), return_inverse=True)[1]
            first, has = np.cumsum(n) - n, np.zeros(int(number.max()) + 1, bool)
            place_in = {int(r): i for i, r in enumerate(own.tolist())}
            for r in asks.tolist():
                if (int(doc[r]), int(place[r])) in out:
                    continue
                i = place_in[r]
                a, b = np.searchsorted(n, [-(-4 * n[i] // 5), 5 * n[i] // 4 + 1])
                mine = number[first[i] : first[i] + n[i]]
                has[mine] = True
                both = np.add.reduceat(has[number[first[a] : first[b - 1] + n[b - 1]]], first[a:b] - first[a], dtype=np.int64)
                has[mine] = False
                if (earlier(doc[own[a:b]], place[own[a:b]], doc[r], place[r]) & (5 * both >= 4 * (n[i] + n[a:b] - both))).any():
                    out.add((int(doc[r]), int(place[r])))
        give_back()
        return pd.DataFrame({"x_doc": pd.Series([d for d, _ in out], dtype="i8"), "x_place": pd.Series([p for _, p in out], dtype="i4")})

    return docs.select("lid", "text").mapInArrow(entries, "b int, blob binary").groupBy("b").applyInPandas(overlaps, "x_doc long, x_place int")


def removals(docs: DataFrame) -> DataFrame:
    """(lid, place) of all lines to remove from (lid, text); lid must be unique and give the order."""
    spark = docs.sparkSession
    table, n_words = counted(docs)
    order, parts = spark.sparkContext.broadcast(table), parts_for(spark, n_words, GROUP_WORDS)
    hot = hot_words(docs, order)
    found = candidates(docs, order, hot, parts)
    line, own = ["x_doc", "x_place"], found.where("y_place >= 0")
    y = F.struct("y_doc", "y_place")
    nearest = own.groupBy(*line).agg(F.min(F.struct("apart", "y_doc", "y_place")).alias("y"), (F.max("more") | (F.min(y) < F.max(y))).alias("more"))
    checked, lines = verified(docs, written(nearest.select(*line, "y.y_doc", "y.y_place", "more"), "nearest"))
    gone = found.where("y_place < 0").select(*line).union(checked.where("ok").select(*line))
    open_lines = checked.where("more and not ok").select(*line)
    if not open_lines.isEmpty():
        asked = lines.join(open_lines.select(F.col("x_doc").alias("d"), F.col("x_place").alias("p")), ["d", "p"])
        gone = gone.union(written(looked_up(docs, order, hot, parts, asked), "again").join(open_lines, line).select(*line))
    return gone.select(F.col("x_doc").alias("lid"), F.col("x_place").alias("place")).distinct()


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the lines to remove; ln_lines and ln_removed, with an underscore more where docs has such columns, count each document's lines."""
    importable(docs.sparkSession)
    n_lines, n_removed, lid, cut, gone = (fresh(docs, name) for name in ("ln_lines", "ln_removed", "ln_lid", "ln_cut", "ln_gone"))
    own, unique = numbered(docs, doc_id, text, lid)
    lines = own.select(F.col(lid).alias("lid"), F.col(text).alias("text"))
    found = removals(lines if unique else lines.dropDuplicates(["lid"])).groupBy(F.col("lid").alias(lid)).agg(F.collect_set("place").alias(gone))
    parts = F.split(F.col(text), "\n", -1)
    # a generator over one array makes the lines of a changed document once, whatever is picked from them
    joined = own.join(found, lid, "left").withColumn(cut, F.explode(F.array(F.when(F.col(gone).isNotNull(), parts))))
    stay = F.array_except(F.sequence(F.lit(0), F.size(cut) - 1), gone)
    kept = F.when(F.col(gone).isNull(), F.col(text)).otherwise(F.array_join(F.transform(stay, lambda i: F.get(F.col(cut), i)), "\n"))
    out = joined.withColumn(n_lines, F.coalesce(F.size(parts), F.lit(0))).withColumn(n_removed, F.coalesce(F.size(gone), F.lit(0))).withColumn(text, kept)
    return out.select(*docs.columns, n_lines, n_removed)
