"""Filter interaction audit: what every order of five filters removes, from one packed bitmap index.

1. A task reads whole texts and keeps, of each row, its id, part, the digest of
   its text and which of the filters A to D it fails.
2. E: the smallest id of each text is aggregated before the shuffle and found
   again for its rows by ``least_of``, which splits large groups of copies off.
3. Index: a batch's rows are laid out by part, each part in 64-bit words of its
   own. One NumPy bitset per filter and label has a bit per row. For each set of
   filters that can stand before a step, AND-NOT leaves the bits of the rows that
   pass all of these, and popcount, summed over a part's words, counts them, for
   all rows and for those with either label. These counts are summed over tasks.
4. All figures of all orders follow from the 32 counts of a part: removed by a
   filter after a set is the difference of two counts, and so on.

Defined results: a null text is an empty one, a null part (lang) is the empty
string, and every part has a row for each order and step. A null id counts as
larger than all others: it fails E if a row with an id has its text. Rows of one
id and text all stay in E, being identical to no smaller id's text. A label
counts if any row of labels for the id has it, so repeated labels change nothing;
a row without label or id has none. An empty table gives no rows. Other columns
aren't read. Equality of words within a text is decided on 64-bit hashes, of
texts on SHA-256.
"""

from __future__ import annotations

from itertools import combinations, permutations
from math import factorial

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import importable, least_of, written
from corpusloom.llm.hashing import buffers, hashed_words

FILTERS = "ABCDE"
ALL = (1 << len(FILTERS)) - 1
#: least words; least distinct words and most capitals, in a hundred; marks that no text may hold
MIN_WORDS, DISTINCT, CAPITALS, MARKS = 200, 50, 3, b"#$%&*|"
MARKED = np.zeros(256, bool)
MARKED[list(MARKS)] = True
#: parts whose counts a task holds before it sends them on
PARTS_HELD = 4_096


def failed(buf: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Bits 0 to 3 of each text of a buffer (see hashing.buffers): it fails A to D."""
    starts = np.concatenate([[0], ends[:-1]])
    sums = lambda marks: np.add.reduceat(marks, starts, dtype=np.int64)
    first, word = hashed_words(buf)
    n = np.diff(np.searchsorted(first, ends), prepend=0)
    by = np.lexsort((word, text := np.repeat(np.arange(len(ends)), n)))
    new = np.ones(len(by), bool)
    new[1:] = (word[by][1:] != word[by][:-1]) | (text[1:] != text[:-1])
    distinct = np.bincount(text[new], minlength=len(ends))
    points = sums((buf & 0xC0) != 0x80) - 1  # without the line end that follows each text
    tests = (n < MIN_WORDS, 100 * distinct < DISTINCT * n, 100 * sums((buf >= 65) & (buf <= 90)) > CAPITALS * points, sums(MARKED[buf]) > 0)
    return sum(t.astype(np.int32) << i for i, t in enumerate(tests))


def examined(docs: DataFrame, text: str, doc_id: str, part: str) -> DataFrame:
    """(doc_id, part, digest, fails) of every row: texts are read once and go no further."""

    def rows(batches):
        import hashlib

        import pyarrow as pa

        for keys, buf, ends in buffers(batches, bytes):
            data, starts = memoryview(buf), [0, *ends[:-1].tolist()]
            digests = [hashlib.sha256(data[a : b - 1]).digest() for a, b in zip(starts, ends.tolist(), strict=True)]
            own = pa.array([k["id"] for k in keys], pa.int64()), pa.array([k["part"] for k in keys], pa.string())
            yield pa.RecordBatch.from_arrays([*own, pa.array(digests, pa.binary()), pa.array(failed(buf, ends))], names=["doc_id", "part", "digest", "fails"])

    key = F.struct(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(part), F.lit("")).alias("part"))
    return docs.select(key.alias("key"), F.col(text).alias("text")).mapInArrow(rows, "doc_id long, part string, digest binary, fails int")


class Index:
    """Bitsets of one batch: rows by part, each part from a word of its own on."""

    def __init__(self, part: np.ndarray, bits: list[np.ndarray]) -> None:
        """part: a small number per row; bits: for each filter and label, which rows have it."""
        size = np.bincount(part)
        self.words = -(-size // 64)
        self.starts = np.cumsum(self.words) - self.words
        order = np.argsort(part, kind="stable")
        within = np.arange(len(part)) - np.repeat(np.cumsum(size) - size, size)
        self.place = np.empty(len(part), np.int64)
        self.place[order] = np.repeat(64 * self.starts, size) + within
        self.there = self.packed(np.ones(len(part), bool))
        self.bits = [self.packed(b) for b in bits]

    def packed(self, mark: np.ndarray) -> np.ndarray:
        spots = np.zeros(64 * int(self.words.sum()), bool)
        spots[self.place] = mark
        return np.packbits(spots, bitorder="little").view("<u8")

    def counts(self) -> np.ndarray:
        """Rows that pass all filters of each set: [part, set, all or label]."""
        out = np.zeros((len(self.words), ALL + 1, len(self.bits) - len(FILTERS) + 1), np.int64)
        for k in range(ALL + 1):
            left = self.there
            for i in range(len(FILTERS)):
                if k >> i & 1:
                    left = left & ~self.bits[i]
            for j, label in enumerate((self.there, *self.bits[len(FILTERS) :])):
                out[:, k, j] = np.add.reduceat(np.bitwise_count(left & label), self.starts, dtype=np.int64)
        return out


def indexed(rows: DataFrame) -> DataFrame:
    """(part, before, kept, good, toxic) of (part, fails, good, toxic): a task's counts for each set of filters."""

    def count(batches):
        import pyarrow as pa

        held: dict[str, np.ndarray] = {}

        def sent():
            parts = list(held)
            table = np.concatenate([held[p] for p in parts])
            columns = [pa.array(np.repeat(np.array(parts, object), ALL + 1), pa.string()), pa.array(np.tile(np.arange(ALL + 1, dtype=np.int32), len(parts))), *[pa.array(table[:, j]) for j in range(3)]]
            return pa.RecordBatch.from_arrays(columns, names=["part", "before", "kept", "good", "toxic"])

        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column(0).dictionary_encode()
            fails, good, toxic = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(1, 4))
            index = Index(part.indices.to_numpy(), [*[(fails >> i & 1).astype(bool) for i in range(len(FILTERS))], good.astype(bool), toxic.astype(bool)])
            for name, own in zip(part.dictionary.to_pylist(), index.counts(), strict=True):
                held[name] = held[name] + own if name in held else own
            if len(held) > PARTS_HELD:
                yield sent()
                held = {}
        if held:
            yield sent()

    return rows.select("part", "fails", "good", "toxic").mapInArrow(count, "part string, before int, kept long, good long, toxic long")


def report(counts: DataFrame) -> DataFrame:
    """A row per part, order and step from (part, before, kept, good, toxic)."""
    sums = counts.groupBy("part", "before").agg(*[F.sum(c).alias(c) for c in ("kept", "good", "toxic")])
    sets = sums.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("before", "kept", "good", "toxic"))).alias("sets"))
    steps = []
    for order in permutations(range(len(FILTERS))):
        before = 0
        for step, i in enumerate(order, 1):
            steps.append(("".join(FILTERS[j] for j in order), step, i, before))
            before |= 1 << i
    listed = F.from_json(F.lit("[" + ",".join(f'{{"filter_order":"{o}","step":{s},"i":{i},"before":{b}}}' for o, s, i, b in steps) + "]"), "array<struct<filter_order:string,step:int,i:int,before:int>>")
    rows = sets.select("part", "sets", F.array(*[_shapley(i) for i in range(len(FILTERS))]).alias("shapley"), F.explode(listed).alias("o"))
    bit = F.element_at(F.array(*[F.lit(1 << i) for i in range(len(FILTERS))]), F.col("o.i") + 1)
    at = lambda k, c: F.get("sets", k)[c]
    before, after = F.col("o.before"), F.col("o.before").bitwiseOR(bit)
    lost = lambda c: at(before, c) - at(after, c)
    fails = at(F.lit(0), "kept") - at(bit, "kept")
    return rows.select(
        "part", "o.filter_order", "o.step", at(after, "kept").alias("kept"), lost("kept").alias("removed"), (fails - lost("kept")).alias("redundant"),
        (at(F.lit(ALL) - bit, "kept") - at(F.lit(ALL), "kept")).alias("unique_fails"), lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"), F.get("shapley", F.col("o.i")).alias("shapley"),
    )


def _shapley(i: int) -> Column:
    """What filter i removes, summed over all orders: each set of others stands before it in (its size)! times (the rest)! of them."""
    others, terms = [j for j in range(len(FILTERS)) if j != i], []
    for size in range(len(FILTERS)):
        for chosen in combinations(others, size):
            before = sum(1 << j for j in chosen)
            terms.append((F.get("sets", F.lit(before))["kept"] - F.get("sets", F.lit(before | 1 << i))["kept"]) * F.lit(factorial(size) * factorial(len(others) - size)))
    return sum(terms[1:], terms[0])


def audit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)."""
    importable(docs.sparkSession)
    rows = written(examined(docs, text, doc_id, part), "examined")
    rows = least_of(rows, ["digest"], "doc_id", "least")
    copy = F.coalesce(F.col("doc_id") > F.col("least"), F.col("least").isNotNull())
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("lb_id")).agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    rows = rows.select("doc_id", "part", (F.col("fails") + copy.cast("int") * 16).alias("fails"))
    rows = rows.join(marks, F.col("doc_id") == F.col("lb_id"), "left").select("part", "fails", *[F.coalesce(c, F.lit(False)).cast("int").alias(c) for c in ("good", "toxic")])
    return report(indexed(rows))
