"""MinHash near-dedup by fast similarity sketching.

A document is the set of its distinct two-word shingles. Two documents link when
100 * both >= 80 * either.

1. Sketch: COORDINATES bins. In round i every shingle goes to a hashed bin with
   the value i + a hashed fraction, and a bin keeps its smallest value. A bin that
   is filled in one round is not changed by later ones, so the rounds end as soon
   as all bins of a set are filled: after one or two for long texts. From round
   COORDINATES on, round i puts all shingles in bin i - COORDINATES, so every bin
   of every set fills. Each coordinate of two sets is equal with a probability of
   their Jaccard similarity, and the number of equal ones is concentrated as that
   of independent draws is (Dahlgaard, Knudsen and Thorup, 2017).
2. Banding: ROWS coordinates make one key, BANDS keys a document. Documents of
   equal sets are one class with the keys of its first document; classes that
   share a key are candidates. At similarity 0.8, the least that links, a pair
   shares no key with probability (1 - 0.8^5)^48, 5 in 10^9; at 0.85 it is 10^-12.
3. Verification: candidates are compared on their full sets, as in ``ngram_join``
   (prefix trees of each group, contracted from round to round), as far as they
   aren't in one component already. Nothing links by its sketch alone.

Key groups are counted before the shuffle, those that hold many classes are
split off, and no pairs of a group are made.

Shingles are known by 56-bit hashes, classes by 128 bits made of them.

Defined results: null, empty and blank texts have the empty set and link with
nothing; a text of one word is one shingle; rows of equal id and text share a
result; a null id is never the smallest of its component unless all are null; an
empty table gives an empty result; further columns are not read by ``linked``
and pass through ``one_of_each``, whatever their names. Texts are read whole.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import ngram_join
from corpusloom.llm.common import least_of, parts_for, written
from corpusloom.llm.hashing import mixed

WORDS, SHARE = 2, 80
BANDS, ROWS = 48, 5
COORDINATES = BANDS * ROWS
#: bits of a fraction; hashes that are made at once
FRACTION, AT_ONCE = 44, 1 << 20
#: shingles, and classes times bands, of one group of tasks
TASK_SHINGLES = 2_000_000
ROUNDS = mixed(np.arange(1, 2 * COORDINATES + 1, dtype=np.uint64), 23)
STEPS = mixed(np.arange(1, ROWS + 1, dtype=np.uint64), 29) | np.uint64(1)
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def sketches(size: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """[set, coordinate] of sets that stand one after the other; each must have a member."""
    n, t = len(size), COORDINATES
    out = np.full(n * t, EMPTY, np.uint64)
    owner, own, begin, rounds = np.repeat(np.arange(n), size), flat, 0, 1
    while len(own):
        # so many rounds at once: a round that a set no longer needs changes nothing
        rounds = max(1, min(rounds, AT_ONCE // len(own), (t if begin < t else 2 * t) - begin))
        for a in range(0, len(own), AT_ONCE):
            i = np.arange(begin, begin + rounds)
            with np.errstate(over="ignore"):
                h = mixed(own[a : a + AT_ONCE, None] + ROUNDS[i])
            bins = ((h >> np.uint64(32)) * np.uint64(t) >> np.uint64(32)).astype(np.int64) if begin < t else i - t
            value = (h & np.uint64((1 << FRACTION) - 1)) | (i.astype(np.uint64) << np.uint64(FRACTION))
            np.minimum.at(out, (owner[a : a + AT_ONCE, None] * t + bins).ravel(), value.ravel())
        begin += rounds
        rounds *= 2
        open_ = (out.reshape(n, t) == EMPTY).any(1)[owner]
        owner, own = owner[open_], own[open_]
    return out.reshape(n, t)


def band_keys(coordinates: np.ndarray) -> np.ndarray:
    """[set, band]: a hash of each band's coordinates and its number."""
    with np.errstate(over="ignore"):
        sums = (coordinates.reshape(len(coordinates), BANDS, ROWS) * STEPS).sum(2, dtype=np.uint64)
        return mixed(sums + mixed(np.arange(BANDS, dtype=np.uint64), 31))


def sketched(docs: DataFrame) -> DataFrame:
    """(lid, n, k1, k2, keys) of the documents (lid, text) that have words: size and hash of the set, and its band keys."""

    def made(batches):
        import pyarrow as pa

        for ids, size, flat in ngram_join.parsed(batches, words=WORDS):
            has = size > 0
            if not has.any():
                continue
            ids, size = ids[has], size[has]
            starts = np.cumsum(size) - size
            with np.errstate(over="ignore"):
                k1, k2 = (np.add.reduceat(mixed(flat, i), starts).view(np.int64) for i in (1, 2))
            keys = band_keys(sketches(size, flat)).view(np.int64)
            listed = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1) * BANDS, pa.int32()), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(size.astype(np.int64)), pa.array(k1), pa.array(k2), listed], names=["lid", "n", "k1", "k2", "keys"])

    return docs.mapInArrow(made, "lid long, n long, k1 long, k2 long, keys array<long>")


def grouped(own: DataFrame, unique: bool, text: str) -> DataFrame:
    """(lid, n, label) of every document with words; label is equal within a component."""
    rows = own.select("lid", F.col(text).alias("text"))
    rows = rows if unique else rows.dropDuplicates(["lid"])
    made = written(sketched(rows), "sketches")
    classes = written(least_of(made, ["k1", "k2"], "lid", "cid").drop("k1", "k2"), "classes")
    words = written(classes.where("lid = cid").select(F.explode("keys").alias("word"), "cid", "n"), "bands")
    todo = written(least_of(words, ["word"], "cid", "first", alone=False).select("word", "cid", "n"), "candidates")
    total = classes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return ngram_join.joined(rows, classes.select("lid", "cid", "n"), todo, parts_for(own.sparkSession, total, TASK_SHINGLES), words=WORDS, share=SHARE)


def linked(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row per row of docs; kept: the first of its component."""
    found = ngram_join.linked(docs, doc_id, text, by=grouped)
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The first document of every component, and every document without words; columns as they are."""
    return ngram_join.one_of_each(docs, doc_id, text, by=grouped)
