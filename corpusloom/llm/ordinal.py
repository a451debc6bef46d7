"""Quality classifier: ordinal cumulative-link regression on graded ratings.

One weight per hashed feature is shared by all grades and ordered thresholds
t_1 < t_2 < ... cut the score: P(grade >= k) = sigmoid(score - t_k). The
expected grade is the sum of these tails, and a document is kept where the tail
of the top grade reaches the cut.

Grades of ``documents`` come from ``labels``: 0 low quality, 1 good but toxic,
2 good and clean. Features of a text are its distinct words, their beginnings
and their shapes, each hashed to one of BUCKETS, and how much it repeats itself.
The fit uses at most ``max_labelled`` labelled documents (smallest hash of the
id); features without a significant link to the grade are screened out first.
Scoring covers every document and its whole text.

Defined results: null text counts as empty; a null or unlabelled id is scored
like any other; repeated rows score alike; labels with nulls are left out and of
several labels of one id the lowest grade counts; with fewer than two grades
among the labels there is nothing to learn and every document is kept with tail
1; an empty table gives an empty result; ``classified`` adds columns that start
with ql_ and leaves all others alone.
"""

from __future__ import annotations

import re
import zlib
from operator import eq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import fresh, importable, written
from corpusloom.llm.hashing import give_back

BUCKETS, MAX_LABELLED, CUT = 1 << 18, 12_000, 0.6
SCREEN, MIN_DF, RIDGE, STEPS = 3.0, 5, 1e-4, 400
#: words whose buckets a worker keeps; when full the table starts anew
CACHED_WORDS = 100_000
EDGE = re.compile(r"^\W*(.*?)(\W*)$", re.S)


def bucket(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "surrogatepass")) & (BUCKETS - 1)


def word_buckets(word: str) -> tuple[int, ...]:
    core, tail = EDGE.match(word).groups()
    low = core.lower()
    out = [bucket("w " + low), bucket("s " + tail[:4])]
    if len(low) > 4:
        out += [bucket("p " + low[:4]), bucket("p " + low[:5])]
    if len(core) > 1 and core.isupper():
        out.append(bucket("upper"))
    return tuple(out)


def repetition(words: list[str]) -> int:
    """The bucket of how many words stand right after themselves."""
    again = sum(map(eq, words, words[1:]))
    return bucket(f"r {min(3, 10 * again // max(len(words), 1))}")


class Buckets:
    """The features of texts; only those in keep, if given."""

    def __init__(self, keep: frozenset[int] | None = None) -> None:
        self.keep, self.cache = keep, {}

    def of(self, text: str | None) -> set[int]:
        words = (text or "").split()
        distinct = set(words)
        if len(self.cache) > CACHED_WORDS:
            self.cache.clear()
        cache, keep, out = self.cache, self.keep, set()
        for w in distinct:
            found = cache.get(w)
            if found is None:
                found = word_buckets(w)
                cache[w] = found = found if keep is None else tuple(b for b in found if b in keep)
            if found:
                out.update(found)
        r = repetition(words)
        if keep is None or r in keep:
            out.add(r)
        return out


class Model:
    """weights: bucket to weight; thresholds ascending. Without thresholds: nothing was learnt."""

    def __init__(self, weights: dict[int, float], thresholds: list[float]) -> None:
        self.weights, self.thresholds = weights, thresholds

    def tails(self, features: set[int]) -> list[float]:
        """P(grade >= k) for k = 1, 2, ..."""
        score = sum(self.weights[b] for b in sorted(features))
        return [float(1 / (1 + np.exp(min(700.0, t - score)))) for t in self.thresholds]


def differs(low, high, all_low: int, all_high: int):
    """Whether a feature's share differs between low and top grades by SCREEN standard errors."""
    low, high = np.asarray(low, "f8"), np.asarray(high, "f8")
    share = (low + high) / max(1, all_low + all_high)
    error = np.sqrt(np.maximum(share * (1 - share), 1e-9) * (1 / max(1, all_low) + 1 / max(1, all_high)))
    return (low + high >= MIN_DF) & (np.abs(low / max(1, all_low) - high / max(1, all_high)) > SCREEN * error)


def fit(rows: list[np.ndarray], grades: np.ndarray, chosen: list[int]) -> Model:
    """Cumulative-link regression by full-batch Adam on the chosen buckets; rows hold no others."""
    levels = sorted(set(grades.tolist()))
    if len(levels) < 2:
        return Model({}, [])
    y = np.searchsorted(levels, grades)
    column = np.full(BUCKETS, -1)
    column[chosen] = np.arange(len(chosen))
    doc = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    feature = column[np.concatenate(rows).astype(np.int64)]
    n, k = len(rows), len(levels) - 1
    at_least = np.array([(y >= i + 1).mean() for i in range(k)])
    first = -np.log(at_least / (1 - at_least))
    theta = np.concatenate([np.zeros(len(chosen)), first[:1], np.log(np.maximum(np.diff(first), 1e-2))])
    cuts_of = lambda t: np.cumsum(np.concatenate([t[len(chosen) : len(chosen) + 1], np.exp(t[len(chosen) + 1 :])]))
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    up, down = np.flatnonzero(y > 0), np.flatnonzero(y < k)
    for step in range(1, STEPS + 1):
        w, cuts = theta[: len(chosen)], cuts_of(theta)
        score = np.bincount(doc, weights=w[feature], minlength=n)
        tail = 1 / (1 + np.exp(-np.clip(score[:, None] - cuts[None, :], -35, 35)))
        upper = np.concatenate([np.ones((n, 1)), tail], 1)
        lower = np.concatenate([tail, np.zeros((n, 1))], 1)
        p = np.maximum(upper[np.arange(n), y] - lower[np.arange(n), y], 1e-12)
        slope = tail * (1 - tail)
        # d(-log p)/d(cut_i): the tail that bounds the grade from above counts against, from below for
        by_cut = np.zeros((n, k))
        by_cut[up, y[up] - 1] += slope[up, y[up] - 1] / p[up]
        by_cut[down, y[down]] -= slope[down, y[down]] / p[down]
        by_score = -by_cut.sum(1)
        g_w = np.bincount(feature, weights=by_score[doc], minlength=len(chosen))[: len(chosen)] / n + RIDGE * w
        later = np.cumsum(by_cut.mean(0)[::-1])[::-1]
        g = np.concatenate([g_w, later[:1], later[1:] * np.exp(theta[len(chosen) + 1 :])])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model({int(b): float(x) for b, x in zip(chosen, theta, strict=False)}, cuts_of(theta).tolist())


def graded(labels: DataFrame) -> DataFrame:
    """(doc_id, grade) of the given labels."""
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(2)
    return labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy("doc_id").agg(F.min(grade).alias("grade"))


def learnt(docs: DataFrame, grades: DataFrame, max_labelled: int = MAX_LABELLED) -> Model:
    """A model of at most max_labelled rated documents; only their screened features come to the driver."""
    importable(docs.sparkSession)

    def features(batches):
        import pyarrow as pa

        tool = Buckets()
        for batch in batches:
            sets = [sorted(tool.of(x.as_py())) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(sets, pa.list_(pa.int32()))], names=["doc_id", "grade", "features"])
        give_back()

    some = grades.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)  # a bounded table, so it may be broadcast
    rated = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(some), "doc_id").select("doc_id", "text", "grade")
    rows = written(rated.mapInArrow(features, "doc_id long, grade int, features array<int>").groupBy("doc_id").agg(F.min(F.struct("grade", "features")).alias("r")).select("doc_id", "r.*"), "rated")  # of rows of one id the first by its features
    levels = rows.groupBy("grade").count().toPandas()
    if len(levels) < 2:
        return Model({}, [])
    top = int(levels["grade"].max())
    high = int(levels["count"][levels["grade"] == top].sum())
    low = int(levels["count"].sum()) - high
    counts = rows.select(F.explode("features").alias("b"), (F.col("grade") < top).cast("long").alias("low")).groupBy("b").agg(F.sum("low").alias("low"), F.count("low").alias("n"))
    counts = counts.where(F.col("n") >= MIN_DF).toPandas()  # BUCKETS rows at most
    chosen = sorted(counts["b"][differs(counts["low"], counts["n"] - counts["low"], low, high)].tolist())
    wanted = frozenset(chosen)

    def kept(batches):
        for frame in batches:
            yield frame.assign(features=[[b for b in own.tolist() if b in wanted] for own in frame["features"]])

    sample = rows.mapInPandas(kept, rows.schema).toPandas().sort_values("doc_id")
    return fit([np.asarray(x, "i4") for x in sample["features"]], sample["grade"].to_numpy(), chosen)


def names(docs: DataFrame) -> dict[str, str]:
    """What the columns that classify adds are called beside those of docs: ql_ and their name, with an underscore more where docs has it."""
    return {c: fresh(docs, f"ql_{c}") for c in ("expected", "tail", "keep")}


def classified(docs: DataFrame, model: Model, cut: float = CUT) -> DataFrame:
    """docs with ql_expected (expected grade), ql_tail (of the top grade) and ql_keep."""
    importable(docs.sparkSession)
    from pyspark.sql.functions import pandas_udf

    weights, thresholds = model.weights, model.thresholds

    @pandas_udf("struct<expected double, tail double>")
    def scores(texts):
        import pandas as pd

        own, tool = Model(weights, thresholds), Buckets(frozenset(weights))
        out = [own.tails(tool.of(t)) for t in texts]
        del tool
        give_back()
        return pd.DataFrame({"expected": [sum(t) for t in out], "tail": [t[-1] if t else 1.0 for t in out]}, dtype="float64")

    own, score = names(docs), fresh(docs, "ql_score")
    scored = docs.withColumn(score, scores("text"))
    expected, tail = F.col(score)["expected"], F.col(score)["tail"]
    return scored.withColumns({own["expected"]: expected, own["tail"]: tail, own["keep"]: tail >= cut}).drop(score)


def classify(docs: DataFrame, labels: DataFrame, cut: float = CUT, max_labelled: int = MAX_LABELLED) -> DataFrame:
    return classified(docs, learnt(docs, graded(labels), max_labelled), cut)
