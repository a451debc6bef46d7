"""Approximate nearest neighbours by shifted space-filling curves.

Vectors are projected to a few dimensions, and each of CURVES random rotations
and shifts gives them another Hilbert order. Spark range-partitions the vectors
by their keys, a query looks at the window of rows around its place in every
order, and the windows' candidates are merged and reranked by the exact inner
product of the original vectors in double precision.

Inner products become distances by one more coordinate that lifts every vector
to the longest one's length; queries are lifted to 0 there.

The rotation's scale is fitted on at most SAMPLE vectors. Every vector is
indexed. The window's width isn't guessed: at most CALIBRATED queries are
answered by brute force over all rows, and the window is the one that holds the
share TARGET of their true neighbours, and TOP + 1 rows at least, so that no query
finds fewer than TOP. Where vectors have no structure at all,
such as uniform directions in 64 dimensions, this honestly gives wide windows.
The share that the window holds is measured on at most CALIBRATED other queries
(on all queries, where there are no others) and returned with the answers.

Equal vectors are one group that keeps its TOP + 1 smallest ids, as no answer
can need more. An order is cut in blocks about as long as the window reaches,
between LEAST_BLOCK and BLOCK rows, and queries in chunks, so no task holds more
than a block and a chunk; within them a query is compared with the rows of its
window only.

Defined results: vectors that are null, zero, or hold null or non-finite
components take no part, nor do rows without vec_id or of another length than the most frequent
one; repeated rows count once; ties go to the smaller id; fewer candidates give
fewer rows; an empty table gives an empty result; further columns aren't read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import importable, shuffle_parts, written

TOP, CURVES, DIMENSIONS, BITS = 20, 4, 6, 10
SAMPLE, CALIBRATED, TARGET, LEAST_BLOCK, BLOCK, CHUNK, AT_ONCE = 4_000, 128, 0.95, 1_024, 65_536, 4_096, 128


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of integer cells (rows x dimensions, bits each), by the public axes-to-transpose scheme."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


class Curves:
    """The fitted orders: a rotation to few dimensions, a scale by the sample's quantiles and a shift for each."""

    def __init__(self, sample: np.ndarray, longest: float, curves: int = CURVES, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        self.longest, width = longest, sample.shape[1] + 1
        d = min(DIMENSIONS, width)
        lifted = self.lift(sample, False)
        self.turns = [np.linalg.qr(rng.standard_normal((width, d)))[0] for _ in range(curves)]
        self.edges = [np.sort(lifted @ t, axis=0) for t in self.turns]
        self.shifts = [rng.random(d) / 2 for _ in range(curves)]

    def lift(self, x: np.ndarray, query: bool) -> np.ndarray:
        norm = np.sqrt((x * x).sum(1))
        if query:
            return np.concatenate([x * (self.longest / norm)[:, None], np.zeros((len(x), 1))], 1)
        return np.concatenate([x, np.sqrt(np.maximum(0.0, self.longest**2 - norm**2))[:, None]], 1)

    def keys(self, x: np.ndarray, query: bool) -> list[np.ndarray]:
        lifted, out = self.lift(x, query), []
        for turn, edges, shift in zip(self.turns, self.edges, self.shifts, strict=True):
            p = lifted @ turn
            share = np.stack([np.searchsorted(edges[:, j], p[:, j]) / (len(edges) + 1) for j in range(p.shape[1])], 1)
            out.append(hilbert_keys(((share + shift) / 1.5 * (1 << BITS)).astype(np.int64), BITS))
        return out


def best(scores: np.ndarray, tie: np.ndarray, n: int) -> np.ndarray:
    """Positions of the n best in each row, best first, ties to the smaller tie value; exact at the cut."""
    m = scores.shape[1]
    if m > n:
        cut = np.partition(scores, m - n, axis=1)[:, m - n]
    out = np.full((len(scores), n), -1)
    for i, row in enumerate(scores):
        at = np.flatnonzero(row >= cut[i]) if m > n else np.arange(m)
        at = at[np.lexsort((tie[at], -row[at]))][:n]
        out[i, : len(at)] = at
    return out


def groups(embeddings: DataFrame, every: int, vec_id: str, embedding: str) -> DataFrame:
    """Distinct vectors (gid, v, ids: the TOP + 1 smallest, least: the smallest, asked: whether a query is among them)."""
    v = F.col("v")
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = embeddings.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v")).where(v.isNotNull() & F.coalesce(sound, F.lit(False)) & F.col("vec_id").isNotNull())
    length = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    rows = rows.where(F.size("v") == (length["n"] if length else 0)).withColumn("q", F.col("vec_id") % every == 0)
    # the smallest ids of a group are found before the shuffle, so a frequent vector costs TOP + 2 rows a task
    nth = Window.partitionBy("v").orderBy("vec_id")
    few = rows.select("v", "vec_id").distinct().withColumn("nth", F.row_number().over(nth)).where(F.col("nth") <= TOP + 1)
    ids = few.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    asked = rows.groupBy("v").agg(F.max("q").alias("asked"))
    return written(ids.join(asked, "v").select(F.monotonically_increasing_id().alias("gid"), "v", "ids", F.element_at("ids", 1).alias("least"), "asked"), "vectors")


def places(vectors: DataFrame, curves: Curves) -> DataFrame:
    """(curve, place, gid, asked): the vectors that stand before each vector and query in its order and in the curves before."""

    def keyed(batches):
        import pandas as pd

        for rows in batches:
            if len(rows):
                x, gid, asked = np.stack(rows["v"]), rows["gid"].to_numpy(), rows["asked"].to_numpy(bool)
                for query, own in ((False, slice(None)), (True, asked)):
                    if len(gid[own]):
                        for c, key in enumerate(curves.keys(x[own], query)):
                            yield pd.DataFrame({"curve": np.int32(c), "key": key, "gid": gid[own], "asked": query})

    def numbered(batches):
        at = 0
        for rows in batches:
            own = (~rows["asked"].to_numpy(bool)).cumsum()
            yield rows[["curve", "gid", "asked"]].assign(at=at + own - ~rows["asked"].to_numpy(bool))
            at += int(own[-1]) if len(own) else 0

    order = ["curve", "key", "gid", "asked"]
    keys = vectors.select("gid", "v", "asked").mapInPandas(keyed, "curve int, key long, gid long, asked boolean")
    held = keys.repartitionByRange(max(2, shuffle_parts(vectors.sparkSession)), *order).sortWithinPartitions(*order).mapInPandas(numbered, "curve int, gid long, asked boolean, at long")
    held = written(held.withColumn("part", F.spark_partition_id()), "places")
    counts = {r["part"]: r["count"] for r in held.where("not asked").groupBy("part").count().collect()}  # a row per partition
    before, total = [], 0
    for p in range(held.agg(F.max("part")).first()[0] + 1):
        before.append(total)
        total += counts.get(p, 0)
    return held.select("curve", (F.col("at") + F.element_at(F.array(*[F.lit(b).cast("long") for b in before]), F.col("part") + 1)).alias("place"), "gid", "asked")


def truth(vectors: DataFrame, queries, n: int):
    """The n nearest groups of the given queries by brute force over all rows: a pandas frame (q, gid)."""
    q, own = np.stack(queries["v"]), queries["gid"].to_numpy()

    def near(batches):
        import pandas as pd

        for rows in batches:
            if len(rows):
                gid = rows["gid"].to_numpy()
                s = q @ np.stack(rows["v"]).T
                s[own[:, None] == gid[None, :]] = -np.inf
                b = best(s, rows["least"].to_numpy(), n)
                i, j = np.nonzero(b >= 0)
                yield pd.DataFrame({"q": own[i], "gid": gid[b[i, j]], "score": s[i, b[i, j]]})

    found = vectors.mapInPandas(near, "q long, gid long, score double").where("score > double('-inf')")
    nth = Window.partitionBy("q").orderBy(F.desc("score"), "gid")
    return found.withColumn("nth", F.row_number().over(nth)).where(F.col("nth") <= n).select("q", "gid").toPandas()


def window(vectors: DataFrame, placed: DataFrame, target: float) -> tuple[int, float]:
    """Rows on either side of a query that hold the target share of some queries' true neighbours in at least one order, and the share that they hold of other queries'."""
    spark = vectors.sparkSession
    queries = vectors.where("asked").orderBy(F.xxhash64("gid")).limit(2 * CALIBRATED).select("gid", "v").toPandas()
    if not len(queries):
        return 0, 1.0
    true = truth(vectors, queries, TOP)
    if not len(true):
        return 0, 1.0
    pairs = F.broadcast(spark.createDataFrame(true[["q", "gid"]].drop_duplicates()))  # 2 x CALIBRATED x TOP rows
    asked = placed.where("asked").select(F.col("gid").alias("q"), "curve", F.col("place").alias("q_place"))
    near = placed.where("not asked").select("gid", "curve", "place").join(pairs, "gid").join(F.broadcast(asked.join(F.broadcast(spark.createDataFrame(queries[["gid"]].rename(columns={"gid": "q"}))), "q")), ["q", "curve"])
    gap = near.groupBy("q", "gid").agg(F.min(F.abs(F.col("place") - F.col("q_place"))).alias("gap")).toPandas()
    fitted = gap["q"].isin(queries["gid"][:CALIBRATED]).to_numpy()
    gap = gap["gap"].to_numpy()
    reach = max(TOP + 1, int(np.quantile(gap[fitted], target, method="higher")))
    other = gap if fitted.all() else gap[~fitted]
    return reach, float((other <= reach).mean())


def nearest(embeddings: DataFrame, every: int = 20, vec_id: str = "vec_id", embedding: str = "embedding", target: float = TARGET) -> DataFrame:
    """(query_id, rank, vec_id, score, recall_measured) for every row whose id is divisible by ``every``."""
    spark = embeddings.sparkSession
    importable(spark)
    vectors = groups(embeddings, every, vec_id, embedding)
    sample = vectors.orderBy(F.xxhash64("gid")).limit(SAMPLE).select("v").toPandas()["v"]
    schema = "query_id long, rank int, vec_id long, score double, recall_measured double"
    if not len(sample):
        return spark.createDataFrame([], schema)
    longest = vectors.select(F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))).first()[0]
    placed = places(vectors, Curves(np.stack(sample), float(longest)))
    reach, held = window(vectors, placed, target)
    block = min(max(reach, LEAST_BLOCK), BLOCK)
    queries = vectors.where("asked").count()
    per_curve = vectors.count()
    chunks = max(1, -(-queries * min(per_curve, 2 * reach + block) // per_curve // CHUNK))
    start = F.col("curve").cast("long") * per_curve
    rank = F.col("place") - start
    rows = placed.where("not asked").withColumn("block", F.floor(rank / block)).withColumn("at", rank).join(vectors.select("gid", "v", "least"), "gid")
    rows = rows.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))).select("curve", "block", "chunk", "at", "gid", "least", "v")
    first, last = F.floor(F.greatest(rank - reach, F.lit(0)) / block), F.floor(F.least(rank + reach, F.lit(per_curve - 1)) / block)
    asked = placed.where("asked").withColumn("at", rank).withColumn("block", F.explode(F.sequence(first, last))).withColumn("chunk", F.pmod(F.xxhash64("gid"), F.lit(chunks)).cast("int"))
    asked = asked.join(vectors.select("gid", "v"), "gid").select(F.col("curve").alias("q_curve"), F.col("block").alias("q_block"), F.col("chunk").alias("q_chunk"), F.col("at").alias("q_at"), F.col("gid").alias("q"), F.col("v").alias("q_v"))

    def near(left, right):
        import pandas as pd

        out = []
        if len(left) and len(right):
            left, right = left.sort_values("at"), right.sort_values("q_at")
            x, gid, least, at = np.stack(left["v"]), left["gid"].to_numpy(), left["least"].to_numpy(), left["at"].to_numpy()
            q, own, q_at = np.stack(right["q_v"]), right["q"].to_numpy(), right["q_at"].to_numpy()
            for a in range(0, len(q), AT_ONCE):
                mine = q_at[a : a + AT_ONCE]
                # neighbouring queries look at one run of rows, each at its own window of it
                low, high = np.searchsorted(at, mine[0] - reach), np.searchsorted(at, mine[-1] + reach, side="right")
                if low == high:
                    continue
                s = q[a : a + AT_ONCE] @ x[low:high].T
                s[np.abs(at[None, low:high] - mine[:, None]) > reach] = -np.inf
                b = best(s, least[low:high], TOP + 1)
                i, j = np.nonzero((b >= 0) & (np.take_along_axis(s, b, 1) > -np.inf))
                found = b[i, j]
                out.append(pd.DataFrame({"q": own[a + i], "gid": gid[low + found], "least": least[low + found], "score": s[i, found]}))
        return pd.concat(out) if out else pd.DataFrame({"q": np.zeros(0, "i8"), "gid": np.zeros(0, "i8"), "least": np.zeros(0, "i8"), "score": np.zeros(0)})

    found = rows.groupBy("curve", "block", "chunk").cogroup(asked.groupBy("q_curve", "q_block", "q_chunk")).applyInPandas(near, "q long, gid long, least long, score double")
    merged = found.groupBy("q", "gid", "least").agg(F.max("score").alias("score"))
    nth = Window.partitionBy("q").orderBy(F.desc("score"), "least")
    merged = merged.withColumn("nth", F.row_number().over(nth)).where(F.col("nth") <= TOP + 1)
    candidates = merged.join(vectors.select("gid", "ids"), "gid").select("q", "score", F.explode("ids").alias("vec_id"))
    after = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    lists = candidates.withColumn("nth", F.row_number().over(after)).where(F.col("nth") <= TOP + 1).groupBy("q").agg(F.sort_array(F.collect_list(F.struct("nth", "vec_id", "score"))).alias("list"))
    # every query of a group takes the group's list without itself
    members = embeddings.select(F.col(vec_id).cast("long").alias("query_id"), F.col(embedding).cast("array<double>").alias("v")).where(F.col("query_id") % every == 0).distinct()
    answers = members.join(vectors.where("asked").select("v", F.col("gid").alias("q")), "v").join(lists, "q")
    own = F.slice(F.filter("list", lambda x: x["vec_id"] != F.col("query_id")), 1, TOP)
    return answers.select("query_id", F.posexplode(own).alias("i", "x")).select("query_id", (F.col("i") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"), F.lit(held).alias("recall_measured"))
