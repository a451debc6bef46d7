"""Mixing sources to target weights.

Tokens are summed per source, a repetition rate follows for each source, and
every document is emitted floor(rate) times plus one hash-seeded Bernoulli copy
whose probability is the fraction of the rate.

Targets are a capped proportional split of ``share`` x all tokens. A source that
would exceed ``cap`` x its own size stops there and its excess is dealt again by
weight; the fixed point has a closed form over the sources sorted by cap/weight,
so no loop and no driver state is needed. Only the table of sources, one row
each, goes through a single sorted window, in one task: some millions of sources
are fine, a source per document is not what this is for.

Defined results: null or empty text has size 0 and is taken 0 words; a null
source is a source of its own, sorted last; repeated rows are decided alike
(equal id, equal decision); an empty table gives an empty result; further
columns pass through ``mix`` untouched, whatever their names: its own begin with
``mix_`` and get an underscore more where the input has them (``names``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import WORD, fresh

#: The table of sources may be broadcast up to this many rows (well under 1 MB).
MAX_BROADCAST_SOURCES = 10_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(doc_id: Column, seed: int) -> Column:
    """A number in [0, 1) from 52 bits of md5(seed:doc_id); the same in every run."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(2.0**52)


def source_targets(sizes: DataFrame, weights: list[int], share: float, cap: float) -> DataFrame:
    """sizes: (mix_source, mix_source_size), a row per source. Adds mix_target."""
    every = Window.orderBy(F.col("mix_source").asc_nulls_last())
    ratio = Window.orderBy("mix_ratio", F.col("mix_source").asc_nulls_last())
    upto = ratio.rowsBetween(Window.unboundedPreceding, -1)
    from_here = ratio.rowsBetween(0, Window.unboundedFollowing)
    all_rows = Window.partitionBy()
    nth = (F.row_number().over(every) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), nth + 1)
    level = (F.col("mix_total") - F.coalesce(F.sum("mix_cap").over(upto), F.lit(0.0))) / F.sum("mix_weight").over(from_here)
    ranked = (
        sizes.withColumn("mix_weight", weight)
        .withColumn("mix_cap", F.lit(cap) * F.col("mix_source_size"))
        .withColumn("mix_ratio", F.col("mix_cap") / F.col("mix_weight"))
        .withColumn("mix_total", F.lit(share) * F.sum("mix_source_size").over(all_rows))
        .withColumn("mix_level", level)
        # the sources below the water level are full; the first one that isn't sets the level
        .withColumn("mix_water", F.max(F.when(F.col("mix_level") <= F.col("mix_ratio"), F.col("mix_level"))).over(all_rows))
    )
    full = F.col("mix_water").isNull() | (F.col("mix_ratio") <= F.col("mix_water"))
    target = F.when(full, F.col("mix_cap")).otherwise(F.col("mix_water") * F.col("mix_weight"))
    return ranked.select("mix_source", "mix_source_size", target.alias("mix_target"))


def names(docs: DataFrame) -> dict[str, str]:
    """What the columns that mix adds are called beside those of docs."""
    return {c: fresh(docs, f"mix_{c}") for c in ("size", "source_size", "target", "rate", "copies")}


def mix(docs: DataFrame, weights: list[int] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 17, source: str = "source", text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs with mix_size, mix_source_size, mix_target, mix_rate and mix_copies."""
    own = names(docs)
    size, whole, target, rate = (F.col(own[c]) for c in ("size", "source_size", "target", "rate"))
    sized = docs.withColumn(own["size"], n_words(F.col(text)))
    sizes = sized.groupBy(F.col(source).alias("mix_source")).agg(F.sum(size).alias("mix_source_size"))
    key = fresh(docs, "mix_key")
    targets = source_targets(sizes, list(weights), share, cap).select(F.col("mix_source").alias(key), F.col("mix_source_size").alias(own["source_size"]), F.col("mix_target").alias(own["target"]))
    # one small row per source: counted, so that only a small table is broadcast
    few = docs.select(source).groupBy(source).agg(F.lit(1)).limit(MAX_BROADCAST_SOURCES + 1).count() <= MAX_BROADCAST_SOURCES
    joined = sized.join(F.broadcast(targets) if few else targets, F.col(source).eqNullSafe(F.col(key)))
    share_of = F.when(whole > 0, target / whole).otherwise(F.lit(0.0))
    # a rate within rounding of its cap is its cap
    share_of = F.when(F.abs(share_of - cap) < 1e-9, F.lit(cap)).otherwise(share_of)
    extra = (draw(F.col(doc_id), seed) < rate - F.floor(rate)).cast("long")
    return joined.withColumn(own["rate"], share_of).withColumn(own["copies"], F.floor(rate) + extra).drop(key)


def repeated(mixed: DataFrame, copies: str = "mix_copies") -> DataFrame:
    """Every document as often as the mix takes it."""
    return mixed.where(F.col(copies) > 0).withColumn(fresh(mixed, "mix_copy"), F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies))))
