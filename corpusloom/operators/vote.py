"""Ensemble vote: segments of several engines merged position by position.

Row-local: every engine's segments are an array in the sentence's row, so the
vote is array functions without a shuffle. ``merge_segments`` takes the same
engines as an exploded table. Weights and confidences are whole hundredths and
thresholds are compared on integers, so no result hangs on rounding.

Semantics: the engine with most segments is primary (the first one wins ties);
each engine votes at the positions it has; the most frequent lemma wins, the
first engine's on a tie; confidence is the weighted mean.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.binding import let, once
from corpusloom.operators.producers import DEFAULT, Producer, tokens

HIGH, MEDIUM = 95, 70
#: agreement is counted in these parts: whole numbers for up to twelve engines
PARTS, MOST_ENGINES = 27_720, 12


#: up to so many engines are compared one by one, without arrays of them
UNROLLED = 4
KNOWN = {"vidyut": 0.35, "dharmamitra": 0.40, "heritage": 0.25}
MERGED = "array<struct<pos:int,surface:string,lemma:string,conf7:bigint,agree:bigint>>"


def merged(words: Column, producers: tuple[Producer, ...] = DEFAULT) -> Column:
    """array of struct(pos, surface, lemma, conf7 (confidence x 1e7), agree (agreement x PARTS))."""
    if len(producers) > MOST_ENGINES:
        raise ValueError(f"agreement is exact for up to {MOST_ENGINES} engines")
    voted = unrolled if len(producers) <= UNROLLED else gathered
    return F.coalesce(let(words, lambda w: voted(w, producers)), F.array().cast(MERGED))


def conf7_of(num: Column, den: Column) -> Column:
    return F.round(num * F.lit(1e5) / den).cast("long")


def unrolled(words: Column, producers: tuple[Producer, ...]) -> Column:
    """The vote of a few engines: functions of arrays evaluate a node for each of their elements, so a position has as few nodes as the engines allow. Which engines have it decides its confidence, a constant."""

    def confidence(i: Column, sizes: list[Column], at: int = 0, num: int = 0, den: int = 0) -> Column:
        if at == len(producers):
            return conf7_of(F.lit(num), F.lit(den)) if den else F.lit(None).cast("long")
        p = producers[at]
        return F.when(i < sizes[at], confidence(i, sizes, at + 1, num + p.weight * p.confidence, den + p.weight)).otherwise(confidence(i, sizes, at + 1, num, den))

    def decided(s: Column, i: Column, lists: list[Column]) -> Column:
        def of(e: Column) -> Column:
            xs = [e[f"x{k}"] for k in range(len(lists))]
            same = lambda k: sum((F.when(xs[k] == x, 1).otherwise(0) for j, x in enumerate(xs) if j != k), F.lit(1))
            counts = F.struct(*[F.when(x.isNull(), 0).otherwise(same(k)).alias(f"c{k}") for k, x in enumerate(xs)])
            n = sum((F.when(x.isNull(), 0).otherwise(1) for x in xs), F.lit(0))

            def told(lemma: Column, top: Column) -> Column:
                return F.struct(
                    i.alias("pos"), s.alias("surface"), lemma.alias("lemma"), confidence(i, [F.size(x) for x in lists]).alias("conf7"),
                    F.when(top == 0, F.lit(0)).otherwise(F.floor(F.lit(PARTS) * top / n)).cast("long").alias("agree"),
                )

            def won(c: Column) -> Column:
                own = [c[f"c{k}"] for k in range(len(xs))]
                top = F.greatest(*own) if len(own) > 1 else own[0]
                lemma = s
                for k in reversed(range(len(xs))):
                    lemma = F.when((own[k] > 0) & (own[k] == top), xs[k]).otherwise(lemma)
                return told(lemma, top)

            # most words: more than half of the engines say what the first one says
            return F.when(xs[0].isNotNull() & (same(0) * 2 > len(xs)), told(xs[0], same(0))).otherwise(let(counts, won))

        there = lambda x: F.when(F.get(x, i) != "", F.get(x, i))
        return let(F.struct(*[there(x).alias(f"x{k}") for k, x in enumerate(lists)]), of)

    def bound(lists: list[Column]) -> Column:
        if len(lists) < len(producers):
            return let(producers[len(lists)].lemmas(words), lambda x: bound([*lists, x]))
        sizes = [F.coalesce(F.size(x), F.lit(-1)) for x in lists]
        longest = F.greatest(*sizes) if len(sizes) > 1 else sizes[0]
        primary = F.get(F.array(*lists), F.array_position(F.array(*sizes), longest).cast("int") - 1)
        return F.transform(primary, lambda s, i: decided(s, i, lists))

    return bound([])


def gathered(words: Column, producers: tuple[Producer, ...]) -> Column:
    """The vote of any engines, gathered in an array at each position."""
    engines = F.array(*[F.struct(F.lit(p.weight).alias("wt"), F.lit(p.confidence).alias("cf"), p.lemmas(words).alias("l")) for p in producers])

    def primary(e: Column) -> Column:
        return let(F.transform(e, lambda x: F.size(x["l"])), lambda sizes: F.get(e, F.array_position(sizes, F.array_max(sizes)).cast("int") - 1)["l"])

    def here(e: Column) -> Callable[[Column, Column], Column]:
        def at(s: Column, i: Column) -> Column:
            return let(
                F.filter(e, lambda x: i < F.size(x["l"])),
                lambda own: F.struct(
                    i.alias("pos"), s.alias("surface"), F.filter(F.transform(own, lambda x: F.get(x["l"], i)), lambda x: x.isNotNull() & (x != "")).alias("ls"),
                    F.aggregate(own, F.lit(0), lambda a, x: a + x["wt"] * x["cf"]).alias("num"), F.aggregate(own, F.lit(0), lambda a, x: a + x["wt"]).alias("den"),
                ),
            )

        return at

    def decided(p: Column) -> Column:
        n = F.size(p["ls"])
        return let(
            F.transform(p["ls"], lambda x: F.size(F.filter(p["ls"], lambda y: y == x))),
            lambda counts: F.struct(
                p["pos"].alias("pos"), p["surface"].alias("surface"),
                F.when(n > 0, F.get(p["ls"], F.array_position(counts, F.array_max(counts)).cast("int") - 1)).otherwise(p["surface"]).alias("lemma"),
                conf7_of(p["num"], p["den"]).alias("conf7"),
                F.when(n == 0, F.lit(0)).otherwise(F.floor(F.lit(PARTS) * F.array_max(counts) / n)).cast("long").alias("agree"),
            ),
        )

    return let(engines, lambda e: let(primary(e), lambda p: F.transform(F.transform(p, here(e)), decided)))


def level(agree: Column, n: Column) -> Column:
    """high, medium or low by the mean agreement; nothing to agree on is low."""
    return F.when(n == 0, "low").when(agree * 100 >= HIGH * PARTS * n, "high").when(agree * 100 >= MEDIUM * PARTS * n, "medium").otherwise("low")


def sentences(docs: DataFrame, producers: tuple[Producer, ...] = DEFAULT, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """key, the columns to keep, segments: the merged segments of every text, computed once whatever reads them."""
    return docs.select(key, *keep, once(merged(tokens(F.coalesce(F.col(text), F.lit(""))), producers)).alias("segments"))


def overall(agree: Column, conf7: Column, n: Column) -> Column:
    """The mean confidence, at most 0.95 on high and 0.85 on medium agreement."""
    mean = F.when(n > 0, conf7 / n / F.lit(1e7)).otherwise(F.lit(0.0))
    lev = level(agree, n)
    return F.when(lev == "high", F.least(F.lit(0.95), mean)).when(lev == "medium", F.least(F.lit(0.85), mean)).otherwise(mean)


def summary(voted: DataFrame, key: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """key, the columns to keep, n_segments, engine_agreement, agreement_level, overall_confidence."""
    sums = voted.select(
        key, *keep, F.size("segments").cast("long").alias("n"),
        F.aggregate("segments", F.lit(0).cast("long"), lambda a, s: a + s["agree"]).alias("a"),
        F.aggregate("segments", F.lit(0).cast("long"), lambda a, s: a + s["conf7"]).alias("c7"),
    )
    n, a = F.col("n"), F.col("a")
    agreement = F.when(n > 0, a / (F.lit(float(PARTS)) * n)).otherwise(F.lit(0.0))
    return sums.select(key, *keep, n.alias("n_segments"), F.round(agreement, 6).alias("engine_agreement"), level(a, n).alias("agreement_level"), F.round(overall(a, F.col("c7"), n), 6).alias("overall_confidence"))


def engine_votes(docs: DataFrame, producers: tuple[Producer, ...] = DEFAULT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, votes: engine to confidence of the engines that found something, as text in engine order."""
    words = tokens(F.coalesce(F.col(text), F.lit("")))
    parts = [F.when(F.size(p.lemmas(words)) > 0, F.concat(F.lit(f"{p.name}="), F.format_string("%.2f", F.lit(p.confidence / 100)))) for p in producers]
    return docs.select(key, F.concat_ws(",", *parts).alias("votes"))


def merge_segments(segments: DataFrame, weights: dict[str, float] | None = None, unknown: float = 0.33) -> DataFrame:
    """The vote over a table (sentence_id, engine, engine_rank, pos, surface, lemma, morphology, pos_tag, confidence, meanings).

    Rows are dealt by sentence once, and what follows groups by more than that. Empty strings count as missing."""
    known = weights or KNOWN
    weight = F.coalesce(F.create_map(*[F.lit(x) for kv in known.items() for x in kv])[F.col("engine")], F.lit(unknown))
    blank = lambda c: F.when(F.col(c) != "", F.col(c))
    rows = segments.repartition("sentence_id").withColumn("wt", weight).withColumn("lemma", blank("lemma")).withColumn("morphology", blank("morphology")).withColumn("pos_tag", blank("pos_tag"))
    sized = rows.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("sentence_id", "engine")))
    first = Window.partitionBy("sentence_id").orderBy(F.desc("n"), "engine_rank", "pos")
    primary = F.first("engine").over(first)
    here = sized.withColumn("primary", primary)
    length = F.max(F.when(F.col("engine") == F.col("primary"), F.col("n"))).over(Window.partitionBy("sentence_id"))
    here = here.withColumn("length", length).where(F.col("pos") < F.col("length"))
    order = lambda c: F.sort_array(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("engine_rank", F.col(c).alias("x")))))
    grouped = here.groupBy("sentence_id", "pos").agg(
        F.max(F.when(F.col("engine") == F.col("primary"), F.col("surface"))).alias("surface"),
        F.max(F.when(F.col("engine") == F.col("primary"), F.coalesce("lemma", "surface"))).alias("own"),
        order("lemma").alias("lemmas"), order("morphology").alias("morphs"), order("pos_tag").alias("tags"),
        (F.sum(F.col("confidence") * F.col("wt")) / F.sum("wt")).alias("confidence"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("engine", (F.col("confidence") * F.col("wt")).alias("v"))))).alias("engine_votes"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("meanings", F.array().cast("array<string>")))))).alias("meanings"),
    )
    names = F.transform("lemmas", lambda s: s["x"])
    counts = F.transform(names, lambda x: F.size(F.filter(names, lambda y: y == x)))
    lemma = F.when(F.size("lemmas") > 0, F.get(names, F.array_position(counts, F.array_max(counts)).cast("int") - 1)).otherwise(F.col("own"))
    agreement = F.when(F.size("lemmas") > 0, F.array_max(counts) / F.size("lemmas")).otherwise(F.lit(0.0))
    return grouped.select("sentence_id", "pos", "surface", lemma.alias("lemma"), F.get("morphs", F.lit(0))["x"].alias("morphology"), F.get("tags", F.lit(0))["x"].alias("pos_tag"), "confidence", agreement.alias("agreement"), "engine_votes", "meanings")


def merge_answers(answers: Column, weights: dict[str, float] | None = None, unknown: float = 0.33) -> Column:
    """The vote of ``merge_segments`` in the row that holds all answers to a text (producers.run_outside, together): array of struct(pos, surface, lemma, confidence, agreement), without an exchange. A segment's place is its position."""
    known = weights or KNOWN
    weight = lambda e: F.coalesce(F.create_map(*[F.lit(x) for kv in known.items() for x in kv])[e], F.lit(unknown))
    blank = lambda c: F.when(c != "", c)
    own = F.filter(answers, lambda x: x["success"] & (F.size(x["segments"]) > 0))
    engines = F.transform(own, lambda x: F.struct(weight(x["engine"]).alias("wt"), x["segments"].alias("l")))

    def decided(s: Column, i: Column, here: Column, lemmas: Column, counts: Column) -> Column:
        n, top = F.size(lemmas), F.array_max(counts)
        total = lambda of: F.aggregate(here, F.lit(0.0), lambda a, x: a + of(x))
        confidence = total(lambda x: F.coalesce(F.get(x["l"], i)["confidence"], F.lit(0.0)) * x["wt"]) / total(lambda x: x["wt"])
        lemma = F.when(n > 0, F.get(lemmas, F.array_position(counts, top).cast("int") - 1)).otherwise(F.coalesce(blank(s["lemma"]), s["surface"]))
        return F.struct(i.alias("pos"), s["surface"].alias("surface"), lemma.alias("lemma"), confidence.alias("confidence"), F.when(n > 0, top / n).otherwise(F.lit(0.0)).alias("agreement"))

    def at(e: Column) -> Callable[[Column, Column], Column]:
        lemmas = lambda here, i: F.filter(F.transform(here, lambda x: blank(F.get(x["l"], i)["lemma"])), lambda x: x.isNotNull())
        counts = lambda ls: F.transform(ls, lambda x: F.size(F.filter(ls, lambda y: y == x)))
        return lambda s, i: let(F.filter(e, lambda x: i < F.size(x["l"])), lambda here: let(lemmas(here, i), lambda ls: let(counts(ls), lambda c: decided(s, i, here, ls, c))))

    first = lambda e: let(F.transform(e, lambda x: F.size(x["l"])), lambda sizes: F.get(e, F.array_position(sizes, F.array_max(sizes)).cast("int") - 1)["l"])
    return let(engines, lambda e: F.coalesce(F.transform(first(e), at(e)), F.array().cast("array<struct<pos:int,surface:string,lemma:string,confidence:double,agreement:double>>")))
