"""Training examples: conversion, validation, filters, statistics and JSONL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.prompts import choice_reasoning

FIELDS = ("pos", "case", "number", "gender", "person", "tense", "voice")
MIN_CONFIDENCE, MAX_ERRORS = 0.85, 20


def morphology(word: Column) -> Column:
    """The known fields joined by '-', else 'unknown'."""
    joined = F.concat_ws("-", *[word[f] for f in FIELDS])
    return F.when(joined == "", "unknown").otherwise(joined)


def grammar_format(groups: Column, confidence: Column) -> Column:
    """groups (surface, words with FIELDS, lemma, dhatu) in the training format, as JSON; null fields are left out."""
    word = lambda w: F.struct(w["lemma"].alias("lemma"), morphology(w).alias("morphology"), F.when(F.coalesce(w["dhatu"], F.lit("")) != "", F.concat(F.lit("√"), w["dhatu"])).alias("dhatu"))
    return F.to_json(F.struct(F.transform(groups, lambda g: F.struct(g["surface"].alias("surface_form"), F.transform(g["words"], word).alias("base_words"))).alias("sandhi_groups"), confidence.alias("confidence")))


def example(text: Column, output: Column, metadata: Column | None = None) -> Column:
    """A grammar example as JSON; metadata: struct of corpus, chapter, verse and confidence."""
    own = [F.concat(F.lit("Parse: "), text).alias("input"), output.alias("output")]
    return F.to_json(F.struct(*own, *([] if metadata is None else [metadata.alias("metadata")])), {"ignoreNullFields": "false"})


def confidence_of(value: Column) -> Column:
    """A confidence in JSON as a double: a number, or an object with overall; anything else is 0."""
    own = F.coalesce(F.get_json_object(value, "$.overall"), value)
    return F.coalesce(own.try_cast("double"), F.lit(0.0))


def confident(rows: DataFrame, confidence: str, least: float = MIN_CONFIDENCE) -> DataFrame:
    return rows.where(F.col(confidence) >= least)


def validation_errors(output: Column) -> Column:
    """Ordered schema errors of an output in JSON: array of strings, empty where it is valid."""
    data = F.try_parse_json(output)
    field = lambda path, kind: F.try_variant_get(data, path, kind)
    groups = F.from_json(field("$.sandhi_groups", "string"), "array<string>")
    strings = lambda n: F.array().cast("array<string>") if n is None else n
    one = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    has = lambda g, k: F.array_contains(F.json_object_keys(g), k)

    def word_errors(i: Column) -> Column:
        return lambda w, j: F.array_compact(F.array(*[F.when(~has(w, k), one("Group ", i.cast("string"), ", word ", j.cast("string"), f": missing {k}")) for k in ("lemma", "morphology")]))

    def group_errors(g: Column, i: Column) -> Column:
        n = i.cast("string")
        words = F.from_json(F.get_json_object(g, "$.base_words"), "array<string>")
        is_array = F.get_json_object(g, "$.base_words").startswith("[")
        return F.concat(
            F.array_compact(F.array(F.when(~has(g, "surface_form"), one("Group ", n, ": missing surface_form")), F.when(~has(g, "base_words"), one("Group ", n, ": missing base_words")).when(~is_array, one("Group ", n, ": base_words must be an array")))),
            F.when(has(g, "base_words") & is_array, F.flatten(F.transform(words, word_errors(i)))).otherwise(strings(None)),
        )

    present = has(output, "sandhi_groups")
    is_list = F.get_json_object(output, "$.sandhi_groups").startswith("[")
    return (
        F.when(data.isNull(), F.array(F.lit("Invalid JSON")))
        .when(~present, F.array(F.lit("Missing required field: sandhi_groups")))
        .when(~is_list, F.array(F.lit("sandhi_groups must be an array")))
        .otherwise(F.flatten(F.transform(groups, group_errors)))
    )


def validation_summary(rows: DataFrame, errors: Column) -> DataFrame:
    marked = rows.select(errors.alias("e"))
    return marked.agg(F.count_if(F.size("e") == 0).alias("valid"), F.count_if(F.size("e") > 0).alias("invalid"))


def first_errors(rows: DataFrame, line: str, errors: Column, n: int = MAX_ERRORS) -> DataFrame:
    """(line, place, message): the first n errors in order of the lines, a partial top-n a task."""
    listed = rows.select(line, F.posexplode(errors).alias("place", "error"))
    return listed.select(line, "place", F.concat(F.lit("Line "), F.col(line).cast("string"), F.lit(": "), F.col("error")).alias("message")).orderBy(line, "place").limit(n)


def training_stats(rows: DataFrame, confidence: str) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("total"), F.round(F.avg(confidence), 3).alias("average_confidence"))


def morphology_types(words: DataFrame, morphology: str, n: int = 10) -> DataFrame:
    """(pos, n): the n most frequent parts of speech, which are a morphology's part before the first '-'; ties in order of the name."""
    return words.select(F.substring_index(F.coalesce(F.col(morphology), F.lit("unknown")), "-", 1).alias("pos")).groupBy("pos").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "pos").limit(n)


def disambiguation_json(text: Column, parses: Column, selected: Column, context: Column) -> Column:
    """A disambiguation example as JSON; parses: array<struct<interpretation, confidence>>."""
    shown = F.transform(parses, lambda p, i: F.struct(F.coalesce(p["interpretation"], F.concat(F.lit("Parse "), i.cast("string"))).alias("interpretation"), F.coalesce(p["confidence"], F.lit(0.5)).alias("confidence")))
    given = F.struct(text.alias("text"), shown.alias("parses"), F.coalesce(context, F.lit("")).alias("context"))
    chosen = F.coalesce(F.get(parses, selected)["confidence"], F.lit(0.5))
    out = F.struct(selected.alias("selected"), choice_reasoning(F.size(parses), selected).alias("reasoning"), chosen.alias("confidence"))
    return F.to_json(F.struct(given.alias("input"), out.alias("output")))


def disambiguation_examples(parses: DataFrame, n: int | None = None) -> DataFrame:
    """(sentence_id, text, parses array<struct<confidence>>): sentences of two parses or more, with the selected one (the first of the highest confidence; the first where none is above 0)."""
    confidences = F.transform("parses", lambda p: p["confidence"])
    best = F.array_max(confidences)
    picked = parses.where(F.size("parses") >= 2).withColumn("selected", F.when(best > 0, F.array_position(confidences, best).cast("int") - 1).otherwise(0))
    return picked if n is None else picked.orderBy("sentence_id").limit(n)


def write_jsonl(rows: DataFrame, path: str) -> None:
    """A JSON object a line."""
    rows.select(F.to_json(F.struct(*rows.columns))).write.mode("overwrite").text(path)
