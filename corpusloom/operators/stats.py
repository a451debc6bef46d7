"""Corpus statistics and exports for graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.binding import once


def batch_statistics(rows: DataFrame, words: Column, ok: Column) -> DataFrame:
    """total, successful and failed texts, words and unique words: one scan, each text split once. A text's first word, or its lack of words, stands for the text."""
    each = rows.select(F.coalesce(ok, F.lit(False)).alias("ok"), F.posexplode_outer(words).alias("at", "w"))
    text = F.coalesce(F.col("at"), F.lit(0)) == 0
    return each.agg(F.count_if(text).alias("total"), F.count_if(text & F.col("ok")).alias("successful"), F.count_if(text & ~F.col("ok")).alias("failed"), F.count("w").alias("words"), F.count_distinct("w").alias("unique_words"))


def top(rows: DataFrame, value: Column, n: int, name: str = "word") -> DataFrame:
    """The n most frequent values; ties in order of the value."""
    return rows.select(value.alias(name)).groupBy(name).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), name).limit(n)


def usage_lists(rows: DataFrame, root: str, order: str, usage: Column, to: str = "usages") -> DataFrame:
    """root with its usages in order, joined by commas."""
    lists = rows.groupBy(root).agg(F.sort_array(F.collect_list(F.struct(F.col(order), usage.alias("u")))).alias("l"))
    return lists.select(root, F.array_join(F.transform("l", lambda s: s["u"]), ",").alias(to))


def nodes(verses: DataFrame, key: Column, words: Column) -> DataFrame:
    """(type, id): verse and word nodes, each once."""
    own = verses.select(key.alias("k"), words.alias("w"))
    verse = own.select(F.lit("Verse").alias("type"), F.col("k").alias("id")).distinct()
    return verse.union(own.select(F.explode("w").alias("id")).distinct().select(F.lit("Word").alias("type"), "id"))


def edges(verses: DataFrame, key: Column, words: Column) -> DataFrame:
    """(src, rel, dst): which word appears in which verse, each once."""
    own = verses.select(key.alias("dst"), F.explode(F.array_distinct(words)).alias("src"))
    return own.select("src", F.lit("APPEARS_IN").alias("rel"), "dst").distinct()


def nominative_names(words: DataFrame, case: Column, pos: Column) -> DataFrame:
    """Character names: nominative nouns."""
    return words.where((case == "nominative") & pos.isin("noun", "proper_noun"))


def extracted_words(parses: DataFrame, key: str, groups: str) -> DataFrame:
    """(key, place, lemma, surface, pos, root) of all words of the first parse, in reading order; groups as in tree.FULL."""
    words = parses.select(key, F.posexplode(F.flatten(F.transform(groups, lambda g: g["base_words"]))).alias("place", "w"))
    return words.select(key, "place", F.col("w.lemma").alias("lemma"), F.col("w.surface_form").alias("surface"), F.col("w.morphology.pos").alias("pos"), F.col("w.dhatu.dhatu_iast").alias("root"))


def word_summary(parses: DataFrame, key: str, groups: str) -> DataFrame:
    """(key, words, lemmas, roots, last_surface, verbs) of the first parse of each row that has words: counts over the row's own array, so nothing is shuffled; groups as in tree.FULL."""
    rows = parses.select(key, once(F.flatten(F.transform(groups, lambda g: g["base_words"]))).alias("ws")).where(F.size("ws") > 0)
    n = lambda c: F.size(c).cast("long")
    of = lambda get: F.array_compact(F.transform("ws", get))
    return rows.select(
        key, n("ws").alias("words"), n(F.array_distinct(of(lambda w: w["lemma"]))).alias("lemmas"), n(of(lambda w: w["dhatu"]["dhatu_iast"])).alias("roots"),
        F.element_at("ws", -1)["surface_form"].alias("last_surface"), n(F.filter("ws", lambda w: w["morphology"]["pos"] == "verb")).alias("verbs"),
    )


def confidence_summary(rows: DataFrame, confidence: str, error: str) -> DataFrame:
    """total_texts, successful_analyses, failed_analyses and average_confidence; a text with an error failed."""
    ok = F.col(error).isNull()
    return rows.agg(
        F.count(F.lit(1)).alias("total_texts"), F.count_if(ok).alias("successful_analyses"), F.count_if(~ok).alias("failed_analyses"),
        F.round(F.coalesce(F.avg(F.when(ok, F.col(confidence))), F.lit(0.0)), 6).alias("average_confidence"),
    )


def located(verses: DataFrame, book: str, chapter: str, order: list[str]) -> DataFrame:
    """verses with verse_number, from 1 within each chapter, and location book.chapter.verse."""
    nth = F.row_number().over(Window.partitionBy(book, chapter).orderBy(*order))
    own = verses.withColumn("verse_number", nth)
    return own.withColumn("location", F.concat_ws(".", F.col(book).cast("string"), F.col(chapter).cast("string"), F.col("verse_number").cast("string")))
