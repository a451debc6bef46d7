"""Differences of two parses, position by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.binding import let
from corpusloom.operators.tree import WORD


def kinds(left: Column, right: Column) -> Column:
    """same, lemma, only_left or only_right of two values at one position."""
    return F.when(left.isNull(), "only_right").when(right.isNull(), "only_left").when(left == right, "same").otherwise("lemma")


def parse_diff(left: DataFrame, right: DataFrame, key: str, pos: str, value: str) -> DataFrame:
    """(key, pos, kind): a full outer join by position."""
    a, b = left.select(key, pos, F.col(value).alias("df_left")), right.select(key, pos, F.col(value).alias("df_right"))
    return a.join(b, [key, pos], "full_outer").select(key, pos, kinds(F.col("df_left"), F.col("df_right")).alias("kind"))


def row_diff(left: Column, right: Column) -> Column:
    """The same for two arrays of one row: no join."""
    return F.zip_with(left, right, kinds)


def counts(left: Column, right: Column) -> Column:
    """struct of both sizes and of the positions that differ."""
    return F.struct(F.size(left).alias("left"), F.size(right).alias("right"), F.size(F.filter(row_diff(left, right), lambda k: k != "same")).alias("different"))


def word_kinds(left: Column, right: Column) -> Column:
    """same, lemma, morphology, only_left or only_right of two words as in tree.WORD."""
    other = ~left["lemma"].eqNullSafe(right["lemma"])
    return F.when(left.isNull(), "only_right").when(right.isNull(), "only_left").when(other, "lemma").when(~left["morphology"].eqNullSafe(right["morphology"]), "morphology").otherwise("same")


def changes(left: Column, right: Column) -> Column:
    """What differs between two parses as in tree.FULL, as lines of text: counts of words and groups, then word by word; an empty array for equal ones."""
    words = lambda p: F.coalesce(F.flatten(F.transform(p["sandhi_groups"], lambda g: g["base_words"])), F.array().cast(f"array<{WORD}>"))
    text = lambda *parts: F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in parts])
    # fixed values: the wording
    counted = lambda what, a, b: F.when(a != b, text(f"{what}: ", a.cast("string"), " vs ", b.cast("string")))
    shown = lambda w: F.coalesce(w["scripts"]["devanagari"], w["lemma"], F.lit(""))
    script = lambda w: F.coalesce(w["scripts"]["devanagari"], F.lit("?"))
    pos = lambda w: F.coalesce(w["morphology"]["pos"], F.lit("?"))

    def line(x: Column, i: Column) -> Column:
        a, b, n = x["a"], x["b"], (i + 1).cast("string")
        told = lambda kind: (
            F.when(kind == "lemma", text("Word ", n, ": Different lemma - ", shown(a), " vs ", shown(b))).when(kind == "morphology", text("Word ", n, " (", shown(a), "): Different analysis - ", pos(a), " vs ", pos(b)))
            .when(kind == "only_left", text("Word ", n, ": ", script(a), " (only in left)")).when(kind == "only_right", text("Word ", n, ": ", script(b), " (only in right)"))
        )
        # compared once, not once for each kind
        return let(word_kinds(a, b), told)

    def listed(ws: Column) -> Column:
        pairs = F.transform(F.arrays_zip(ws["l"].alias("a"), ws["r"].alias("b")), lambda x: x)
        head = F.array(counted("Word count differs", F.size(ws["l"]), F.size(ws["r"])), counted("Sandhi groups differ", F.size(left["sandhi_groups"]), F.size(right["sandhi_groups"])))
        return F.array_compact(F.concat(head, F.transform(pairs, line)))

    return let(F.struct(words(left).alias("l"), words(right).alias("r")), listed)
