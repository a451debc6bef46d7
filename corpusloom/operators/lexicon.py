"""Root lexicon: lookups, searches, class counts and nested conjugations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: common roots (SLP1, class, voice, meanings); tenses of the conjugation listing
COMMON_ROOTS = [
    ("gam", 1, "parasmaipada", ["to go"]), ("kf", 8, "ubhayapada", ["to do", "to make"]), ("BU", 1, "parasmaipada", ["to be", "to become"]), ("as", 2, "parasmaipada", ["to be"]), ("vac", 2, "parasmaipada", ["to speak"]),
    ("dfS", 1, "parasmaipada", ["to see"]), ("Sru", 5, "parasmaipada", ["to hear"]), ("DA", 3, "ubhayapada", ["to place", "to hold"]), ("dA", 3, "ubhayapada", ["to give"]), ("pA", 1, "parasmaipada", ["to drink", "to protect"]),
]
CLASSES = range(1, 11)
MAX_LISTED = 1000


def common_roots(spark: SparkSession) -> DataFrame:
    """A table of ten rows: small enough to broadcast."""
    return spark.createDataFrame(COMMON_ROOTS, "root string, gana int, pada string, meanings array<string>")


def with_root(words: DataFrame, roots: DataFrame, lemma: str, verb: Column) -> DataFrame:
    """words with root columns where they are verbs of a known root; Spark broadcasts roots by their measured size."""
    return words.join(roots, verb & (F.col(lemma) == F.col("root")), "left")


def exact(rows: DataFrame, columns: list[str], value: str, key: str) -> DataFrame:
    """The row of smallest key where any column equals the value."""
    return rows.where(reduce(lambda a, b: a | b, [F.col(c) == value for c in columns])).orderBy(key).limit(1)


def holds(column: Column, query: str) -> Column:
    """Case-insensitive substring; the query has no wildcards."""
    return F.lower(column).contains(query.lower())


def search(rows: DataFrame, columns: list[str], query: str, rank: str, key: str, n: int) -> DataFrame:
    """Rows where any column holds the query, by descending rank."""
    return rows.where(reduce(lambda a, b: a | b, [holds(F.col(c), query) for c in columns])).orderBy(F.desc(rank), key).limit(n)


def search_by(rows: DataFrame, kind: str, query: str, exact_columns: list[str], meaning: str, all_columns: list[str], rank: str, key: str, n: int) -> DataFrame:
    """dhatu: exact, else by meaning; meaning; all."""
    if kind == "meaning":
        return search(rows, [meaning], query, rank, key, n)
    if kind == "all":
        return search(rows, all_columns, query, rank, key, n)
    if kind != "dhatu":
        raise ValueError(f"unknown search type: {kind}")
    found = exact(rows, exact_columns, query, key)
    other = search(rows, [meaning], query, rank, key, n)
    # the fallback counts only where the exact look-up found nothing
    return found.unionByName(other.join(found.select(F.lit(1).alias("lx_found")).limit(1), how="left_anti", on=F.lit(True)))


def of_class(rows: DataFrame, column: str, gana: int, key: str, n: int = 100) -> DataFrame:
    if gana not in CLASSES:
        raise ValueError(f"class must be from 1 to 10: {gana}")
    return rows.where(F.col(column) == gana).orderBy(key).limit(n)


def class_counts(rows: DataFrame, column: str) -> DataFrame:
    return rows.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def class_overview(rows: DataFrame, column: str) -> DataFrame:
    """(class, n) for classes 1 to 10, zero where there is none, each at most MAX_LISTED as in the listing."""
    every = rows.sparkSession.range(1, 11).select(F.col("id").cast("int").alias("class"))
    counts = class_counts(rows.where(F.col(column).between(1, 10)), column)
    return every.join(counts, F.col("class") == F.col(column), "left").select("class", F.least(F.coalesce("n", F.lit(0)), F.lit(MAX_LISTED)).cast("long").alias("n"))


def conjugations(rows: DataFrame, **equal) -> DataFrame:
    """Optional equality filters, all of them."""
    return reduce(lambda df, kv: df.where(F.col(kv[0]) == kv[1]), [(k, v) for k, v in equal.items() if v is not None], rows)


def nested(parents: DataFrame, children: DataFrame, parent_key: str, child_key: str, order: list[str], fields: list[str], to: str) -> DataFrame:
    """parents with an array of their children's fields in order: one join instead of a query per parent."""
    lists = children.groupBy(child_key).agg(F.sort_array(F.collect_list(F.struct(*order, *[f for f in fields if f not in order]))).alias("lx_list"))
    lists = lists.select(F.col(child_key).alias("lx_key"), F.transform("lx_list", lambda s: F.struct(*[s[f].alias(f) for f in fields])).alias(to))
    return parents.join(lists, F.col(parent_key) == F.col("lx_key"), "left").drop("lx_key")


def flattened(sections: DataFrame) -> DataFrame:
    """Grammar sections (category, entries array<struct>) as one row per entry."""
    return sections.select("category", F.posexplode("entries").alias("n", "entry")).select("category", "n", "entry.*")


def grammar_index(sections: DataFrame) -> DataFrame:
    return sections.agg(F.count(F.lit(1)).alias("categories"), F.coalesce(F.sum(F.size("entries")), F.lit(0)).cast("long").alias("total"))


def sutra_search(sutras: DataFrame, query: str, columns=("text", "meaning", "transliteration")) -> DataFrame:
    """sutras (adhyaya, pada, number, text, meaning, transliteration) that hold the query, with their reference a.p.n."""
    found = sutras.where(reduce(lambda a, b: a | b, [holds(F.col(c), query) for c in columns]))
    return found.withColumn("reference", F.concat_ws(".", "adhyaya", "pada", "number"))


def sutra_section(sutras: DataFrame, adhyaya: int, pada: int) -> DataFrame:
    """The rules of one section in order; an empty table where there is none."""
    return sutras.where((F.col("adhyaya") == adhyaya) & (F.col("pada") == pada)).orderBy("number")


def sutra_overview(sutras: DataFrame) -> DataFrame:
    """One row: chapters, sections and rules that the table holds."""
    return sutras.agg(F.count_distinct("adhyaya").alias("adhyayas"), F.count_distinct("adhyaya", "pada").alias("padas"), F.count(F.lit(1)).alias("total_sutras"))


def category(sections: DataFrame, name: str) -> DataFrame:
    """(n, entry fields) of one category of a grammar table, in order."""
    return flattened(sections.where(F.col("category") == name)).drop("category").orderBy("n")


def named_overview(rows: DataFrame, column: str) -> DataFrame:
    """(class, name, n) of all ten classes, and with class null the total of those listed."""
    from corpusloom.functions.morphology import gana_name

    counts = class_overview(rows, column)
    total = counts.agg(F.lit(None).cast("int").alias("class"), F.lit("total").alias("name"), F.sum("n").alias("n"))
    return counts.select("class", gana_name(F.col("class")).alias("name"), "n").unionByName(total)


def bounded(limit: int, most: int) -> int:
    """A request's limit, from 1 to most."""
    if not 1 <= limit <= most:
        raise ValueError(f"limit must be from 1 to {most}: {limit}")
    return limit


def routed(uri: Column) -> Column:
    """struct of kind and argument of a resource's address; kind 'unknown' where there is none, 'invalid' where its number is no number."""
    rest = F.regexp_extract(uri, "^[a-z]+://(.*)$", 1)
    gana, section = F.regexp_extract(uri, "^dhatu://gana/(.*)$", 1), F.regexp_extract(uri, "^grammar://sutras/([^/]*/[^/]*)$", 1)
    kind = (
        F.when(uri == "dhatu://overview", "root_overview")
        .when(uri.startswith("dhatu://gana/"), F.when(gana.rlike("^[+-]?[0-9]+$"), "class").otherwise("invalid"))
        .when(uri.startswith("dhatu://") & uri.contains("/conjugations"), "conjugations")
        .when(uri.startswith("dhatu://"), "root")
        .when(uri == "grammar://sutras", "sutra_overview")
        .when(section != "", F.when(section.rlike("^[0-9]+/[0-9]+$"), "sutra_section").otherwise("invalid"))
        .when(uri.startswith("grammar://sutras/search"), "sutra_search")
        .when(uri.rlike("^grammar://(sandhi-rules|pratyayas)$"), "index")
        .when(uri.rlike("^grammar://(sandhi-rules/(vowel|consonant|visarga)|pratyayas/(krt|taddhita|tin|sup))$"), "category")
        .otherwise("unknown")
    )
    argument = (
        F.when(kind == "class", gana).when(kind == "conjugations", F.replace(rest, F.lit("/conjugations"), F.lit(""))).when(kind == "sutra_section", section)
        .when(kind == "sutra_search", F.regexp_extract(uri, "\\?q=(.*)$", 1)).when(kind == "category", F.substring_index(rest, "/", -1)).when(kind.isin("root", "index"), rest)
    )
    return F.struct(kind.alias("kind"), argument.alias("argument"))
