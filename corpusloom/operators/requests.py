"""A table of requests answered in one job.

requests: (request_id, uri). Each address is parsed in its row; requests of one
kind are one branch, a join of what they ask for with the table that has it. A
listing is made once for each thing that is asked for, at most so many entries,
aggregated before the shuffle, and then joined to its requests, so a frequent
request costs a row and a table of millions of roots is scanned once however
many requests there are. A request that can't be answered gets an error, and no
request is lost: rows of equal id and address are answered each.

answers: (request_id, kind, status, count, body): body is JSON, without nulls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.binding import once
from corpusloom.functions.morphology import GANAS
from corpusloom.operators.lexicon import CLASSES, MAX_LISTED, routed

#: fixed values: entries of a listing; texts of errors
LISTED = 100
GANA_RANGE, GANA_BAD, NOT_FOUND, UNKNOWN = "Gana must be between 1 and 10", "Invalid gana number: ", "Dhatu not found: ", "Unknown resource: "
#: fixed values: the columns that an entry shows
ENTRY = ("id", "dhatu_devanagari", "dhatu_iast", "meaning_english", "meaning_hindi", "gana", "pada", "panini_reference")
FORMS = ("purusha", "vacana", "pada", "form_devanagari", "form_iast")


def entry(roots: DataFrame) -> Column:
    """A root's row as struct: the eight columns of an entry, of these the ones that the table has."""
    return F.struct(*[c for c in ENTRY if c in roots.columns])


def listings(roots: DataFrame, n: int) -> DataFrame:
    """(gana, count, entries): the first n entries of each class by id."""
    # the first of each class are found within a task first (WindowGroupLimit), so a class of any size sends n rows a task
    nth = F.row_number().over(Window.partitionBy("gana").orderBy("id"))
    few = roots.where(F.col("gana").between(min(CLASSES), max(CLASSES))).withColumn("rq_n", nth).where(F.col("rq_n") <= n)
    lists = few.groupBy("gana").agg(F.sort_array(F.collect_list(F.struct("id", entry(roots).alias("e")))).alias("l"))
    return lists.select(F.col("gana").alias("rq_gana"), F.size("l").cast("long").alias("rq_count"), F.transform("l", lambda x: x["e"]).alias("rq_entries"))


def overview(roots: DataFrame) -> DataFrame:
    """One row: how many of each class there are, at most MAX_LISTED, and in all."""
    sums = roots.agg(*[F.count_if(F.col("gana") == g).alias(f"g{g}") for g in CLASSES])
    rows = F.array(*[F.struct(F.lit(g).alias("gana"), F.lit(GANAS[g - 1]).alias("name"), F.least(F.col(f"g{g}"), F.lit(MAX_LISTED).cast("long")).alias("count")) for g in CLASSES])
    total = sum((F.least(F.col(f"g{g}"), F.lit(MAX_LISTED).cast("long")) for g in CLASSES), F.lit(0).cast("long"))
    return sums.select(total.alias("rq_total"), rows.alias("rq_ganas"))


def answered(requests: DataFrame, roots: DataFrame, forms: DataFrame | None = None, key: str = "request_id", uri: str = "uri", names: tuple[str, ...] = ("dhatu_devanagari", "dhatu_iast"), listed: int = LISTED) -> DataFrame:
    """An answer to every request; names: columns by any of which a root is found, the smallest id of several. forms: (dhatu_id, lakara, FORMS)."""
    own = requests.select(F.col(key).alias("request_id"), F.col(uri).alias("rq_uri"), once(routed(F.coalesce(F.col(uri), F.lit("")))).alias("r")).select("request_id", "rq_uri", "r.kind", F.col("r.argument").alias("rq_arg"))
    answer = lambda status, count, body: (F.lit(status).alias("status"), count.cast("long").alias("count"), body.alias("body"))
    error = lambda text: F.to_json(F.struct(text.alias("error")))
    of = lambda *kinds: own.where(F.col("kind").isin(*kinds))
    base = ("request_id", "kind")
    zero = F.lit(0)

    # the kinds that no table answers
    bad = F.when(F.col("kind") == "invalid", F.concat(F.lit(GANA_BAD), F.substring_index("rq_uri", "/", -1))).otherwise(F.concat(F.lit(UNKNOWN), F.coalesce("rq_uri", F.lit(""))))
    known = ("class", "root", "conjugations", "root_overview")
    out = [own.where(~F.col("kind").isin(*known)).select(*base, *answer("error", zero, error(bad)))]

    # a class: its listing, made once
    asked = of("class").withColumn("rq_class", F.col("rq_arg").try_cast("int"))
    in_range = F.col("rq_class").between(min(CLASSES), max(CLASSES))
    out.append(asked.where(~F.coalesce(in_range, F.lit(False))).select(*base, *answer("error", zero, error(F.lit(GANA_RANGE)))))
    lists = listings(roots, listed)  # a row for each class
    whole = F.struct(F.col("rq_class").alias("gana"), F.coalesce("rq_count", zero.cast("long")).alias("count"), F.coalesce("rq_entries", F.array().cast(lists.schema["rq_entries"].dataType)).alias("dhatus"))
    found = asked.where(in_range).join(F.broadcast(lists), F.col("rq_class") == F.col("rq_gana"), "left")
    out.append(found.select(*base, *answer("ok", F.coalesce("rq_count", zero), F.to_json(whole))))

    # a root by any of its names: what is asked for is looked up once
    asked = of("root", "conjugations")
    wanted = asked.select(F.col("rq_arg").alias("rq_name")).distinct()
    by_name = roots.select("id", entry(roots).alias("rq_e"), F.explode(F.array_distinct(F.array_compact(F.array(*[F.col(c) for c in names])))).alias("rq_name"))
    entries = by_name.join(wanted, "rq_name", "left_semi").groupBy("rq_name").agg(F.min_by("rq_e", "id").alias("rq_e"))
    if forms is not None:
        shown = F.struct(*[F.col(c) for c in FORMS if c in forms.columns])
        per = forms.join(entries.select(F.col("rq_e.id").alias("dhatu_id")).distinct(), "dhatu_id", "left_semi").groupBy("dhatu_id", "lakara").agg(F.sort_array(F.collect_list(shown)).alias("l"))
        tables = per.groupBy("dhatu_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("lakara", "l")))).alias("rq_forms"))
        entries = entries.join(tables, F.col("rq_e.id") == F.col("dhatu_id"), "left").drop("dhatu_id")
    else:
        entries = entries.withColumn("rq_forms", F.lit(None).cast("map<string,array<struct<purusha:string>>>"))
    found = asked.join(entries.withColumnRenamed("rq_name", "rq_arg"), "rq_arg", "left")
    there = F.col("rq_e").isNotNull()
    empty = F.map_from_arrays(F.array(), F.array()).cast(entries.schema["rq_forms"].dataType)
    card = F.when(F.col("kind") == "root", F.to_json("rq_e")).otherwise(F.to_json(F.struct(F.col("rq_e").alias("dhatu"), F.coalesce("rq_forms", empty).alias("conjugations"))))
    out.append(found.select(*base, F.when(there, "ok").otherwise("error").alias("status"), F.when(there, 1).otherwise(0).cast("long").alias("count"), F.when(there, card).otherwise(error(F.concat(F.lit(NOT_FOUND), F.col("rq_arg")))).alias("body")))

    # the overview: one row for all who ask
    sums = overview(roots)
    body = F.to_json(F.struct(F.col("rq_total").alias("total_dhatus"), F.col("rq_ganas").alias("gana_distribution")))
    out.append(of("root_overview").crossJoin(F.broadcast(sums)).select(*base, *answer("ok", F.col("rq_total"), body)))
    done = out[0]
    for part in out[1:]:
        done = done.unionByName(part)
    return done
