"""Queries of the stored table: upserts, deletes, the maintained index, look-ups by key, accesses, and a stream into it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.plans.voting import documents
from corpusloom.session import shared_dir, table
from corpusloom.sources.stored import Stored, counts_before
from corpusloom.streaming import corpus_stream

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def _store(spark, name: str) -> Stored:
    return Stored(spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", "text string, mode long", key="doc_id", key_type="long", text="text", done="mode = 1", buckets=16)


def _filled(spark, sf_dir) -> Stored:
    """All documents; every seventh again with another text; every eleventh deleted; of these every seventh back."""
    own, docs = _store(spark, "analyses"), documents(spark, sf_dir)
    own.apply(docs.select("doc_id", "text", (F.col("doc_id") % 3).alias("mode")))
    own.apply(docs.where("doc_id % 7 = 0").select("doc_id", F.concat(F.lower("text"), F.lit(" renewed text")).alias("text"), F.lit(1).cast("long").alias("mode")))
    own.delete(docs.where("doc_id % 11 = 0"))
    own.apply(docs.where("doc_id % 77 = 0").select("doc_id", F.lit("back again, renewed").alias("text"), F.lit(2).cast("long").alias("mode")))
    return own


_ROWS = """
r AS (SELECT doc_id, CASE WHEN doc_id % 77 = 0 THEN 'back again, renewed' WHEN doc_id % 7 = 0 THEN lower(text) || ' renewed text' ELSE text END AS text, CASE WHEN doc_id % 77 = 0 THEN 2 WHEN doc_id % 7 = 0 THEN 1 ELSE doc_id % 3 END AS mode,
 CASE WHEN doc_id % 77 = 0 THEN 3 WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END AS version FROM documents WHERE doc_id % 11 <> 0 OR doc_id % 77 = 0),
p AS (SELECT DISTINCT doc_id, t AS term FROM (SELECT doc_id, unnest(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+')) AS t FROM r) WHERE t <> '')"""


@query(f"WITH {_ROWS} SELECT doc_id, md5(text) AS text, mode::BIGINT AS mode, version::BIGINT AS version FROM r")
def store_upserts_and_deletes(spark, sf_dir):
    return _filled(spark, sf_dir).rows().select("doc_id", F.md5(F.col("text").cast("binary")).alias("text"), "mode", "version")


@query(f"WITH {_ROWS} SELECT doc_id, count(*) AS terms, md5(string_agg(term, ' ' ORDER BY encode(term))) AS digest FROM p GROUP BY 1")
def store_index_maintained(spark, sf_dir):
    """All postings after four batches and a compaction, as an index that is built anew would have them."""
    own = _filled(spark, sf_dir)
    own.compacted(least=4)
    # dealt before it is grouped: lists of terms don't get smaller by grouping them on both sides
    listed = own.index().repartition("doc_id").groupBy("doc_id").agg(F.sort_array(F.collect_list("term")).alias("l"))
    return listed.select("doc_id", F.size("l").cast("long").alias("terms"), F.md5(F.array_join("l", " ").cast("binary")).alias("digest"))


@query(f"WITH {_ROWS} SELECT doc_id FROM p WHERE term IN ('renewed', 'text') GROUP BY 1 HAVING count(*) = 2")
def store_search(spark, sf_dir):
    return _filled(spark, sf_dir).search(["Renewed", "text"])


@query(f"WITH {_ROWS} SELECT count(*) AS total, count(*) FILTER (mode = 1) AS done FROM r")
def store_totals(spark, sf_dir):
    """From what each batch changed, not from the rows."""
    return _filled(spark, sf_dir).totals()


def _accesses(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select((F.col("user_id") % 500).alias("doc_id"), F.col("ts").alias("at"), F.col("event_id").alias("id"))


@query(
    f"WITH {_ROWS}, a AS (SELECT user_id % 500 AS doc_id, count(*) AS n, max(ts) AS last FROM events GROUP BY 1), k AS (SELECT DISTINCT user_id % 500 AS doc_id FROM events WHERE event_type = 'purchase')"
    " SELECT doc_id, md5(text) AS text, n AS access_count, epoch_us(last)::BIGINT AS accessed_at FROM r JOIN k USING (doc_id) JOIN a USING (doc_id)"
)
def store_keyed_lookup(spark, sf_dir):
    """The rows that some events ask for, with their accesses; only the buckets of these keys are read."""
    own = _filled(spark, sf_dir)
    own.log(_accesses(spark, sf_dir), 0)
    keys = table(spark, sf_dir, "events").where("event_type = 'purchase'").select((F.col("user_id") % 500).alias("doc_id")).distinct()
    found = own.get(keys).join(own.access_counts(keys), "doc_id")
    return found.select("doc_id", F.md5(F.col("text").cast("binary")).alias("text"), "access_count", F.unix_micros("accessed_at").alias("accessed_at"))


@query("SELECT event_id AS id, user_id % 500 AS doc_id, row_number() OVER (PARTITION BY user_id % 500 ORDER BY ts, event_id) - 1 AS count_before FROM events")
def access_count_before(spark, sf_dir):
    return counts_before(_accesses(spark, sf_dir), "doc_id", ["at", "id"]).select("id", "doc_id", "count_before")


@query(
    r"""WITH p AS (SELECT DISTINCT doc_id, t AS term FROM (SELECT doc_id, unnest(string_split_regex(lower(text), '[^\p{L}\p{N}]+')) AS t FROM documents) WHERE t <> ''), n AS (SELECT doc_id, count(*) AS terms FROM p GROUP BY 1)
SELECT doc_id, md5(text) AS text, coalesce(terms, 0) AS terms, (SELECT count(*) FROM documents) AS total, (SELECT count(*) FROM documents WHERE doc_id % 3 = 1) AS done FROM documents LEFT JOIN n USING (doc_id)"""
)
def stream_into_store(spark, sf_dir):
    """The documents as a stream, upserted batch by batch; the second run of the stream finds nothing new."""
    own = _store(spark, "streamed")
    checkpoint = f"{shared_dir(spark)}/store-stream-{uuid.uuid4().hex}"
    for _ in range(2):
        stream = corpus_stream.read(spark, sf_dir, files_per_trigger=64).select("doc_id", "text", (F.col("doc_id") % 3).alias("mode"))
        own.from_stream(stream, checkpoint)
    terms = own.index().groupBy("doc_id").agg(F.count(F.lit(1)).alias("terms"))
    rows = own.rows().join(terms, "doc_id", "left").crossJoin(F.broadcast(own.totals()))
    return rows.select("doc_id", F.md5(F.col("text").cast("binary")).alias("text"), F.coalesce("terms", F.lit(0)).alias("terms"), "total", "done")
