"""Queries of the store, the caches and the corpus readers."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import text
from corpusloom.operators import stats, store
from corpusloom.session import spread, table
from corpusloom.sources import corpus

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


@query("WITH v AS (SELECT user_id, event_id, event_type, value, count(*) OVER (PARTITION BY user_id) AS versions, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) SELECT user_id, event_id, event_type, value, versions FROM v WHERE k = 1")
def upsert_latest(spark, sf_dir):
    return store.upserted(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], ["event_id", "event_type", "value"])


@query("SELECT count(*) AS total, count(quality) AS disambiguated, coalesce(sum(n_chars), 0)::BIGINT AS accesses FROM documents LEFT JOIN labels USING (doc_id)")
def corpus_stats(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return store.corpus_stats(rows, F.col("quality").isNotNull(), F.col("n_chars"))


@query("SELECT event_id, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 10")
def recent_by_access(spark, sf_dir):
    return store.recent(table(spark, sf_dir, "events"), "ts", "event_id", 10).select("event_id", "user_id", "event_type")


@query("SELECT event_id, user_id, value FROM events WHERE event_type = 'purchase' ORDER BY ts DESC, event_id DESC LIMIT 100")
def filter_by_mode(spark, sf_dir):
    return store.by_mode(table(spark, sf_dir, "events"), "event_type", "purchase", "ts", "event_id", 100).select("event_id", "user_id", "value")


@query("SELECT doc_id, source, n_chars::BIGINT AS n_chars FROM documents WHERE doc_id = 42")
def point_lookup(spark, sf_dir):
    return store.point_lookup(table(spark, sf_dir, "documents"), "doc_id", 42).select("doc_id", "source", F.col("n_chars").cast("long").alias("n_chars"))


@query("SELECT doc_id, quality IS NOT NULL AS disambiguated, coalesce(quality, -1) AS selected_parse FROM documents LEFT JOIN labels USING (doc_id)")
def update_disambiguation(spark, sf_dir):
    return store.with_choice(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id", "quality").withColumn("selected_parse", F.coalesce("selected_parse", F.lit(-1)))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def delete_anti_join(spark, sf_dir):
    return store.without(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").where("toxic = 1"), "doc_id")


@query("SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def get_many(spark, sf_dir):
    return store.many(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").where("quality = 1"), "doc_id")


_TERMS = r"string_split_regex(lower(text), '[^\p{L}\p{N}]+')"


@query(f"SELECT doc_id FROM documents WHERE list_contains({_TERMS}, 'the') AND list_contains({_TERMS}, 'of')")
def fts_and_search(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return store.search_all(docs, "text", ["the", "Of"]).select("doc_id")


@query(f"SELECT doc_id FROM documents WHERE list_contains({_TERMS}, 'und') AND list_contains({_TERMS}, 'der')")
def fts_index_search(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return store.search_index(store.inverted_index(docs, "doc_id", "text"), ["und", "der"], "doc_id")


@query(
    """WITH e AS (SELECT event_id, event_type, user_id, lag(event_id) OVER (PARTITION BY event_type, user_id ORDER BY event_id) AS p FROM events),
d AS (SELECT e.event_id, count(DISTINCT x.user_id) AS others FROM e JOIN events x ON x.event_type = e.event_type AND x.event_id > e.p AND x.event_id < e.event_id AND x.user_id <> e.user_id GROUP BY 1)
SELECT e.event_id, p IS NOT NULL AND coalesce(others, 0) < 100 AS hit FROM e LEFT JOIN d ON e.event_id = d.event_id"""
)
def lru_simulation(spark, sf_dir):
    own = table(spark, sf_dir, "events").select("event_id", "event_type", "user_id")
    return store.lru(own, "event_type", "user_id", "event_id", 100).select("event_id", "hit")


@query("WITH e AS (SELECT event_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) SELECT event_id, coalesce(epoch_us(ts) - epoch_us(p) <= 3600000000, false) AS hit FROM e")
def ttl_lookup(spark, sf_dir):
    return store.ttl_hits(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", 3600).select("event_id", "hit")


@query(
    """WITH t AS (SELECT CASE WHEN l.doc_id IS NOT NULL THEN 'memory' WHEN source IN ('src0', 'src1') THEN 'redis' WHEN lang = 'en' THEN 'sqlite' ELSE 'none' END AS tier FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
SELECT tier, count(*) AS n, round(count(*) / (SELECT count(*) FROM t)::DOUBLE, 6)::DOUBLE AS rate FROM t GROUP BY tier"""
)
def tier_resolution(spark, sf_dir):
    docs, held = table(spark, sf_dir, "documents").select("doc_id", "source", "lang"), table(spark, sf_dir, "labels").select(F.col("doc_id").alias("held"))
    tiers = docs.join(held, F.col("doc_id") == F.col("held"), "left").select(store.tier(F.col("held").isNotNull(), F.col("source").isin("src0", "src1"), F.col("lang") == "en").alias("tier"))
    counts = tiers.groupBy("tier").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("all"))
    return counts.crossJoin(total).select("tier", "n", F.round(store.hit_rate(F.col("n"), F.col("all")), 6).alias("rate"))  # one row of totals


_KEY = "substr(sha256('academic:' || text), 1, 32)"


@query(f"SELECT doc_id, {_KEY} AS key FROM documents")
def cache_key(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", text.cache_key(F.lit("academic"), F.col("text")).alias("key"))


@query(f"WITH k AS (SELECT doc_id, {_KEY} AS key FROM documents) SELECT doc_id, key FROM k WHERE key NOT IN (SELECT key FROM k WHERE doc_id IN (SELECT doc_id FROM labels))")
def cache_miss_anti_join(spark, sf_dir):
    keys = cache_key(spark, sf_dir)
    held = store.many(keys, table(spark, sf_dir, "labels"), "doc_id").select("key")
    return store.misses(keys, held, "key").select("doc_id", "key")


@query("WITH e AS (SELECT event_type || user_id AS text, max({'t': ts, 'e': event_id}) AS m FROM events GROUP BY 1) SELECT text, m.e AS event_id FROM e ORDER BY m.t DESC, m.e DESC LIMIT 20")
def history_mru(spark, sf_dir):
    own = table(spark, sf_dir, "events").withColumn("text", F.concat("event_type", F.col("user_id").cast("string")))
    return store.history(own, "text", "ts", "event_id", 20).select("text", "event_id")


@query("SELECT user_id, count(*) % 2 = 1 AS expanded FROM events GROUP BY 1")
def expanded_ids(spark, sf_dir):
    return store.toggled(table(spark, sf_dir, "events"), "user_id")


@query("WITH c AS (SELECT event_id, greatest(0.0::DOUBLE, least(1.0::DOUBLE, value / 100)) AS x FROM events) SELECT event_id, round(x, 6)::DOUBLE AS confidence, CASE WHEN x >= 0.8::DOUBLE THEN 'high' WHEN x >= 0.5::DOUBLE THEN 'medium' ELSE 'low' END AS bucket, floor(x * 100.0::DOUBLE)::BIGINT AS percent FROM c")
def confidence_bucket(spark, sf_dir):
    x = text.clamp(F.col("value") / F.lit(100.0))
    return table(spark, sf_dir, "events").select("event_id", F.round(x, 6).alias("confidence"), text.confidence_bucket(x).alias("bucket"), text.percent(x).alias("percent"))


@query("SELECT page_id, CASE WHEN contains(lower(html), 'error') OR contains(html, 'no_solution') OR contains(html, 'No solution') THEN 'none' WHEN contains(html, '<td') OR contains(html, '<span') THEN 'analysis' ELSE 'fallback' END AS kind FROM pages")
def html_response_class(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.html_response_class(F.col("html")).alias("kind"))


# ---- readers

_KEPT = r"list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '' AND NOT starts_with(x, '#'))"


@query(f"WITH k AS (SELECT doc_id, {_KEPT} AS l FROM documents) SELECT doc_id, unnest(range(1, len(l) + 1))::INT AS verse, unnest(l) AS text FROM k")
def corpus_text_scan(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return corpus.kept_lines(docs, "doc_id", "text")


@query("SELECT event_id, 1::INT AS verse, event_type AS text, NULL::VARCHAR AS chapter FROM events UNION ALL SELECT event_id, 3::INT, 'k' || (props::JSON ->> 'k'), 'c' || user_id FROM events")
def corpus_json_scan(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    named = F.format_string('{"verse": "k%s", "text": "", "chapter": "c%d"}', F.get_json_object("props", "$.k"), F.col("user_id"))
    data = F.concat(F.lit('{"corpus": "events", "verses": ["'), F.col("event_type"), F.lit('", '), F.col("props"), F.lit(", "), named, F.lit("]}"))
    return events.select("event_id", F.explode(corpus.json_entries(data)).alias("e")).select("event_id", "e.verse", "e.text", "e.chapter")


@query("SELECT event_id, (props::JSON ->> 'k')::BIGINT AS k FROM events")
def jsonl_scan(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("SELECT conv_id, turn, role, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS previous FROM conversations")
def previous_context(spark, sf_dir):
    return corpus.context(table(spark, sf_dir, "conversations"), "conv_id", "turn").select("conv_id", "turn", "role", "previous")


@query("SELECT conv_id, turn, role, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS next FROM conversations")
def next_context(spark, sf_dir):
    return corpus.context(table(spark, sf_dir, "conversations"), "conv_id", "turn").select("conv_id", "turn", "role", "next")


# ---- statistics and graphs

_WORDS = r"list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')"


def _words(column: str = "text"):
    return F.filter(F.split(column, "\\s+"), lambda x: x != "")


@query(f"WITH w AS (SELECT n_chars > 100 AS ok, {_WORDS} AS ws FROM documents) SELECT count(*) AS total, count(*) FILTER (ok) AS successful, count(*) FILTER (NOT ok) AS failed, sum(len(ws))::BIGINT AS words, (SELECT count(DISTINCT x) FROM (SELECT unnest(ws) AS x FROM w)) AS unique_words FROM w")
def batch_statistics(spark, sf_dir):
    return stats.batch_statistics(spread(table(spark, sf_dir, "documents").select("n_chars", "text")), _words(), F.col("n_chars") > 100)


@query(f"SELECT word, count(*) AS n FROM (SELECT unnest({_WORDS}) AS word FROM documents) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def top_words(spark, sf_dir):
    return stats.top(spread(table(spark, sf_dir, "documents").select("text")), F.explode(_words()), 10)


@query("SELECT split_part(p_type, ' ', 1) AS word, count(*) AS n FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def pos_distribution(spark, sf_dir):
    return stats.top(table(spark, sf_dir, "part"), F.substring_index("p_type", " ", 1), 10)


@query("SELECT o_custkey, string_agg(o_orderkey || ':' || o_orderstatus, ',' ORDER BY o_orderkey) AS usages FROM orders GROUP BY 1")
def root_usage_lists(spark, sf_dir):
    return stats.usage_lists(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", F.concat_ws(":", F.col("o_orderkey").cast("string"), "o_orderstatus"))


_VERSE = "conv_id || '.' || turn"


def _verse():
    return F.concat_ws(".", F.col("conv_id").cast("string"), F.col("turn").cast("string"))


@query(f"SELECT 'Verse' AS type, {_VERSE} AS id FROM conversations UNION SELECT 'Word', x FROM (SELECT unnest({_WORDS}) AS x FROM conversations)")
def kg_nodes(spark, sf_dir):
    return stats.nodes(spread(table(spark, sf_dir, "conversations")), _verse(), _words())


@query(f"SELECT DISTINCT src, 'APPEARS_IN' AS rel, dst FROM (SELECT unnest({_WORDS}) AS src, {_VERSE} AS dst FROM conversations)")
def kg_edges(spark, sf_dir):
    return stats.edges(spread(table(spark, sf_dir, "conversations")), _verse(), _words())


@query(f"SELECT type, count(*) AS n FROM (SELECT 'Verse' AS type, {_VERSE} AS id FROM conversations UNION SELECT 'Word', x FROM (SELECT unnest({_WORDS}) AS x FROM conversations)) GROUP BY 1")
def kg_node_counts(spark, sf_dir):
    return kg_nodes(spark, sf_dir).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_custkey || '.' || l_orderkey || '.' || l_linenumber AS location, l_returnflag AS flag FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' AND l_linestatus = 'F'")
def character_name_filter(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")
    case, pos = F.when(F.col("l_returnflag") == "R", "nominative").otherwise("accusative"), F.when(F.col("l_linestatus") == "F", "noun").otherwise("verb")
    named = stats.nominative_names(lines, case, pos)
    joined = named.join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select(F.concat_ws(".", F.col("o_custkey").cast("string"), F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("location"), F.col("l_returnflag").alias("flag"))
