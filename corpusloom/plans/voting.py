"""Queries of the vote, the rules and the trees."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import prompts
from corpusloom.functions.binding import once
from corpusloom.operators import diff, producers, rules, tree, vote
from corpusloom.session import shared_dir, spread, table
from corpusloom.streaming import corpus_stream

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


_ENGINES = r"""
w AS (SELECT doc_id, CASE WHEN trim(regexp_replace(text, '\s+', ' ', 'g')) = '' THEN [] ELSE string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ') END AS ws FROM documents),
e AS (SELECT doc_id, list_transform(ws, lambda x: lower(x)) AS s, list_transform(ws, lambda x: regexp_replace(lower(x), '(ing|ed|s|tion)$', '')) AS st, list_transform(list_filter(ws, lambda x: length(x) >= 3), lambda x: lower(x)) AS lx FROM w)"""


def _vote_sql(third: bool, fourth: bool = False) -> str:
    # whether the third engine votes here is known by its having an entry at this place
    c = "unnest(lx)" if third else "NULL::VARCHAR"
    d = "unnest(s)" if fourth else "NULL::VARCHAR"
    return rf"""
WITH {_ENGINES},
p AS (SELECT doc_id, unnest(range(len(s))) AS pos, unnest(s) AS a, unnest(st) AS b, {c} AS c, {d} AS d FROM e),
q AS (SELECT doc_id, pos, a, list_filter([a, b, c, left(d, 5)], lambda x: x IS NOT NULL AND x <> '') AS ls, 6830 + CASE WHEN c IS NOT NULL THEN 1750 ELSE 0 END + CASE WHEN d IS NOT NULL THEN 1980 ELSE 0 END AS num,
  75 + CASE WHEN c IS NOT NULL THEN 25 ELSE 0 END + CASE WHEN d IS NOT NULL THEN 33 ELSE 0 END AS den FROM p WHERE pos IS NOT NULL),
k AS (SELECT *, list_transform(ls, lambda x: len(list_filter(ls, lambda y: y = x))) AS counts FROM q),
v AS (SELECT doc_id, pos, a AS surface, ls[list_position(counts, list_max(counts))] AS lemma, CAST(round(num * 1e5 / den) AS BIGINT) AS conf7, CAST(27720 * list_max(counts) // len(ls) AS BIGINT) AS agree FROM k)"""


_SUMMARY = """,
t AS (SELECT d.doc_id, count(v.doc_id) AS n, coalesce(sum(agree), 0)::BIGINT AS a, coalesce(sum(conf7), 0)::BIGINT AS c7 FROM documents d LEFT JOIN v ON d.doc_id = v.doc_id GROUP BY d.doc_id),
l AS (SELECT *, CASE WHEN n = 0 THEN 'low' WHEN a * 100 >= 95 * 27720 * n THEN 'high' WHEN a * 100 >= 70 * 27720 * n THEN 'medium' ELSE 'low' END AS agreement_level, CASE WHEN n > 0 THEN c7 / n / 1e7 ELSE 0.0 END::DOUBLE AS mean FROM t),
s AS (SELECT doc_id, n AS n_segments, round(CASE WHEN n > 0 THEN a / (27720.0::DOUBLE * n) ELSE 0 END, 6)::DOUBLE AS engine_agreement, agreement_level,
  round(CASE agreement_level WHEN 'high' THEN least(0.95::DOUBLE, mean) WHEN 'medium' THEN least(0.85::DOUBLE, mean) ELSE mean END, 6)::DOUBLE AS overall_confidence FROM l)"""
VOTE = _vote_sql(True) + _SUMMARY


@query(VOTE + " SELECT * FROM s")
def ensemble_vote(spark, sf_dir):
    return vote.summary(vote.sentences(documents(spark, sf_dir)))


@query(_vote_sql(True) + " SELECT doc_id, pos::BIGINT AS pos, surface, lemma, round(conf7 / 1e7, 6)::DOUBLE AS confidence, round(agree / 27720.0::DOUBLE, 6)::DOUBLE AS agreement FROM v")
def vote_segments(spark, sf_dir):
    voted = vote.sentences(documents(spark, sf_dir)).select("doc_id", F.explode("segments").alias("s"))
    return voted.select("doc_id", F.col("s.pos").cast("long").alias("pos"), "s.surface", "s.lemma", F.round(F.col("s.conf7") / F.lit(1e7), 6).alias("confidence"), F.round(F.col("s.agree") / F.lit(float(vote.PARTS)), 6).alias("agreement"))


@query(VOTE + " SELECT agreement_level, count(*) AS n, round(avg(overall_confidence), 6)::DOUBLE AS mean_confidence FROM s GROUP BY 1")
def agreement_levels(spark, sf_dir):
    rows = vote.summary(vote.sentences(documents(spark, sf_dir)))
    return rows.groupBy("agreement_level").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("overall_confidence"), 6).alias("mean_confidence"))


@query(f"WITH {_ENGINES} SELECT doc_id, concat_ws(',', CASE WHEN len(s) > 0 THEN 'surface=0.90' END, CASE WHEN len(st) > 0 THEN 'stem=0.92' END, CASE WHEN len(lx) > 0 THEN 'lexicon=0.70' END) AS votes FROM e")
def engine_votes_map(spark, sf_dir):
    return vote.engine_votes(documents(spark, sf_dir))


@query(_vote_sql(False) + _SUMMARY + " SELECT * FROM s")
def engine_subset_vote(spark, sf_dir):
    own = producers.Registry().chosen(["surface", "stem"])
    return vote.summary(vote.sentences(documents(spark, sf_dir), own))


@query(_vote_sql(True, True) + _SUMMARY + " SELECT * FROM s")
def four_engine_vote(spark, sf_dir):
    own = producers.Registry()
    own.add(producers.Producer("prefix", producers.UNKNOWN_WEIGHT, 60, lambda words: F.transform(words, lambda w: F.left(F.lower(w), F.lit(5)))))
    return vote.summary(vote.sentences(documents(spark, sf_dir), own.chosen()))


@query(VOTE + " SELECT * FROM s")
def streaming_corpus(spark, sf_dir):
    own = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    return corpus_stream.vote_stream(corpus_stream.read(spark, sf_dir), f"{own}/out", f"{own}/state")


# ---- rules: the orders of a customer stand for the candidate parses of a sentence


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    key, first = F.col("o_orderkey"), F.substring("o_orderpriority", 1, 1)
    nth = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    lemma = F.element_at(F.array(*map(F.lit, ("gam", "rāma", "xyz", "kṛ"))), (key % 4 + 1).cast("int"))
    fields = ("lemma", "pos", "gender", "number", "case", "sandhi_type", "surface")
    segment = lambda *values: F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in zip(fields, values, strict=True)])
    a = segment(lemma, "adj", F.col("o_orderstatus"), "sg", "nom", F.element_at(F.array(*map(F.lit, ("vowel", "exotic", ""))), (key % 3 + 1).cast("int")), F.lower("o_orderstatus"))
    gender = F.when(key % 5 == 0, F.lit(None).cast("string")).when(first.isin("1", "2"), "F").when(first == "3", "O").otherwise("P")
    b = segment(F.when(F.col("o_custkey") % 2 == 0, "deva").otherwise("foo"), "noun", gender, "sg", "nom", F.when(key % 2 == 0, F.lit("Guna")), F.lit("n"))
    cents = F.pmod(F.round(F.col("o_totalprice") * 100).cast("long"), F.lit(100))
    return o.select(F.col("o_custkey").alias("sentence_id"), nth.alias("idx"), (cents / F.lit(100.0)).alias("confidence"), F.array(a, b).alias("segments"))


CANDIDATES = """
WITH c AS (SELECT o_custkey AS sentence_id, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1)::INT AS idx, (round(o_totalprice * 100)::BIGINT % 100) / 100.0::DOUBLE AS confidence,
  o_orderstatus AS g1, CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN substr(o_orderpriority, 1, 1) IN ('1', '2') THEN 'F' WHEN substr(o_orderpriority, 1, 1) = '3' THEN 'O' ELSE 'P' END AS g2,
  CASE o_orderkey % 4 WHEN 0 THEN 0.8 WHEN 1 THEN 0.7 WHEN 2 THEN 0.3 ELSE 0.8 END::DOUBLE AS s1, CASE WHEN o_custkey % 2 = 0 THEN 0.7 ELSE 0.3 END::DOUBLE AS s2,
  CASE o_orderkey % 3 WHEN 0 THEN 0.03 WHEN 1 THEN -0.015 ELSE 0 END::DOUBLE AS t1, (o_orderkey % 3 <> 2)::INT AS n1, CASE WHEN o_orderkey % 2 = 0 THEN 0.03 ELSE 0 END::DOUBLE AS t2, (o_orderkey % 2 = 0)::INT AS n2,
  CASE o_orderkey % 4 WHEN 0 THEN 'gam' WHEN 1 THEN 'rāma' WHEN 2 THEN 'xyz' ELSE 'kṛ' END AS lemma1, CASE WHEN o_custkey % 2 = 0 THEN 'deva' ELSE 'foo' END AS lemma2
  FROM orders),
m AS (SELECT *, (g2 IS NULL OR g1 = g2) AS ok, max((g2 IS NULL OR g1 = g2)::INT) OVER (PARTITION BY sentence_id) AS any_ok FROM c),
a AS (SELECT * FROM m WHERE ok OR any_ok = 0),
f AS (SELECT * REPLACE (CASE WHEN count(*) OVER (PARTITION BY sentence_id) > 1 THEN least(1.0::DOUBLE, confidence + ((s1 + s2) / 2) / max((s1 + s2) / 2) OVER (PARTITION BY sentence_id) * 0.05::DOUBLE) ELSE confidence END AS confidence) FROM {rows}),
d AS (SELECT * REPLACE (CASE WHEN count(*) OVER (PARTITION BY sentence_id) > 1 THEN least(1.0::DOUBLE, confidence + (t1 + t2) / greatest(n1 + n2, 1)) ELSE confidence END AS confidence) FROM {after}),
r AS (SELECT *, row_number() OVER (PARTITION BY sentence_id ORDER BY confidence DESC, idx) AS rank FROM d WHERE confidence >= 0.3),
k AS (SELECT * FROM r WHERE rank <= 5)"""
CHAIN = CANDIDATES.format(rows="a", after="f")
ALONE = CANDIDATES.format(rows="c", after="c")


@query(CHAIN + " SELECT sentence_id, idx FROM a")
def agreement_rule(spark, sf_dir):
    return rules.agreement(candidates(spark, sf_dir)).select("sentence_id", "idx")


@query(ALONE + " SELECT sentence_id, idx, round(confidence, 6)::DOUBLE AS confidence FROM f")
def frequency_rule(spark, sf_dir):
    return rules.frequency(candidates(spark, sf_dir)).select("sentence_id", "idx", F.round("confidence", 6).alias("confidence"))


@query(ALONE + " SELECT sentence_id, idx, round(confidence, 6)::DOUBLE AS confidence FROM d")
def sandhi_rule(spark, sf_dir):
    return rules.sandhi(candidates(spark, sf_dir)).select("sentence_id", "idx", F.round("confidence", 6).alias("confidence"))


@query(CHAIN + " SELECT sentence_id, idx, round(confidence, 6)::DOUBLE AS confidence, rank::BIGINT AS rank FROM k")
def rule_chain_topk(spark, sf_dir):
    kept = rules.RuleSet().apply(candidates(spark, sf_dir))
    return kept.select("sentence_id", "idx", F.round("confidence", 6).alias("confidence"), F.col("rank").cast("long").alias("rank"))


@query(
    CHAIN
    + """, b AS (SELECT sentence_id, count(*) AS before FROM c GROUP BY 1), t AS (SELECT sentence_id, count(*) AS after, max(confidence) AS top FROM k GROUP BY 1),
g AS (SELECT b.sentence_id, CASE WHEN before < 2 THEN 'none' WHEN coalesce(after, 0) <= 1 OR top >= 0.95 THEN 'rules' ELSE 'llm' END AS resolved_at, coalesce(top, 0) AS confidence, coalesce(after, 0) AS after FROM b LEFT JOIN t USING (sentence_id))
SELECT sentence_id, resolved_at, round(confidence, 6)::DOUBLE AS confidence, ((after > 1 AND confidence < 0.5) OR (resolved_at = 'llm' AND confidence < 0.8)) AS needs_review FROM g"""
)
def pipeline_stage(spark, sf_dir):
    own = candidates(spark, sf_dir)
    before = own.groupBy("sentence_id").agg(F.count(F.lit(1)).alias("before"))
    after = rules.RuleSet().apply(own).groupBy("sentence_id").agg(F.count(F.lit(1)).alias("after"), F.max("confidence").alias("top"))
    both = before.join(after, "sentence_id", "left").withColumn("after", F.coalesce("after", F.lit(0))).withColumn("top", F.coalesce("top", F.lit(0.0)))
    staged = both.withColumn("resolved_at", rules.stage(F.col("before"), F.col("after"), F.col("top")))
    return staged.select("sentence_id", "resolved_at", F.round("top", 6).alias("confidence"), rules.needs_review(F.col("after"), F.col("top"), F.col("resolved_at")).alias("needs_review"))


@query(ALONE + " SELECT sentence_id, idx, row_number() OVER (PARTITION BY sentence_id ORDER BY CASE idx WHEN 2 THEN 0 WHEN 0 THEN 1 WHEN 7 THEN 2 ELSE 100 END, idx) AS place FROM c")
def ranking_reorder(spark, sf_dir):
    own = candidates(spark, sf_dir)
    ranking = own.select("sentence_id").distinct().withColumn("ranking", F.array(*map(F.lit, (2, 0, 7, 2))))
    return rules.reordered(own, ranking).select("sentence_id", "idx", F.col("place").cast("long").alias("place"))


@query(
    ALONE
    + """, t AS (SELECT *, 'Candidate ' || idx || ':' || chr(10) || '  Confidence: ' || printf('%.2f', confidence) || chr(10) || '  Segments:' || chr(10)
  || '    - ' || lower(g1) || ' → ' || lemma1 || ' (adj) [gender=' || g1 || ', number=sg, case=nom]' || chr(10)
  || '    - n → ' || lemma2 || ' (noun) [' || CASE WHEN g2 IS NULL THEN '' ELSE 'gender=' || g2 || ', ' END || 'number=sg, case=nom]' || chr(10) AS block FROM c)
SELECT sentence_id, 'Parse candidates for Sanskrit text:' || chr(10) || chr(10) || string_agg(block, chr(10) ORDER BY idx) || chr(10) || 'Topic: orders' || chr(10) || chr(10) || 'Rank these candidates from most to least likely.' AS prompt FROM t GROUP BY 1"""
)
def prompt_build(spark, sf_dir):
    full = lambda s: F.struct(*[s[k].alias(k) for k in ("surface", "lemma", "pos", "gender", "number", "case")], *[F.lit(None).cast("string").alias(k) for k in ("person", "tense")])
    own = candidates(spark, sf_dir).withColumn("block", prompts.candidate_block(F.col("idx"), F.col("confidence"), F.transform("segments", full)))
    grouped = own.groupBy("sentence_id").agg(F.sort_array(F.collect_list(F.struct("idx", "block"))).alias("b"))
    return grouped.select("sentence_id", prompts.prompt(F.transform("b", lambda s: s["block"]), topic=F.lit("orders")).alias("prompt"))


# ---- trees

_LINES = "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1"


@query(f"WITH p AS (SELECT l_orderkey, ({_LINES})::INT AS idx, l_discount AS confidence FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY confidence DESC, idx) AS k FROM p) SELECT l_orderkey, idx, confidence FROM r WHERE k = 1")
def best_parse(spark, sf_dir):
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    parses = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.row_number().over(order) - 1).alias("idx"), F.col("l_discount").alias("confidence"))
    return tree.best_parse(parses, "l_orderkey", "idx", "confidence")


_GROUPS = r"g AS (SELECT doc_id, unnest(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) AS line FROM documents), h AS (SELECT doc_id, line, list_filter(string_split_regex(line, '\s+'), lambda x: x <> '') AS words FROM g)"


@query(f"WITH {_GROUPS} SELECT CASE WHEN len(words) < 2 THEN 'simple' WHEN ends_with(words[len(words)], 'ly') THEN 'bahuvrihi' ELSE 'tatpurusha' END AS type, count(*) AS n FROM h GROUP BY 1")
def compound_types(spark, sf_dir):
    groups = documents(spark, sf_dir).select(F.explode(tree.line_groups(F.col("text"))).alias("g"))
    words = F.transform("g.words", lambda w: F.struct(F.when(w.endswith("ly"), "adjective").otherwise("noun").alias("pos")))
    return groups.select(F.coalesce(tree.compound_type(words), F.lit("simple")).alias("type")).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_GROUPS}, t AS (SELECT doc_id, count(*) AS groups, sum(len(words))::BIGINT AS words FROM h GROUP BY 1) SELECT d.doc_id, coalesce(groups, 0) AS groups, coalesce(words, 0) AS words FROM documents d LEFT JOIN t USING (doc_id)")
def tree_flatten_counts(spark, sf_dir):
    groups = documents(spark, sf_dir).select("doc_id", tree.line_groups(F.col("text")).alias("g"))
    return groups.select("doc_id", F.size("g").cast("long").alias("groups"), F.size(tree.all_words(F.col("g"))).cast("long").alias("words"))


@query(_vote_sql(True) + " SELECT d.doc_id, count(v.doc_id) AS groups, coalesce(string_agg(lemma, ' ' ORDER BY pos), '') AS lemmas FROM documents d LEFT JOIN v ON d.doc_id = v.doc_id GROUP BY d.doc_id")
def tree_json_roundtrip(spark, sf_dir):
    voted = vote.sentences(documents(spark, sf_dir), keep=("text",))
    written = voted.select("doc_id", once(tree.to_json(tree.built(F.col("segments"), F.col("text")))).alias("j"))
    back = written.select("doc_id", once(tree.from_json(F.col("j"))).alias("q"))
    lemmas = F.flatten(F.transform("q.groups", lambda g: F.transform(g["words"], lambda w: w["lemma"])))
    return back.select("doc_id", F.size("q.groups").cast("long").alias("groups"), F.array_join(lemmas, " ").alias("lemmas"))


@query(
    r"""SELECT doc_id, coalesce(nullif(array_to_string(list_transform(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''),
lambda x: x || ' → ' || array_to_string(list_filter(string_split_regex(x, '\s+'), lambda w: w <> ''), ' + ')), ' • '), ''), '—') AS preview FROM documents"""
)
def parse_preview(spark, sf_dir):
    groups = documents(spark, sf_dir).select("doc_id", tree.line_groups(F.col("text")).alias("g"))
    shaped = F.transform("g", lambda g: F.struct(g["surface"].alias("surface"), F.transform(g["words"], lambda w: F.struct(w.alias("lemma"))).alias("words")))
    return groups.select("doc_id", tree.preview(shaped).alias("preview"))


@query("WITH l AS (SELECT conv_id, turn AS pos, role AS x FROM conversations), r AS (SELECT conv_id, turn - 1 AS pos, role AS y FROM conversations) SELECT coalesce(l.conv_id, r.conv_id) AS conv_id, coalesce(l.pos, r.pos) AS pos, CASE WHEN x IS NULL THEN 'only_right' WHEN y IS NULL THEN 'only_left' WHEN x = y THEN 'same' ELSE 'lemma' END AS kind FROM l FULL OUTER JOIN r ON l.conv_id = r.conv_id AND l.pos = r.pos")
def parse_diff(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    return diff.parse_diff(turns.withColumn("pos", F.col("turn")), turns.withColumn("pos", F.col("turn") - 1), "conv_id", "pos", "role")


@query(r"""WITH w AS (SELECT doc_id, lang, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS ws FROM documents)
SELECT doc_id, CASE lang WHEN 'en' THEN to_json({'lemma': ws[1], 'pos': lang}) WHEN 'de' THEN to_json({'lemma': ws[1], 'pos': lang, 'meanings': ws, 'root': ws[2]}) ELSE to_json({'lemma': ws[1], 'pos': lang, 'meanings': ws[1:3], 'root': ws[2]}) END::VARCHAR AS card FROM w WHERE len(ws) >= 2""")
def verbosity_projection(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))
    words = docs.select("doc_id", "lang", F.filter(F.split("text", "\\s+"), lambda x: x != "").alias("ws")).where(F.size("ws") >= 2)
    asked = F.when(F.col("lang") == "en", "minimal").when(F.col("lang") == "de", "DETAILED").otherwise("bogus")
    return words.select("doc_id", tree.projected(F.get("ws", F.lit(0)), F.col("lang"), F.col("ws"), F.get("ws", F.lit(1)), tree.verbosity_of(asked)).alias("card"))


@query(
    r"""WITH g AS (SELECT doc_id, list_transform(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''), lambda x: len(list_filter(string_split_regex(x, '\s+'), lambda w: w <> ''))) AS ns FROM documents)
SELECT doc_id, len(ns) AS groups, list_sum(ns)::BIGINT AS words, 'w0_' || (len(ns) - 1) || '_' || (ns[len(ns)] - 1) AS last_word FROM g WHERE len(ns) > 0"""
)
def response_ids(spark, sf_dir):
    groups = documents(spark, sf_dir).select("doc_id", tree.response_ids(tree.line_groups(F.col("text")), F.lit(0)).alias("g")).where(F.size("g") > 0)
    words = F.flatten(F.transform("g", lambda g: F.transform(g["words"], lambda w: w["id"])))
    return groups.select("doc_id", F.size("g").cast("long").alias("groups"), F.size(F.array_distinct(words)).cast("long").alias("words"), F.element_at(words, -1).alias("last_word"))
