"""Queries of text functions, morphology, the lexicon and training data."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import morphology, prompts, text, translit
from corpusloom.operators import lexicon, training, vote
from corpusloom.plans.voting import VOTE, documents
from corpusloom.session import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# ---- scalar text functions


@query(
    r"""SELECT CASE WHEN trim(regexp_replace(text, '\s', ' ', 'g')) = '' THEN 'slp1' WHEN regexp_matches(text, '[\x{0900}-\x{097F}]') THEN 'devanagari' WHEN regexp_matches(text, '[āīūṛṝḷḹēōṃḥṅñṭḍṇśṣĀĪŪṚṜḶḸĒŌṂḤṄÑṬḌṆŚṢ]') THEN 'iast'
WHEN regexp_matches(text, '[wWqQzSN]|[AIURLMH]([^a-z]|$)') THEN 'slp1' ELSE 'iast' END AS script, count(*) AS n FROM documents GROUP BY 1"""
)
def script_detection(spark, sf_dir):
    return documents(spark, sf_dir).groupBy(text.detect_script(F.col("text")).alias("script")).agg(F.count(F.lit(1)).alias("n"))


@query(r"SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM documents")
def whitespace_normalize(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", text.normalize_whitespace(F.col("text")).alias("text"))


@query(r"""SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[।॥]', ' ', 'g'), '[\x{0966}-\x{096F}0-9]', '', 'g'), '[,.\-;:!?"''()\[\]{}]', '', 'g'), '\s+', ' ', 'g')) AS text FROM documents""")
def punctuation_removal(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", text.remove_punctuation(F.col("text")).alias("text"))


def _replaced() -> str:
    """SLP1 to IAST as nested replacements: no output holds a sign that another one replaces."""
    out, back = "text", {}
    for latin, slp1 in translit.TO_SLP1["iast"].items():
        back.setdefault(slp1, latin)
    for slp1, latin in back.items():
        if slp1 != latin:
            out = f"replace({out}, '{slp1.replace(chr(39), chr(39) * 2)}', '{latin}')"
    return out


@query(f"SELECT doc_id, CASE WHEN trim(text) = '' THEN text ELSE {_replaced()} END AS text FROM documents")
def slp1_to_iast(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", translit.transliterate(F.col("text"), "slp1", "iast").alias("text"))


# ---- morphology


@query(
    r"""WITH w AS (SELECT p_partkey, lower(p_name) AS t, split_part(lower(p_type), ' ', 1) AS k FROM part)
SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'noun' WHEN 1 THEN 'verb' END AS pos, CASE WHEN p_partkey % 3 < 2 THEN CASE WHEN contains(t, 'mas') THEN 'masculine' WHEN contains(t, 'm.') THEN 'masculine' WHEN contains(t, 'feminine') OR contains(t, 'fem') OR contains(t, 'f.') THEN 'feminine' WHEN contains(t, 'neu') OR contains(t, 'n.') THEN 'neuter' END END AS gender,
 CASE WHEN p_partkey % 3 < 2 THEN CASE WHEN contains(t, 'sing') OR contains(t, 'sg') THEN 'singular' WHEN contains(t, 'du') THEN 'dual' WHEN contains(t, 'pl') THEN 'plural' END END AS number FROM w"""
)
def morphology_scan(spark, sf_dir):
    kind = F.when(F.col("p_partkey") % 3 == 0, "Noun").when(F.col("p_partkey") % 3 == 1, "VERB").otherwise("other")
    rows = table(spark, sf_dir, "part").select("p_partkey", morphology.parsed(F.col("p_name"), kind).alias("m"))
    return rows.select("p_partkey", "m.pos", "m.gender", "m.number")


@query("SELECT p_partkey, CASE WHEN p_size <= 10 THEN ['bhvādi', 'adādi', 'juhotyādi', 'divādi', 'svādi', 'tudādi', 'rudhādi', 'tanādi', 'kryādi', 'curādi'][p_size] ELSE 'gaṇa-' || p_size END AS gana FROM part")
def gana_names(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", morphology.gana_name(F.col("p_size")).alias("gana"))


@query("SELECT n_nationkey, 'Rule ''sandhi_preference'' matched: ' || n_name || ' follows standard guna sandhi rules. ' || r_name || ' would require irregular sandhi.' AS reasoning FROM nation JOIN region ON n_regionkey = r_regionkey")
def reasoning_template(spark, sf_dir):
    joined = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select("n_nationkey", prompts.filled("sandhi_preference", preferred_split=F.col("n_name"), sandhi_type=F.lit("guna"), alternative_split=F.col("r_name")).alias("reasoning"))


# ---- lexicon

_PART = "p_partkey, p_name, p_retailprice"


@query(f"SELECT {_PART} FROM part WHERE contains(lower(p_name), 'ring') ORDER BY p_retailprice DESC, p_partkey LIMIT 10")
def like_search_ranked(spark, sf_dir):
    return lexicon.search(table(spark, sf_dir, "part"), ["p_name"], "Ring", "p_retailprice", "p_partkey", 10).select(*_PART.split(", "))


@query(f"SELECT {_PART} FROM part WHERE contains(lower(p_name), 'econ') OR contains(lower(p_brand), 'econ') OR contains(lower(p_type), 'econ') ORDER BY p_retailprice DESC, p_partkey LIMIT 20")
def multi_field_search(spark, sf_dir):
    return lexicon.search(table(spark, sf_dir, "part"), ["p_name", "p_brand", "p_type"], "econ", "p_retailprice", "p_partkey", 20).select(*_PART.split(", "))


@query("SELECT c_custkey, c_name FROM customer WHERE c_name = 'BUILDING' OR c_mktsegment = 'BUILDING' ORDER BY c_custkey LIMIT 1")
def exact_or_lookup(spark, sf_dir):
    return lexicon.exact(table(spark, sf_dir, "customer"), ["c_name", "c_mktsegment"], "BUILDING", "c_custkey").select("c_custkey", "c_name")


@query(f"SELECT {_PART} FROM part WHERE contains(lower(p_name), 'widget') ORDER BY p_retailprice DESC, p_partkey LIMIT 5")
def search_type_dispatch(spark, sf_dir):
    return lexicon.search_by(table(spark, sf_dir, "part"), "dhatu", "widget", ["p_name"], "p_name", ["p_name", "p_type"], "p_retailprice", "p_partkey", 5).select(*_PART.split(", "))


@query("SELECT p_partkey, p_name FROM part WHERE p_size = 7 ORDER BY p_partkey LIMIT 100")
def class_filter(spark, sf_dir):
    return lexicon.of_class(table(spark, sf_dir, "part"), "p_size", 7, "p_partkey").select("p_partkey", "p_name")


@query("SELECT p_size, count(*) AS n FROM part WHERE p_size IS NOT NULL GROUP BY 1")
def class_counts(spark, sf_dir):
    return lexicon.class_counts(table(spark, sf_dir, "part"), "p_size")


@query('SELECT c::INT AS "class", least(count(p_partkey), 1000) AS n FROM range(1, 11) AS r(c) LEFT JOIN part ON p_size = c GROUP BY 1')
def class_overview_zero_fill(spark, sf_dir):
    return lexicon.class_overview(table(spark, sf_dir, "part"), "p_size")


@query("SELECT l_orderkey, l_partkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F'")
def conjugation_filter(spark, sf_dir):
    return lexicon.conjugations(table(spark, sf_dir, "lineitem"), l_returnflag="R", l_linestatus="F", l_tax=None).select("l_orderkey", "l_partkey", "l_linenumber")


@query("SELECT o_orderkey, coalesce(string_agg(l_linenumber || ':' || l_partkey || ':' || l_suppkey, ',' ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice), '') AS lines FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def nested_conjugations(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    both = lexicon.nested(table(spark, sf_dir, "orders").select("o_orderkey"), lines, "o_orderkey", "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], ["l_linenumber", "l_partkey", "l_suppkey"], "lines")
    shown = F.transform("lines", lambda s: F.concat_ws(":", *[s[c].cast("string") for c in ("l_linenumber", "l_partkey", "l_suppkey")]))
    return both.select("o_orderkey", F.coalesce(F.array_join(shown, ","), F.lit("")).alias("lines"))


@query(
    """WITH r AS (SELECT * FROM (VALUES ('gam', 1, 'to go'), ('vac', 2, 'to speak'), ('as', 2, 'to be')) AS t(root, gana, meaning)), w AS (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'gam' WHEN 1 THEN 'vac' WHEN 2 THEN 'as' ELSE 'zzz' END AS lemma, p_size % 3 <> 0 AS verb FROM part)
SELECT p_partkey, lemma, coalesce(gana, 0) AS gana, meaning FROM w LEFT JOIN r ON verb AND lemma = root"""
)
def root_broadcast_lookup(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    lemma = F.element_at(F.array(*map(F.lit, ("gam", "vac", "as", "zzz"))), F.col("p_size") % 4 + 1)
    words = part.select("p_partkey", lemma.alias("lemma"), (F.col("p_size") % 3 != 0).alias("verb"))
    return lexicon.with_root(words, lexicon.common_roots(spark), "lemma", F.col("verb")).select("p_partkey", "lemma", F.coalesce("gana", F.lit(0)).alias("gana"), F.get("meanings", F.lit(0)).alias("meaning"))


@query("SELECT count(DISTINCT p_brand) AS categories, count(*) AS total FROM part")
def grammar_index(spark, sf_dir):
    entry = F.struct(F.col("p_name").alias("name"), F.col("p_type").alias("rule"))
    return lexicon.grammar_index(table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("category")).agg(F.collect_list(entry).alias("entries")))


# ---- training data


@query(VOTE + " SELECT doc_id, 'Parse: ' || text AS input, overall_confidence FROM s JOIN documents USING (doc_id) WHERE overall_confidence >= 0.85")
def training_filter(spark, sf_dir):
    docs = documents(spark, sf_dir)
    kept = training.confident(vote.summary(vote.sentences(docs, keep=("text",)), keep=("text",)), "overall_confidence", 0.85)
    return kept.select("doc_id", F.concat(F.lit("Parse: "), F.col("text")).alias("input"), "overall_confidence")


@query(
    r"""SELECT doc_id, to_json({'sandhi_groups': list_transform(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''), lambda x: {'surface_form': x,
'base_words': list_transform(list_filter(string_split_regex(x, '\s+'), lambda w: w <> ''), lambda w: {'lemma': w, 'morphology': 'noun-singular'})}), 'confidence': 0.5::DOUBLE})::VARCHAR AS output FROM documents"""
)
def grammar_format(spark, sf_dir):
    from corpusloom.operators import tree

    groups = tree.line_groups(F.col("text"))
    word = lambda w: F.struct(w.alias("lemma"), *[(F.lit({"pos": "noun", "number": "singular"}.get(f)).cast("string")).alias(f) for f in training.FIELDS], F.lit("").alias("dhatu"))
    shaped = F.transform(groups, lambda g: F.struct(g["surface"].alias("surface"), F.transform(g["words"], word).alias("words")))
    return documents(spark, sf_dir).select("doc_id", training.grammar_format(shaped, F.lit(0.5)).alias("output"))


@query("SELECT count(*) FILTER (event_id % 3 > 0) AS valid, count(*) FILTER (event_id % 3 = 0) AS invalid FROM events")
def validation_summary(spark, sf_dir):
    """Every third output has a word without its morphology."""
    word = F.when(F.col("event_id") % 3 == 0, F.lit("{}")).otherwise(F.lit('{"morphology": "noun"}'))
    output = F.concat(F.lit('{"sandhi_groups": [{"surface_form": "x", "base_words": [{"lemma": "a", "morphology": "verb"}, {"lemma": "b", "n": 1, "m": '), word, F.lit(", "), F.when(F.col("event_id") % 3 == 0, '"o": 1').otherwise('"morphology": "noun"'), F.lit("}]}]}"))
    return training.validation_summary(table(spark, sf_dir, "events").select(output.alias("output")), training.validation_errors(F.col("output")))


@query(VOTE + " SELECT count(*) AS total, round(avg(overall_confidence), 3)::DOUBLE AS average_confidence FROM s")
def training_stats(spark, sf_dir):
    return training.training_stats(vote.summary(vote.sentences(documents(spark, sf_dir))), "overall_confidence")


@query(
    """WITH p AS (SELECT o_custkey AS sentence_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS idx, o_totalprice AS c, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY sentence_id ORDER BY c DESC, idx) AS k FROM p WHERE n >= 2) SELECT sentence_id, idx::INT AS selected, n AS parses FROM r WHERE k = 1"""
)
def disambiguation_examples(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("sentence_id")).agg(F.sort_array(F.collect_list(F.struct("o_orderkey", F.col("o_totalprice").alias("confidence")))).alias("parses"))
    return training.disambiguation_examples(orders).select("sentence_id", "selected", F.size("parses").cast("long").alias("parses"))
