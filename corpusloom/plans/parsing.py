"""Queries of the parsers, decoders, grammar tables and validators over whole tables: every row of a table makes an input of its own."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions import morphology, prompts, translit
from corpusloom.functions.binding import once
from corpusloom.operators import analysis, lexicon, training
from corpusloom.session import shared_dir, table
from corpusloom.sources import corpus

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def nth(n: Column, values) -> Column:
    """The value at a row's number, round and round; None is null."""
    return F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (n % len(values) + 1).cast("int"))


def sql_nth(n: str, values) -> str:
    shown = ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values)
    return f"[{shown}][(({n}) % {len(values)} + 1)::INT]"


# ---- transliteration: customers' numbers as syllables

_CONSONANTS = ("k", "K", "c", "C", "w", "q", "t", "T", "d", "D", "n", "p", "B", "m", "y", "r", "l", "v", "S", "z", "s", "h", "R", "Y")
_C_DEVA = ("क", "ख", "च", "छ", "ट", "ड", "त", "थ", "द", "ध", "न", "प", "भ", "म", "य", "र", "ल", "व", "श", "ष", "स", "ह", "ण", "ञ")
_C_IAST = ("k", "kh", "c", "ch", "ṭ", "ḍ", "t", "th", "d", "dh", "n", "p", "bh", "m", "y", "r", "l", "v", "ś", "ṣ", "s", "h", "ṇ", "ñ")
_VOWELS = ("a", "A", "i", "I", "u", "U", "f", "e", "E", "o", "O")
_V_DEVA = ("", "ा", "ि", "ी", "ु", "ू", "ृ", "े", "ै", "ो", "ौ")
_V_IAST = ("a", "ā", "i", "ī", "u", "ū", "ṛ", "e", "ai", "o", "au")
_ENDS, _E_DEVA, _E_IAST = ("", "M", "H", "m", "t"), ("", "ं", "ः", "म्", "त्"), ("", "ṃ", "ḥ", "m", "t")
#: (factor, shift) of each syllable's consonant and vowel
_SYLLABLES = (((1, 0), (1, 3)), ((7, 5), (3, 1)), ((5, 11), (7, 2)))


def _spelled(c, v, e) -> str:
    parts = [x for (a, b), (p, q) in _SYLLABLES for x in (sql_nth(f"c_custkey * {a} + {b}", c), sql_nth(f"c_custkey * {p} + {q}", v))]
    return " || ".join([*parts, sql_nth("c_custkey", e)])


@query(f"SELECT c_custkey, {_spelled(_C_DEVA, _V_DEVA, _E_DEVA)} AS devanagari, {_spelled(_C_IAST, _V_IAST, _E_IAST)} AS iast, {_spelled(_CONSONANTS, _VOWELS, _ENDS)} AS from_devanagari, {_spelled(_CONSONANTS, _VOWELS, _ENDS)} AS from_iast FROM customer")
def transliterate_vectors(spark, sf_dir):
    n = F.col("c_custkey")
    parts = [x for (a, b), (p, q) in _SYLLABLES for x in (nth(n * a + b, _CONSONANTS), nth(n * p + q, _VOWELS))]
    rows = table(spark, sf_dir, "customer").select("c_custkey", once(F.concat(*parts, nth(n, _ENDS))).alias("slp1"))
    rows = rows.select("c_custkey", once(F.struct(translit.transliterate(F.col("slp1"), "slp1", "devanagari").alias("d"), translit.transliterate(F.col("slp1"), "slp1", "iast").alias("i"))).alias("s"))
    return rows.select("c_custkey", F.col("s.d").alias("devanagari"), F.col("s.i").alias("iast"), translit.transliterate(F.col("s.d"), "devanagari", "slp1").alias("from_devanagari"), translit.transliterate(F.col("s.i"), "iast", "slp1").alias("from_iast"))


# ---- morphology: order lines as tags

_GENDERS = ("masculine", "mas", "fem", "feminine", "neu", "neuter", None)
_NUMBERS = ("singular", "sg", "dual", "du", "plural", "pl")
_CASES = ("nominative", "acc", "instrumental", "dat", "ablative", "gen", "locative", "voc")
_KINDS = ("noun", "Noun", "ADJ", "verb", "subanta", None)
_TENSES, _VOICES = ("present", "imperf", "optative", "fut"), ("active", "atma", "passive")
_LINE = "l_orderkey * 7 + l_linenumber"


_TAG_SQL = f"""
t AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, {sql_nth(_LINE, _KINDS)} AS k, {_LINE} AS n FROM lineitem),
g AS (SELECT *, CASE lower(k) WHEN 'noun' THEN 'noun' WHEN 'adj' THEN 'adjective' WHEN 'verb' THEN 'verb' END AS pos, CASE WHEN lower(k) = 'verb' THEN concat_ws('.', 'verb', {sql_nth("n", ("3", "second", "first"))}, {sql_nth("n // 3", _NUMBERS)}, {sql_nth("n // 5", _TENSES)}, {sql_nth("n // 7", _VOICES)})
 ELSE concat_ws('.', k, {sql_nth("n // 2", _GENDERS)}, {sql_nth("n // 3", _NUMBERS)}, {sql_nth("n // 5", _CASES)}) END AS tag FROM t),
p AS (SELECT *, CASE WHEN pos IS NOT NULL AND pos <> 'verb' THEN CASE WHEN contains(tag, 'mas') OR contains(tag, 'm.') THEN 'masculine' WHEN contains(tag, 'fem') OR contains(tag, 'f.') THEN 'feminine' WHEN contains(tag, 'neu') OR contains(tag, 'n.') THEN 'neuter' END
  WHEN pos = 'verb' THEN CASE WHEN contains(tag, 'm.') THEN 'masculine' WHEN contains(tag, 'f.') THEN 'feminine' WHEN contains(tag, 'n.') THEN 'neuter' END END AS gender,
 CASE WHEN pos IS NULL THEN NULL WHEN contains(tag, 'singular') OR contains(tag, 'sg') THEN 'singular' WHEN contains(tag, 'du') THEN 'dual' WHEN contains(tag, 'pl') THEN 'plural' END AS number,
 CASE WHEN pos IN ('noun', 'adjective') THEN {sql_nth("n // 5", ("nominative", "accusative", "instrumental", "dative", "ablative", "genitive", "locative", "vocative"))} END AS cas,
 CASE WHEN pos = 'verb' THEN {sql_nth("n", ("third", "second", "first"))} END AS person, CASE WHEN pos = 'verb' THEN {sql_nth("n // 5", ("present", "imperfect", "potential", "future"))} END AS tense, CASE WHEN pos = 'verb' THEN {sql_nth("n // 7", ("active", "middle", "passive"))} END AS voice FROM g)"""


def _tags(spark, sf_dir):
    n = F.col("l_orderkey") * 7 + F.col("l_linenumber")
    over = lambda k: F.floor(n / k)
    kind = nth(n, _KINDS)
    verb = F.concat_ws(".", F.lit("verb"), nth(n, ("3", "second", "first")), nth(over(3), _NUMBERS), nth(over(5), _TENSES), nth(over(7), _VOICES))
    tag = F.when(F.lower(kind) == "verb", verb).otherwise(F.concat_ws(".", kind, nth(over(2), _GENDERS), nth(over(3), _NUMBERS), nth(over(5), _CASES)))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", once(F.struct(tag.alias("tag"), kind.alias("kind"))).alias("t"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", once(morphology.parsed(F.col("t.tag"), F.col("t.kind"))).alias("m"))


@query(f'WITH {_TAG_SQL} SELECT l_orderkey, l_linenumber, l_partkey, pos, gender, number, cas AS "case", person, tense, voice FROM p')
def morphology_parse(spark, sf_dir):
    return _tags(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", *[F.col("m")[c].alias(c) for c in ("pos", "gender", "number", "case", "person", "tense", "voice")])


@query(f"WITH {_TAG_SQL} SELECT l_orderkey, l_linenumber, l_partkey, concat_ws('.', pos, gender[1:3], number[1:2], cas[1:3], person[1:1] || 'p', tense[1:4], voice[1:3]) AS tag FROM p")
def morph_to_string(spark, sf_dir):
    return _tags(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", morphology.tag_string(F.col("m")).alias("tag"))


_KV = (("Tense=Present, Mood=Indicative, Person=3, Number=Sing", "verb", "verb.pres.ind.p3.si"), ("Case=Nominative,Gender=Masc", "noun", "noun.nom.mas"), ("Degree=Cmp", "adjective", "adjective"), ("junk", None, ""), ("case=a=b, Case = Loc", "noun", "noun.loc"))


@query(f"SELECT p_partkey, {sql_nth('p_partkey', [x[1] for x in _KV])} AS pos, {sql_nth('p_partkey', [x[2] for x in _KV])} AS tag, p_type AS own FROM part")
def tag_decode_kv(spark, sf_dir):
    """Tags with a part's type as a further key, which is read back."""
    given = F.concat(nth(F.col("p_partkey"), [x[0] for x in _KV]), F.lit(", Own ="), F.col("p_type"))
    rows = table(spark, sf_dir, "part").select("p_partkey", once(given).alias("given")).select("p_partkey", once(morphology.key_values(F.col("given"))).alias("t"))
    return rows.select("p_partkey", morphology.kv_pos(F.col("t")).alias("pos"), morphology.kv_tag(F.col("t")).alias("tag"), F.col("t")["own"].alias("own"))


_LINGA, _VIBHAKTI, _VACANA, _PURUSHA, _LAKARA = ("Pum", "Stri", "Napumsaka"), ("Prathama", "Dvitiya", "Trtiya", "Caturthi", "Pancami", "Sasthi", "Saptami"), ("Eka", "Dvi", "Bahu"), ("Prathama", "Madhyama", "Uttama"), ("Lat", "Lit", "Lot", "Lan", "Lun")


@query(
    f"""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN concat_ws('.', 'subanta', {sql_nth('p_size', ('mas', 'fem', 'neu'))}, {sql_nth('p_partkey // 3', ('pra', 'dvi', 'trt', 'cat', 'pan', 'sas', 'sap'))}, {sql_nth('p_partkey', ('si', 'du', 'pl'))})
 WHEN 1 THEN concat_ws('.', 'tinanta', {sql_nth('p_partkey // 5', ('si', 'du', 'pl'))}, {sql_nth('p_size', ('thi', 'sec', 'fir'))}, {sql_nth('p_partkey', ('lat', 'lit', 'lot', 'lan', 'lun'))}) ELSE '' END AS tag,
 CASE WHEN p_partkey % 3 = 1 THEN {sql_nth('p_size', morphology.GANAS)} END AS gana FROM part"""
)
def tag_decode_native(spark, sf_dir):
    k, size = F.col("p_partkey"), F.col("p_size")
    three = F.floor(k / 3)
    noun = F.concat(F.lit("Subanta(Linga."), nth(size, _LINGA), F.lit(", Vibhakti."), nth(three, _VIBHAKTI), F.lit(", Vacana."), nth(k, _VACANA), F.lit(")"))
    verb = F.concat(F.lit("Tinanta(Lakara."), nth(k, _LAKARA), F.lit(", Purusha."), nth(size, _PURUSHA), F.lit(", Vacana."), nth(F.floor(k / 5), _VACANA), F.lit(", Gana."), nth(size, morphology.GANA_TAGS), F.lit(")"))
    data = F.when(k % 3 == 0, noun).when(k % 3 == 1, verb).otherwise("Avyaya")
    rows = table(spark, sf_dir, "part").select("p_partkey", once(data).alias("data")).select("p_partkey", once(morphology.decoded(F.col("data"))).alias("d"))
    return rows.select("p_partkey", morphology.decoded_tag(F.col("d")).alias("tag"), F.when(F.col("d.gana").isNotNull(), morphology.gana_name(F.col("d.gana"))).alias("gana"))


# ---- rules of grammar: parts as rules


def _sutras(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return part.select((F.col("p_size") % 8 + 1).cast("int").alias("adhyaya"), (F.col("p_partkey") % 4 + 1).cast("int").alias("pada"), F.col("p_partkey").alias("number"), F.col("p_name").alias("text"), F.col("p_type").alias("meaning"), F.col("p_brand").alias("transliteration"))


@query("SELECT concat_ws('.', p_size % 8 + 1, p_partkey % 4 + 1, p_partkey) AS reference, p_brand AS transliteration FROM part WHERE contains(lower(p_name), 'econ') OR contains(lower(p_type), 'econ') OR contains(lower(p_brand), 'econ')")
def sutra_search(spark, sf_dir):
    return lexicon.sutra_search(_sutras(spark, sf_dir), "Econ").select("reference", "transliteration")


@query("SELECT p_partkey AS number, p_name AS text, p_type AS meaning, p_brand AS transliteration FROM part WHERE p_size % 8 = 0 AND p_partkey % 4 = 1")
def sutra_section(spark, sf_dir):
    return lexicon.sutra_section(_sutras(spark, sf_dir), 1, 2).select("number", "text", "meaning", "transliteration")


@query("SELECT count(DISTINCT p_size % 8) AS adhyayas, count(DISTINCT (p_size % 8, p_partkey % 4)) AS padas, count(*) AS total_sutras FROM part")
def sutra_overview(spark, sf_dir):
    return lexicon.sutra_overview(_sutras(spark, sf_dir))


@query("SELECT p_brand AS category, (row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1)::INT AS n, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_name END AS name, CASE WHEN p_partkey % 3 = 0 THEN p_type ELSE p_type || ' ' || p_partkey END AS rule FROM part")
def yaml_scan(spark, sf_dir):
    """Parts as grammar files, one for each brand, written and read."""
    entry = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("    - "), "p_type")).otherwise(F.concat(F.lit("    - {name: "), "p_name", F.lit(", rule: "), "p_type", F.lit(" "), F.col("p_partkey").cast("string"), F.lit("}")))
    listed = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.sort_array(F.collect_list(F.struct("p_partkey", entry.alias("e")))).alias("l"))
    text = F.concat(F.lit("description: rules\ncategories:\n  '"), "p_brand", F.lit("':\n"), F.array_join(F.transform("l", lambda x: x["e"]), "\n"), F.lit("\n"))
    path = f"{shared_dir(spark)}/rules-{uuid.uuid4().hex}"
    listed.select(F.col("p_brand").alias("brand"), text.alias("value")).write.partitionBy("brand").text(path)
    return lexicon.flattened(corpus.read_sections(spark, path)).select("category", "n", "name", "rule")


# ---- outputs, answers and addresses: events make them

_OUTPUTS = (
    ('{"sandhi_groups": [{"surface_form": "a", "base_words": [{"lemma": "%", "morphology": "noun"}]}]}', ""), ('{"id": "%"}', "Missing required field: sandhi_groups"), ('{"sandhi_groups": "%"}', "sandhi_groups must be an array"),
    ('{"sandhi_groups": [{"base_words": [{"lemma": "%"}, {"morphology": "b"}]}, {"surface_form": "x"}]}', "Group 0: missing surface_form|Group 0, word 0: missing morphology|Group 0, word 1: missing lemma|Group 1: missing base_words"),
    ('{"sandhi_groups": [{"surface_form": "%", "base_words": 3}]}', "Group 0: base_words must be an array"), ('{"sandhi_groups": []}', ""), ("not json %", "Invalid JSON"),
)


def _outputs(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.replace(nth(F.col("event_id"), [x[0] for x in _OUTPUTS]), F.lit("%"), F.concat("event_type", F.col("event_id").cast("string"))).alias("output"))


@query(f"SELECT event_id, {sql_nth('event_id', [x[1] for x in _OUTPUTS])} AS errors FROM events")
def format_validate(spark, sf_dir):
    return _outputs(spark, sf_dir).select("event_id", F.array_join(training.validation_errors(F.col("output")), "|").alias("errors"))


@query(f"SELECT event_id AS line, place::INT AS place, 'Line ' || event_id || ': ' || e AS message FROM (SELECT event_id, unnest(es) AS e, unnest(range(len(es))) AS place FROM (SELECT event_id, list_filter(string_split({sql_nth('event_id', [x[1] for x in _OUTPUTS])}, '|'), lambda x: x <> '') AS es FROM events)) ORDER BY 1, 2 LIMIT 20")
def validation_first_errors(spark, sf_dir):
    return training.first_errors(_outputs(spark, sf_dir).withColumnRenamed("event_id", "line"), "line", training.validation_errors(F.col("output")))


_ANSWERS = (
    ('I think {"ranking": [1, 0], "explanation": "%"} is best', None, "1,0"), ("no braces at all, %", "No JSON found in response", None), ('{"ranking": [5, 10], "explanation": "%"}', "No valid indices in ranking", None), ('{"ranking": [0, 99, 1], "explanation": "%"}', None, "0,1"),
    ('{"ranking": "%"}', "Ranking is not a list", None), ('{"ranking": [0, "%" }', "JSON parse error", None), ('{"explanation": "%"}', "No valid indices in ranking", None), ('text {"ranking": ["%", 2.0, 1]} more', None, "2,1"),
)


@query(f"SELECT event_id, {sql_nth('event_id', [x[1] for x in _ANSWERS])} IS NULL AS success, {sql_nth('event_id', [x[1] for x in _ANSWERS])} AS error, {sql_nth('event_id', [x[2] for x in _ANSWERS])} AS ranking FROM events")
def llm_response_parse(spark, sf_dir):
    response = F.replace(nth(F.col("event_id"), [x[0] for x in _ANSWERS]), F.lit("%"), F.concat("event_type", F.col("event_id").cast("string")))
    n = F.when(F.col("event_id") % len(_ANSWERS) >= 6, 3).otherwise(2)
    rows = table(spark, sf_dir, "events").select("event_id", once(prompts.parsed_response(response, n)).alias("p"))
    return rows.select("event_id", "p.success", "p.error", F.array_join("p.ranking", ",").alias("ranking"))


_ADDRESSES = (
    ("dhatu://overview", "root_overview", None), ("dhatu://gana/%", "class", "%"), ("dhatu://gana/x%", "invalid", None), ("dhatu://gam%", "root", "gam%"), ("dhatu://gam%/conjugations", "conjugations", "gam%"),
    ("grammar://sandhi-rules", "index", "sandhi-rules"), ("grammar://sandhi-rules/vowel", "category", "vowel"), ("grammar://pratyayas/krt", "category", "krt"), ("grammar://sutras", "sutra_overview", None),
    ("grammar://sutras/1/%", "sutra_section", "1/%"), ("grammar://sutras/a/%", "invalid", None), ("grammar://sutras/search?q=guna%", "sutra_search", "guna%"), ("grammar://other%", "unknown", None),
)


@query(f"SELECT event_id, {sql_nth('event_id', [x[1] for x in _ADDRESSES])} AS kind, replace({sql_nth('event_id', [x[2] for x in _ADDRESSES])}, '%', event_id::VARCHAR) AS argument FROM events")
def uri_routing(spark, sf_dir):
    uri = F.replace(nth(F.col("event_id"), [x[0] for x in _ADDRESSES]), F.lit("%"), F.col("event_id").cast("string"))
    return table(spark, sf_dir, "events").select("event_id", once(lexicon.routed(uri)).alias("r")).select("event_id", "r.*")


@query("SELECT event_type AS component, coalesce(arg_max(CASE WHEN event_id % 7 = 0 THEN 'null' WHEN value > 100 THEN 'up' ELSE 'down' END, event_id) = 'up', false) AS healthy, count(*) AS checks, count(*) FILTER (event_id % 7 = 0 OR NOT value > 100 OR value IS NULL) AS failures FROM events GROUP BY 1")
def health_rollup(spark, sf_dir):
    """Events as checks of components; a check that couldn't tell is a failure, and the last one decides."""
    checks = table(spark, sf_dir, "events").select(F.col("event_type").alias("component"), "event_id", F.when(F.col("event_id") % 7 != 0, F.col("value") > 100).alias("up"))
    return analysis.health_of(checks, "component", "event_id", "up")
