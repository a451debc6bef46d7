"""Known inputs of the parsers, decoders, grammar tables and validators, each with what is expected."""

from pyspark.sql import functions as F

from corpusloom.functions import morphology, prompts, text, translit
from corpusloom.operators import lexicon, rules, training, tree

# fixed values: inputs with their results
VECTORS = [
    ("राम", "devanagari", "iast", "rāma"), ("राम", "devanagari", "slp1", "rAma"), ("rāma", "iast", "devanagari", "राम"), ("rāma", "iast", "slp1", "rAma"), ("rAma", "slp1", "devanagari", "राम"), ("rAma", "slp1", "iast", "rāma"),
    ("राम", "devanagari", "devanagari", "राम"), ("", "devanagari", "iast", ""), ("   ", "devanagari", "iast", "   "), ("योगश्चित्तवृत्तिनिरोधः", "devanagari", "iast", "yogaścittavṛttinirodhaḥ"),
    ("योगश्चित्तवृत्तिनिरोधः", "devanagari", "slp1", "yogaScittavfttiniroDaH"), ("yogaScittavfttiniroDaH", "slp1", "devanagari", "योगश्चित्तवृत्तिनिरोधः"), ("rAmaH gacchati", "hk", "slp1", "rAmaH gacCati"), ("raamaH", "itrans", "iast", "rāmaḥ"), ("raama.h", "velthuis", "slp1", "rAmaH"),
]
TAGS = [
    ("noun.masculine.singular.nominative", "noun", "noun", "masculine", "singular", "nominative", None, None, None, "noun.mas.si.nom"),
    ("verb.third.singular.present.active", "verb", "verb", None, "singular", None, "third", "present", "active", "verb.si.tp.pres.act"),
    ("noun.si.nom.fem", "noun", "noun", "masculine", None, "nominative", None, None, None, "noun.mas.nom"),
    ("noun.si.acc.neu", "noun", "noun", "neuter", None, "accusative", None, None, None, "noun.neu.acc"),
    ("noun.pl.gen.mas", "noun", "noun", "masculine", "plural", "genitive", None, None, None, "noun.mas.pl.gen"),
    ("verb.1.dual.imperfect.atmanepada", "Verb", "verb", None, "dual", None, "first", "imperfect", "middle", "verb.du.fp.impe.mid"),
    (None, "adv", "adverb", None, None, None, None, None, None, "adverb"),
    ("subanta.mas", "subanta", None, None, None, None, None, None, None, ""),
]
KV = [("Tense=Present, Mood=Indicative, Person=3, Number=Sing", "verb", "verb.pres.ind.p3.si"), ("Case=Nominative,Gender=Masc", "noun", "noun.nom.mas"), ("Degree=Cmp", "adjective", "adjective"), ("junk", None, ""), ("case=a=b, Case = Loc", "noun", "noun.loc")]
NATIVE = [("Subanta(Linga.Pum, Vibhakti.Prathama, Vacana.Eka)", "subanta.mas.pra.si", None), ("Tinanta(Lakara.Lat, Purusha.Prathama, Vacana.Bahu, Gana.Bhvadi)", "tinanta.pl.thi.lat", "bhvādi"), ("Avyaya", "", None), ("Tinanta(Gana.Curadi, Purusha.Uttama)", "tinanta.fir", "curādi")]
SUTRAS = [(1, 1, 1, "वृद्धिरादैच्", "ā ai au are called vṛddhi", "vṛddhirādaic"), (1, 1, 2, "अदेङ्गुणः", "a e o are called guṇa", "adeṅguṇaḥ"), (1, 1, 3, "इको गुणवृद्धी", "guṇa and vṛddhi replace i u ṛ ḷ", "iko guṇavṛddhī"), (6, 1, 77, "इको यणचि", "semivowels replace i u ṛ ḷ before vowels", "iko yaṇaci")]
OUTPUTS = [
    ('{"sandhi_groups": [{"surface_form": "a", "base_words": [{"lemma": "a", "morphology": "noun"}]}]}', ""), ("{}", "Missing required field: sandhi_groups"), ('{"sandhi_groups": "x"}', "sandhi_groups must be an array"),
    ('{"sandhi_groups": [{"base_words": [{"lemma": "a"}, {"morphology": "b"}]}, {"surface_form": "x"}]}', "Group 0: missing surface_form|Group 0, word 0: missing morphology|Group 0, word 1: missing lemma|Group 1: missing base_words"),
    ('{"sandhi_groups": [{"surface_form": "a", "base_words": 3}]}', "Group 0: base_words must be an array"), ('{"sandhi_groups": []}', ""), ("not json", "Invalid JSON"),
]
URIS = [
    ("dhatu://overview", "root_overview", None), ("dhatu://gana/7", "class", "7"), ("dhatu://gana/x", "invalid", None), ("dhatu://gam", "root", "gam"), ("dhatu://gam/conjugations", "conjugations", "gam"),
    ("grammar://sandhi-rules", "index", "sandhi-rules"), ("grammar://sandhi-rules/vowel", "category", "vowel"), ("grammar://pratyayas/krt", "category", "krt"), ("grammar://sutras", "sutra_overview", None),
    ("grammar://sutras/1/2", "sutra_section", "1/2"), ("grammar://sutras/a/2", "invalid", None), ("grammar://sutras/search?q=guna", "sutra_search", "guna"), ("grammar://other", "unknown", None),
]
RESPONSES = [
    ('I think {"ranking": [1, 0], "explanation": "x"} is best', 2), ("no braces at all", 2), ('{"ranking": [5, 10], "explanation": "test"}', 2), ('{"ranking": [0, 99, 1], "explanation": "test"}', 2),
    ('{"ranking": "first"}', 2), ('{"ranking": [0, }', 2), ('{"explanation": "none"}', 3), ('text {"ranking": ["a", 2.0, 1]} more', 3),
]
RANKED = [(True, None, [1, 0]), (False, "No JSON found in response", None), (False, "No valid indices in ranking", None), (True, None, [0, 1]), (False, "Ranking is not a list", None), (False, "JSON parse error", None), (False, "No valid indices in ranking", None), (True, None, [2, 1])]


def rows_of(spark, rows, schema):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, " + schema)


def in_order(df):
    return [tuple(r)[1:] for r in df.orderBy("id").collect()]


def test_transliteration_vectors(spark):
    rows = rows_of(spark, [v[:3] for v in VECTORS], "text string, source string, target string")
    result = F.coalesce(*[F.when((F.col("source") == a) & (F.col("target") == b), translit.transliterate(F.col("text"), a, b)) for a, b in sorted({v[1:3] for v in VECTORS})])
    assert in_order(rows.select("id", result)) == [(v[3],) for v in VECTORS]


def test_tags(spark):
    rows = rows_of(spark, [t[:2] for t in TAGS], "tag string, pos string").withColumn("m", morphology.parsed(F.col("tag"), F.col("pos")))
    fields = ("pos", "gender", "number", "case", "person", "tense", "voice")
    assert in_order(rows.select("id", *[F.col("m")[c] for c in fields], morphology.tag_string(F.col("m")))) == [t[2:] for t in TAGS]
    verbs = rows.select("id", morphology.is_verb(F.col("pos"), F.col("m.pos")))
    assert [v for (v,) in in_order(verbs)] == [False, True, False, False, False, True, False, False]
    assert [v for (v,) in in_order(rows_of(spark, [("v",), ("tiṅanta",), ("noun",), (None,)], "p string").select("id", morphology.is_verb(F.col("p"), F.lit(None).cast("string"))))] == [True, True, False, False]


def test_decoders(spark):
    tags = morphology.key_values(F.col("tag"))
    assert in_order(rows_of(spark, [t[:1] for t in KV], "tag string").select("id", morphology.kv_pos(tags), morphology.kv_tag(tags))) == [t[1:] for t in KV]
    rows = rows_of(spark, [t[:1] for t in NATIVE], "data string").withColumn("d", morphology.decoded(F.col("data")))
    assert in_order(rows.select("id", morphology.decoded_tag(F.col("d")), F.when(F.col("d.gana").isNotNull(), morphology.gana_name(F.col("d.gana"))))) == [t[1:] for t in NATIVE]


def test_rules_of_grammar(spark):
    rows = spark.createDataFrame(SUTRAS, "adhyaya int, pada int, number int, text string, meaning string, transliteration string")
    assert {r.reference for r in lexicon.sutra_search(rows, "Guṇa").collect()} == {"1.1.2", "1.1.3"}
    assert [r.number for r in lexicon.sutra_section(rows, 1, 1).collect()] == [1, 2, 3] and lexicon.sutra_section(rows, 9, 9).count() == 0
    assert tuple(lexicon.sutra_overview(rows).first()) == (2, 2, 4)


def test_outputs_answers_and_addresses(spark):
    errors = rows_of(spark, [o[:1] for o in OUTPUTS], "output string").select("id", F.array_join(training.validation_errors(F.col("output")), "|"))
    assert in_order(errors) == [o[1:] for o in OUTPUTS]
    p = prompts.parsed_response(F.col("response"), F.col("n"))
    answers = rows_of(spark, RESPONSES, "response string, n int").select("id", p.alias("p")).select("id", "p.success", "p.error", "p.ranking")
    assert in_order(answers) == RANKED
    assert in_order(rows_of(spark, [u[:1] for u in URIS], "uri string").select("id", lexicon.routed(F.col("uri")).alias("r")).select("id", "r.*")) == [u[1:] for u in URIS]


def test_small_functions_of_keys_and_flags(spark):
    row = spark.createDataFrame([("rAma", 3, {"a": 0.4, "b": 0.6})], "t string, n int, votes map<string,double>")
    got = row.select(
        text.sentence_id(F.col("t")).alias("s"), text.parse_id(F.col("t"), F.lit(0)).alias("p0"), text.parse_id(F.col("t"), F.lit(1)).alias("p1"), text.lexicon_url("http://x/?t=", F.lit("a b&ā")).alias("url"),
        tree.flagged(F.col("votes")).alias("flags"), rules.is_ambiguous(F.lit(2), F.lit(0.89)).alias("a"), rules.is_ambiguous(F.lit(1), F.lit(0.1)).alias("b"), rules.is_ambiguous(F.lit(2), F.lit(0.9)).alias("c"),
        *[tree.selected_by_hand(F.col("n"), F.lit(i)).alias(f"h{i}") for i in (0, 2, 3)], tree.selected_by_hand(F.col("n"), F.lit(-1)).alias("h"), translit.variants(F.col("t")).alias("v"),
    ).first()
    import hashlib

    assert got.s == "sent_" + hashlib.sha256(b"rAma").hexdigest()[:8] and got.p0 != got.p1 and got.p0 == "parse_" + hashlib.sha256(b"rAma#0").hexdigest()[:12]
    assert got.url == "http://x/?t=a+b%26%C4%81" and got.flags == {"a": False, "b": True} and (got.a, got.b, got.c) == (True, False, False)
    assert (got.h0, got.h2, got.h3, got.h) == ("human", "human", None, None) and got.v.slp1 is not None


def test_best_of_an_array_of_parses(spark):
    rows = spark.createDataFrame([(1, [0.2, 0.7, 0.7], None), (2, [0.2, 0.7], 0), (3, [0.2, 0.7], 9), (4, [], 0), (5, [0.0], None)], "id int, cs array<double>, selected int")
    parses = F.transform("cs", lambda c, i: F.struct(i.alias("at"), c.alias("confidence")))
    got = rows.select("id", tree.best_of(parses, F.col("selected")).alias("b")).orderBy("id").collect()
    assert [r.b and r.b["at"] for r in got] == [1, 0, 1, None, 0]


def test_replacements_read_as_look_ups_do(spark):
    """Names replaced one after the other against a longest-first reading, on random runs of all signs."""
    import random

    rng = random.Random(6)
    for scheme, table in translit.TO_SLP1.items():
        back = {}
        for latin, slp1 in table.items():
            back.setdefault(slp1, latin)
        for pairs in (table, back):
            signs = [*pairs, *{c for k in pairs for c in k}, " ", "\n", "ā", "X", "1"]
            rows = spark.createDataFrame([("".join(rng.choice(signs) for _ in range(rng.randrange(30))),) for _ in range(300)], "t string")
            got = rows.select("t", translit._read(F.col("t"), pairs).alias("a"), translit._mapped(F.col("t"), translit._longest(pairs), pairs).alias("b")).collect()
            assert all(r.a == r.b for r in got), scheme
    assert translit._apart(translit.TO_SLP1["iast"]) and not translit._apart({"ab": "x", "bc": "y"}) and not translit._apart({"a": "b", "b": "c"}) and not translit._apart({"aa": "x"})
