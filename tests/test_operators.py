"""Golden cases of the operators and their edges."""

import pytest
from pyspark.sql import functions as F

from corpusloom.config import Options
from corpusloom.functions import morphology, prompts, text, translit
from corpusloom.operators import analysis, diff, lexicon, producers, rules, store, training, tree, vote
from corpusloom.sources import corpus
from corpusloom.streaming import corpus_stream

SEGMENTS = "sentence_id long, engine string, engine_rank int, pos int, surface string, lemma string, morphology string, pos_tag string, confidence double, meanings array<string>"


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def segments(spark, rows):
    return spark.createDataFrame([(1, e, r, 0, "s", lemma, m, p, c, meanings) for e, r, lemma, m, p, c, meanings in rows], SEGMENTS)


def test_vote_all_agree(spark):
    r = one(vote.merge_segments(segments(spark, [(e, i, "gam", "", "verb", 0.9, None) for i, e in enumerate(("vidyut", "dharmamitra", "heritage"))])))
    assert (r.lemma, r.agreement, r.pos_tag, r.morphology) == ("gam", 1.0, "verb", None) and abs(r.confidence - 0.9) < 1e-12


def test_vote_partial_weighted_and_ties(spark):
    r = one(vote.merge_segments(segments(spark, [("x", 0, "lemma1", None, None, 0.9, ["b"]), ("y", 1, "lemma1", None, None, 0.9, ["a"]), ("z", 2, "lemma2", "m", None, 0.9, ["a"])])))
    assert r.lemma == "lemma1" and abs(r.agreement - 2 / 3) < 1e-12 and r.meanings == ["a", "b"] and r.morphology == "m"
    r = one(vote.merge_segments(segments(spark, [("a", 0, "b", None, None, 0.9, None), ("b", 1, "a", None, None, 0.5, None)]), {"a": 0.7, "b": 0.3}))
    assert r.lemma == "b" and r.agreement == 0.5 and abs(r.confidence - 0.78) < 1e-12


def test_level_boundary_is_medium(spark):
    assert value(spark, vote.level(F.lit(7 * vote.PARTS), F.lit(10))) == "medium"
    assert value(spark, vote.level(F.lit(0), F.lit(0))) == "low"


def test_vote_of_blank_and_null_text(spark):
    docs = spark.createDataFrame([(1, None), (2, "  "), (3, "Going home")], "doc_id long, text string")
    rows = {r.doc_id: r for r in vote.summary(vote.sentences(docs)).collect()}
    assert rows[1].n_segments == rows[2].n_segments == 0 and rows[1].agreement_level == "low" and rows[3].n_segments == 2


def test_registry_keeps_weights():
    own = producers.Registry()
    own.add(producers.Producer("stem", 1, 50, producers.surface))
    assert own.chosen(["stem"])[0].weight == 40 and own.remove("stem") and not own.remove("stem")
    with pytest.raises(ValueError, match="No engines"):
        own.chosen(["nobody"])


CANDIDATES = "sentence_id long, idx int, confidence double, segments array<struct<lemma:string,pos:string,gender:string,number:string,case:string,sandhi_type:string>>"


def candidates(spark, rows):
    return spark.createDataFrame(rows, CANDIDATES)


def test_agreement_rule_and_its_guard(spark):
    adj = lambda g: ("sundara", "adj", g, "sg", None, None)
    noun = ("nara", "noun", "masc", "sg", "nom", None)
    own = candidates(spark, [(1, 0, 0.9, [adj("masc"), noun]), (1, 1, 0.8, [adj("fem"), noun]), (2, 0, 0.9, [adj("fem"), noun]), (2, 1, 0.9, [noun, adj("neut")]), (3, 0, 0.5, [])])
    assert sorted((r.sentence_id, r.idx) for r in rules.agreement(own).collect()) == [(1, 0), (2, 0), (2, 1), (3, 0)]


def test_frequency_and_sandhi_figures(spark):
    seg = lambda lemma, s=None: [(lemma, None, None, None, None, s)]
    own = candidates(spark, [(1, 0, 0.8, seg("gam")), (1, 1, 0.8, seg("xyz_rare"))])
    got = {r.idx: r.confidence for r in rules.frequency(own).collect()}
    assert abs(got[0] - 0.85) < 1e-12 and abs(got[1] - 0.81875) < 1e-12
    got = {r.idx: r.confidence for r in rules.frequency(own, custom={"xyz_rare": 0.95}).collect()}
    assert abs(got[1] - 0.85) < 1e-12
    own = candidates(spark, [(1, 0, 0.8, seg("a", "vowel")), (1, 1, 0.8, seg("a", "exotic")), (2, 0, 0.4, seg("a", "vowel"))])
    got = {(r.sentence_id, r.idx): r.confidence for r in rules.sandhi(own).collect()}
    assert abs(got[1, 0] - 0.83) < 1e-12 and abs(got[1, 1] - 0.785) < 1e-12 and got[2, 0] == 0.4


def test_rule_set_limits_and_switches(spark):
    own = candidates(spark, [(1, i, 0.2 + 0.1 * i, []) for i in range(8)])
    chain = rules.RuleSet()
    assert chain.enable("frequency_preference", False) and not chain.enable("nothing") and chain.summary()[1] == ("frequency_preference", False)
    got = [(r.idx, r["rank"]) for r in chain.apply(own).orderBy("rank").collect()]
    assert got == [(7, 1), (6, 2), (5, 3), (4, 4), (3, 5)]


def test_ranking_reorder(spark):
    own = candidates(spark, [(1, i, 0.5, []) for i in range(4)])
    ranking = spark.createDataFrame([(1, [2, 0, 2, 9])], "sentence_id long, ranking array<int>")
    assert [r.idx for r in rules.reordered(own, ranking).orderBy("place").collect()] == [2, 0, 1, 3]


def test_script_and_punctuation(spark):
    for t, script in (("राम", "devanagari"), ("rāma", "iast"), ("rama", "iast"), ("rAma", "iast"), ("gacCatI", "slp1"), ("rAmaH", "slp1"), ("kfzRa", "slp1"), ("  ", "slp1"), ("", "slp1")):
        assert value(spark, text.detect_script(F.lit(t))) == script, t
    assert value(spark, text.remove_punctuation(F.lit("रामः। १२ गच्छति॥ (12), ok!"))) == "रामः गच्छति ok"
    assert value(spark, text.percent(F.lit(0.29))) == 28


@pytest.mark.parametrize("line", ["योगश्चित्तवृत्तिनिरोधः", "धर्मक्षेत्रे कुरुक्षेत्रे समवेता युयुत्सवः", "सोऽहम्"])
def test_devanagari_round_trip(spark, line):
    there = translit.transliterate(F.lit(line), "devanagari", "slp1")
    assert value(spark, translit.transliterate(there, "slp1", "devanagari")) == line
    iast = translit.transliterate(F.lit(line), "devanagari", "iast")
    assert value(spark, translit.transliterate(iast, "iast", "devanagari")) == line


def test_unknown_script_fails(spark):
    with pytest.raises(ValueError, match="unknown script"):
        translit.transliterate(F.lit("x"), "klingon", "slp1")


def test_response_of_missing_ranking(spark):
    r = value(spark, prompts.parsed_response(F.lit('{"ranking": [1.0, 0]}'), F.lit(2)))
    assert r["success"] and r["ranking"] == [1, 0]


def test_key_values_keep_the_last(spark):
    assert value(spark, morphology.key_values(F.lit("A=1, a=2,b = c=d,x"))) == {"a": "2", "b": "c=d"}
    assert value(spark, morphology.key_values(F.lit(""))) == {}


def test_best_parse_prefers_the_selected(spark):
    rows = spark.createDataFrame([(1, 0, 0.5, 1), (1, 1, 0.4, 1), (2, 0, 0.5, None), (2, 1, 0.5, None)], "s long, idx int, c double, sel int")
    assert {r.s: r.idx for r in tree.best_parse(rows, "s", "idx", "c", "sel").collect()} == {1: 1, 2: 0}
    assert {r.s: r.idx for r in tree.best_parse(rows, "s", "idx", "c").collect()} == {1: 0, 2: 0}


def test_row_diff_pads(spark):
    assert value(spark, diff.row_diff(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("a"), F.lit("c"), F.lit("d")))) == ["same", "lemma", "only_right"]


def test_lru_equals_an_ordered_dict(spark):
    from collections import OrderedDict

    keys = [(i * 7 + i // 3) % 11 for i in range(200)]
    rows = spark.createDataFrame([(i, i % 2, k) for i, k in enumerate(keys)], "at long, shard int, k int")
    got = {r["at"]: r["hit"] for r in store.lru(rows, "shard", "k", "at", 4).collect()}
    want, caches = {}, {0: OrderedDict(), 1: OrderedDict()}
    for i, k in enumerate(keys):
        c = caches[i % 2]
        want[i] = k in c
        c[k] = 1
        c.move_to_end(k)
        if len(c) > 4:
            c.popitem(last=False)
    assert got == want


def test_search_dispatch(spark):
    rows = spark.createDataFrame([(1, "gam", "to go", 5), (2, "x", "gam like", 9)], "id long, root string, meaning string, f int")
    ask = lambda kind, q: [r.id for r in lexicon.search_by(rows, kind, q, ["root"], "meaning", ["root", "meaning"], "f", "id", 5).collect()]
    assert ask("dhatu", "gam") == [1] and ask("dhatu", "like") == [2] and ask("all", "gam") == [2, 1] and ask("meaning", "GO") == [1]
    with pytest.raises(ValueError, match="unknown search"):
        ask("other", "x")
    with pytest.raises(ValueError, match="class"):
        lexicon.of_class(rows, "f", 11, "id")


def test_corpus_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("# head\n one \n\ntwo\n")
    assert [(r.verse, r.text) for r in corpus.read_corpus(spark, str(tmp_path / "a.txt")).orderBy("verse").collect()] == [(1, "one"), (2, "two")]
    (tmp_path / "b.json").write_text('{"corpus": "gita", "verses": ["x", {"verse": "y", "chapter": "2"}, {"note": 1}, {"text": "z", "verse": "no"}]}')
    rows = corpus.read_corpus(spark, str(tmp_path / "b.json")).orderBy("verse").collect()
    assert [(r.text, r.corpus, r.chapter, r.verse) for r in rows] == [("x", "gita", None, 1), ("y", "gita", "2", 2), ("z", "gita", None, 4)]
    (tmp_path / "c.jsonl").write_text('{"a": 1}\nbad\n\n')
    assert [(r.a, r.bad) for r in corpus.read_jsonl(spark, str(tmp_path / "c.jsonl"), "a int").collect()] == [(1, False), (None, True)]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        corpus.read_corpus(spark, str(tmp_path / "none.txt")).collect()


def test_jsonl_round_trip(spark, tmp_path):
    training.write_jsonl(spark.createDataFrame([(1, "a")], "n int, t string"), str(tmp_path / "out"))
    assert corpus.read_jsonl(spark, str(tmp_path / "out"), "n int, t string").collect()[0].t == "a"


def test_ttl_stream(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 00:00:00", "a"), ("2024-01-03 00:00:00", "a"), ("2024-01-20 00:00:00", "a")], "ts string, k string").withColumn("ts", F.col("ts").cast("timestamp"))
    spans = corpus_stream.ttl_cache(rows, "k", "ts", "7 days").orderBy("since").collect()
    assert [r.accesses for r in spans] == [2, 1]


def test_options():
    assert Options.of({"mode": "academic", "unknown": 1}, {"CORPUSLOOM_CACHE_SIZE": "7"}).cache_size == 7
    for bad in ({"mode": "x"}, {"cache_size": 0}, {"engine_weights": {"a": 2.0}}, {"max_candidates": 0}, {"log_level": "LOUD"}):
        with pytest.raises(ValueError):
            Options.of(bad, {})


@pytest.mark.parametrize("parts", [1, 4, 16])
def test_vote_is_the_same_for_any_partitioning(spark, parts):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    base = vote.summary(vote.sentences(docs)).orderBy("doc_id").collect()
    assert vote.summary(vote.sentences(docs.repartition(parts))).orderBy("doc_id").collect() == base


# ---- the composed analysis, tiers, facades and files


def test_agreement_of_four_engines(spark):
    own = producers.Registry()
    own.add(producers.Producer("other", 33, 60, lambda words: F.transform(words, lambda w: F.concat(w, F.lit("x")))))
    rows = vote.summary(vote.sentences(spark.createDataFrame([(1, "long tree")], "doc_id long, text string"), own.chosen()))
    assert one(rows).engine_agreement == 0.75 and one(rows).agreement_level == "medium" and one(rows).overall_confidence <= 0.85


def test_analysis_takes_stored_results_and_modes(spark):
    docs = spark.createDataFrame([(1, " राम "), (2, "rāma"), (3, None), (4, "gam gam")], "doc_id long, text string")
    done = {r.doc_id: r for r in analysis.analysed(docs).collect()}
    assert done[1].normalized == done[2].normalized == "rAma" and done[1].cache_key == done[2].cache_key and done[3].n_segments == 0
    held = analysis.to_store(analysis.analysed(docs.where("doc_id = 1"))).withColumn("n_segments", F.lit(99).cast("long"))
    again = {r.doc_id: r for r in analysis.analysed(docs, held).collect()}
    assert [(again[i].cached_at, again[i].n_segments) for i in (1, 2, 4)] == [("sqlite", 99), ("sqlite", 99), ("none", 2)]
    assert {r.cached_at for r in analysis.analysed(docs, held, bypass=True).collect()} == {"none"}
    assert analysis.analysed(docs, options=Options(mode="academic")).where("doc_id = 1").first().cache_key != done[1].cache_key
    up = {r.component: r.healthy for r in analysis.health(spark, {"a": True, "b": None}, {"rules": True}, {"memory": False}).collect()}
    assert up == {"engine_a": True, "engine_b": False, "disambiguation_rules": True, "cache_memory": False}
    with pytest.raises(ValueError, match="mode"):
        analysis.normalised(docs, "other")


def test_options_from_files(tmp_path):
    path = str(tmp_path / "options.yaml")
    assert Options.load(path, {}) == Options()
    Options(cache_size=7, mode="academic", engine_weights={"a": 0.5}).save(path)
    assert Options.load(path, {}).weights() == {"a": 0.5} and Options.load(path, {"CORPUSLOOM_CACHE_SIZE": "9"}).cache_size == 9


def test_tiers_of_nothing_and_prefixes(spark):
    rows = {r.tier: r for r in store.tier_counters(spark.createDataFrame([], "tier string")).collect()}
    assert all((r.hits, r.misses, r.promotions, r.hit_rate) == (0, 0, 0, 0.0) for r in rows.values()) and set(rows) == set(store.TIERS)
    keys = spark.createDataFrame([("sanskrit:a:1",), ("sanskrit:b:1",), ("other:a",), (None,)], "key string")
    assert [r.key for r in store.clear_prefix(keys, "key", "a").collect()] == ["sanskrit:b:1", "other:a", None]
    assert [r.key for r in store.clear_prefix(keys, "key", "").collect()] == ["other:a", None]


def test_facades(spark):
    assert lexicon.bounded(100, 100) == 100
    for limit in (0, 101):
        with pytest.raises(ValueError, match="limit"):
            lexicon.bounded(limit, 100)
    sections = spark.createDataFrame([("vowel", [("a", "b"), ("c", "d")]), ("visarga", [])], "category string, entries array<struct<name:string,rule:string>>")
    assert [(r.n, r.name) for r in lexicon.category(sections, "vowel").collect()] == [(0, "a"), (1, "c")] and lexicon.category(sections, "none").count() == 0
    roots = spark.createDataFrame([(1, "गम्", "gam", "to go", 1, "p", "x")], "id int, dhatu_devanagari string, dhatu_iast string, meaning_english string, gana int, pada string, notes string")
    cards = one(roots.select(*[tree.root_card(roots, v).alias(v) for v in ("minimal", "standard", "DETAILED")]))
    assert cards.minimal == '{"dhatu_iast":"gam","gana":1,"meaning_english":"to go"}' and "notes" not in cards.standard and '"notes":"x"' in cards.DETAILED


def test_reasons_and_confidences(spark):
    own = value(spark, prompts.choice_reasoning(F.lit(1), F.lit(0)))
    assert own.startswith("Rule 'semantic_coherence' matched: the only available interpretation")
    assert value(spark, prompts.choice_reasoning(F.lit(4), F.lit(3))).endswith("Parse 0 is semantically unlikely here.")
    assert [value(spark, training.confidence_of(F.lit(x))) for x in ("0.5", '{"overall": 0.25}', "null", "", None, "x")] == [0.5, 0.25, 0.0, 0.0, 0.0, 0.0]


def test_yaml_of_nothing(spark, tmp_path):
    (tmp_path / "a.yaml").write_text("")
    (tmp_path / "b.yaml").write_text("categories: {vowel: [one, {name: x}]}\n")
    rows = corpus.read_sections(spark, str(tmp_path)).collect()
    assert [(r.category, [(e.name, e.rule) for e in r.entries]) for r in rows] == [("vowel", [("", "one"), ("x", "")])]


@pytest.mark.parametrize("capacity", [1, 3, 50])
def test_lru_of_a_frequent_shard_in_many_parts(spark, capacity):
    import random
    from collections import OrderedDict

    rng = random.Random(capacity)
    rows = [(i, rng.choice(["a"] * 8 + ["b", None]), min(rng.randrange(40), rng.randrange(40))) for i in range(900)]
    rng.shuffle(rows)
    own = spark.createDataFrame(rows, "id long, shard string, k int")
    got = {r.id: r.hit for r in store.lru(own, "shard", "k", "id", capacity, parts=7).collect()}
    caches, want = {}, {}
    for i, s, k in sorted(rows):
        cache = caches.setdefault(s, OrderedDict())
        want[i] = k in cache
        cache[k] = True
        cache.move_to_end(k)
        if len(cache) > capacity:
            cache.popitem(last=False)
    assert got == want
