"""Steps over whole tables: how they are planned, and that their results stay what they were."""

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.config import Options
from corpusloom.operators import analysis, batch, producers, vote
from corpusloom.plans import catalogue

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_frequencies_are_hashed_and_order_ties_by_first_occurrence(spark):
    rows = [(2, ["b", "a", "b"]), (1, ["c", "d", "c", "d"]), (-3, ["e"])]
    word = "array<struct<lemma:string,morphology:struct<pos:string>,dhatu:struct<root:string>>>"
    own = spark.createDataFrame([(i, [(w, None, None) for w in ws], None) for i, ws in rows], f"id long, words {word}, error string")
    counts = batch.frequencies(own, "id")
    assert "SortAggregate" not in plan_of(counts)
    want = [("c", 2), ("d", 2), ("b", 2), ("e", 1), ("a", 1)]
    assert [(r.value, r.n) for r in batch.most_common(counts, 9).orderBy("place").collect()] == want
    named = own.withColumn("id", F.format_string("%05d", F.col("id") + 10))
    assert [(r.value, r.n) for r in batch.most_common(batch.frequencies(named, "id"), 9).orderBy("place").collect()] == want


@pytest.mark.parametrize("name", ["best_parse_by_mode", "disambiguated_forest"])
def test_rankings_meet_texts_not_parses(spark, name):
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lines = plan_of(catalogue.queries()[name](spark, SF)).splitlines()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    join = next(i for i, line in enumerate(lines) if "SortMergeJoin" in line)
    assert not any("Generate" in line for line in lines[join:]) and any("Generate" in line for line in lines[:join])


def test_one_text_of_each_key_gives_what_the_store_takes(spark):
    docs = spark.createDataFrame([(1, "rāma gam"), (2, " rāma gam "), (3, "rAma gam"), (4, "other"), (4, "other"), (5, None), (6, " ")], "doc_id long, text string")
    for mode in ("production", "academic"):
        want = analysis.to_store(analysis.analysed(docs, options=Options(mode=mode), alternatives=True))
        got = analysis.analysed(docs, options=Options(mode=mode), alternatives=True, once_each=True).select(*want.columns)
        assert got.count() == want.count() == 4 and sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    with pytest.raises(ValueError, match="rankings"):
        analysis.analysed(docs, rankings=docs.select("doc_id", F.array(F.lit(0)).alias("ranking")), once_each=True)


@pytest.mark.parametrize("seed", [1, 2])
def test_few_engines_vote_as_many_do(spark, seed):
    rng = random.Random(seed)
    some = lambda: [rng.choice(["a", "b", "", None]) for _ in range(rng.randrange(6))]
    rows = spark.createDataFrame([(i, ["w"], *[some() for _ in range(4)]) for i in range(150)], "id int, w array<string>, l0 array<string>, l1 array<string>, l2 array<string>, l3 array<string>")
    for n in (1, 2, 3, 4):
        own = tuple(producers.Producer(f"l{k}", (35, 40, 25, 33)[k], (90, 92, 70, 60)[k], lambda _, k=k: F.col(f"l{k}")) for k in range(n))
        both = rows.select(vote.unrolled(F.col("w"), own).alias("a"), vote.gathered(F.col("w"), own).alias("b")).collect()
        assert all(r.a == r.b for r in both) and any(r.a for r in both)


def test_endings_go_as_the_pattern_takes_them(spark):
    rows = spark.createDataFrame([(["s", "ing", "Nations", "singed", "TION", "station", "walkings", "", None, "ed", "naïveś"],)], "w array<string>")
    plain = F.transform("w", lambda w: F.regexp_replace(F.lower(w), "(ing|ed|s|tion)$", ""))
    r = rows.select(producers.stem(F.col("w")).alias("a"), plain.alias("b")).first()
    assert r.a == r.b


def test_a_language_is_written_by_many_tasks_and_numbered_through(spark):
    from pathlib import Path
    from urllib.parse import urlparse

    from corpusloom.plans import services
    from corpusloom.sources import corpus

    docs = spark.createDataFrame([("en" if i % 5 else "fr", i, "\n".join(f"{i} {k}" for k in range(i % 4))) for i in range(400)], "lang string, key long, value string").repartition(7)
    held = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        path = services._written_by_language(spark, docs, "parts")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", held)
    assert len(list(Path(urlparse(path).path, "lang=en").glob("part-*"))) > 3
    rows = corpus.numbered_lines(spark, path, lambda c: c != "", parts=True)
    assert "SortMergeJoin" not in plan_of(rows)
    for lang, own in (("fr", range(0, 400, 5)), ("en", [i for i in range(400) if i % 5])):
        want = [f"{i} {k}" for i in own for k in range(i % 4)]
        got = sorted((r["line"], r.text) for r in rows.where(F.col("file").contains(f"lang={lang}/")).collect())
        assert got == [(n + 1, t) for n, t in enumerate(want)]


def test_locations_meet_texts_not_parses(spark):
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lines = plan_of(catalogue.queries()["verse_entities"](spark, SF)).splitlines()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    join = next(i for i, line in enumerate(lines) if "SortMergeJoin" in line)
    assert not any("Generate" in line for line in lines[join:]) and any("Generate" in line for line in lines[:join])


@pytest.mark.parametrize("name", ["analysis_tools", "batch_words"])
def test_counts_of_a_parse_stay_in_its_row(spark, name):
    plan = plan_of(catalogue.queries()[name](spark, SF))
    assert "hashpartitioning" not in plan and "Aggregate" not in plan


def _parses(spark):
    from corpusloom.operators import tree

    word = lambda lemma, pos, root, ms: (lemma, f"{lemma}-s", None, pos and (pos, None, None, None), ms, root and (root, 1, None, "x"), [], 0.5)
    groups = [("g1", None, True, None, [word("a", "verb", "r", ["m"]), word("b", None, None, None)]), ("g2", "v", False, None, [word("a", "noun", None, [])]), ("g3", None, False, None, [])]
    rows = [(1, [("p0", 0.5, None, 3, groups), ("p1", 0.4, None, 1, groups[1:])]), (2, [("p0", 0.5, None, 0, [])]), (3, [])]
    return spark.createDataFrame(rows, f"id long, parses array<{tree.FULL}>")


def test_tools_are_counted_in_the_row_as_over_findings(spark):
    from corpusloom.operators import tree

    rows = _parses(spark)
    got = {r.id: r.n.asDict() for r in rows.select("id", tree.told(tree.findings(F.col("parses"))).alias("n")).collect()}
    found = tree.walked(rows, "id")
    for name in tree.TOOLS:
        want = {r.id: r["count"] for r in tree.tool(found, name).groupBy("id").count().collect()}
        assert {i: n[name] for i, n in got.items()} == {i: want.get(i, 0) for i in (1, 2, 3)}


def test_words_are_counted_in_the_row_as_over_rows(spark):
    from corpusloom.operators import stats

    rows = _parses(spark).select("id", F.get("parses", F.lit(0))["sandhi_groups"].alias("g"))
    words = stats.extracted_words(rows, "id", "g")
    want = words.groupBy("id").agg(F.count(F.lit(1)).alias("words"), F.count_distinct("lemma").alias("lemmas"), F.count("root").alias("roots"), F.max_by("surface", "place").alias("last_surface"), F.count_if(F.col("pos") == "verb").alias("verbs"))
    got = stats.word_summary(rows, "id", "g").collect()
    assert got == want.collect() and got[0][1:] == (3, 2, 1, "a-s", 1)


def _stored(spark, path):
    from corpusloom.sources.stored import Stored

    return Stored(spark, str(path), "text string", key="k", key_type="long", text="text", buckets=4)


def test_one_version_is_read_without_aggregation(spark, tmp_path):
    own = _stored(spark, tmp_path)
    own.apply(spark.range(50).select(F.col("id").alias("k"), F.concat(F.lit("Word w"), F.col("id").cast("string")).alias("text")))
    assert all("Aggregate" not in plan_of(df) and "Exchange" not in plan_of(df) for df in (own.rows(), own.index()))
    assert own.rows().count() == 50 and own.index().count() == 100


@pytest.mark.parametrize("most", [0, 1_000_000])
def test_only_keys_of_several_versions_are_aggregated(spark, tmp_path, monkeypatch, most):
    from corpusloom.sources import stored

    monkeypatch.setattr(stored, "MOST_KEYS", most)
    own = _stored(spark, tmp_path)
    text = lambda word: F.concat(F.lit(f"{word} w"), F.col("id").cast("string")).alias("text")
    own.apply(spark.range(40).select(F.col("id").alias("k"), text("old")))
    own.apply(spark.range(30, 60).select(F.col("id").alias("k"), text("new")))
    own.delete(spark.range(35, 37).select(F.col("id").alias("k")))
    assert {r.k for r in own._again().collect()} == set(range(30, 40)) and "LeftAnti" in plan_of(own.rows()) and "LeftAnti" in plan_of(own.index())
    left = [i for i in range(60) if i not in (35, 36)]
    word = lambda i: "old" if i < 30 else "new"
    assert sorted((r.k, r.text, r.version) for r in own.rows().collect()) == [(i, f"{word(i)} w{i}", int(i >= 30)) for i in left]
    assert {(r.term, r.k) for r in own.index().collect()} == {(t, i) for i in left for t in (word(i), f"w{i}")}
    assert sorted(r.k for r in own.get(spark.range(20, 37).select(F.col("id").alias("k"))).collect()) == list(range(20, 35))


def test_a_batch_is_dealt_once_to_its_buckets(spark, tmp_path, monkeypatch):
    from corpusloom.sources.stored import Stored

    plans, real = {}, Stored._write

    def seen(self, rows, what, *a, **b):
        plans[what] = plan_of(rows)
        return real(self, rows, what, *a, **b)

    monkeypatch.setattr(Stored, "_write", seen)
    _stored(spark, tmp_path).apply(spark.range(9).select(F.col("id").alias("k"), F.lit("x").alias("text")))
    assert plans["rows"].count("Exchange") == 1


def test_outside_engines_are_asked_once(spark, monkeypatch):
    asked, real = [], producers.run_outside
    monkeypatch.setattr(producers, "run_outside", lambda *a, **b: asked.append(real(*a, **b)) or asked[-1])
    plan = plan_of(catalogue.queries()["guarded_engines"](spark, SF))
    assert len(asked) == 1 and "MapInArrow" in plan_of(asked[0]) and "MapInArrow" not in plan


def test_two_words_are_compared_once(spark):
    from corpusloom.operators import diff

    shown = str(diff.changes(F.col("a"), F.col("b")))
    assert shown.count("only_right") == 2


def test_long_work_is_dealt_in_several_tasks_a_core(spark, tmp_path):
    from corpusloom.session import spread

    cores = spark.sparkContext.defaultParallelism
    rows = spark.range(200).select(F.col("id").alias("doc_id"), F.concat(F.lit("Word\n of  "), F.col("id").cast("string")).alias("text"))
    rows.repartition(cores + 2).write.parquet(str(tmp_path / "documents.parquet"))
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        files = spark.read.parquet(str(tmp_path / "documents.parquet"))
        assert cores <= files.rdd.getNumPartitions() < 4 * cores and spread(files).rdd.getNumPartitions() == files.rdd.getNumPartitions()
        assert spread(files, tasks=4).rdd.getNumPartitions() == 4 * cores
        done = catalogue.queries()["tree_full_roundtrip"](spark, str(tmp_path))
        assert f"RoundRobinPartitioning({4 * cores})" in plan_of(done) and {(r.doc_id, r.words) for r in done.collect()} == {(i, 3) for i in range(200)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)


def test_a_tree_read_back_is_held_by_no_row(spark):
    steps = [line for line in plan_of(catalogue.queries()["tree_full_roundtrip"](spark, SF)).splitlines() if "from_json" in line]
    assert len(steps) == 1 and "Generate" in steps[0] and "md5" in steps[0]


def test_marks_of_words_of_all_lengths(spark):
    from corpusloom.plans.analysis import _full_parses

    docs = spark.createDataFrame([(1, " ".join("ā" * n for n in range(1, 131))), (2, None), (3, " \n\t")], "doc_id long, text string")
    got = {r.doc_id: r.p for r in _full_parses(spark, None, docs).collect()}
    words = got[1].sandhi_groups[0].base_words
    want = [("noun" if n % 4 else "verb", "masculine" if n % 3 == 1 else None, "singular", None, 0.5 + n % 8 / 16.0, n % 5 + 1, n % 10 + 1 if n % 4 == 0 else None) for n in range(1, 131)]
    assert [(*w.morphology, w.confidence, len(w.meanings), w.dhatu and w.dhatu.gana) for w in words] == want and got[1].word_count == 130
    assert got[2].sandhi_groups is None and [len(g.base_words) for g in got[3].sandhi_groups] == [0]


def test_all_changes_of_a_long_parse_are_told(spark, tmp_path):
    text = "\n".join(f"abc abcde w{n:04d}" for n in range(300))
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    lines = catalogue.queries()["parse_changes"](spark, str(tmp_path)).first().changes.split("\n")
    assert len(lines) == 2 + 900 and lines[-1] == "Word 900: ? (only in left)" and sum(map(len, lines)) > 4000


def test_a_bound_value_is_not_copied_by_a_transform(spark):
    from corpusloom.functions.binding import let

    rows = spark.createDataFrame([(1, ["a", "b"]), (2, None)], "id int, w array<string>")
    bound = rows.select("id", let(F.col("w"), lambda w: F.struct(F.size(w).alias("n"), w.alias("w"))).alias("s"))
    assert "transform(" not in plan_of(bound) and [(r.s.n, r.s.w) for r in bound.orderBy("id").collect()] == [(2, ["a", "b"]), (None, None)]


def test_rules_take_candidates_from_flat_memory_and_rows_keep_no_segments(spark):
    for name in ("best_parse_by_mode", "disambiguated_forest"):
        plan = catalogue.queries()[name](spark, SF)
        assert "an_listed" in plan_of(plan) and "sandhi_groups" not in plan_of(plan)
    docs = spark.createDataFrame([(1, "running to trees"), (2, "a")], "doc_id long, text string")
    held = {a: analysis.staged(docs, asking=a).orderBy("doc_id").collect() for a in (True, False)}
    assert [c.segments is None for c in held[False][0].an_done.candidates] == [True] * len(held[True][0].an_done.candidates)
    bare = [[(c["index"], c.confidence) for c in r.an_done.candidates] for r in held[True]]
    assert bare == [[(c["index"], c.confidence) for c in r.an_done.candidates] for r in held[False]] and bare[0] and held[True][0].an_done.candidates[1].segments[0].surface == "running"


@pytest.mark.parametrize("seed", [1, 2])
def test_answers_vote_in_their_row_as_segments_do(spark, seed):
    rng = random.Random(seed)

    def engine(name):
        def analyze(texts):
            if any(len(t) % 7 == k for t in texts for k in [len(name)]):
                raise ValueError("no")
            own = random.Random(name)
            return [[{"surface": f"s{n}", "lemma": own.choice(["a", "b", "", None]), "confidence": own.choice([0.5, 0.9, None])} for n in range(own.randrange(5))] for _ in texts]

        return producers.Outside(name, analyze, lambda: name != "gone")

    engines = tuple(map(engine, ("x", "yy", "zzz", "gone")))
    docs = spark.createDataFrame([(i, "w" * rng.randrange(12) if i % 9 else None) for i in range(120)], "doc_id long, text string").repartition(3)
    weights = {"x": 0.6, "yy": 0.4}
    rows = producers.run_outside(docs, engines, batch=1)
    merged = vote.merge_segments(producers.segments_of(rows), weights)
    want = sorted((r.sentence_id, r.pos, r.surface, r.lemma, round(r.confidence, 9), r.agreement) for r in merged.collect())
    together = producers.run_outside(docs, engines, batch=1, together=True)
    got = together.select("doc_id", F.explode(vote.merge_answers(F.col("answers"), weights)).alias("s")).select("doc_id", "s.*").collect()
    assert want and sorted((r.doc_id, r.pos, r.surface, r.lemma, round(r.confidence, 9), r.agreement) for r in got) == want
    assert {r.doc_id for r in together.where(F.size("answers") == 4).collect()} == set(range(120))


def test_answers_of_outside_engines_are_neither_shuffled_nor_written(spark, monkeypatch):
    from corpusloom.plans import services

    held = []
    monkeypatch.setattr(services, "written", lambda df, name: held.append(df) or df)
    plan = plan_of(catalogue.queries()["guarded_engines"](spark, SF))
    assert "hashpartitioning" not in plan and "Window" not in plan and "segments" not in held[0].schema.simpleString()


def test_tools_are_counted_in_the_tree_as_over_findings(spark):
    from corpusloom.operators import tree

    for suffixes in (lambda w: w["upasarga"], lambda w: w["meanings"]):
        r = _parses(spark).select("id", tree.told(tree.findings(F.col("parses"), suffixes)).alias("a"), tree.counted(F.col("parses"), suffixes).alias("b")).collect()
        assert len(r) == 3 and all(x.a == x.b for x in r)
    assert "to_json" not in plan_of(catalogue.queries()["analysis_tools"](spark, SF))


def test_exported_lines_are_packed(spark, tmp_path):
    own = spark.createDataFrame([(1, [("b", ("noun",), None)], None), (2, [], "broken")], "id long, words array<struct<lemma:string,morphology:struct<pos:string>,dhatu:struct<root:string>>>, error string")
    batch.export(own, own.select("id"), str(tmp_path / "out"))
    assert list((tmp_path / "out/results").glob("part-*.gz")) and not list((tmp_path / "out/results").glob("part-*.txt"))
    assert spark.read.text(str(tmp_path / "out/results")).count() == 2
