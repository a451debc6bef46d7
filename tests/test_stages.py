"""Disambiguation in rows, the composed analysis, the stored table, splitting readers, guarded engines, requests and tools."""

import gzip
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from corpusloom.config import Options
from corpusloom.operators import analysis, disambiguation, producers, requests, rules, tree, vote
from corpusloom.plans import catalogue
from corpusloom.sources import corpus
from corpusloom.sources.stored import Stored, counts_before

SF = "/root/testdata/sf0.001"
LONG = "sentence_id long, candidates " + f"array<{disambiguation.CANDIDATE}>"


def seg(lemma, pos=None, gender=None, sandhi=None, case=None):
    return (lemma, lemma, pos, gender, None, case, None, None, sandhi)


def some_candidates(seed, n=60):
    rng = random.Random(seed)
    one = lambda: seg(rng.choice(["gam", "rāma", "xyz", "KṚ", ""]), rng.choice(["noun", "adj", "verb", None]), rng.choice(["m", "f", None, ""]), rng.choice(["vowel", "exotic", None, ""]))
    return [(i, [(k, rng.randrange(0, 100) / 100, [one() for _ in range(rng.randrange(4))]) for k in range(rng.randrange(8))]) for i in range(n)]


# ---- disambiguation in the row


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_rules_in_rows_equal_rules_over_exploded_rows(spark, seed):
    own = spark.createDataFrame(some_candidates(seed), LONG)
    rows = own.select("sentence_id", F.explode("candidates").alias("c")).select("sentence_id", F.col("c.index").alias("idx"), "c.confidence", "c.segments")
    want = {}
    for r in rules.RuleSet().apply(rows).orderBy("sentence_id", "rank").collect():
        want.setdefault(r.sentence_id, []).append((r.idx, round(r.confidence, 6)))
    done = own.select("sentence_id", "candidates", disambiguation.Chain().by_rules(F.col("candidates")).alias("d")).collect()
    assert len(done) == 60
    for r in done:
        got = [(c["index"], round(c.confidence, 6)) for c in r.d.candidates]
        if len(r.candidates) < 2:
            assert r.d.stage == "none" and got == [(c["index"], round(c.confidence, 6)) for c in r.candidates]
        else:
            assert got == want.get(r.sentence_id, [])
            assert r.d.stage == ("rules" if len(got) == 1 or got and got[0][1] >= 0.95 else "none")


def stages(spark, candidates, ranking=None, chain=None):
    chain = chain or disambiguation.Chain(rules=())
    row = spark.createDataFrame([(1, candidates, ranking)], LONG + ", ranking array<int>")
    done = row.select(chain.by_rules(F.col("candidates")).alias("d"), "ranking").select("d", chain.open_(F.col("d")).alias("open"), chain.finished(F.col("d"), F.col("ranking")).alias("r"))
    return done.select("open", "r.*", disambiguation.is_ambiguous(F.col("r")).alias("ambiguous"), disambiguation.best(F.col("r"))["index"].alias("best")).first()


def test_stages_end_early(spark):
    c = lambda *confidences: [(i, x, [seg("gam")]) for i, x in enumerate(confidences)]
    human = disambiguation.Chain(rules=(), human_enabled=True)
    none = stages(spark, [])
    assert (none.stage, none.confidence, none.best, none.open, none.ambiguous) == ("none", 0.0, None, False, False)
    one = stages(spark, c(0.2), [0])
    assert (one.stage, one.confidence, one.best, one.open) == ("none", 0.2, 0, False)
    sure = stages(spark, c(0.5, 0.96), [0, 1])
    assert (sure.stage, sure.best, sure.open) == ("rules", 1, False) and [x["index"] for x in sure.candidates] == [1, 0]
    open_ = stages(spark, c(0.6, 0.7, 0.5))
    assert (open_.stage, open_.open, open_.ambiguous, open_.review) == ("none", True, True, False)
    # a ranking names places after the rules: 1, 0, 2 by confidence
    asked = stages(spark, c(0.6, 0.7, 0.5), [2, 9, -1, 2, 0], human)
    assert asked.stage == "llm" and [x["index"] for x in asked.candidates] == [2, 1, 0] and asked.confidence == 0.7 and asked.review and asked.reason == disambiguation.MODERATE_RANKING
    assert stages(spark, c(0.6, 0.7), [7]).stage == "none"
    low = stages(spark, c(0.35, 0.4), None, human)
    assert low.review and low.reason == disambiguation.LOW_AFTER_ALL
    assert not stages(spark, c(0.35, 0.4)).review
    gone = stages(spark, c(0.1, 0.2), [0, 1])
    assert (gone.stage, gone.candidates, gone.confidence) == ("none", [], 0.0)
    off = stages(spark, c(0.5, 0.96), [0, 1], replace(human, rules_enabled=False, ranking_enabled=False))
    assert off.stage == "none" and [x["index"] for x in off.candidates] == [0, 1]
    assert human.without("agreement").status() == {"rules": True, "llm": True, "human_review": True}


def test_prompts_and_answers_of_open_sentences(spark):
    row = spark.createDataFrame([(1, [(0, 0.6, [seg("gam", "verb")]), (1, 0.7, [seg("rāma", "noun", "m")])])], LONG)
    chain = disambiguation.Chain(rules=())
    done = row.select(chain.by_rules(F.col("candidates")).alias("d"))
    asked = done.select(disambiguation.request(F.col("d"), F.lit("before")).alias("p"), disambiguation.answer(F.lit('so {"ranking": [1, 0, 5]}'), F.col("d")).alias("a")).first()
    assert asked.p.index("rāma") < asked.p.index("gam") and "Previous: before" in asked.p and asked.a == [1, 0]


# ---- the composed analysis


def test_analysis_builds_and_decides_a_forest(spark):
    docs = spark.createDataFrame([(1, "running to trees"), (2, "a"), (3, None), (4, "abc"), (5, "walked it")], "doc_id long, text string")
    chain = analysis.chain_of(Options()).without("frequency_preference")
    rows = analysis.staged(docs, options=Options(mode="academic"), chain=chain)
    prompts = {r.doc_id: r.prompt for r in analysis.requests(rows, chain).collect()}
    assert {1, 5} <= set(prompts) and not {3, 4} & set(prompts)
    every = {r.doc_id: r for r in analysis.analysed(docs, options=Options(mode="academic"), chain=chain, alternatives=True).collect()}
    assert [len(every[i].parses) for i in (3, 4)] == [0, 1] and every[3].selected is None
    lemmas = [[g.base_words[0].lemma for g in p.sandhi_groups] for p in every[1].parses]
    assert sorted(lemmas) == sorted([["running", "to", "trees"], ["runn", "to", "tree"], ["running", "trees"]]) or len(lemmas) >= 3
    answers = spark.createDataFrame([(1, [2, 0])], "doc_id long, ranking array<int>")
    ranked = {r.doc_id: r for r in analysis.analysed(docs, options=Options(mode="academic"), chain=chain, alternatives=True, rankings=answers).collect()}
    assert ranked[1].stage == "llm" and ranked[1].selected == 0 and ranked[5].stage != "llm"
    asked = [c.confidence for c in every[1].parses]
    assert len(asked) == len(ranked[1].parses)
    one = {r.doc_id: r for r in analysis.analysed(docs, chain=chain, alternatives=True, rankings=answers, scripts=True).collect()}
    assert {len(r.parses) for r in one.values()} == {0, 1} and one[1].parses[0].parse_id == ranked[1].parses[0].parse_id
    best = one[4].parses[0].sandhi_groups[0].base_words[0]
    assert best.scripts.slp1 == "abc" and best.scripts.devanagari and best.scripts.iast


def test_a_stored_tree_comes_back_and_is_not_voted_on(spark, tmp_path):
    docs = spark.createDataFrame([(1, "rāma gam"), (2, "other words")], "doc_id long, text string")
    first = analysis.analysed(docs.where("doc_id = 1"))
    path = str(tmp_path / "store")
    analysis.to_store(first).write.parquet(path)
    held = spark.read.parquet(path)
    again = {r.doc_id: r for r in analysis.analysed(docs, held).collect()}
    assert again[1].cached_at == "sqlite" and again[2].cached_at == "none"
    assert again[1].parses == first.first().parses and again[1].sentence_id.startswith("sent_")
    assert again[1].parses[0].sandhi_groups[1].base_words[0].lemma == "gam"


def test_previous_sentences_are_context(spark):
    docs = spark.createDataFrame([(1, "v", 1, "first one"), (2, "v", 2, "second walked"), (3, "w", 1, "third walked")], "doc_id long, verse string, at int, text string")
    chain = analysis.chain_of(Options()).without("frequency_preference")
    rows = analysis.staged(analysis.with_previous(docs, "verse", "at"), chain=chain, keep=("an_previous",))
    asked = {r.doc_id: r.prompt for r in analysis.requests(rows, chain, previous="an_previous").collect()}
    assert "Previous: first one" in asked[2] and "Previous" not in asked[3]


def test_the_composed_analysis_has_one_vote_in_its_plan(spark):
    plan = lambda name: catalogue.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    alone = plan("ensemble_vote").count("array_position")
    assert plan("analyze_corpus").count("array_position") == alone
    assert plan("disambiguated_forest").count("array_position") == alone


# ---- the stored table


def store_of(spark, path):
    return Stored(spark, str(path), "text string, mode long", key="k", key_type="long", text="text", done="mode = 1", buckets=8)


def changed(spark, rows):
    return spark.createDataFrame(rows, "k long, text string, mode long, gone boolean, at int")


def same_as(own, model):
    assert {(r.k, r.text, r.mode) for r in own.rows().collect()} == {(k, *v) for k, v in model.items()}
    words = {(t, k) for k, (text, _) in model.items() for t in "".join(c if c.isalnum() else " " for c in (text or "").lower()).split()}
    assert {(r.term, r.k) for r in own.index().collect()} == words
    assert tuple(own.totals().first()) == (len(model), sum(m == 1 for _, m in model.values()))


def test_the_index_follows_random_batches(spark, tmp_path):
    rng, own, model = random.Random(3), store_of(spark, tmp_path), {}
    for n in range(6):
        rows = []
        for at in range(rng.randrange(1, 14)):
            k, gone = rng.randrange(12), rng.random() < 0.3
            rows.append((k, " ".join(rng.choice(["Red", "blue", "go,ld", "tree"]) for _ in range(rng.randrange(4))) if rng.random() < 0.9 else None, rng.choice([0, 1, None]), gone, at))
        rows += [(None, "lost", 1, False, 99)]
        assert own.apply(changed(spark, rows), order="at")
        for k, text, mode, gone, _ in rows:
            if k is not None:
                model.pop(k, None)
                if not gone:
                    model[k] = (text, mode)
        same_as(own, model)
        if n == 3:
            assert own.compacted(least=4) and own.generation == 1 and own.versions() == [3]
            same_as(own, model)
    assert own.versions() == [3, 4, 5]
    holds = {k for k, (t, _) in model.items() if t and "red" in t.lower() and "tree" in t.lower()}
    assert {r.k for r in own.search(["tree", "RED"]).collect()} == holds and own.search(["nothing"]).count() == 0


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path, monkeypatch):
    own = store_of(spark, tmp_path)
    own.apply(changed(spark, [(1, "old words", 1, False, 0), (2, "two", 0, False, 0)]))
    batch = changed(spark, [(1, "new words", 0, False, 0), (3, "three", 1, False, 0), (2, None, None, True, 0)])
    # it fails after rows and postings are written, and again before its commit
    for step in ("_write", "_commit"):
        with monkeypatch.context() as m:
            real = Stored._write
            m.setattr(Stored, step, (lambda self, rows, what, *a, **b: real(self, rows, what, *a, **b) if what != "totals" else 1 / 0) if step == "_write" else (lambda *a: 1 / 0))
            with pytest.raises(ZeroDivisionError):
                own.apply(batch)
        same_as(own, {1: ("old words", 1), 2: ("two", 0)})
    assert own.apply(batch, 1) and not own.apply(batch, 1)
    same_as(own, {1: ("new words", 0), 3: ("three", 1)})
    assert own.delete(spark.createDataFrame([(3,), (77,)], "k long"))
    same_as(own, {1: ("new words", 0)})


def test_look_ups_read_the_buckets_of_their_keys(spark, tmp_path):
    own = store_of(spark, tmp_path)
    own.apply(spark.range(400).select(F.col("id").alias("k"), F.concat(F.lit("w"), F.col("id").cast("string")).alias("text"), F.lit(1).cast("long").alias("mode")))
    keys = spark.createDataFrame([(5,), (6,), (5,)], "k long")
    found = own.get(keys)
    assert {(r.k, r.text) for r in found.collect()} == {(5, "w5"), (6, "w6")}
    buckets = own.buckets_of(keys, "k")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert len(buckets) <= 2 and "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    read = own._read("rows", own.row, buckets=buckets).select(F.input_file_name().alias("f")).distinct().collect()
    assert {r.f.split("bucket=")[1].split("/")[0] for r in read} == {str(b) for b in buckets}
    search = own.search(["w7"])
    assert [r.k for r in search.collect()] == [7] and "PartitionFilters: [" in search._jdf.queryExecution().executedPlan().toString()


def test_accesses_fold_to_counts(spark, tmp_path):
    own = store_of(spark, tmp_path)
    own.apply(changed(spark, [(1, "a", 1, False, 0), (2, "b", 1, False, 0)]))
    log = spark.sql("SELECT * FROM VALUES (1L, timestamp'2020-01-01', 1L), (1L, timestamp'2020-01-02', 2L), (2L, timestamp'2020-01-01', 3L), (null, null, 4L) t(k, at, id)")
    own.log(log, 0)
    own.log(log, 0)
    own.log(log.where("k = 1"), 1)
    assert {(r.k, r.access_count, r.accessed_at.day) for r in own.access_counts().collect()} == {(1, 4, 2), (2, 1, 1)}
    assert own.access_counts(spark.createDataFrame([(2,)], "k long")).count() == 1
    own.compacted(least=1)
    assert {(r.k, r.access_count) for r in own.access_counts().collect()} == {(1, 4), (2, 1)}


def test_counts_before_of_a_frequent_key(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["hot"] * 5 + ["a", "b", None])) for i in range(3_000)]
    got = counts_before(spark.createDataFrame(rows, "id long, k string").repartition(6), "k", ["id"]).collect()
    seen = {}
    for i, k in rows:
        seen[i] = sum(1 for j, o in rows[:i] if o == k) if i < 60 else None
    assert all(r.count_before == seen[r.id] for r in got if r.id < 60)
    for k in ("hot", "a", None):
        own = sorted((r.id, r.count_before) for r in got if r.k == k)
        assert [c for _, c in own] == list(range(len(own)))


def test_a_stream_that_fails_goes_on_where_it_was(spark, tmp_path, monkeypatch):
    folder, own = tmp_path / "in", store_of(spark, tmp_path / "store")
    own.apply(changed(spark, [(100, "before the stream", 1, False, 0)]))
    for n in range(3):
        spark.createDataFrame([(n, f"text {n}", n), (50, f"last {n}", n)], "k long, text string, mode long").coalesce(1).write.mode("append").parquet(str(folder))
    stream = lambda: spark.readStream.schema("k long, text string, mode long").option("maxFilesPerTrigger", 1).parquet(str(folder))
    calls = []
    real = Stored._commit

    def commit(self, version, *a):
        calls.append(version)
        if len(calls) == 2:
            raise RuntimeError("lost")
        real(self, version, *a)

    monkeypatch.setattr(Stored, "_commit", commit)
    with pytest.raises(Exception, match="lost"):
        own.from_stream(stream(), str(tmp_path / "checkpoint"))
    assert own.versions() == [0, 1]
    own.from_stream(stream(), str(tmp_path / "checkpoint"))
    own.from_stream(stream(), str(tmp_path / "checkpoint"))
    assert own.versions() == [0, 1, 2, 3] and calls == [1, 2, 2, 3]
    rows = {r.k: r.text for r in own.rows().collect()}
    assert set(rows) == {0, 1, 2, 50, 100} and own.totals().first().total == 5 and own.totals().first().done == own.rows().where("mode = 1").count()


# ---- splitting readers


@pytest.fixture
def small_splits(spark):
    held = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in held.items():
        spark.conf.set(k, v)


def test_large_files_are_read_by_many_tasks_with_the_verses_of_one(spark, tmp_path, small_splits):
    rng = random.Random(8)
    texts = {}
    for name in ("a.txt", "b.txt", "c.txt"):
        lines = [rng.choice(["", "  ", "# note", " # note", f"verse {i} " + "x" * rng.randrange(90), "  रामो वनं  "]) for i in range(1_500 if name != "c.txt" else 3)]
        texts[name] = lines
        (tmp_path / name).write_bytes(("\r\n" if name == "b.txt" else "\n").join(lines).encode())
    (tmp_path / "d.txt").write_bytes(b"")
    rows = corpus.read_text(spark, str(tmp_path), "own")
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 10
    got = {}
    for r in rows.collect():
        got.setdefault(r.source_file.rsplit("/", 1)[1], []).append((r.verse, r.text))
    for name, lines in texts.items():
        kept = [x.strip() for x in lines if x.strip() and not x.strip().startswith("#")]
        assert sorted(got.get(name, [])) == list(enumerate(kept, 1))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "wholetext" not in plan


def test_lines_of_packed_files_and_json_lines(spark, tmp_path, small_splits):
    with gzip.open(tmp_path / "x.txt.gz", "wt") as f:
        f.write("\n".join(f"line {i}" for i in range(5_000)))
    rows = corpus.read_text(spark, str(tmp_path / "x.txt.gz")).collect()
    assert sorted((r.verse, r.text) for r in rows) == [(i + 1, f"line {i}") for i in range(5_000)]
    lines = [f'{{"n": {i}}}' if i % 7 else ["", "{bad", "  "][i // 7 % 3] for i in range(3_000)]
    (tmp_path / "y.jsonl").write_text("\n".join(lines))
    got = corpus.read_jsonl(spark, str(tmp_path / "y.jsonl"), "n int", line="line").collect()
    assert sorted((r.line, r.n, r.bad) for r in got if not r.bad) == [(i + 1, i, False) for i in range(3_000) if i % 7]
    assert sorted(r.line for r in got if r.bad) == [i + 1 for i in range(3_000) if lines[i] == "{bad"]
    errors = corpus.jsonl_errors(spark, str(tmp_path / "y.jsonl"), lambda c: F.when(c.startswith("{bad"), F.array(F.lit("no"), F.lit("bad"))))
    assert sorted((r.line, r.place, r.error) for r in errors.collect())[:2] == [(8, 0, "no"), (8, 1, "bad")]


# ---- outside engines


def test_a_failing_text_costs_its_own_result_only():
    calls = []

    def analyze(texts):
        calls.append(len(texts))
        if "bad" in texts:
            raise KeyError("x")
        return [[{"lemma": t}] for t in texts]

    texts = [f"t{i}" for i in range(64)]
    texts[17] = "bad"
    got = producers.answered(analyze, texts)
    assert [e for _, e in got] == [None] * 17 + ["KeyError: 'x'"] + [None] * 46 and got[18] == ([{"lemma": "t18"}], None)
    assert len(calls) == 13  # one for the batch, two for each halving
    assert producers.answered(lambda t: [], ["a"]) == [([], "ValueError: 0 results for 1 texts")] and producers.answered(analyze, []) == []


def _good(texts):
    return [[{"surface": w, "lemma": w.lower(), "confidence": 0.9, "meanings": [w]} for w in t.split()] for t in texts]


def _raises(texts):
    raise RuntimeError("broken")


def test_the_vote_goes_on_without_a_failing_engine(spark):
    docs = spark.createDataFrame([(1, "One two"), (2, None), (3, " ")], "doc_id long, text string")
    rows = producers.run_outside(docs, (producers.Outside("good", _good), producers.Outside("broken", _raises)))
    by = {(r.doc_id, r.engine): r for r in rows.collect()}
    assert len(by) == 6 and by[1, "broken"].error == "RuntimeError: broken" and not by[1, "broken"].success and by[2, "broken"].success and by[1, "good"].segments[1].pos == 1
    merged = vote.merge_segments(producers.segments_of(rows), {"good": 0.5}).collect()
    assert sorted((r.sentence_id, r.pos, r.lemma, r.agreement) for r in merged) == [(1, 0, "one", 1.0), (1, 1, "two", 1.0)]
    failed = {r.doc_id: r for r in producers.errors_of(rows).collect()}
    assert failed[1].errors == {"broken": "RuntimeError: broken"} and failed[1].failure is None and failed[2].errors == {}
    alone = producers.errors_of(producers.run_outside(docs.where("doc_id = 1"), (producers.Outside("broken", _raises),))).first()
    assert alone.failure == "No available engines"
    with pytest.raises(ValueError, match="No engines"):
        producers.run_outside(docs, ())


def test_segments_are_dealt_once(spark):
    plan = catalogue.queries()["merge_segments_vote"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    # one for the query's own numbering of the lines, one by sentence
    assert plan.count("Exchange hashpartitioning(") == 2
    with pytest.raises(ValueError, match="12 engines"):
        vote.merged(F.col("w"), producers.DEFAULT * 5)


# ---- requests


ROOTS = "id long, dhatu_devanagari string, dhatu_iast string, meaning_english string, gana int"


def test_every_request_is_answered(spark):
    roots = spark.createDataFrame([(2, "गम्", "gam", "to go", 1), (1, "x", "gam", "other", 1), (3, "भू", "bhū", "to be", 1), (4, "as", "as", "to be", 2), (5, None, None, "none", 11)], ROOTS)
    forms = spark.createDataFrame([(1, "lat", "third", "singular", "gacchati"), (1, "lan", "third", "singular", "agacchat"), (9, "lat", "x", "y", "z")], "dhatu_id long, lakara string, purusha string, vacana string, form_iast string")
    uris = ["dhatu://gam", "dhatu://गम्", "dhatu://gam", "dhatu://none", "dhatu://gana/1", "dhatu://gana/3", "dhatu://gana/11", "dhatu://gana/x", "dhatu://gana/99999999999", "dhatu://overview", "dhatu://gam/conjugations", "dhatu://as/conjugations", "dhatu://q/conjugations", "http://x", None]
    asked = spark.createDataFrame(list(enumerate(uris)), "request_id long, uri string")
    got = {r.request_id: r for r in requests.answered(asked, roots, forms, listed=2).collect()}
    assert len(got) == len(uris)
    assert got[0].body == got[2].body == '{"id":1,"dhatu_devanagari":"x","dhatu_iast":"gam","meaning_english":"other","gana":1}' and got[1].body.startswith('{"id":2')
    assert got[3].status == "error" and got[3].body == '{"error":"Dhatu not found: none"}' and got[12].status == "error"
    assert got[4]["count"] == 2 and got[4].body.count('"id"') == 2 and '"id":1' in got[4].body and got[5].body == '{"gana":3,"count":0,"dhatus":[]}' and got[5].status == "ok"
    assert got[6].body == got[8].body == '{"error":"Gana must be between 1 and 10"}' and got[7].body == '{"error":"Invalid gana number: x"}'
    assert got[9]["count"] == 4 and '{"gana":2,"name":"adādi","count":1}' in got[9].body
    assert '"conjugations":{"lan":[{"purusha":"third","vacana":"singular","form_iast":"agacchat"}],"lat"' in got[10].body and got[11].body.endswith('"conjugations":{}}')
    assert {got[13].status, got[14].status} == {"error"} and got[14].body == '{"error":"Unknown resource: "}'
    none = requests.answered(asked, roots.limit(0)).collect()
    assert len(none) == len(uris) and [r["count"] for r in none if r.kind == "root_overview"] == [0]
    assert requests.answered(asked.limit(0), roots).collect() == []


# ---- tools over parses


def test_a_walk_finds_all_parts_of_a_parse(spark):
    parses = f"""from_json('[{{"parse_id":"p0","confidence":0.5,"sandhi_groups":[{{"surface_form":"ab","sandhi_type":"vowel","is_compound":true,"base_words":[{{"lemma":"a","surface_form":"a","morphology":{{"pos":"noun"}},"upasarga":["pra","vi"],"confidence":0.4}},{{"lemma":"b","surface_form":"b"}}]}}]}},
    {{"parse_id":"p1","confidence":0.4,"sandhi_groups":[]}}]', 'array<{tree.FULL}>')"""
    rows = spark.range(1).selectExpr("id", f"{parses} AS parses")
    found = tree.walked(rows, "id")
    of = lambda name: [(r.kind, r.parse, r.group, r.word, r.lemma, r.value) for r in tree.tool(found, name).orderBy("at").collect()]
    assert of("identify_compound") == [("compound", 0, 0, None, "a + b", "unknown")] and of("split_sandhi") == [("group", 0, 0, None, "a + b", "vowel")]
    assert of("get_pratyaya") == [("suffix", 0, 0, 0, "a", "pra"), ("suffix", 0, 0, 0, "a", "vi")]
    assert [x[:4] for x in of("explain_parse")] == [("parse", 0, None, None), ("word", 0, 0, 0), ("word", 0, 0, 1), ("parse", 1, None, None)] and of("get_morphology")[0][5] == '{"pos":"noun"}'
    assert len(of("resolve_ambiguity")) == 4
    with pytest.raises(ValueError, match="Unknown tool"):
        tree.tool(found, "other")
    assert tree.walked(rows.withColumn("parses", F.lit(None).cast(rows.schema["parses"].dataType)), "id").collect() == []


# ---- differences of parses, batches


def full(*groups):
    """A parse as JSON: groups of (lemma, pos) words."""
    import json

    return json.dumps({"parse_id": "p", "confidence": 0.5, "sandhi_groups": [{"surface_form": "s", "base_words": [{"lemma": w, "surface_form": w, "morphology": {"pos": p} if p else None, "dhatu": {"dhatu_iast": w, "gana": 1} if p == "verb" else None} for w, p in g]} for g in groups]})


def test_changes_of_two_parses(spark):
    a = full([("gam", "verb"), ("rama", "noun")])
    cases = [
        (a, a, []), (a, full([("gam", "verb")], [("rama", "noun")]), ["Sandhi groups differ: 1 vs 2"]), (a, full([("gam", "verb")]), ["Word count differs: 2 vs 1", "Word 2: ? (only in left)"]),
        (full([("gam", "verb")]), a, ["Word count differs: 1 vs 2", "Word 2: ? (only in right)"]), (a, full([("gam", "noun"), ("sita", "noun")]), ["Word 1 (gam): Different analysis - verb vs noun", "Word 2: Different lemma - rama vs sita"]),
        (full([("x", None)]), full([("x", "noun")]), ["Word 1 (x): Different analysis - ? vs noun"]), (full(), full(), []),
    ]
    from corpusloom.operators import diff

    rows = spark.createDataFrame([(i, *c[:2]) for i, c in enumerate(cases)], "id int, a string, b string").select("id", tree.from_full_json(F.col("a")).alias("a"), tree.from_full_json(F.col("b")).alias("b"))
    assert [r.c for r in rows.select("id", diff.changes(F.col("a"), F.col("b")).alias("c")).orderBy("id").collect()] == [c[2] for c in cases]


def test_batches_count_what_was_analysed(spark, tmp_path):
    from corpusloom.operators import batch

    texts = [(1, "a", [full([("gam", "verb"), ("b", "noun")])], 0.5, None), (2, "b", [full([("b", "noun"), ("c", None), ("gam", "verb")])], 0.25, None), (3, "c", [full([("lost", "noun")])], 0.9, "broken"), (4, "d", [], 0.0, None), (5, None, None, None, None)]
    rows = spark.createDataFrame(texts, "id int, text string, js array<string>, overall_confidence double, error string")
    rows = rows.select("id", "text", F.transform("js", tree.from_full_json).alias("parses"), "overall_confidence", "error")
    own = batch.summarised(rows, "id")
    counts = batch.frequencies(own, "id")
    done = batch.statistics(own, counts).first()
    assert (done.total_texts, done.successful_analyses, done.failed_analyses, done.total_words, done.unique_words, done.average_confidence, done.unique_dhatus) == (5, 4, 1, 5, 3, 0.25, 1)
    # of equal counts the word that was seen first
    assert [tuple(x) for x in done.top_words] == [("gam", 2), ("b", 2), ("c", 1)] and {tuple(x) for x in done.pos_distribution} == {("noun", 2), ("verb", 2)} and [tuple(x) for x in done.top_dhatus] == [("gam", 2)]
    assert [tuple(x)[:2] for x in batch.most_common(counts, 1).where("kind = 'word'").collect()] == [("word", "gam")]
    batch.export(own, batch.statistics(own, counts), str(tmp_path / "out"))
    import json

    back = {x["id"]: x for x in (json.loads(r.value) for r in spark.read.text(str(tmp_path / "out/results")).collect())}
    assert back[3] == {"id": 3, "text": "c", "error": "broken"} and [w["lemma"] for w in back[2]["words"]] == ["b", "c", "gam"] and "morphology" not in back[2]["words"][1] and back[5]["words"] == []
    stats_line = json.loads(spark.read.text(str(tmp_path / "out/statistics")).first().value)
    assert stats_line["total_texts"] == 5
    empty = batch.summarised(rows.limit(0), "id")
    assert batch.statistics(empty, batch.frequencies(empty, "id")).first().total_words == 0
    verses = batch.verse_entities(rows.where("id in (1, 4, 5)").withColumn("location", F.concat(F.lit("1.2."), F.col("id").cast("string"))))
    got = {r.id: r for r in verses.collect()}
    assert [d.verse_location for d in got[1].dhatus] == ["1.2.1"] and [w.devanagari for w in got[1].words] == ["gam", "b"] and got[4].words == [] and got[5].dhatus == []


# ---- the service's calls


def test_calls_answer_every_request(spark):
    from corpusloom.operators import service

    asked = spark.createDataFrame([(1, "rāma gam", None), (2, "", "production"), (3, None, "production"), (4, "x" * 10_001, "academic"), (5, "word", "Academic"), (6, "word", "other"), (7, " \n", "educational")], "request_id long, text string, mode string")
    got = {r.request_id: r for r in service.analyses(asked).collect()}
    assert {k: r.status for k, r in got.items()} == {1: 200, 2: 422, 3: 422, 4: 422, 5: 200, 6: 400, 7: 200}
    assert got[6].detail == "Invalid mode: other. Must be one of: production, academic, educational" and got[2].detail == service.BAD_LENGTH
    assert (got[1].mode, got[5].mode, got[1].n_segments, got[7].parses) == ("production", "academic", 2, []) and got[1].parses[0].sandhi_groups[1].base_words[0].lemma == "gam"
    docs = spark.createDataFrame([(1, "running to trees"), (2, "abc")], "doc_id long, text string")
    stored = analysis.to_store(analysis.analysed(docs, options=Options(mode="academic"), alternatives=True))
    ids = {r.doc_id: (r.sentence_id, len(r.parses)) for r in analysis.analysed(docs, options=Options(mode="academic"), alternatives=True).collect()}
    looked = spark.createDataFrame([(1, ids[1][0]), (2, "sent_none"), (3, None), (4, ids[1][0])], "request_id long, sentence_id string")
    answers = {r.request_id: r for r in service.found(looked, stored).collect()}
    assert [answers[i].status for i in (1, 2, 3, 4)] == [200, 404, 404, 200] and answers[2].detail == "Analysis not found: sent_none" and answers[1].parses == answers[4].parses and len(answers[1].parses) == ids[1][1]
    many = ids[1][1]
    choices = spark.createDataFrame([(1, ids[1][0], 0), (2, ids[1][0], many - 1), (3, ids[1][0], many), (4, ids[2][0], -1), (5, "sent_none", 0), (6, ids[2][0], None)], "request_id long, sentence_id string, selected_parse int")
    done, updated = service.chosen(choices, stored, "request_id")
    assert {r.request_id: r.status for r in done.collect()} == {1: 200, 2: 200, 3: 400, 4: 400, 5: 404, 6: 400}
    rows = {r.sentence_id: r for r in updated.collect()}
    assert updated.columns == stored.columns and (rows[ids[1][0]].selected, rows[ids[1][0]].stage) == (many - 1, "human") and rows[ids[2][0]].stage == "none"
