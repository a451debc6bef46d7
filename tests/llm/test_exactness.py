"""Plain versions, random inputs, hostile inputs and clashing names."""

import itertools
import random
import re
import struct
import time
from collections import Counter

import numpy as np
import pandas as pd
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from corpusloom.llm import hashing, hilbert_ann, html_text, line_dedup, ngram_join, ordinal, packing, parity, simhash
from corpusloom.llm.tokens import Encoder, vocabulary
from tests.llm import brute

DOCS = "doc_id long, text string, lang string, source string, n_chars int"
SF = "/root/testdata/sf0.01"


# ---- words


@given(st.lists(st.text(alphabet="abcÄİσΣ é 　 \u0085\x1c\t\n\r ßﬀ漢​ ", max_size=40), max_size=8))
@settings(max_examples=300, deadline=None)
def test_hashed_words_are_those_of_split(texts):
    known = {}
    for t in texts:
        low = hashing.lowered(t.encode())
        buf = np.frombuffer(low, np.uint8)
        for words, (_, h) in ((t.lower().split(), hashing.hashed_words(buf, hashing.WHITE, wide=True)), (t.encode().lower().split(), hashing.hashed_words(hashing.LOWER[np.frombuffer(t.encode(), np.uint8)]))):
            words = [w if isinstance(w, bytes) else w.encode() for w in words]
            assert len(words) == len(h) and all(known.setdefault(w, x) == x for w, x in zip(words, h.tolist(), strict=True))
    assert len(set(known.values())) == len(known)


def test_very_long_words_have_hashes_of_their_own():
    a, b = b"ab" * 3000, b"ab" * 2999 + b"ac"
    _, h = hashing.hashed_words(np.frombuffer(b" ".join([a, b, a, b"x" * 1024, b"x" * 1025]), np.uint8))
    assert h[0] == h[2] and len(set(h.tolist())) == 4


# ---- tokens


ODD = "abEé'’.,;:!?()<|>#_-0123½²İıŉſßΣςσǅжЖ漢字कि́̇̈ͅ‍­   \t\n\r🙂"


@pytest.mark.parametrize(("name", "kind"), [("byte_bpe_50k.json", "byte"), ("word_bpe_49k.json", "word")])
def test_ids_of_random_unicode_equal_the_library(name, kind):
    tool, rng = Encoder(vocabulary(name), kind), random.Random(7)
    texts = []
    for _ in range(20_000):
        signs = [rng.choice(ODD) if rng.random() < 0.8 else chr(rng.choice([rng.randrange(32, 0x500), rng.randrange(0x500, 0xD800), rng.randrange(0xE000, 0x1F900)])) for _ in range(rng.randint(1, 14))]
        texts.append("".join(signs) if rng.random() < 0.5 else " ".join(["".join(signs), rng.choice(["BELEDİYESİ,", "TEKELİ)", "xİ.", "İ_", "é,", "word", "Don't!"])]))
    got = tool.arrays(t.encode() for t in texts)
    for t, own in zip(texts, got, strict=True):
        assert own.tolist() == tool.tokenizer.encode(t, add_special_tokens=False).ids, ascii(t)


# ---- op1


def plain_fingerprint(text):
    words = [w for w in re.split("[\x20\x09-\x0d]", text or "") if w]
    terms = [words[i : i + 5] for i in range(max(len(words) - 4, 1))] if words else []
    votes = [0] * 128
    for term in terms:
        a = 42
        for w in term:
            a = xxhash.xxh64_intdigest(w.encode(), a)
        b = xxhash.xxh64_intdigest(struct.pack("<i", 128), xxhash.xxh64_intdigest(struct.pack("<Q", a), 42))
        for k in range(128):
            votes[k] += 1 if (a >> k if k < 64 else b >> (k - 64)) & 1 else -1
    half = lambda v: sum(1 << k for k in range(64) if v[k] > 0)
    return f"{half(votes[:64]):016x}{half(votes[64:]):016x}"


def test_fingerprints_equal_plain_simhash(spark):
    rng = random.Random(2)
    texts = [" ".join(f"w{rng.randrange(30)}" for _ in range(rng.randint(1, 60))) for _ in range(30)] + ["", None, " \t ", "one", "a b c d e", "é ü x ß", "long " * 5000]
    rows = simhash.edited(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.fingerprint for r in rows} == {i: plain_fingerprint(t) for i, t in enumerate(texts)}
    plan = simhash.edited(spark.createDataFrame([(1, "a")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# ---- op2


def lines_frame(spark, lines):
    return spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "doc_id long, text string")


@pytest.mark.parametrize("hot", [20_000, 5])
def test_line_dedup_of_a_group_of_near_lines(spark, monkeypatch, hot):
    # lines around the threshold: many candidates that fail, so that the second look-up decides
    monkeypatch.setattr(line_dedup, "HOT", hot)
    monkeypatch.setattr(line_dedup, "SAMPLED", 1)
    rng = random.Random(4)
    base = [f"b{i}" for i in range(30)]
    lines = []
    for _ in range(250):
        own = rng.sample(base, rng.randint(24, 27)) + [f"x{rng.randrange(40)}" for _ in range(rng.randint(1, 5))]
        lines.append(" ".join(own))
    done = line_dedup.dedup(lines_frame(spark, lines)).orderBy("doc_id").collect()
    assert [r.text for r in done] == brute.kept_lines(list(enumerate(lines)))


@given(st.integers(4, 60), st.integers(4, 60), st.integers(0, 60), st.randoms(use_true_random=False))
@settings(max_examples=400, deadline=None)
def test_similar_lines_share_enough_prefix_words(n, m, both, rng):
    both = min(n, m, both)
    if 5 * both < 4 * (n + m - both):
        return
    order = list(range(n + m - both))
    rng.shuffle(order)
    a = sorted(order[:n])
    b = sorted(order[:both] + order[n:])
    shared = set(a[: line_dedup.prefix_length(n)]) & set(b[: line_dedup.prefix_length(m)])
    assert len(shared) >= line_dedup.least_shared(n, m)
    # and so the look-up finds the other line
    word = lambda x: hashing.mixed(np.asarray(x, np.uint64), 99)
    bits = np.zeros(line_dedup.BITMAP >> 5, np.uint32)
    prefix = word(a[: line_dedup.prefix_length(n)])
    for s in line_dedup.sized(prefix, np.full(len(prefix), n)).tolist():
        bits[s >> 5] |= np.uint32(1 << (s & 31))
    own = np.array([w for w in b[: line_dedup.prefix_length(m)] if w in a[: line_dedup.prefix_length(n)]])
    assert line_dedup.may_match(bits, word(own), np.zeros(len(own), np.int64), np.array([m], np.int32)).all()


@given(st.lists(st.tuples(st.integers(0, 3), st.integers(4, 40)), max_size=60), st.integers(0, 5), st.integers(1, 50))
@settings(max_examples=200, deadline=None)
def test_partners_leave_out_only_pairs_of_rows_that_look_no_more(rows, beside, at_once):
    rows = sorted(rows)
    group, size = (np.array([r[i] for r in rows], np.int64) for i in (0, 1))
    seen, ended = Counter(), set()

    def look(i, j):
        assert (i < j).all() and (group[i] == group[j]).all()
        seen.update(zip(i.tolist(), j.tolist(), strict=True))
        out = [k for k in {*i.tolist(), *j.tolist()} if k % 3 == 0]
        ended.update(out)
        return np.array(out, np.int64)

    parity.partners(group, size, lambda n: ((4 * n + 4) // 5, 5 * n // 4), look, beside, at_once)
    assert max(seen.values(), default=1) == 1
    for j in range(len(rows)):
        for i in range(j):
            if group[i] == group[j] and 4 * size[j] <= 5 * size[i] and not {i, j} <= ended:
                assert (i, j) in seen


@given(st.lists(st.tuples(st.sets(st.integers(0, 400), min_size=1, max_size=300), st.sets(st.integers(0, 400), max_size=40)), min_size=1, max_size=6))
@settings(max_examples=100, deadline=None)
def test_sketches_bound_the_difference_from_below(pairs):
    sets = [s for a, b in pairs for s in (a, a ^ b or {1})]
    size = np.array([len(s) for s in sets])
    shape = parity.Shape(16, 4)
    known = parity.Sketches(shape, size, shape.made(size, np.concatenate([np.array(sorted(s), np.uint64) for s in sets])))
    for i, j in itertools.combinations(range(len(sets)), 2):
        at, apart = known.near(np.array([i]), np.array([j]), np.array([len(sets[i] ^ sets[j])]))
        assert at.tolist() == [0] and apart[0] <= len(sets[i] ^ sets[j])


def test_line_dedup_of_long_lines_and_clashing_names(spark):
    long = " ".join(f"w{i}" for i in range(40_000))
    docs = spark.createDataFrame([(1, f"{long} end\nshort", 7, 8, 9, "a"), (2, f"x {long}\nshort", 1, 2, 3, "b")], "doc_id long, text string, lid int, ln_lines int, ln_gone int, ln_removed string")
    done = line_dedup.dedup(docs).orderBy("doc_id").collect()
    assert [(r.text, r.lid, r.ln_lines, r.ln_gone, r.ln_removed, r.ln_lines_, r.ln_removed_) for r in done] == [(f"{long} end\nshort", 7, 8, 9, "a", 2, 0), ("", 1, 2, 3, "b", 2, 2)]


def test_classes_of_fingerprints_equal_brute_force(spark):
    rng = random.Random(8)
    ball = rng.getrandbits(128)
    # one dense ball, whose block tables must be cut further, chains, copies and lone ones
    values = [ball ^ sum(1 << k for k in rng.sample(range(128), rng.randrange(6))) for _ in range(400)]
    for _ in range(30):
        v = rng.getrandbits(128)
        for _ in range(rng.randrange(1, 6)):
            values.append(v)
            v ^= sum(1 << k for k in rng.sample(range(128), rng.randrange(0, 5)))
    values += [values[-1]] * 60 + [0, 0]
    ids = rng.sample(range(10_000), len(values))
    ids[-3], ids[-2], ids[-1] = None, None, None
    rows = [(i, f"{v:032x}", "x") for i, v in zip(ids, values, strict=True)]
    docs = spark.createDataFrame(rows, "doc_id long, fingerprint string, text string")
    for bucket in (256, 32):
        hi, lo = (F.conv(F.substring("fingerprint", k, 16), 16, -10).cast("long") for k in (1, 17))
        pairs = simhash.near_pairs(docs.select(hi.alias("fp_hi"), lo.alias("fp_lo")), 3, bucket).collect()
        distinct = sorted(set(values))
        want = {frozenset(p) for p in itertools.combinations(distinct, 2) if (p[0] ^ p[1]).bit_count() <= 3}
        whole = lambda a, b: ((a & (2**64 - 1)) << 64) | (b & (2**64 - 1))
        assert {frozenset((whole(r.fp_hi, r.fp_lo), whole(r.fp_hi2, r.fp_lo2))) for r in pairs} == want and len(pairs) == len(want)
    group = {v: v for v in distinct}

    def root(v):
        while group[v] != v:
            v = group[v]
        return v

    for p in want:
        a, b = map(root, p)
        group[a] = b
    members = {}
    for i, v in zip(ids, values, strict=True):
        members.setdefault(root(v), []).append(i)
    expected = sorted(((i, min((x for x in m if x is not None), default=None), len(m)) for m in members.values() for i in m), key=str)
    got = simhash.classes(docs)
    assert got.columns == ["doc_id", "fingerprint", "text", "class_id", "class_rows"]
    assert sorted(((r.doc_id, r.class_id, r.class_rows) for r in got.collect()), key=str) == expected
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
    assert simhash.classes(docs.limit(0)).collect() == []


# ---- op3


def test_nearest_compares_windows_and_tells_its_recall(spark, monkeypatch):
    monkeypatch.setattr(hilbert_ann, "LEAST_BLOCK", 16)
    rng = np.random.default_rng(3)
    x = (rng.standard_normal((40, 8)) * 4)[rng.integers(0, 40, 2500)] + rng.standard_normal((2500, 8)) * 0.1
    rows = [(i, [float(v) for v in r], 0) for i, r in enumerate(x)]
    got = hilbert_ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).toPandas()
    assert 0.9 <= got.recall_measured.iloc[0] <= 1 and got.recall_measured.nunique() == 1
    hit = 0
    for q, own in got.groupby("query_id"):
        s = x @ x[q]
        s[q] = -np.inf
        hit += len(set(own.vec_id) & set(np.argsort(-s)[:20].tolist()))
    assert hit >= 0.9 * 20 * got.query_id.nunique()
    assert (got.groupby("query_id").size() == 20).all()


def test_nearest_finds_twenty_even_where_queries_stand_together(spark):
    # the window counts rows only, so queries that lie side by side don't take each other's room
    rng = np.random.default_rng(4)
    x = rng.standard_normal((900, 6))
    rows = [(i * 20 if i < 300 else i * 20 + 1, [float(v) for v in r]) for i, r in enumerate(x)]
    got = hilbert_ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), target=0.0).toPandas()
    assert got.query_id.nunique() == 300 and (got.groupby("query_id").size() == 20).all()
    assert not (got.query_id == got.vec_id).any() and not got.duplicated(["query_id", "vec_id"]).any()


# ---- op4


def test_cumulative_link_fit_equals_a_plain_one():
    rng = np.random.default_rng(1)
    x = rng.random((400, 6)) < 0.4
    score = x @ np.array([2.0, -2, 1, 0, 0, -1]) + rng.logistic(size=400)
    grade = (score > -0.5).astype(int) + (score > 1.5)
    model = ordinal.fit([np.flatnonzero(r).astype("i4") for r in x], grade, list(range(6)))

    def loss(theta):
        w, cuts = theta[:6], np.array([theta[6], theta[6] + np.exp(theta[7])])
        tail = 1 / (1 + np.exp(cuts[None, :] - (x @ w)[:, None]))
        upper, lower = np.concatenate([np.ones((400, 1)), tail], 1), np.concatenate([tail, np.zeros((400, 1))], 1)
        k = np.arange(400)
        return -np.log(np.maximum(upper[k, grade] - lower[k, grade], 1e-12)).mean() + ordinal.RIDGE / 2 * (w @ w)

    theta = np.zeros(8)
    for _ in range(3000):  # plain descent along numeric slopes
        slope = np.array([(loss(theta + e) - loss(theta - e)) / 2e-5 for e in np.eye(8) * 1e-5])
        theta -= 0.5 * slope
    own = np.array([model.weights[i] for i in range(6)] + [model.thresholds[0], np.log(model.thresholds[1] - model.thresholds[0])])
    assert loss(own) < loss(theta) + 1e-3
    tails = model.tails({0, 2})
    assert tails[0] > tails[1] and np.allclose(tails, [1 / (1 + np.exp(t - model.weights[0] - model.weights[2])) for t in model.thresholds])


# ---- op5


def stripped(page):
    """Without class, id and role, and with plain divs for all elements whose name tells what they hold."""
    page = re.sub(r"\s(?:class|id|role|aria-[a-z]+)\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>]+)", "", page, flags=re.I)
    return re.sub(r"<(/?)(article|main|nav|header|footer|aside|section|menu|dialog|form|fieldset)\b", r"<\1div", page, flags=re.I)


def test_text_features_alone_find_the_article():
    pages = pd.read_parquet(f"{SF}/pages.parquet").html
    right = kept = wanted = 0
    for page in pages:
        truth = Counter(b[0] for b in html_text.blocks(page) if b[5] and not b[4])
        found = html_text.blocks(stripped(page))
        keep = html_text.decide(html_text._TREE, html_text.features(found)) if found else []
        for b, k in zip(found, keep, strict=True):
            good = truth[b[0]] > 0
            right, kept, wanted = right + b[1] * (good and k), kept + b[1] * k, wanted + b[1] * good
    assert right / kept > 0.93 and right / wanted > 0.95


def test_hostile_pages_end_in_time():
    began = time.time()
    for page in ("<a " * 700_000, '<a "' * 500_000, "<div></p>" * 200_000, "<!" * 700_000, "x<!-- " * 300_000, "<div>" * 200_000 + "</p>" * 200_000, "<p>word " * 200_000):
        html_text.main_text(page)
    assert time.time() - began < 30


def test_extract_keeps_other_columns(spark):
    pages = spark.createDataFrame([(1, "<article><p>Some text here</p></article>", "old", "other")], "page_id long, html string, text string, ht_text string")
    r = html_text.extract(pages).first()
    assert (r.page_id, r.text, r.ht_text) == (1, "Some text here", "other") and "html" not in r


# ---- op6


def fewest(lengths, capacity):
    """By trying all ways."""
    best = [len(lengths)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + lengths[i] <= capacity:
                bins[k] += lengths[i]
                go(i + 1, bins)
                bins[k] -= lengths[i]
        go(i + 1, [*bins, lengths[i]])

    go(0, [])
    return best[0]


def test_packing_against_all_ways():
    rng = random.Random(5)
    more = 0
    for _ in range(150):
        lengths = [rng.randint(1, 20) for _ in range(rng.randint(1, 9))]
        bins = packing.packed(lengths, 20)
        assert sorted(i for b in bins for i in b) == list(range(len(lengths))) and max(sum(lengths[i] for i in b) for b in bins) <= 20
        more += len(bins) - fewest(lengths, 20)
    assert more <= 2


def test_swaps_gain_on_a_plain_first_filling():
    # next fit in the given order, as a first filling without any sorting, and what the swaps make of it
    rng = random.Random(6)
    lengths = [rng.choice([rng.randint(20, 400), rng.randint(300, 900)]) for _ in range(1500)]
    bins, room = [[]], 1024
    for i, n in enumerate(lengths):
        if n > room:
            bins.append([])
            room = 1024
        bins[-1].append(i)
        room -= n
    done = packing.improve([list(b) for b in bins], lengths, 1024)
    least = -(-sum(lengths) // 1024)
    assert sorted(i for b in done for i in b) == list(range(1500)) and max(sum(lengths[i] for i in b) for b in done) <= 1024
    assert least <= len(packing.packed(lengths)) <= least + 1 <= len(done) < 0.85 * len(bins)


def test_many_equal_rows_are_dealt_to_all_groups(spark):
    items = spark.createDataFrame([(None, 0, 3)] * 900 + [(i, 0, 5) for i in range(300)], "doc_id long, piece int, length long")
    done = packing.pack(items, capacity=10, group_pieces=100).toPandas()
    assert len(done) == 1200 and done.groupby("sequence_id").length.sum().max() <= 10
    assert (done.sequence_id // 2**32).value_counts().max() < 200
    with pytest.raises(ValueError, match="offset"):
        packing.pack(items.withColumn("offset", F.lit(1)))


# ---- op9


def test_one_of_each_keeps_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b c d e", 77, "x"), (2, "A b c d e", 78, "y"), (3, "other words", 79, "z")], "doc_id long, text string, lid int, ng_lid string")
    assert sorted(map(tuple, ngram_join.one_of_each(docs).collect())) == [(1, "a b c d e", 77, "x"), (3, "other words", 79, "z")]


def test_ngram_join_of_long_texts_and_one_large_group(spark, monkeypatch):
    rng = random.Random(9)
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    texts = []
    for _ in range(150):
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10_000)}"
        texts.append(" ".join(w))
    long = " ".join(f"v{rng.randrange(3000)}" for _ in range(30_000))
    texts += [long, long + " more words at the end", None, "", "two words", "TWO words"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    first, sizes = brute.components(texts)
    for limit in (4096, 20):
        monkeypatch.setattr(ngram_join, "GROUP_SETS", limit)
        rows = ngram_join.linked(docs).orderBy("doc_id").collect()
        assert [r.component_id for r in rows] == first and [r.n_shingles for r in rows] == sizes


# ---- the pipeline


def test_pipeline_on_empty_and_null_tables(spark, tmp_path):
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    for name, rows in (("none", []), ("nulls", [(None, None, None, None, None), (1, "", None, "s", 0), (1, "", None, "s", 0), (2, "a b c d e f", "en", None, 11)])):
        d = tmp_path / name
        spark.createDataFrame(rows, DOCS).write.parquet(str(d / "documents.parquet"))
        (labels if rows else labels.limit(0)).write.parquet(str(d / "labels.parquet"))
        done = corpus_pipeline.run(spark, str(d)).collect()
        assert bool(done) == bool(rows)
        if rows:
            assert 2 in {r.doc_id for r in done} and all(r.length >= 1 for r in done)


def test_stages_keep_columns_with_clashing_names(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b c d e f\nx y z w", 3, 4), (2, "A b c d e f\nnew words here", 5, 6)], "doc_id long, text string, lid int, ln_gone int")
    second = corpus_pipeline.lines(spark, docs, str(tmp_path))
    third = corpus_pipeline.near_copies(spark, second, str(tmp_path))
    assert second.columns == third.columns == docs.columns
    assert sorted(map(tuple, third.collect())) == [(1, "a b c d e f\nx y z w", 3, 4), (2, "new words here", 5, 6)]


def test_underfull_bins_of_all_groups_meet(spark):
    rng = random.Random(6)
    rows = [(None if i == 5 else i, 0, rng.randrange(1, 9) if i % 3 else 4, "x") for i in range(3000)]
    items = spark.createDataFrame(rows, "doc_id long, piece int, length int, pk_fill string").repartition(5)
    done = packing.pack(items, capacity=10, group_pieces=100).toPandas()
    assert sorted(done.doc_id.fillna(-1).tolist()) == sorted(-1 if r[0] is None else r[0] for r in rows) and (done.pk_fill == "x").all()
    assert done.length.sum() == sum(r[2] for r in rows)
    fills = done.groupby("sequence_id").length.sum()
    assert fills.max() <= 10
    for _, own in done.sort_values("offset").groupby("sequence_id"):
        assert own.offset.tolist() == [0, *own.length.cumsum()[:-1]]
    # thirty groups apart waste more bins than all pieces in one group do; the rounds get back most of that
    apart = sum(len(packing.packed([r[2] for r in rows[a : a + 100]], 10)) for a in range(0, 3000, 100))
    at_once = len(packing.packed([r[2] for r in rows], 10))
    assert at_once < apart and len(fills) - at_once <= (apart - at_once) / 2
    again = packing.pack(items, capacity=10, group_pieces=100).toPandas()
    key = ["doc_id", "sequence_id", "offset"]
    assert done[key].sort_values(key).to_numpy().tolist()[:-1] == again[key].sort_values(key).to_numpy().tolist()[:-1]


def test_bins_that_nothing_helps_end_after_one_round(spark):
    items = spark.createDataFrame([(i, 0, 6) for i in range(900)], "doc_id long, piece int, length int")
    done = packing.pack(items, capacity=10, group_pieces=100).toPandas()
    assert len(done) == 900 and done.sequence_id.nunique() == 900 and (done.offset == 0).all()
