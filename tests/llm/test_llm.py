"""Each operator against a plain version, and its edge cases."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from corpusloom.llm import graph, hilbert_ann, html_text, katz, line_dedup, mixing, ngram_join, ordinal, packing, queries, simhash, token_files
from corpusloom.llm.tokens import Encoder, vocabulary
from tests.llm import brute

DOCS = "doc_id long, text string, lang string, source string, n_chars int"
SF = "/root/testdata/sf0.001"


def made(seed=3, n=120):
    """Texts with copies, near copies, shared passages, common lines, odd white space, nulls and a very long one."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    line = lambda k: " ".join(rng.choice(vocab) for _ in range(k))
    common, passage = [line(8) for _ in range(3)], line(60)
    texts = []
    for i in range(n):
        kind = rng.random()
        if texts and kind < 0.12:
            t = rng.choice(texts)
        elif texts and kind < 0.35:
            w = (rng.choice(texts) or "a").split(" ")
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            t = " ".join(w)
        else:
            t = "\n".join([line(rng.randint(1, 30)) for _ in range(rng.randint(1, 5))] + rng.sample(common, rng.randint(0, 2)) + [passage] * (rng.random() < 0.15))
        texts.append(t)
    texts[5], texts[6], texts[7], texts[8], texts[9] = None, "", "  \t\n ", "one", "Two  words\tHERE"
    texts[10] = "\n".join(line(20) for _ in range(700))
    return texts


def frame(spark, texts, ids=None):
    ids = list(range(0, 3 * len(texts), 3)) if ids is None else ids
    return spark.createDataFrame([(d, t, "en", f"s{(d or 0) % 4}" if d is None or d % 7 else None, None if t is None else len(t)) for d, t in zip(ids, texts, strict=True)], DOCS)


EMPTY = []


# ---- op1


def simhash_rows(docs):
    return {r.doc_id: r for r in simhash.edited(docs).collect()}


def test_simhash_edits_and_likeness(spark):
    texts = made()
    got = simhash_rows(frame(spark, texts).withColumn("fingerprint", F.lit("clash")))
    ids = list(range(0, 3 * len(texts), 3))
    assert sorted(got) == ids
    plain = [t or "" for t in texts]
    by_text = {}
    for i, d in enumerate(ids):
        own, after = plain[i], plain[i - 1]  # descending ids; after the smallest the largest
        half = len(own) // 2
        edit = own[: len(own) - half] + after[:half]
        assert got[d].n_chars == len(own) and got[d].edited_sha256 == hashlib.sha256(edit.encode()).hexdigest()
        assert by_text.setdefault(own, got[d].fingerprint) == got[d].fingerprint
        bits = lambda a, b: bin(int(a, 16) ^ int(b, 16)).count("1")
        assert got[d].hamming_edited == bits(got[d].fingerprint, got[d].edited_fingerprint)
        assert got[d].hamming_next == bits(got[d].fingerprint, got[ids[i - 1]].fingerprint)
        assert 0 <= got[d].near_edited <= 1 and (got[d].near_next == 1.0) == (got[d].hamming_next == 0)
    assert got[18].fingerprint == "0" * 32 and got[15].fingerprint == "0" * 32


def test_simhash_of_repeated_rows_null_ids_and_nothing(spark):
    texts = ["alpha beta gamma", "x y z", "x y z", "tail"]
    rows = simhash.edited(frame(spark, texts, [4, 2, 2, None])).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in rows) == [(False, 2), (False, 2), (False, 4), (True, 0)]
    last = next(r for r in rows if r.doc_id is None)
    assert last.edited_sha256 == hashlib.sha256(b"taal").hexdigest()
    assert simhash.edited(frame(spark, EMPTY)).collect() == []


def test_block_tables_find_all_within_the_radius(spark):
    rng = random.Random(1)
    base = [rng.getrandbits(128) for _ in range(40)]
    values = base + [b ^ sum(1 << rng.randrange(128) for _ in range(k)) & ((1 << 128) - 1) for b in base for k in (1, 2, 3, 4)]
    signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x
    split = sorted({(signed(v >> 64), signed(v & ((1 << 64) - 1))) for v in values})
    dist = lambda a, b: bin((a[0] ^ b[0]) & (2**64 - 1)).count("1") + bin((a[1] ^ b[1]) & (2**64 - 1)).count("1")
    want = {(a, b) for i, a in enumerate(split) for b in split[i + 1 :] if dist(a, b) <= 3}
    got = simhash.near_pairs(spark.createDataFrame(split + split[:3], "fp_hi long, fp_lo long"), 3).collect()
    assert {((r.fp_hi, r.fp_lo), (r.fp_hi2, r.fp_lo2)) for r in got} == want and len(got) == len(want) and want


def test_simhash_runs_no_python(spark):
    plan = simhash.fingerprints(frame(spark, ["a b"]).select("doc_id", "text"), ["doc_id"])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# ---- op2


@pytest.mark.parametrize("seed", [3, 4])
def test_line_dedup_equals_brute_force(spark, seed):
    texts = made(seed)
    ids = list(range(0, 3 * len(texts), 3))
    done = line_dedup.dedup(frame(spark, texts, ids).withColumn("place", F.lit(1))).orderBy("doc_id").collect()
    assert [r.text for r in done] == brute.kept_lines(list(zip(ids, texts, strict=True)))
    assert done[0].place == 1 and done[5].text is None


def test_line_dedup_looks_again_and_splits_hot_words(spark, monkeypatch):
    # small groups: the exact ways for the rest must give the same
    monkeypatch.setattr(line_dedup, "NEIGHBOURS", 2)
    monkeypatch.setattr(line_dedup, "HOT", 3)
    monkeypatch.setattr(line_dedup, "SAMPLED", 1)
    rng = random.Random(8)
    texts = ["\n".join(" ".join(rng.sample([f"v{i}" for i in range(14)], 9)) for _ in range(6)) for _ in range(25)]
    ids = list(range(len(texts)))
    done = line_dedup.dedup(frame(spark, texts, ids)).orderBy("doc_id").collect()
    assert [r.text for r in done] == brute.kept_lines(list(zip(ids, texts, strict=True)))


def test_line_dedup_edges(spark):
    a = "one two three four five"
    docs = frame(spark, [a, a + "\nshort", a, "new words go here now"], [1, 1, None, None])
    assert sorted((r.doc_id or 0, r.text or "") for r in line_dedup.dedup(docs).collect()) == [(0, ""), (0, "new words go here now"), (1, "one two three four five"), (1, "short")]
    assert line_dedup.dedup(frame(spark, EMPTY)).collect() == []


# ---- op3


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def test_nearest_equals_brute_force_on_small_tables(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((300, 8)).astype("f4") * rng.random((300, 1)).astype("f4")
    rows = [(i, [float(v) for v in x[i]], 0) for i in range(300)]
    rows += [(i, rows[40][1], 0) for i in range(300, 360)] + [rows[7], (901, None, 0), (920, [0.0] * 8, 0), (940, [float("nan")] * 8, 0), (960, [1.0, None] + [0.0] * 6, 0), (980, [1.0], 0)]
    got = pd.DataFrame([r.asDict() for r in hilbert_ann.nearest(vectors(spark, rows), target=1.0).collect()])
    sound = {i: np.array(v, "f8") for i, v, _ in rows if v is not None and len(v) == 8 and all(c is not None and np.isfinite(c) for c in v) and any(v)}
    assert sorted(set(got.query_id)) == [i for i in sorted(sound) if i % 20 == 0]
    for q, own in got.groupby("query_id"):
        own = own.sort_values("rank")
        want = sorted((-float(sound[q] @ v), i) for i, v in sound.items() if i != q)[:20]
        assert own["rank"].tolist() == list(range(1, 21)) and np.allclose(own.score, [-s for s, _ in want], atol=1e-12)
        ties = {round(-s, 9) for s, _ in want}
        assert len(ties) < 20 or own.vec_id.tolist() == [i for _, i in want]


def test_nearest_of_few_or_no_vectors(spark):
    got = hilbert_ann.nearest(vectors(spark, [(0, [1.0, 0.0], 0), (1, [0.5, 0.5], 0), (20, [0.0, 1.0], 0)])).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in got) == [(0, 1, 1), (0, 2, 20), (20, 1, 1), (20, 2, 0)]
    assert hilbert_ann.nearest(vectors(spark, EMPTY)).collect() == []


def test_nearest_recall_with_narrow_windows(spark, monkeypatch):
    monkeypatch.setattr(hilbert_ann, "LEAST_BLOCK", 128)
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((60, 16)) * 3
    x = centres[rng.integers(0, 60, 4000)] + rng.standard_normal((4000, 16)) * 0.3
    x /= np.linalg.norm(x, axis=1)[:, None]
    got = hilbert_ann.nearest(vectors(spark, [(i, [float(v) for v in r], 0) for i, r in enumerate(x.astype("f4"))])).toPandas()
    x = x.astype("f4").astype("f8")
    hit = 0
    for q, own in got.groupby("query_id"):
        s = x @ x[q]
        s[q] = -np.inf
        hit += len(set(np.argsort(-s)[:20]) & set(own.vec_id))
    assert hit / (200 * 20) >= 0.9


@given(st.integers(2, 4), st.integers(1, 3))
@settings(max_examples=12, deadline=None)
def test_hilbert_curve_steps_to_neighbours(d, bits):
    grid = np.stack([g.ravel() for g in np.meshgrid(*[np.arange(1 << bits)] * d, indexing="ij")], 1)
    keys = hilbert_ann.hilbert_keys(grid, bits)
    assert sorted(keys.tolist()) == list(range(len(grid)))
    path = grid[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


# ---- op4


def test_classifier_on_held_out_labels():
    d = "/root/testdata/sf0.1"
    docs = pd.read_parquet(f"{d}/documents.parquet").set_index("doc_id")["text"]
    labels = pd.read_parquet(f"{d}/labels.parquet")
    grade = np.where(labels.quality == 0, 0, np.where(labels.toxic == 1, 1, 2))
    tool = ordinal.Buckets()
    rows = [np.array(sorted(tool.of(docs[i])), "i4") for i in labels.doc_id]
    train = np.arange(len(labels)) % 5 != 0
    low = grade[train] < 2
    flat = lambda keep: np.bincount(np.concatenate([r for r, k in zip([r for r, t in zip(rows, train, strict=True) if t], keep, strict=True) if k]), minlength=ordinal.BUCKETS)
    chosen = np.flatnonzero(ordinal.differs(flat(low), flat(~low), low.sum(), (~low).sum())).tolist()
    wanted = set(chosen)
    model = ordinal.fit([np.array([b for b in r if b in wanted], "i4") for r, t in zip(rows, train, strict=True) if t], grade[train], chosen)
    assert model.thresholds == sorted(model.thresholds)
    tails = np.array([model.tails({b for b in r.tolist() if b in wanted}) for r in rows])
    keep = tails[:, -1] >= ordinal.CUT
    test = ~train
    assert keep[test & (grade == 2)].mean() > 0.97 and keep[test & (grade == 0)].mean() < 0.05 and keep[test & (grade == 1)].mean() < 0.35


def test_classifier_edges(spark):
    docs = frame(spark, [None, "", "good text here", "good text here"], [1, 2, None, 4])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    kept = ordinal.classify(docs, none).collect()
    assert len(kept) == 4 and all(r.ql_keep and r.ql_tail == 1.0 for r in kept)
    labels = spark.createDataFrame([(i, i % 2, None if i == 7 else 0) for i in range(40)] + [(None, 1, 0), (3, 0, 0)], "doc_id long, quality int, toxic int")
    many = frame(spark, [("fine words" if i % 2 else "junk %% ##") + f" u{i}" for i in range(40)], list(range(40)))
    got = {r.doc_id: r.ql_keep for r in ordinal.classify(many.withColumn("ql", F.lit(1)), labels).collect()}
    assert got[9] and not got[10] and len(got) == 40
    assert ordinal.classify(frame(spark, EMPTY), labels).collect() == []


# ---- op5

PAGE = (
    '<html><head><title>T</title><style>p{}</style><script>var a="<p>x</p>";</script></head><body><header><a href="/">Site</a></header><nav><ul><li><a href="/a">Home</a></li></ul></nav>'
    '<div class="cookie-notice">We use cookies on this site for your comfort and ours, please accept</div><article><h1>The &amp; title</h1><p>First  para&shy;graph<br>goes <a href="x">on</a> here.<p>Short.<aside>Related reading here</aside>'
    '<div class="ad">Buy now at a very good price today</div><form>Name <input> <button>Send</button></form><p>Last &lt;one&gt; &#233;</p><div id="comments"><p>A reader says that this is all wrong and more</p></div></article><div class="sidebar">More things to read on the side</div><footer>&copy; all</footer>'
)


def test_html_keeps_the_article_only():
    assert html_text.main_text(PAGE) == "The & title First para\xadgraph goes on here. Short. Last <one> é"
    plain = "<body><nav><a href=a>x</a> <a href=b>y</a></nav><div><p>" + "A long paragraph of text without links. " * 5 + "</p><p>" + "Another one that goes on for quite some words here. " * 4 + "</p></div><div><a href=1>one</a> <a href=2>two</a> <a href=3>three</a></div></body>"
    assert html_text.main_text(plain).startswith("A long") and html_text.main_text(plain).endswith("words here.")


@pytest.mark.parametrize("page", [None, "", "<", "<!-- open", "<p", "text <b>", "</div></p>", "<script>never closed", "<a><p>", "&#xZZ; &bogus; &#99999999;", "<article>" * 300, "\x00<p>\x00"])
def test_html_survives_broken_pages(page):
    assert isinstance(html_text.main_text(page), str)


def test_html_pages_of_the_test_data(spark):
    import html
    import re

    got = {r.page_id: r.text for r in html_text.extract(spark.read.parquet(f"{SF}/pages.parquet").withColumn("text", F.lit("clash"))).collect()}
    for page_id, page in pd.read_parquet(f"{SF}/pages.parquet")[["page_id", "html"]].itertuples(index=False):
        inner = re.search(r"<article>(.*?)(</article>|\Z)", page, re.S)[1]
        want = " ".join(html.unescape(re.sub(r"<(?:p|br|/p|h1|/h1)[^>]*>", " ", inner).replace("<b>", "").replace("</b>", "")).split())
        assert got[page_id] == want
    assert html_text.extract(spark.createDataFrame([(1, None)], "page_id long, html string")).collect()[0].text == ""
    assert html_text.extract(spark.createDataFrame(EMPTY, "page_id long, html string")).collect() == []


# ---- tokens, op6, op7

ODD_TEXTS = ["", " ", "a  b", " x", "x ", "a\n\nb", "tab\tb", "<|endoftext|> hi <|endoftext|>there", "x<|startoftext|>y", "Σ ΑΣ. ΑΣ́ b", "a b", "a\x1cb c", "\n", "é ́x", "I'm you'll 12 34's", "日本 語テ", "'s 's\n's", "a\xa0b", "x\r\ny", "İstanbul ŉ ß ſ", "don't.", "a,b. c.,; (d)", "¼ ½ ²", "word.'s"]


@pytest.mark.parametrize(("name", "kind"), [("byte_bpe_50k.json", "byte"), ("word_bpe_49k.json", "word")])
def test_encoder_equals_the_library(name, kind):
    tool = Encoder(vocabulary(name), kind)
    texts = ODD_TEXTS + [t for t in made() if t] + pd.read_parquet(f"{SF}/documents.parquet")["text"].tolist()
    for t in texts * 2:
        assert tool.one(t) == np.asarray(tool.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), repr(t[:80])


@given(st.lists(st.integers(1, 50), max_size=120))
@settings(max_examples=60, deadline=None)
def test_packing_is_whole_and_tight(lengths):
    bins = packing.packed(lengths, 50)
    assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
    assert all(0 < sum(lengths[i] for i in b) <= 50 for b in bins)
    first_fit = []
    for n in sorted(lengths, reverse=True):
        at = next((i for i, f in enumerate(first_fit) if f + n <= 50), None)
        first_fit.append(n) if at is None else first_fit.__setitem__(at, first_fit[at] + n)
    assert len(bins) <= len(first_fit)


def test_local_search_empties_bins():
    # two bins of 6+3 and two of 5+4 hold what fits in ceil(36/12) = 3 bins
    lengths = [6, 3, 6, 3, 5, 4, 5, 4]
    bins = packing.improve([[0, 1], [2, 3], [4, 5], [6, 7]], lengths, 12)
    assert len(bins) == 3 and sorted(i for b in bins for i in b) == list(range(8))


def check_packing(rows, texts_by_id, capacity=1024):
    tool = Encoder(vocabulary("byte_bpe_50k.json"), "byte")
    for d, text in texts_by_id.items():
        ids = tool.one(text or "") + b"\x02\0\0\0"
        own = rows[rows.doc_id == d].sort_values("start")
        assert own.length.sum() * 4 == len(ids) and own.piece.tolist() == list(range(len(own))) and (own.length[1:] == capacity).all()
        assert own.start.tolist() == [0, *own.length.cumsum().tolist()[:-1]]
        assert [zlib.crc32(ids[4 * a : 4 * (a + n)]) for a, n in zip(own.start, own.length, strict=True)] == own.ids_crc32.tolist()
    by = rows.sort_values(["sequence_id", "offset"])
    assert (by.offset == by.groupby("sequence_id").length.cumsum() - by.length).all() and by.groupby("sequence_id").length.sum().max() <= capacity


def test_pack_documents(spark):
    texts = made()
    ids = list(range(0, 3 * len(texts), 3))
    rows = packing.pack_documents(frame(spark, texts, ids).withColumn("piece", F.lit("clash")), vocabulary("byte_bpe_50k.json")).toPandas()
    check_packing(rows, dict(zip(ids, texts, strict=True)))
    assert rows.sequence_id.nunique() <= -(-rows.length.sum() // 1024) + 1
    odd = packing.pack_documents(frame(spark, ["a b", "a b", None], [1, 1, None]), vocabulary("byte_bpe_50k.json")).toPandas()
    assert len(odd) == 3 and odd.sequence_id.nunique() == 1 and odd.doc_id.isna().sum() == 1
    assert packing.pack_documents(frame(spark, EMPTY), vocabulary("byte_bpe_50k.json")).collect() == []


def test_token_files_round_trip(spark):
    texts = made()
    ids = [3 * i for i in range(len(texts))][::-1]
    tool = Encoder(vocabulary("word_bpe_49k.json"), "word")
    folder = token_files.write_files(frame(spark, texts, ids).withColumn("frame", F.lit(1)), vocabulary("word_bpe_49k.json"))
    got = token_files.read_files(spark, folder).toPandas().sort_values("doc_id")
    want = [tool.one(t or "") + b"\x02\0\0\0" for _, t in sorted(zip(ids, texts, strict=True), key=lambda x: x[0])]
    n = np.array([len(w) // 4 for w in want])
    assert got.n_tokens.tolist() == n.tolist() and got.start.tolist() == (n.cumsum() - n).tolist() and got.ids_crc32.tolist() == [zlib.crc32(w) for w in want]
    dictionary = bytes(spark.read.parquet(f"{folder}/dictionary").first()["dictionary"])
    blob = bytes(spark.read.parquet(f"{folder}/files").orderBy("part", "n").first()["blob"])
    assert token_files.read_document(blob, dictionary, 2) == want[2]
    with pytest.raises(ValueError, match="dictionary"):
        token_files.read_document(blob, dictionary + b"x", 0)


def test_token_files_edges(spark):
    path = vocabulary("word_bpe_49k.json")
    rows = token_files.read_files(spark, token_files.write_files(frame(spark, ["a b", "c", None, "d"], [None, 2, 2, 1]), path)).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [1, 2, 2, None] and [r.start for r in rows] == [0, 2, *sorted(r.start for r in rows)[2:]]
    assert token_files.read_files(spark, token_files.write_files(frame(spark, EMPTY), path)).collect() == []


# ---- op8


def test_mixing_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    cursor = con.execute(queries.OP8_SQL)
    names = [d[0] for d in cursor.description]
    own = queries.op8_mix_sources(spark, SF)
    assert sorted(map(str, own.select(*names).collect())) != [] and sorted(tuple(r) for r in own.select(*names).collect()) == sorted(cursor.fetchall())


def plain_targets(sizes, weights=(3, 1, 2), share=1.5, cap=2.0):
    w = {s: weights[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, (s or "").encode())))}
    left, out, open_ = share * sum(sizes.values()), {}, set(sizes)
    while open_:
        total = sum(w[s] for s in open_)
        full = {s for s in open_ if left * w[s] / total > cap * sizes[s]}
        if not full:
            return out | {s: left * w[s] / total for s in open_}
        for s in full:
            out[s] = cap * sizes[s]
            left -= out[s]
        open_ -= full
    return out


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1, "c": 1000, None: 5}, {"a": 0, "b": 0}, {"x": 7}, {"a": 5, "b": 500, "c": 500, "d": 500, "e": 2, "f": 0}])
def test_targets_equal_the_loop(spark, sizes):
    rows = spark.createDataFrame(list(sizes.items()), "mix_source string, mix_source_size long")
    got = {r.mix_source: r.mix_target for r in mixing.source_targets(rows, [3, 1, 2], 1.5, 2.0).collect()}
    want = plain_targets(sizes)
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in want)


def test_mixing_edges(spark):
    docs = frame(spark, [None, "", "a b c", "a b c", "d e f g"], [1, 2, 3, 3, None])
    rows = mixing.mix(docs.withColumn("rate", F.lit(9))).collect()
    assert len(rows) == 5 and {r.mix_copies for r in rows if r.doc_id == 3} != set() and len({r.mix_copies for r in rows if r.doc_id == 3}) == 1
    assert all(0 <= r.mix_copies <= 2 for r in rows)
    assert mixing.repeated(mixing.mix(docs)).count() == sum(r.mix_copies for r in rows)
    assert mixing.mix(frame(spark, EMPTY)).collect() == []


# ---- op9


@pytest.mark.parametrize("seed", [3, 6])
def test_ngram_join_equals_brute_force(spark, seed):
    texts = made(seed)
    ids = list(range(0, 3 * len(texts), 3))
    got = ngram_join.linked(frame(spark, texts, ids).withColumn("label", F.lit(1))).orderBy("doc_id").collect()
    first, n = brute.components(texts)
    assert [r.n_shingles for r in got] == n and [r.component_id for r in got] == [ids[f] for f in first]
    kept = sorted(r.doc_id for r in ngram_join.one_of_each(frame(spark, texts, ids)).collect())
    assert kept == sorted({ids[f] for f in first})


@pytest.mark.parametrize(("sets", "shingles"), [(4096, 2_000_000), (7, 2_000_000), (4096, 200)])
def test_ngram_join_of_large_groups_in_chunks_is_the_same(spark, monkeypatch, sets, shingles):
    monkeypatch.setattr(ngram_join, "GROUP_SETS", sets)
    monkeypatch.setattr(ngram_join, "GROUP_SHINGLES", shingles)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(40)]
    texts = []
    for _ in range(60):  # a group of near copies of many sizes
        w = base[rng.randint(0, 4) : len(base) - rng.randint(0, 4)]
        w[rng.randrange(len(w))] = "x" * rng.randint(1, 3)
        texts.append(" ".join(w))
    got = ngram_join.linked(frame(spark, texts)).orderBy("doc_id").collect()
    first, _ = brute.components(texts)
    assert [r.component_id for r in got] == [3 * f for f in first]


def test_ngram_join_edges(spark):
    rows = ngram_join.linked(frame(spark, ["a b", "A B", None, "", "a b", "é x"], [5, 5, 7, 7, None, 9])).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in rows) == [(0, 1, 5), (5, 1, 5), (5, 1, 5), (7, 0, 7), (7, 0, 7), (9, 1, 9)]
    assert ngram_join.linked(frame(spark, EMPTY)).collect() == []
    assert sorted((r.doc_id or 0, r.text or "") for r in ngram_join.one_of_each(frame(spark, ["a b", "A B", None, "", "a b"], [5, 5, 7, 8, None])).collect()) in ([(5, "A B"), (7, ""), (8, "")], [(5, "a b"), (7, ""), (8, "")])


@given(st.lists(st.lists(st.integers(0, 30), min_size=1, max_size=30, unique=True), min_size=1, max_size=12), st.lists(st.integers(0, 3), min_size=12, max_size=12))
@settings(max_examples=300, deadline=None)
def test_prefix_tree_joins_what_is_linked(sets, given_labels):
    tree = ngram_join.Tree([np.array(sorted(s), np.int64) for s in sets])
    own = [set(s.tolist()) for s in tree.leaves]
    assert [set(sets[i]) for i in tree.order] == own
    labels = np.array(given_labels[: len(sets)])
    near = lambda i, j: 100 * len(own[i] & own[j]) >= 85 * len(own[i] | own[j])
    want = list(labels)
    for i in range(len(own)):
        for j in range(i):
            if near(i, j):
                want = [want[i] if x == want[j] else x for x in want]
    links = tree.walk(labels)
    assert all(near(i, j) for i, j in links)
    assert [[a == b for b in labels] for a in labels] == [[a == b for b in want] for a in want]


def test_prefix_tree_shares_the_paths_of_near_copies():
    base = list(range(200))
    sets = [np.array(base[: 150 + k] + [1000 + k], np.int64) for k in range(50)]
    tree = ngram_join.Tree(sets)
    # a node for each number of the shared path and an own end for each set, where plain lists have 175 numbers each
    assert tree.steps == 199 + 50 and sum(map(len, sets)) > 8000
    assert sum(b - a for _, _, a, b in ngram_join.Tree([np.arange(5), np.arange(5), np.arange(3)]).nodes) == 5


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1001 + i) for i in range(300)] + [(5, 5), (2001, 2000)]
    got = graph.components(spark.createDataFrame(edges, "a long, b long")).collect()
    by = {}
    for r in got:
        by.setdefault(r.label, set()).add(r.node)
    assert sorted(map(len, by.values())) == [2, 201, 301]


# ---- op10


def test_katz_equals_brute_force_and_adds_up(spark):
    texts = made()
    ids = list(range(len(texts)))
    got = katz.score(frame(spark, texts, ids).withColumn("score", F.lit(1))).orderBy("doc_id").collect()
    score, base, n, sums = brute.katz(list(zip(ids, texts, strict=True)), katz.discounts)
    assert np.allclose([r.score for r in got], score, rtol=1e-9) and np.allclose([r.base_score for r in got], base, rtol=1e-9)
    assert {r.train_tokens for r in got} == {n} and all(abs(s - 1) < 1e-9 for s in sums.values())
    assert [r.held_out for r in got] == [zlib.crc32(str(i).encode()) % 5 == 1 for i in ids]


def test_katz_in_many_blocks_with_spread_histories(spark, monkeypatch):
    texts = made(9, 60)
    ids = list(range(60))
    whole = katz.score(frame(spark, texts, ids)).orderBy("doc_id").collect()
    monkeypatch.setattr(katz, "BLOCK_TOKENS", 500)
    monkeypatch.setattr(katz, "SPREAD", 50)
    parts = katz.score(frame(spark, texts, ids).repartition(3)).orderBy("doc_id").collect()
    assert np.allclose([r.score for r in whole], [r.score for r in parts], rtol=1e-9) and [r.n_known for r in whole] == [r.n_known for r in parts]


def test_katz_edges(spark):
    rows = katz.score(frame(spark, [None, "", "a a a", "a a a"], [None, 2, 3, 3])).collect()
    assert len(rows) == 4 and all(np.isfinite(r.score) and np.isfinite(r.base_score) for r in rows) and sum(r.doc_id is None for r in rows) == 1
    held = next(i for i in range(100) if katz.held_out(i))
    only = katz.score(frame(spark, ["x y"], [held])).collect()[0]
    assert only.train_tokens == 0 and only.score == 0.0 and only.n_known == 0
    assert katz.score(frame(spark, EMPTY)).collect() == []


# ---- the pipeline


def test_pipeline_equals_its_plain_version(spark, tmp_path):
    texts = made(11, 100)
    docs = frame(spark, texts)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(3 * i, 0 if t and "w1 " in t else 1, 0) for i, t in enumerate(texts) if i % 2]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    d = str(tmp_path)
    first = corpus_pipeline.quality(spark, docs, d)
    rows = sorted((r.doc_id, r.text, r.source) for r in first.collect())
    cut = brute.kept_lines([(i, t) for i, t, _ in rows])
    component, _ = brute.components(cut)
    kept = [(i, t, s) for k, ((i, _, s), t) in enumerate(zip(rows, cut, strict=True)) if component[k] == k]
    second = corpus_pipeline.lines(spark, first, d)
    assert second.columns == docs.columns and all(r.n_chars == len(r.text) for r in second.collect() if r.text is not None)
    third = corpus_pipeline.near_copies(spark, second, d)
    assert sorted((r.doc_id, r.text) for r in third.collect()) == sorted((i, t) for i, t, _ in kept)
    fourth = corpus_pipeline.mixed(spark, third, d)
    sizes = {}
    for _, t, s in kept:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    targets = plain_targets(sizes)
    want = {}
    for i, _, s in kept:
        rate = targets[s] / sizes[s] if sizes[s] else 0.0
        rate = 2.0 if abs(rate - 2) < 1e-9 else rate
        u = int(hashlib.md5(f"17:{i}".encode()).hexdigest()[:13], 16) / 2**52
        want[i] = int(rate) + (u < rate - int(rate))
    counts = {r.doc_id: r["count"] for r in fourth.groupBy("doc_id").count().collect()}
    assert counts == {i: n for i, n in want.items() if n}
    packed = corpus_pipeline.run(spark, d).toPandas()
    tool = Encoder(vocabulary("byte_bpe_50k.json"), "byte")
    by_id = {i: t for i, t, _ in kept}
    assert packed.length.sum() == sum(n * (len(tool.one(by_id[i] or "")) // 4 + 1) for i, n in want.items())
    assert packed.groupby("sequence_id").length.sum().max() <= 1024


def test_every_query_is_registered():
    import __spark_entry__

    own = __spark_entry__.queries()
    assert [sum(q.startswith(f"op{n}_") for q in own) for n in range(1, 11)] == [1] * 10 and own["pipeline"] is corpus_pipeline.run
