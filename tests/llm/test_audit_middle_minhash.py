"""Filter audit, fill-in-middle and MinHash against plain versions."""

import hashlib
import random
from itertools import permutations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import fill_middle, filter_audit, minhash, ngram_join
from corpusloom.llm.common import least_of, written

DOCS = "doc_id long, text string, lang string"
LABELS = "doc_id long, quality int, toxic int"


# ---- filter audit


def plain_fails(text):
    words = text.encode().split()
    blank = [w.decode() for w in words]
    return [len(blank) < 200, 100 * len(set(blank)) < 50 * len(blank), 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text), any(c in "#$%&*|" for c in text)]


def plain_audit(docs, labels):
    """docs: (id, text, lang); labels: (id, quality, toxic)."""
    rows = []
    for d, t, lang in docs:
        t = t or ""
        smaller = any((o or "") == t and o_id is not None and (d is None or o_id < d) for o_id, o, _ in docs)
        good, toxic = (any(x[0] == d and d is not None and x[i] == 1 for x in labels) for i in (1, 2))
        rows.append((lang or "", [*plain_fails(t), smaller], good, toxic))
    out = {}
    for part in {r[0] for r in rows}:
        own = [r[1:] for r in rows if r[0] == part]
        removed_in = {i: 0 for i in range(5)}
        for order in permutations(range(5)):
            gone = [False] * len(own)
            for step, i in enumerate(order, 1):
                here = [f[i] and not g for (f, _, _), g in zip(own, gone, strict=True)]
                again = sum(f[i] and g for (f, _, _), g in zip(own, gone, strict=True))
                gone = [a or b for a, b in zip(gone, here, strict=True)]
                good, toxic = (sum(h and r[k] for h, r in zip(here, own, strict=True)) for k in (1, 2))
                removed_in[i] += sum(here)
                unique = sum(f[i] and sum(f) == 1 for f, _, _ in own)
                out[part, "".join("ABCDE"[j] for j in order), step] = [len(own) - sum(gone), sum(here), again, unique, good, toxic, i]
        for key, v in out.items():
            if key[0] == part:
                v[-1] = removed_in[v[-1]]
    return out


def audited(spark, docs, labels):
    df = filter_audit.audit(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(labels, LABELS))
    assert df.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return {(r[0], r[1], r[2]): list(r[3:]) for r in df.collect()}


def audit_rows(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)] + ["É", "ABC", "x#y", "5%", "naïve"]
    texts = [" ".join(rng.choice(words[: rng.choice([20, 400, 405])]) for _ in range(rng.choice([0, 1, 50, 250, 600]))) for _ in range(12)]
    texts += ["", " \t\n", "A B C", "one\x0btwo\x0cthree\rfour", "\x1c\x85　 word", "$" * 300, None]
    docs = [(i, rng.choice(texts), rng.choice(["en", "de", None, ""])) for i in range(60)]
    docs += [(None, texts[0], "en"), (None, None, None), docs[3], docs[3], (5, texts[1], "xx")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(40)] + [(3, 1, 0), (3, 0, 1), (None, 1, 1), (999, 1, 1)]
    return docs, labels


@pytest.mark.parametrize("seed", [1, 2])
def test_audit_equals_brute_force(spark, seed):
    docs, labels = audit_rows(seed)
    assert audited(spark, docs, labels) == plain_audit(docs, labels)


def test_audit_of_large_groups_of_copies(spark):
    """One text in most rows, another in some: every copy but the first fails E, and a marked long text fails what it should."""
    long = "word #1 " * 60_000
    docs = [(i, "same text", "en") for i in range(10_000)] + [(20_000 + i, "other text", "de") for i in range(3)] + [(30_000, long, "de")]
    got = audited(spark, docs, [(5, 1, 1)])
    assert got["en", "EABCD", 1][:2] == [1, 9_999] and got["de", "EABCD", 1][:2] == [2, 2]
    assert got["en", "EABCD", 1][4:6] == [1, 1] and got["de", "DABCE", 1][1] == 1


def test_audit_of_nothing_and_with_other_columns(spark):
    assert audited(spark, [], []) == {}
    docs, labels = audit_rows(3)
    df = spark.createDataFrame([(*d, "x", 1, 2) for d in docs], DOCS + ", digest string, fails int, part int")
    got = filter_audit.audit(df, spark.createDataFrame([(*x, 7) for x in labels], LABELS + ", good int"))
    assert {tuple(r) for r in got.collect()} == {(*k, *v) for k, v in plain_audit(docs, labels).items()}


@given(st.lists(st.tuples(st.integers(0, 4), *[st.booleans()] * 7), min_size=1, max_size=300))
@settings(max_examples=40, deadline=None)
def test_index_counts_rows(rows):
    part = np.array([r[0] for r in rows])
    _, part = np.unique(part, return_inverse=True)
    got = filter_audit.Index(part, [np.array([r[i] for r in rows]) for i in range(1, 8)]).counts()
    for p in range(part.max() + 1):
        own = [r[1:] for r, q in zip(rows, part, strict=True) if q == p]
        for k in range(32):
            left = [r for r in own if not any(r[i] and k >> i & 1 for i in range(5))]
            assert got[p, k].tolist() == [len(left), sum(r[5] for r in left), sum(r[6] for r in left)]


def test_least_of_splits_hot_keys(spark):
    rows = written(spark.createDataFrame([(i % 7 if i % 2 else 1, i) for i in range(20_000)] + [(100 + i, i) for i in range(50)] + [(50, None), (50, None)], "k long, v long"), "rows")
    got = least_of(rows, ["k"], "v", "least").collect()
    least = {}
    for r in rows.collect():
        least[r.k] = min([x for x in (least.get(r.k), r.v) if x is not None], default=None)
    assert len(got) == 20_052 and all(r.least == least[r.k] for r in got)
    assert {r.k for r in least_of(rows, ["k"], "v", "least", alone=False).collect()} == {*range(7), 50}


# ---- fill in the middle


def plain_cut(key, text):
    """As the contract says it."""
    x = hashlib.sha256(f"1:{key}".encode()).hexdigest()
    h = [int(x[i : i + 8], 16) for i in range(0, 32, 8)]
    n = len(text)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"
    return n, "psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"


TEXTS = st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("<PSM> \n")), max_size=40)


@given(st.integers(-5, 10**12), TEXTS)
@settings(max_examples=300, deadline=None)
def test_cuts_equal_plain_ones(key, text):
    n, form, a, b, output = fill_middle.cut(str(key), text.encode())
    assert (n, form, a, b, output.decode()) == plain_cut(key, text)


@given(TEXTS, st.sampled_from(["char", "word", "line"]))
@settings(max_examples=300, deadline=None)
def test_units_join_to_the_text(text, unit):
    points = fill_middle.code_points(text.encode())
    at = fill_middle.bounds(points, unit)
    assert "".join(fill_middle.encoded(points[a:b]).decode() for a, b in zip(at, at[1:], strict=False)) == text
    units = [text[a:b] for a, b in zip(at, at[1:], strict=False)]
    expected = {"char": list(text), "line": text.split("\n"), "word": None}[unit]
    if unit == "line":
        expected = [x + "\n" for x in expected[:-1]] + ([expected[-1]] if expected[-1] else [])
    if expected is not None:
        assert units == expected
    else:
        kinds = [u[0] in " \t\n\x0b\x0c\r" for u in units]
        assert all(a != b for a, b in zip(kinds, kinds[1:], strict=False)) and all(all((c in " \t\n\x0b\x0c\r") == k for c in u) for u, k in zip(units, kinds, strict=True))


def test_bytes_that_are_no_text_come_back():
    for raw in (b"ab\xff\xfec", b"\x80", "xé".encode() + b"\xc3"):
        assert fill_middle.encoded(fill_middle.code_points(raw)) == raw


@pytest.mark.parametrize("unit", ["char", "word", "line"])
def test_fill_middle_keeps_rows_and_columns_and_gives_texts_back(spark, unit):
    rng = random.Random(4)
    made = lambda n: "".join(rng.choice(["a", "é", "\U0001f600", " ", "\n", "<", "P", ">", "<S", "M>"]) for _ in range(n))
    texts = [None, "", " ", "<P>", "a<S>b", "<S", *[made(rng.randrange(60)) for _ in range(120)], made(400_000)]
    rows = [(i if i % 9 else None, t, f"c{i}", -i) for i, t in enumerate(texts)]
    rows += [rows[20], rows[20]]
    df = spark.createDataFrame(rows, "doc_id long, text string, fm_output string, fm_n int").repartition(4)
    out, name = fill_middle.transform(df, unit=unit)
    assert out.columns[:4] == df.columns and len(out.columns) == 9
    got = out.withColumn("back", fill_middle.restored(out[name["form"]], out[name["output"]])).collect()
    assert sorted(map(repr, [tuple(r[c] for c in df.columns) for r in got])) == sorted(map(repr, rows))
    for r in got:
        assert r["back"] == (r["text"] or "")
        if unit == "char":
            assert (r[name["n"]], r[name["form"]], r[name["prefix_chars"]], r[name["middle_chars"]], r[name["output"]]) == plain_cut("null" if r["doc_id"] is None else r["doc_id"], r["text"] or "")
    assert {r[name["form"]] for r in got} == {"plain", "psm", "spm"}


def test_fill_middle_of_nothing(spark):
    out, _ = fill_middle.transform(spark.createDataFrame([], "doc_id long, text string"))
    assert out.count() == 0
    with pytest.raises(ValueError, match="unit"):
        fill_middle.transform(spark.createDataFrame([], "doc_id long, text string"), unit="page")


# ---- MinHash


def sets_of(text):
    w = (text or "").encode().lower().split()
    return {*zip(w, w[1:], strict=False)} if len(w) > 1 else {tuple(w)} if w else set()


def plain_links(rows):
    """(id, size, component, kept) of (id, text) rows of different ids."""
    sets = {d: sets_of(t) for d, t in rows}
    first = {d: d for d in sets}

    def find(x):
        while first[x] != x:
            x = first[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                first[y] = x
    return {(d, len(sets[d]), find(d), find(d) == d) for d in ids}


def near_copies(rng, n):
    base = [[f"w{rng.randrange(3_000)}" for _ in range(rng.choice([1, 2, 3, 6, 12, 40, 200]))] for _ in range(n // 4)]
    rows = [(0, None), (1, ""), (2, " \n"), (3, "One"), (4, "one"), (5, "one two"), (6, "two one")]
    for i in range(10, n):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 1, 1, 2, 4, 10])):
            words[rng.randrange(len(words))] = f"x{rng.randrange(50)}"
        rows.append((i, rng.choice([" ", "\n"]).join(words)))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_minhash_equals_brute_force(spark, seed):
    rows = near_copies(random.Random(seed), 250)
    got = minhash.linked(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert {tuple(r) for r in got} == plain_links(rows) and len(got) == len(rows)


@pytest.mark.parametrize("sets", [5, 16])
def test_minhash_of_one_large_group_in_small_trees(spark, monkeypatch, sets):
    """A chain of near copies: each links with those near it only, all are one component."""
    monkeypatch.setattr(ngram_join, "GROUP_SETS", sets)
    words = [f"w{i}" for i in range(180)]
    rows = [(i, " ".join(words[i : i + 120])) for i in range(60)] + [(100 + i, " ".join(words[:100] + [f"y{i}"] * 3)) for i in range(60)]
    got = minhash.linked(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {tuple(r) for r in got} == plain_links(rows)


def test_minhash_edges(spark):
    linked = lambda rows: sorted(map(repr, map(tuple, minhash.linked(spark.createDataFrame(rows, "doc_id long, text string")).collect())))
    assert linked([]) == []
    assert linked([(1, "a b c"), (1, "a b c"), (2, "A B\tC"), (None, "a b c"), (3, None)]) == sorted(map(repr, [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (None, 2, 1, False), (3, 0, 3, True)]))
    long = " ".join(f"w{i}" for i in range(60_000))
    assert linked([(7, long), (8, long + " end"), (9, long[: len(long) // 2])]) == sorted(map(repr, [(7, 59_999, 7, True), (8, 60_000, 7, False), (9, len(sets_of(long[: len(long) // 2])), 9, True)]))


def test_minhash_keeps_one_of_each_with_its_columns(spark):
    rows = [(3, "a b c d", "x", 1), (1, "a b c d", "y", 2), (2, "", "z", 3), (4, None, "z", 4), (5, "other text", None, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, cid string, lid int")
    got = minhash.one_of_each(df)
    assert got.columns == df.columns and {tuple(r) for r in got.collect()} == {*rows} - {rows[0]}


@given(st.lists(st.integers(1, 400), min_size=1, max_size=12), st.randoms())
@settings(max_examples=25, deadline=None)
def test_every_coordinate_is_filled_and_order_is_nothing(sizes, rng):
    size = np.array(sizes)
    flat = np.array([rng.getrandbits(56) for _ in range(size.sum())], np.uint64)
    own = minhash.sketches(size, flat)
    assert own.shape == (len(size), minhash.COORDINATES) and not (own == minhash.EMPTY).any()
    parts = np.split(flat, np.cumsum(size)[:-1])
    for x, row in zip(parts, own, strict=True):
        assert (minhash.sketches(np.array([len(x)]), x[::-1].copy()) == row).all()
    # as said: the first round that fills a bin decides it
    t, x = minhash.COORDINATES, parts[0]
    plain = {}
    for i in range(2 * t):
        h = minhash.mixed(x + minhash.ROUNDS[i])
        for v in h.tolist():
            b = (v >> 32) * t >> 32 if i < t else i - t
            value = (i << minhash.FRACTION) | (v & ((1 << minhash.FRACTION) - 1))
            plain[b] = min(plain.get(b, value), value)
        if len(plain) == t:
            break
    assert own[0].tolist() == [plain[b] for b in range(t)]


def test_equal_coordinates_are_concentrated_about_the_similarity():
    rng = np.random.default_rng(5)
    for n, shared in ((40, 32), (300, 240), (5_000, 2_500)):
        shares = []
        for _ in range(60):
            x = rng.integers(0, 1 << 56, 2 * n - shared, dtype=np.uint64)
            a, b = minhash.sketches(np.array([n, n]), np.concatenate([x[:n], x[n - shared :]]))
            shares.append((a == b).mean())
        similarity = shared / (2 * n - shared)
        assert abs(np.mean(shares) - similarity) < 0.02
        # no wider than independent draws (three of them in a thousand fall out of 3.3 deviations; 60 trials)
        assert np.abs(np.array(shares) - similarity).max() < 4.5 * (similarity * (1 - similarity) / minhash.COORDINATES) ** 0.5


# ---- clashing names in the pipeline


def test_no_stage_overwrites_a_column_of_the_input(spark, tmp_path):
    """Every name that an operator gives to a column of its own, as a column of the input."""
    import re
    from pathlib import Path

    import corpus_pipeline

    text = "".join(p.read_text() for p in Path(corpus_pipeline.__file__).parent.glob("corpusloom/llm/*.py"))
    taken = {"doc_id", "text", "lang", "source", "n_chars"}
    names = sorted({n.lower() for n in re.findall(r'(?:withColumn|alias|fresh|withColumnRenamed)\((?:docs, )?f?"([a-z]\w*)"', text)} - taken | {f"mix_{c}" for c in ("size", "copies", "copy", "target")} | {f"ql_{c}" for c in ("keep", "tail", "expected")})
    assert len(names) > 60
    rows = [(1, "a b c d e f g\nx y z w", "en", "s1", 15, *names), (2, "A b c d e f g\nnew words are here", "en", "s2", 32, *names), (3, "quite another text", None, None, 18, *names)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.createDataFrame(rows, schema)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = written(stage(spark, docs, str(tmp_path)), "stage")
        assert out.columns == docs.columns
        assert {tuple(r[5:]) for r in out.collect()} == {tuple(names)}
        docs = out


# ---- queries against their SQL


@pytest.mark.parametrize("name", ["op9_ngram_join", "op11_filter_audit", "op12_minhash", "op13_fill_middle"])
def test_query_equals_its_sql(spark, name):
    import duckdb

    from corpusloom.llm import queries

    sf, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    df = queries.queries()[name](spark, sf)
    found = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(repr, map(tuple, df.select(*names).collect()))) == sorted(map(repr, found.fetchall()))
