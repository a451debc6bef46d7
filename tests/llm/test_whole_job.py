"""Cases in which an operator once did less than its whole job."""

import random

from corpusloom.llm import line_dedup, ngram_join, packing, token_files
from corpusloom.llm.tokens import vocabulary

DOCS = "doc_id long, text string"


def all_kept_lines(docs):
    """docs: (id, text) in order. Texts without lines that match an earlier line, whatever their number of words."""
    seen, out = [], []
    for _, text in docs:
        keep = []
        for line in text.split("\n"):
            own = set(line.lower().split())
            gone = bool(own) and any(5 * len(own & s) >= 4 * len(own | s) for s in seen)
            if own:
                seen.append(own)
            if not gone:
                keep.append(line)
        out.append("\n".join(keep))
    return out


# ---- op2


def test_line_dedup_takes_short_lines(spark):
    docs = [
        (1, "a b c d e\nAll rights  reserved.\nx\n\n"),
        (2, "x\nd c b a\nall rights reserved.\ny z\n"),  # four words of the five above
        (3, "z y\np q r s\nx y z\nX x\n \nreserved. rights all"),
        (4, "p q r s t\ny z x w\np q r\nx y z w v"),
    ]
    done = line_dedup.dedup(spark.createDataFrame(docs, DOCS)).orderBy("doc_id").collect()
    want = all_kept_lines(docs)
    assert [r.text for r in done] == want
    assert want == ["a b c d e\nAll rights  reserved.\nx\n\n", "y z\n", "p q r s\nx y z\n ", "y z x w\np q r"]
    assert [r.ln_removed for r in done] == [0, 3, 3, 2]


def test_line_dedup_keeps_the_earliest_of_rows_in_any_order(spark):
    line = "one two three four five six"
    docs = [(100, f"{line}\nshort"), (5, f"x y\n{line}\n{line}"), (50, f"short\n{line}"), (7, f"{line} seven")]
    # one partition, so that a task reads document 100 before document 5
    done = line_dedup.dedup(spark.createDataFrame(docs, DOCS).coalesce(1)).orderBy("doc_id").collect()
    assert [r.text for r in done] == all_kept_lines(sorted(docs)) == [f"x y\n{line}", "", "short", ""]


# ---- op6


def test_packing_reaches_bins_beyond_a_group_of_copies():
    rng = random.Random(1)
    # three copies leave a gap of 1 that nothing fits, in more bins than a donor once tried
    lengths = [341] * 1500 + [n for n in (rng.randint(260, 600) for _ in range(1500)) if n != 342]
    bins = packing.packed(lengths)
    assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
    fills = [sum(lengths[i] for i in b) for b in bins]
    assert max(fills) <= packing.LENGTH and len(bins) < len(packing.fill(lengths, packing.LENGTH)) - 10
    assert len(bins) > -(-sum(lengths) // packing.LENGTH)  # so it ended because no step helps
    under = [b for b, n in enumerate(fills) if n < packing.LENGTH]
    kinds = {tuple(sorted(lengths[i] for i in bins[b])): b for b in under}.values()
    for a in kinds:
        for b in kinds:
            if fills[b] >= fills[a] and a != b:
                assert packing._exchange(bins[b], bins[a], packing.LENGTH - fills[b], lengths.__getitem__) is None


# ---- the n-gram join of the pipeline


def test_one_of_each_keeps_every_row_without_words(spark):
    blank = [(1, None, "a"), (1, None, "b"), (None, "", "a"), (None, "", "b"), (2, " \t\n", "a"), (2, " \t\n", "a")]
    rows = [*blank, (3, "one two", "a"), (3, "one two", "b"), (None, "ONE two", "a"), (4, "three", "a")]
    kept = ngram_join.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert kept.columns == ["doc_id", "text", "source"]
    got = [tuple(r) for r in kept.collect()]
    assert sorted(map(str, (r for r in got if not (r[1] or "").split()))) == sorted(map(str, blank))
    assert sorted(r[:2] for r in got if (r[1] or "").split()) == [(3, "one two"), (4, "three")]


# ---- op7


def test_dictionary_is_trained_on_all_parts_of_the_table_and_of_texts(spark, monkeypatch):
    samples = []
    train = token_files.train
    monkeypatch.setattr(token_files, "train", lambda own: train(samples.extend(own) or own))
    rng = random.Random(2)
    path = vocabulary("word_bpe_49k.json")
    empty_first = [(i, "") for i in range(1200)] + [(i, " ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(50))) for i in range(1200, 2600)]
    token_files.trained_on(spark.createDataFrame(empty_first, DOCS).coalesce(1), path, 2)
    assert 400 < len(samples) < 900  # one of two, and those without words leave nothing
    samples.clear()
    long_texts = [(i, "alpha " * 1000 + "omega " * 9000) for i in range(40)]
    token_files.trained_on(spark.createDataFrame([(i, f"{t}{i}") for i, t in long_texts], DOCS), path, 2)
    assert len(samples) == 40 and len({own[:200] for own in samples}) > 1  # not all of them the beginning
