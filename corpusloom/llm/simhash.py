"""SimHash document fingerprints, built from DataFrame functions only.

Terms are the five-word shingles of a text (the whole sequence where it has
fewer words), a term's weight is its count. Each term's 128-bit hash votes on
every bit and a bit is set where more weight votes for than against it. Votes
are added in packed lanes: one long holds the counters of two bits, so a text
needs 64 sums and no array per term; a lane holds 2**31 terms.

``near_pairs`` finds all fingerprints within a Hamming radius r by permuted
block tables: the 128 bits are cut into r + 2 blocks, two fingerprints within r
agree on two whole blocks, and each pair of blocks is a table keyed by both. A
bucket of more than BUCKET fingerprints isn't joined: the bits that it hasn't
fixed yet are cut in the same way, so no join meets a larger one. ``classes``
gives every document the smallest doc_id that such links reach.

Defined results: null text counts as empty; a text without words has the zero
fingerprint; equal texts have equal fingerprints; rows of one doc_id follow each
other in order of their text; a null doc_id comes after all others; further
columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm import graph
from corpusloom.llm.common import HOT, shuffle_parts, whole, written

BITS, SHINGLE = 128, 5
#: rows in a block of neighbours, and the most blocks; beyond, blocks grow and their window spills
BLOCK_ROWS, MAX_BLOCKS = 1_000, 65_536
#: fingerprints that one key of a block table may hold before it is cut further
BUCKET = 256


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, "\t\n\x0b\x0c\r", "     "), " "), "")


def _votes(h: Column, name: str) -> list[Column]:
    pair = F.lit((1 << 32) | 1)
    return [F.sum(F.shiftright(h, k).bitwiseAND(pair)).alias(f"{name}{k}") for k in range(32)]


def _bits(name: str) -> Column:
    """The 64 majority bits of one half as a long; n: the number of terms."""
    out = F.lit(0).cast("long")
    for k in range(32):
        low, high = F.col(f"{name}{k}").bitwiseAND(F.lit((1 << 31) - 1)), F.shiftrightunsigned(F.col(f"{name}{k}"), 32)
        for votes, at in ((low, k), (high, k + 32)):
            bit = 1 << at if at < 63 else -(1 << 63)
            out = out.bitwiseOR(F.when(2 * votes > F.col("sh_n"), F.lit(bit).cast("long")).otherwise(F.lit(0).cast("long")))
    return out


def fingerprints(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, fp_hi long, fp_lo long), a row for each distinct value of the keys, which must fix the text."""
    w = F.col("sh_words")
    zipped = F.arrays_zip(*[(w if i == 0 else F.slice(w, i + 1, F.greatest(F.size(w), F.lit(1)))).alias(f"w{i}") for i in range(SHINGLE)])
    terms = (
        texts.select(*keys, words(whole(F.col(text))).alias("sh_words"))
        .select(*keys, F.size("sh_words").alias("sh_size"), F.posexplode_outer(zipped).alias("sh_pos", "sh_term"))
        .where(F.col("sh_pos").isNull() | (F.col("sh_pos") <= F.greatest(F.col("sh_size") - SHINGLE, F.lit(0))))
    )
    h = F.when(F.col("sh_pos").isNotNull(), F.xxhash64(*[F.col(f"sh_term.w{i}") for i in range(SHINGLE)]))
    hashed = terms.select(*keys, h.alias("sh_a")).select(*keys, "sh_a", F.xxhash64("sh_a", F.lit(BITS)).alias("sh_b"))
    hashed = hashed.withColumn("sh_b", F.when(F.col("sh_a").isNotNull(), F.col("sh_b")))
    voted = hashed.groupBy(*keys).agg(F.count("sh_a").alias("sh_n"), *_votes(F.col("sh_a"), "a"), *_votes(F.col("sh_b"), "b"))
    half = lambda name: F.coalesce(_bits(name), F.lit(0).cast("long"))
    return voted.select(*keys, half("a").alias("fp_hi"), half("b").alias("fp_lo"))


def as_text(hi: Column, lo: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(hi), 16, "0"), F.lpad(F.hex(lo), 16, "0")))


def distance(hi: Column, lo: Column, hi2: Column, lo2: Column) -> Column:
    return F.bit_count(hi.bitwiseXOR(hi2)) + F.bit_count(lo.bitwiseXOR(lo2))


def likeness(hamming: Column) -> Column:
    """The cosine that this many differing bits estimate, at least 0."""
    cosine = F.cos(hamming * F.lit(3.141592653589793 / BITS))
    return F.when(hamming == 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), cosine))


def _tables(rows: DataFrame, radius: int) -> DataFrame:
    """(fp_hi, fp_lo, key, rest): the rows under the key of every pair of blocks of their rest, and the bits of the other blocks."""
    n, size = radius + 2, F.length("rest")
    at = [F.floor(size * i / n).cast("int") for i in range(n + 1)]
    block = [F.substring(F.col("rest"), at[i] + 1, at[i + 1] - at[i]) for i in range(n)]
    pairs = itertools.combinations(range(n), 2)
    made = [
        F.struct(F.xxhash64("key", F.lit(i * n + j), block[i], block[j]).alias("key"), F.concat(*[block[k] for k in range(n) if k not in (i, j)]).alias("rest"))
        for i, j in pairs
    ]
    return rows.select("fp_hi", "fp_lo", F.explode(F.array(*made)).alias("t")).select("fp_hi", "fp_lo", "t.*")


def near_pairs(fps: DataFrame, radius: int = 3, bucket: int = BUCKET) -> DataFrame:
    """All pairs of distinct fingerprints (fp_hi, fp_lo, fp_hi2, fp_lo2, hamming) within radius, the smaller one first.

    Documents of equal fingerprint are one class and aren't expanded; join the
    pairs back on the fingerprint for its members. bucket must be so large that
    radius + 2 bits can tell as many apart."""
    if bucket < 1 << (radius + 2):
        raise ValueError(f"bucket must be at least {1 << (radius + 2)}")
    bits = F.concat(F.lpad(F.bin("fp_hi"), 64, "0"), F.lpad(F.bin("fp_lo"), 64, "0"))
    rows = fps.select("fp_hi", "fp_lo").distinct().select("fp_hi", "fp_lo", F.lit(0).cast("long").alias("key"), bits.alias("rest"))
    first = (F.col("fp_hi") < F.col("fp_hi2")) | ((F.col("fp_hi") == F.col("fp_hi2")) & (F.col("fp_lo") < F.col("fp_lo2")))
    d = distance(F.col("fp_hi"), F.col("fp_lo"), F.col("fp_hi2"), F.col("fp_lo2"))
    found = None
    while True:
        rows = _tables(rows, radius)
        # keys are counted alone, so only the fingerprints of shared ones move
        shared = written(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "fp_keys")
        met = written(rows.join(shared, "key"), "fp_met")
        few = met.where(F.col("n") <= bucket).select("fp_hi", "fp_lo", "key")
        pairs = few.join(few.select(F.col("fp_hi").alias("fp_hi2"), F.col("fp_lo").alias("fp_lo2"), "key"), "key").where(first & (d <= radius)).select("fp_hi", "fp_lo", "fp_hi2", "fp_lo2", d.alias("hamming"))
        found = pairs if found is None else found.unionByName(pairs)
        rows = met.where(F.col("n") > bucket).select("fp_hi", "fp_lo", "key", "rest")
        if rows.isEmpty():
            return found.distinct()


def classes(rows: DataFrame, radius: int = 3) -> DataFrame:
    """rows (doc_id, fingerprint as ``as_text`` gives it, others) with class_id, the smallest doc_id that fingerprints within radius of one another reach, and class_rows, how many rows that are.

    A class whose rows have no id has a null class_id. Equal fingerprints are
    counted before they are shuffled; the few that very many rows share are
    joined by broadcast (fewer than HOT of them)."""
    rows = written(rows, "fp_rows")
    half = lambda at: F.conv(F.substring("fingerprint", at, 16), 16, -10).cast("long")
    sums = written(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "fp_sums")
    pairs = near_pairs(sums.select(half(1).alias("fp_hi"), half(17).alias("fp_lo")), radius)
    label = graph.components(pairs.select(as_text(F.col("fp_hi"), F.col("fp_lo")).alias("a"), as_text(F.col("fp_hi2"), F.col("fp_lo2")).alias("b")))
    labelled = sums.join(label, F.col("fingerprint") == F.col("node")).select("fingerprint", "least", "n", "label")
    of_label = labelled.groupBy("label").agg(F.min("least").alias("class_id"), F.sum("n").alias("class_rows"))
    linked = labelled.join(of_label, "label").select("fingerprint", F.col("class_id").alias("own_id"), F.col("class_rows").alias("own_rows"))
    known = sums.join(linked, "fingerprint", "left").select("fingerprint", F.when(F.col("own_rows").isNull(), F.col("least")).otherwise(F.col("own_id")).alias("class_id"), F.coalesce("own_rows", "n").alias("class_rows"), "n")
    known = written(known.where("class_rows > 1"), "fp_classes")
    total = rows.count()
    hot = known.where(F.col("n") * HOT > total).drop("n")
    at_once = rows.join(F.broadcast(hot), "fingerprint", "left")
    others = at_once.where("class_rows IS NULL").select(*rows.columns).join(known.where(F.col("n") * HOT <= total).drop("n"), "fingerprint", "left")
    alone = F.col("class_rows").isNull()
    others = others.select(*rows.columns, F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("class_rows", F.lit(1).cast("long")).alias("class_rows"))
    return at_once.where("class_rows IS NOT NULL").select(*rows.columns, "class_id", "class_rows").unionByName(others)


def _blocks(docs: DataFrame, doc_id: str) -> tuple[DataFrame, list]:
    """docs with its block of neighbouring ids, 0 for the largest; the first id of each block in that order."""
    spark = docs.sparkSession
    rows = docs.select(doc_id).count()
    n = min(MAX_BLOCKS, max(4 * shuffle_parts(spark), rows // BLOCK_ROWS, 2))
    shares = f"CAST(split('{','.join(str(i / n) for i in range(1, n))}', ',') AS array<double>)"  # one literal, however many
    cuts = docs.select(F.col(doc_id).alias("d")).agg(F.expr(f"percentile_approx(d, {shares}, {max(10_000, 4 * n)})").alias("q")).first()["q"] or []
    cuts = sorted(set(cuts))
    step = 256
    c = F.col(doc_id)
    if not cuts:
        block = F.lit(0)
    else:
        # two steps: which 256 cuts, then where among them
        listed = lambda ids: F.split(F.lit(",".join(map(str, ids))), ",").cast("array<bigint>")  # noqa: E731  one literal, however many
        coarse, fine = listed(cuts[::step]), listed(cuts)
        at = F.size(F.filter(coarse, lambda x: x <= c))
        upto = F.size(F.filter(F.slice(fine, F.greatest((at - 1) * step + 1, F.lit(1)), step), lambda x: x <= c))
        block = F.when(at == 0, 0).otherwise((at - 1) * step + upto)
    # ids descend over the blocks; a null id is last of all
    block = F.when(c.isNull(), len(cuts) + 1).otherwise(len(cuts) - block)
    blocked = docs.withColumn("sh_block", block.cast("int"))
    heads = blocked.groupBy("sh_block").agg(F.max(doc_id).alias("head")).collect()  # MAX_BLOCKS + 1 rows at most
    return blocked, sorted((r["sh_block"], r["head"]) for r in heads) if heads else []


def edited(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text, of its edited text and the likeness to the next document's.

    The next document is the one before in doc_id (after the smallest: the
    largest). Texts move once: rows are dealt to blocks of neighbouring ids, and
    the first id of each block goes to the block before it as well."""
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).alias("doc_id"), whole(F.col(text)).alias("text"))
    blocked, heads = _blocks(docs, "doc_id")
    before = [(b, h, heads[i - 1][0]) for i, (b, h) in enumerate(heads)]
    ghosts = spark.createDataFrame(before, "sh_block int, sh_head long, sh_before int")
    ghost_of = F.broadcast(ghosts)  # a row for each block
    tagged = blocked.join(ghost_of, "sh_block", "left")
    is_head = F.col("doc_id").eqNullSafe(F.col("sh_head"))
    own = F.struct(F.col("sh_block").alias("b"), F.lit(0).alias("ghost"))
    ghost = F.struct(F.col("sh_before").alias("b"), F.lit(1).alias("ghost"))
    dealt = tagged.select("doc_id", "text", F.explode(F.when(is_head, F.array(own, ghost)).otherwise(F.array(own))).alias("at")).select("doc_id", "text", "at.*")
    # a text's place among the rows of its id; ghosts stand behind the block's own rows
    order = Window.partitionBy("b").orderBy("ghost", F.col("doc_id").desc_nulls_last(), "text")
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    seen = dealt.withColumn("next", F.lead("text").over(order)).withColumn("row", F.row_number().over(order))
    made = seen.select(
        "b", "row", "ghost", "doc_id", n.cast("long").alias("n_chars"), "text",
        F.when(F.col("ghost") == 0, F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.coalesce("next", F.lit("")), F.lit(1), half))).alias("edit"),
    )
    made = made.withColumn("edited_sha256", F.sha2(F.col("edit").cast("binary"), 256))
    keys = ["b", "row", "ghost", "doc_id", "n_chars", "edited_sha256"]
    two = made.select(*keys, F.explode(F.array(F.struct(F.lit(0).alias("which"), F.col("text").alias("t")), F.struct(F.lit(1).alias("which"), F.col("edit").alias("t")))).alias("x")).select(*keys, "x.*").where("which = 0 or ghost = 0")
    fps = fingerprints(two, [*keys, "which"], "t")
    pick = lambda c, which: F.max(F.when(F.col("which") == which, F.col(c))).alias(f"{c}_{which}")
    rows = fps.groupBy(*keys).agg(*[pick(c, k) for c in ("fp_hi", "fp_lo") for k in (0, 1)])
    after = Window.partitionBy("b").orderBy("row")
    rows = rows.withColumn("next_hi", F.lead("fp_hi_0").over(after)).withColumn("next_lo", F.lead("fp_lo_0").over(after)).where("ghost = 0")
    to_edit = distance(F.col("fp_hi_0"), F.col("fp_lo_0"), F.col("fp_hi_1"), F.col("fp_lo_1"))
    to_next = distance(F.col("fp_hi_0"), F.col("fp_lo_0"), F.col("next_hi"), F.col("next_lo"))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256",
        as_text(F.col("fp_hi_0"), F.col("fp_lo_0")).alias("fingerprint"), as_text(F.col("fp_hi_1"), F.col("fp_lo_1")).alias("edited_fingerprint"),
        likeness(to_edit).alias("near_edited"), likeness(to_next).alias("near_next"), to_edit.alias("hamming_edited"), to_next.alias("hamming_next"),
    )
