"""The queries opN_<name> of this subpackage, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm import simhash

    return simhash.classes(simhash.edited(table(spark, sf_dir, "documents")))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm import line_dedup

    done = line_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "text", F.col("ln_lines").alias("n_lines"), F.col("ln_removed").alias("n_removed"))


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm import hilbert_ann

    return hilbert_ann.nearest(table(spark, sf_dir, "embeddings"), every=20)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm import ordinal

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = ordinal.classify(docs, table(spark, sf_dir, "labels"))
    return scored.select("doc_id", F.col("ql_expected").alias("expected_grade"), F.col("ql_tail").alias("tail"), F.col("ql_keep").alias("keep"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm import html_text

    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_text.extract(pages).withColumn("n_chars", F.length("text").cast("long"))


def op6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm import packing
    from corpusloom.llm.tokens import vocabulary

    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm import token_files
    from corpusloom.llm.tokens import vocabulary

    return token_files.read_files(spark, token_files.write_files(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json")))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm import mixing

    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select(
        "doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"), (F.col("mix_size") * F.col("mix_copies")).cast("long").alias("taken"), F.col("mix_copies").cast("long").alias("copies"),
    )


OP8_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::DOUBLE AS source_size, row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1 AS nth FROM d GROUP BY source),
w AS (SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][(nth % 3 + 1)::INT] AS weight, 2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS total FROM s),
l AS (SELECT *, cap / weight AS ratio, (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY cap / weight, nth ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT *, max(CASE WHEN level <= ratio THEN level END) OVER () AS water FROM l),
g AS (SELECT source, source_size, CASE WHEN water IS NULL OR ratio <= water THEN cap ELSE water * weight END AS target FROM t),
r AS (SELECT d.doc_id, d.size, g.source_size::BIGINT AS source_size, g.target, CASE WHEN g.source_size > 0 THEN CASE WHEN abs(g.target / g.source_size - 2) < 1e-9 THEN 2.0::DOUBLE ELSE g.target / g.source_size END ELSE 0 END AS rate
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
c AS (SELECT *, floor(rate)::BIGINT + (('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE < rate - floor(rate))::BIGINT AS copies FROM r)
SELECT doc_id, size, source_size, target, (size * copies)::BIGINT AS taken, copies FROM c
"""


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm import ngram_join

    return ngram_join.linked(table(spark, sf_dir, "documents"))


def op10_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm import katz

    return katz.score(table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm import filter_audit

    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP11_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, (len(ws) < 200)::INT AS a, (100 * len(list_distinct(ws)) < 50 * len(ws))::INT AS b,
 (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t))::INT AS c, regexp_matches(t, '[#$%&*|]')::INT AS d, coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY t), min(w.doc_id) OVER (PARTITION BY t) IS NOT NULL)::INT AS e FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
g AS (SELECT part, good, toxic, a + 2 * b + 4 * c + 8 * d + 16 * e AS fails, count(*) AS k FROM f GROUP BY ALL),
x AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(n, bit)),
o AS (SELECT o1.n || o2.n || o3.n || o4.n || o5.n AS filter_order, [o1.bit, o2.bit, o3.bit, o4.bit, o5.bit] AS bits FROM x o1, x o2, x o3, x o4, x o5 WHERE o1.bit + o2.bit + o3.bit + o4.bit + o5.bit = 31 AND o1.bit | o2.bit | o3.bit | o4.bit | o5.bit = 31),
s AS (SELECT filter_order, step, bits[step]::INT AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before FROM o, range(1, 6) r(step)),
r AS (SELECT part, filter_order, step, bit, sum(k) FILTER (fails & (before | bit) = 0) AS kept, sum(k) FILTER (fails & bit > 0 AND fails & before = 0) AS removed, sum(k) FILTER (fails & bit > 0 AND fails & before > 0) AS redundant,
 sum(k) FILTER (fails = bit) AS unique_fails, sum(k) FILTER (fails & bit > 0 AND fails & before = 0 AND good = 1) AS good_lost, sum(k) FILTER (fails & bit > 0 AND fails & before = 0 AND toxic = 1) AS toxic_lost FROM g, s GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
 coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, coalesce(sum(removed) OVER (PARTITION BY part, bit), 0)::BIGINT AS shapley FROM r
"""


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm import minhash

    return minhash.linked(table(spark, sf_dir, "documents"))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm import fill_middle

    rows, name = fill_middle.transform(table(spark, sf_dir, "documents").select("doc_id", "text"))
    c = {k: F.col(v) for k, v in name.items()}
    back = fill_middle.restored(c["form"], c["output"])
    digest = lambda x: F.sha2(x.cast("binary"), 256)
    return rows.select("doc_id", c["n"].alias("n"), c["form"].alias("form"), c["prefix_chars"].alias("prefix_chars"), c["middle_chars"].alias("middle_chars"), digest(c["output"]).alias("output_sha256"), digest(back).alias("restored_sha256"))


OP13_SQL = """
WITH h AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, 'null')) AS x FROM documents),
d AS (SELECT *, ('0x' || x[1:8])::BIGINT % (n + 1) AS a, ('0x' || x[9:16])::BIGINT % (n + 1) AS b, ('0x' || x[17:24])::BIGINT % 100 AS plain, ('0x' || x[25:32])::BIGINT % 100 AS spm FROM h),
f AS (SELECT *, least(a, b) AS p, abs(a - b) AS m, CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR plain >= 90 THEN 'plain' WHEN spm < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
o AS (SELECT *, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || t[1:p] || '<S>' || t[p + m + 1:] || '<M>' || t[p + 1:p + m] ELSE '<S>' || t[p + m + 1:] || '<P>' || t[1:p] || '<M>' || t[p + 1:p + m] END AS output FROM f)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN p END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN m END::BIGINT AS middle_chars, sha256(output) AS output_sha256, sha256(t) AS restored_sha256 FROM o
"""


def _linked_sql(words: int, share: int, more: str) -> str:
    """Sets of shingles, candidates by a prefix filter, links on whole sets, the smallest id that each document reaches."""
    shingle = " || ' ' || ".join(f"ws[i + {k}]" for k in range(words))
    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, CASE WHEN len(ws) < {words} THEN array_to_string(ws, ' ') ELSE {shingle} END AS h FROM d, LATERAL (SELECT unnest(range(1, greatest(len(ws) - {words} + 2, 2))) AS i) WHERE len(ws) > 0),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
f AS (SELECT h, count(*) AS df FROM s GROUP BY 1 HAVING count(*) > 1),
o AS MATERIALIZED (SELECT s.doc_id, s.h, n.n, row_number() OVER (PARTITION BY s.doc_id ORDER BY coalesce(df, 1), s.h) AS k FROM s JOIN n USING (doc_id) LEFT JOIN f USING (h)),
p AS MATERIALIZED (SELECT doc_id, h, n FROM o WHERE k <= n - ({share} * n + 99) // 100 + 1),
c AS MATERIALIZED (SELECT DISTINCT a.doc_id AS x, b.doc_id AS y, a.n AS nx, b.n AS ny FROM p a JOIN p b ON a.h = b.h AND a.doc_id < b.doc_id WHERE 100 * least(a.n, b.n) >= {share} * greatest(a.n, b.n)),
l AS MATERIALIZED (SELECT x, y FROM c JOIN s a ON a.doc_id = x JOIN s b ON b.doc_id = y AND b.h = a.h GROUP BY x, y, nx, ny HAVING 100 * count(*) >= {share} * (nx + ny - count(*))),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id, doc_id AS root FROM d UNION SELECT e.y, r.root FROM r JOIN e ON r.doc_id = e.x WHERE r.root < e.y)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, min(root) AS component_id{more} FROM d JOIN r ON r.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id, n
"""


OP9_SQL = _linked_sql(4, 85, "")
OP12_SQL = _linked_sql(2, 80, ", d.doc_id = min(root) AS kept")


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op8_mix_sources": OP8_SQL, "op9_ngram_join": OP9_SQL, "op11_filter_audit": OP11_SQL, "op12_minhash": OP12_SQL, "op13_fill_middle": OP13_SQL}
