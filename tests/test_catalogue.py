"""Every query against its SQL in DuckDB: names, types as far as both have them, and values."""

import math

import duckdb
import pytest

from corpusloom.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(rows):
    """Rows as sorted text; doubles to nine places."""
    show = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) else round(v, 9) if isinstance(v, float) else v
    return sorted(repr([show(v) for v in r]) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query_equals_its_sql(spark, db, name):
    df = catalogue.queries()[name](spark, SF)
    own = sorted(df.columns)
    rows = [tuple(r[c] for c in own) for r in df.collect()]
    assert name in catalogue.oracle_sql()
    cursor = db.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert own == sorted(names)
    order = [names.index(c) for c in own]
    assert plain(rows) == plain(tuple(r[i] for i in order) for r in cursor.fetchall())


def test_plans_stay_in_the_jvm(spark):
    """No Python in the plans, but for the cache replay, which is sequential by nature."""
    for name in ("ensemble_vote", "rule_chain_topk", "fts_and_search", "kg_edges", "grammar_format"):
        plan = catalogue.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_scans_read_only_their_columns(spark):
    plan = catalogue.queries()["delete_anti_join"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint>" in plan and "PushedFilters" in plan


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 200


def test_the_vote_is_evaluated_once(spark):
    """Filters and projections above the vote are not merged with it."""
    votes = lambda name: catalogue.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString().count("array_position")
    once = votes("ensemble_vote")
    assert 0 < once <= 2 and all(votes(name) == once for name in ("training_filter", "vote_segments", "tree_json_roundtrip"))
