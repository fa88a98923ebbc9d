"""Every registered query of the store against its SQL."""

import duckdb
import pytest

from tidemark.plans import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def told(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    text = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(columns), sorted([text(r[i]) for i in order] for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    if name in ORACLES:
        out = duck.execute(ORACLES[name])
        assert told(df.columns, rows) == told([d[0] for d in out.description], out.fetchall())
    else:
        assert rows


def test_batch_set_wins_over_a_longer_log(spark, tmp_path):
    # Sequences below, at and beyond that of the batch; keys in the log, in the batch and in both.
    events = [(5, 1, "click", 1.0), (999_998, 2, "click", 2.0), (999_999, 3, "error", 3.0), (1_000_000, 4, "click", 4.0)]
    events += [(1_000_001, 4, "error", 5.0), (1_000_002, 5, "view", 6.0), (7, 6, "error", 7.0)]
    orders = [(1, 1, 10.5), (2, 2, 20.5), (3, 3, 30.5), (9, 4, 40.5), (4, 4, 41.5), (5, 7, 70.5)]
    con = duckdb.connect()
    for name, rows, spec in (
        ("events", events, "event_id long, user_id long, event_type string, value double"),
        ("orders", orders, "o_orderkey long, o_custkey long, o_totalprice double"),
    ):
        spark.createDataFrame(rows, spec).write.parquet(str(tmp_path / f"{name}.parquet"))
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    df, out = QUERIES["kv_batch_set"](spark, str(tmp_path)), con.execute(ORACLES["kv_batch_set"])
    assert told(df.columns, [tuple(r) for r in df.collect()]) == told([d[0] for d in out.description], out.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
