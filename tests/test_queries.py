"""Every registered query runs at the smallest scale; those with SQL agree with DuckDB on all rows."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

CORE = {k: v for m in entry.MODULES if not m.__name__.startswith("ledgerloom.llm") for k, v in m.QUERIES.items()}


@pytest.fixture(scope="module")
def duck(sf):
    from pathlib import Path

    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    return con


def rows(df):
    columns = sorted(df.columns)
    return columns, sorted(tuple("" if pd.isna(v) else str(v) for v in r) for r in df[columns].astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(CORE))
def test_query(spark, sf, duck, name):
    got = CORE[name](spark, sf).toPandas()
    sql = entry.oracle_sql().get(name)
    if sql:
        assert rows(got) == rows(duck.execute(sql).df())
    else:
        INVARIANTS[name](got, sf)


def _same_units(got, sf):
    lines = duckdb.execute(f"select count(*) from '{sf}/line_items.parquet'").fetchone()[0]
    assert len(got) == lines == got.row_id.nunique()
    assert (got.quantity_milli.notna() <= got.common_unit.notna()).all() and set(got.common_unit.dropna()) <= {"kg", "l", "m", "m2", "h", "month", "each"}


def _repeated_digests(got, sf):
    import collections
    import json

    texts = [t for (t,) in duckdb.execute(f"select record_json from '{sf}/canonical_records.parquet'").fetchall()]
    want = collections.Counter(json.dumps(json.loads(t), sort_keys=True) for t in texts)
    assert sorted(got.n) == sorted(n for n in want.values() if n > 1)


#: What queries without SQL are held to.
INVARIANTS = {"p2_normalised": _same_units, "canonical_digests": _repeated_digests}


def test_entry_has_a_stable_schema(spark):
    assert entry.entry(spark).columns == ["row_id", "risk_score", "n_findings"]


def test_state_of_streams(spark, tmp_path):
    from ledgerloom.streaming.events import spend_state

    spark.createDataFrame([(1, 1, 60, "a"), (1, 2, 50, "b"), (1, 3, 10, "c"), (2, 1, 100, "d")], "user_id long, ts long, cents long, event_id string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("user_id long, ts long, cents long, event_id string").parquet(str(tmp_path / "in"))
    job = spend_state(stream, 100).writeStream.outputMode("update").format("memory").queryName("spend").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    job.awaitTermination()
    assert sorted(map(tuple, spark.sql("select * from spend").collect())) == [(1, 1, 2, 60), (2, 1, 0, 100)]
