"""Every query runs and its rows are those of its SQL, over the whole smallest tables."""

import datetime
import math

import duckdb
import pytest

import __spark_entry__ as entry
from graphloom import queries as core

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, list | tuple):
        return [plain(x) for x in v]
    return str(v) if isinstance(v, datetime.datetime) else v


@pytest.mark.parametrize("name", [n for n in entry.queries() if n != "pipeline" and n[:2] != "op"])
def test_query(spark, db, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(([plain(v) for v in r] for r in df.select(cols).collect()), key=str)
    if sql := entry.oracle_sql().get(name):
        r = db.execute(sql)
        names = [d[0] for d in r.description]
        assert sorted(names) == cols
        order = [names.index(c) for c in cols]
        assert got == sorted(([plain(row[i]) for i in order] for row in r.fetchall()), key=str)
    else:
        assert got


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_views_make_triples_of_a_bounded_number_of_rows_a_task(spark, tmp_path, monkeypatch):
    part = core.table(spark, "/root/testdata/sf0.001", "part")
    part.coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    whole = {tuple(r) for r in core.graph_union(spark, str(tmp_path)).collect()}
    monkeypatch.setattr(core, "ROWS", 20)
    t = core.t_part(spark, str(tmp_path))
    assert t.count() == 3 * part.count() > 6 * core.ROWS
    assert t.groupBy(core.F.spark_partition_id()).count().agg({"count": "max"}).first()[0] <= 2 * 3 * core.ROWS
    assert {tuple(r) for r in core.graph_union(spark, str(tmp_path)).collect()} == whole
