"""The catalogue's queries against the SQL that they must agree with."""

from __future__ import annotations

import datetime
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from jobloom.plans.catalogue import ORACLES, QUERIES


def as_text(value):
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, (int, float, Decimal)):
        return f"{float(value):.6f}"
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, datetime.date):
        return datetime.datetime(value.year, value.month, value.day).isoformat()
    if isinstance(value, (list, tuple)):
        return str([as_text(v) for v in value])
    return str(value)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_its_sql(spark, sf_dir, duck, name):
    got = QUERIES[name](spark, sf_dir)
    columns = sorted(got.columns)
    quoted = ", ".join(f'"{c}"' for c in columns)
    want = duck.execute(f"SELECT {quoted} FROM ({ORACLES[name].strip().rstrip(';')})").fetchall()
    mine = sorted(tuple(as_text(r[c]) for c in columns) for r in got.collect())
    assert mine == sorted(tuple(map(as_text, r)) for r in want)


def test_entry_gives_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_sql_only_for_known_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
