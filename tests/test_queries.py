"""Every registered query against its SQL, over the smallest given tables."""

from __future__ import annotations

import math
from pathlib import Path

import pytest

import __spark_entry__ as entry
from checks.inputs import TABLES

DATA = Path(entry.SMOKE_DIR)
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="the given tables are absent")


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{DATA / name}.parquet'")
    return connection


def shown(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return str(value)


KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


OWN = entry.registry.registered()


def test_every_query_has_sql():
    assert set(OWN) == set(entry.oracle.registered())


@pytest.mark.parametrize("name", OWN)
def test_query(spark, sql, name):
    df = entry.queries()[name](spark, str(DATA))
    cursor = sql.execute(entry.oracle_sql()[name])
    kinds = {c[0]: str(c[1]) for c in cursor.description}
    assert {c: KINDS[k] for c, k in df.dtypes} == kinds
    names = sorted(df.columns)
    places = [list(kinds).index(n) for n in names]
    found = sorted(tuple(shown(row[n]) for n in names) for row in df.collect())
    expected = sorted(tuple(shown(row[p]) for p in places) for row in cursor.fetchall())
    assert found == expected


def test_entry(spark):
    assert entry.entry(spark).count() == 11


def test_estimated_quantiles_are_checked_by_one_exact_call_a_table(spark, monkeypatch):
    calls, own = [], entry.registry.tg.numeric_quantiles

    def counted(*args, **options):
        calls.append(options.get("approx", False))
        return own(*args, **options)

    monkeypatch.setattr(entry.registry.tg, "numeric_quantiles", counted)
    entry.registry.quantiles_estimated(spark, str(DATA))
    assert calls == [True, False, True, False]
