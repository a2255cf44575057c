"""Every query with SQL gives what DuckDB gives, on the smallest tables."""

from __future__ import annotations

import math
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from colloquy.plans import queries as core

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(FOLDER):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(core.oracle_sql()))
def test_same_as_sql(spark, con, name):
    df = core.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = Counter(tuple(map(plain, r)) for r in df.select(*columns).collect())
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({core.oracle_sql()[name]})").fetchall()
    assert got == Counter(tuple(map(plain, r)) for r in want)


@pytest.mark.parametrize("name", sorted(set(core.queries()) - set(core.oracle_sql())))
def test_runs(spark, name):
    assert core.queries()[name](spark, FOLDER).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_gates_judge_every_target(spark):
    """Completions that are null or hold wide white space are judged too."""
    q, n = core.queries(), spark.read.parquet(f"{FOLDER}/targets.parquet").count()
    for name in ("map_budgets", "preamble_gate", "plain_bullets", "keep_gate", "format_gate"):
        assert q[name](spark, FOLDER).count() == n, name
    assert q["curate_outcomes"](spark, FOLDER).groupBy().sum("n").first()[0] == n


def test_evidence_of_every_line(spark, monkeypatch):
    monkeypatch.setattr(core.notes, "evidence", lambda items, lines, **more: items)
    q = core.queries()
    assert q["evidence_lines"](spark, FOLDER).count() == q["transcript_lines"](spark, FOLDER).count()
