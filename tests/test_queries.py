"""Every query with an oracle against DuckDB on the smallest tables, and the driver's contract."""

from __future__ import annotations

import math
import os
import re
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from cadenza.plans import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def rows(values):
    out = []
    for row in values:
        out.append(tuple("null" if v is None or (isinstance(v, float) and math.isnan(v)) else f"{v + 0.0:.5f}" if isinstance(v, float) else str(v) for v in row))
    return sorted(out)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_duckdb(spark, duck, name):
    got = QUERIES[name](spark, DATA)
    names = sorted(got.columns)
    result = duck.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == names
    want = [tuple(r[columns.index(c)] for c in names) for r in result.fetchall()]
    assert rows(tuple(r) for r in got.select(*names).collect()) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_without_oracle_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


@pytest.mark.parametrize("name", ["canonical_delta", "canonical_delta_padded", "canonical_delta_clamped"])
def test_canonical_delta_of_more_videos(spark, tmp_path, name):
    """Every video has the one before it as representative, beyond ten too."""
    frames = [(k, [k / 10] * 64, k) for k in range(12)]
    spark.createDataFrame(frames, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    level = [int(float(f"{k / 10}") * 255 + 1e-4) for k in range(12)]
    got = {r.video: r.total for r in QUERIES[name](spark, str(tmp_path)).collect()}
    assert set(got) == set(range(1, 12)) and all(abs(got[k] - 64 * (level[k] - level[k - 1])) <= 64 for k in got)


@pytest.mark.parametrize("name", ["agg_approximate", "agg_distinct"])
def test_distinct_values_hold_no_states(spark, name):
    """What is aggregated by distinct value is the value alone: no sketch, no percentile."""
    plan = QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    by_value = [line for line in plan.splitlines() if "Aggregate(keys=" in line and re.search("keys=.*l_(part|supp)key.*functions=", line)]
    assert by_value and not any(re.search("functions=.*(percentile|median|approx_count)", line) for line in by_value)


def test_aggregates_of_few_and_null_lines(spark, tmp_path):
    """A flag of two lines, a null flag, a flag of nulls: the lower of two prices is a median within the rank allowed."""
    lines = [("A", 1, 1, 5.0, 10.0), ("A", 2, 1, 7.0, 20.0), (None, 3, 2, 1.0, 5.0), (None, 3, None, None, 6.0), (None, 4, 2, 2.0, 7.0), ("N", None, None, None, None)]
    spark.createDataFrame(lines, "l_returnflag string, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r.l_returnflag: tuple(r)[1:] for r in QUERIES["agg_approximate"](spark, str(tmp_path)).collect()}
    assert got == {"A": (2, True, True), None: (2, True, True), "N": (0, True, True)}
    got = {r.l_returnflag: tuple(r)[1:] for r in QUERIES["agg_distinct"](spark, str(tmp_path)).collect()}
    assert got == {"A": (1, 2, 6.0), None: (1, 2, 1.5), "N": (0, 0, None)}


def test_no_task_holds_the_values_of_a_key(spark, tmp_path):
    """The user-defined aggregate's values stay where they are: what is shuffled are states; nulls, a null key and zeros too."""
    lines = [("A", 2.0), ("A", 8.0), ("A", None), ("A", 0.0), (None, 3.0), ("N", -1.0), ("R", float("nan")), ("I", float("inf")), *([("B", 5.0)] * 500)]
    spark.createDataFrame(lines, "l_returnflag string, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    of = QUERIES["agg_user_defined"](spark, str(tmp_path))
    assert {tuple(r) for r in of.collect()} == {("A", 4.0), (None, 3.0), ("N", None), ("R", None), ("I", float("inf")), ("B", 5.0)}
    plan = of._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") > 0 and "AggregateInPandas" not in plan and "ArrowAggregatePython" not in plan and "partial_sum" in plan


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_without_the_corpus_operators(tmp_path):
    """The rest imports and lists its queries where the corpus operators' folder and the pipeline are not there."""
    root = Path(__spark_entry__.__file__).parent
    shutil.copytree(root / "cadenza", tmp_path / "cadenza", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    assert not (tmp_path / "cadenza" / "llm").exists()
    code = "import __spark_entry__ as e, cadenza; assert '" + str(tmp_path) + "' in cadenza.__path__[0] and len(e.queries()) > 100 and e.oracle_sql() and not any(k[:2] == 'op' and k[2].isdigit() or k == 'pipeline' for k in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120, env=os.environ | {"PYTHONPATH": str(tmp_path)})
