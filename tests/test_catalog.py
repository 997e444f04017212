"""The registered queries against their SQL at the smallest scale, and the entry points without the llm subpackage."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from tidewell.plans import catalog

DIR = "/root/testdata/sf0.001"
SOME = sorted(catalog.queries())[::6] + ["bars_hourly", "win_cusum_filter", "scan_kdj", "tumble_nested", "roll_lag_last_time", "pipeline_hour_range"]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("customer", "orders", "part", "lineitem", "events"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def rows(frame):
    frame = frame[sorted(frame.columns)]
    text = lambda v: "null" if v is None or v != v else f"{float(v):.6f}" if isinstance(v, (int, float)) or hasattr(v, "dtype") else str(v)
    return sorted(tuple(text(v) for v in r) for r in frame.astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(set(SOME)))
def test_query(spark, duck, name):
    assert rows(catalog.queries()[name](spark, DIR).toPandas()) == rows(duck.execute(catalog.oracle_sql()[name]).df())


def test_entry_points_without_llm(tmp_path):
    root = Path(catalog.__file__).parents[2]
    for p in ("tidewell", "__spark_entry__.py"):
        (tmp_path / p).parent.mkdir(exist_ok=True)
    subprocess.run(["cp", "-r", str(root / "tidewell"), str(root / "__spark_entry__.py"), str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "tidewell/llm")], check=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'bars_hourly' in q and not any(n.startswith('op1_') for n in q) and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path), "HOME": "/tmp"})


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(catalog.oracle_sql())
