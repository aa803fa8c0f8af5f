import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

DATA = Path("/root/testdata/sf0.001")
ROOT = Path(__file__).resolve().parent.parent


def test_every_query_has_a_name_and_sql_only_for_known_ones():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_core_imports_nothing_of_the_training_data_part():
    for path in (ROOT / "attesta").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "attesta.llm" not in path.read_text() and "import llm" not in path.read_text()
    code = "import sys; sys.modules['attesta.llm'] = None; import __spark_entry__ as e; assert 'edge_trust' in e.queries() and 'p1_found' not in e.queries() and 'p2_found' in e.queries()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=ROOT)


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", ["p2_found", "edge_trust", "functional_current", "gaps_all", "span_check", "stream_calls_per_day", "stream_sessions", "usage_by_tool", "alias_match"])
def test_queries_equal_their_sql(spark, name):
    rows = entry.queries()[name](spark, str(DATA))
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in DATA.glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from read_parquet('{f}')")
    result = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(rows.columns)

    def plain(v):
        return repr(round(v, 6)) if isinstance(v, float) else v.replace(tzinfo=None).isoformat() if hasattr(v, "isoformat") else str(v)

    want = sorted(tuple(plain(v) for v in r) for r in result.fetchall())
    assert sorted(tuple(plain(r[n]) for n in names) for r in rows.collect()) == want


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_flagship(spark):
    assert entry.entry(spark).count() > 0
