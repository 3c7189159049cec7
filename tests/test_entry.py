import shutil
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parent.parent
DATA = Path("/root/testdata/sf0.001")


def test_every_sql_has_its_query():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 80


def test_core_stands_without_the_subpackage(tmp_path):
    shutil.copytree(REPO / "tarn", tmp_path / "tarn", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 60 and not [k for k in q if k[0] == 'p' and k[1].isdigit()]; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin"}, check=True, timeout=120)


def test_nothing_else_imports_the_subpackage():
    for p in (REPO / "tarn").rglob("*.py"):
        if "llm" not in p.relative_to(REPO / "tarn").parts:
            assert "tarn.llm" not in p.read_text()


@pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
@pytest.mark.parametrize("name", ["rt_hybrid", "ev_summary", "ev_paired", "qc_question_checks", "qc_near_fingerprints", "sm_controls", "tx_citation_stats", "ch_chunks"])
def test_queries_run_and_keep_their_schema(spark, name):
    import __spark_entry__ as e

    a, b = e.queries()[name](spark, str(DATA)), e.queries()[name](spark, str(DATA))
    assert a.schema == b.schema and sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


@pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
def test_queries_equal_their_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    import __spark_entry__ as e

    c = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        c.sql(f"create view {p.stem} as select * from '{p}'")
    for name in ("ev_by_type", "qc_latest_labels", "qc_badcases", "tx_tokens", "tx_leak", "sm_round_robin", "st_windows"):
        df = e.queries()[name](spark, str(DATA))
        cols = sorted(df.columns)
        got = sorted(str(tuple(r)) for r in df.select(*cols).collect())
        want = sorted(str(r) for r in c.sql(f"select {', '.join(cols)} from ({e.oracle_sql()[name]})").fetchall())
        assert got == want, name
