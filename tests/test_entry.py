import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parents[1]
DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


sys.path.insert(0, str(ROOT))


def plain(v):
    if isinstance(v, float):
        return "%.11g" % v
    return v.isoformat() if hasattr(v, "isoformat") else str(v)


def catalog():
    from gleaner.plans import catalog as c

    return c


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("name", sorted(catalog().oracle_sql()))
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    got, want = catalog().queries()[name](spark, DATA), db.sql(catalog().oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    assert sorted(tuple(plain(r[c]) for c in columns) for r in got.collect()) == sorted(tuple(plain(r[k]) for k in at) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog().queries()) - set(catalog().oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert catalog().queries()[name](spark, DATA).count() > 0


def test_the_rest_stands_alone(tmp_path):
    """Without the subpackage for language-model data everything else imports."""
    import shutil

    shutil.copytree(ROOT / "gleaner", tmp_path / "gleaner", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert e.queries() and not any(n.startswith('op') for n in e.queries())"
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path).returncode == 0


def test_a_missing_library_leaves_the_other_queries(tmp_path):
    (tmp_path / "ahocorasick.py").write_text("raise ImportError('not here')")
    code = f"import sys; sys.path[:0] = [{str(tmp_path)!r}, {str(ROOT)!r}]; import __spark_entry__ as e; assert len(e.queries()) > 180 and not any(n.startswith('op1_') for n in e.queries()) and set(e.oracle_sql()) <= set(e.queries())"
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path).returncode == 0
