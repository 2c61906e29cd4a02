"""The driver contract, with and without the optional subpackage."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
TABLES = "region nation customer supplier part orders lineitem pages".split()


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_every_query_has_a_name_and_sql_belongs_to_a_query():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_works_without_the_subpackage(tmp_path):
    import shutil

    for p in ROOT.iterdir():
        if p.name in ("axiomata", "__spark_entry__.py"):
            (shutil.copytree if p.is_dir() else shutil.copy)(p, tmp_path / p.name)
    shutil.rmtree(tmp_path / "axiomata/llm", ignore_errors=True)
    code = "import __spark_entry__ as e; assert e.queries() and e.oracle_sql() and not any(q.startswith('op') for q in e.queries()), e.queries().keys()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)


def test_nothing_outside_imports_the_subpackage():
    for p in (ROOT / "axiomata").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT / "axiomata").parts:
            assert "axiomata.llm" not in p.read_text()


@pytest.mark.parametrize("name", ["signature", "ancestors_cyclic", "diff_removed", "undeclared_entity", "profile_violations", "icv_all_values", "el_direct_supers", "owner_prefix", "parsed_documents"])
def test_queries_equal_their_sql(spark, name):
    import duckdb

    import __spark_entry__

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{d}/{table}.parquet'")
    df = __spark_entry__.queries()[name](spark, d)
    own = sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=str)
    con.execute(__spark_entry__.oracle_sql()[name])
    cols = [c[0] for c in con.description]
    assert sorted(cols) == sorted(df.columns)
    assert own == sorted((tuple(r[cols.index(c)] for c in sorted(cols)) for r in con.fetchall()), key=str)
