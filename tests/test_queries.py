"""Every query with an oracle against DuckDB on the smallest tables."""

import os

import pandas as pd
import pytest

import __spark_entry__ as entry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(x):
    if pd.api.types.is_scalar(x) and pd.isna(x):
        return None
    if hasattr(x, "item"):
        x = x.item()
    if isinstance(x, float) and x.is_integer():
        return int(x)
    return str(x) if hasattr(x, "isoformat") else x


NAMES = sorted(n for m in entry.MODULES for n in m.ORACLES)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    got = entry.queries()[name](spark, DATA).toPandas()
    want = duck.sql(entry.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda d: sorted((tuple(map(plain, r)) for r in d[columns].itertuples(index=False)), key=repr)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", ["build_notes", "content_hash", "device_token"])
def test_hashes_of_odd_texts(spark, tmp_path, name):
    import duckdb

    rows = [(i, t, "en", "src1") for i, t in enumerate(["abc", "", None, "a😀b", "😀" * 70000, " ", "a\0b", "é" * 70000, "polygenelubricants"])]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    got = sorted(map(tuple, entry.queries()[name](spark, str(tmp_path)).collect()))
    assert got == sorted(con.sql(entry.oracle_sql()[name]).fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_registry_survives_without_the_llm_folder(tmp_path):
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.abspath(entry.__file__))
    shutil.copytree(f"{root}/inkwell", tmp_path / "inkwell", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(entry.__file__, tmp_path)
    code = "import __spark_entry__ as e; assert 'text_search' in e.queries() and not any(n.startswith('op') for n in e.queries()) and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
