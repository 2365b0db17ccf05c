"""The catalogue's queries against their SQL twins at the smallest scale, where the test tables are at hand."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__
from ebbflow import catalog, oracles

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
NAMES = sorted(set(oracles.ORACLES) & set(catalog.QUERIES))


def rows_of(df):
    return sorted(tuple("" if v is None or v != v else str(v) for v in row) for row in df)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for file in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{FOLDER}/{file}'")
    got = __spark_entry__.queries()[name](spark, FOLDER)
    want = con.execute(__spark_entry__.oracle_sql()[name])
    columns = sorted(got.columns)
    names = [d[0] for d in want.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert rows_of(map(tuple, got.select(*[f"`{c}`" for c in columns]).collect())) == rows_of(tuple(r[i] for i in order) for r in want.fetchall())


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_all_but_the_training_data_operators_stand_alone(tmp_path):
    """The entry imports, with all other queries, where the subpackage and its tests are gone; the pipeline file may stay or go."""
    home = Path(__spark_entry__.__file__).parent
    skip = shutil.ignore_patterns(".git", "__pycache__", "llm", "*.json", "*.md", "*.txt")
    shutil.copytree(home, tmp_path / "copy", ignore=skip)
    for pipeline in (True, False):
        if not pipeline:
            (tmp_path / "copy" / "corpus_pipeline.py").unlink(missing_ok=True)
        code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), 'pipeline' in e.queries())"
        said = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path / "copy", capture_output=True, text=True, timeout=120, check=True)
        assert said.stdout.split() == [str(len(catalog.QUERIES)), str(len(oracles.ORACLES)), "False"]
