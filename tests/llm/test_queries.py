"""The registered queries against their SQL, and the package's place in the library."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest
from conftest import SMALL, TABLES
from helpers import duck_rows, rows_of

from threadlens.llm.queries import QUERIES, SQL

ROOT = Path(__file__).resolve().parents[2]


@pytest.fixture(scope="module", params=[SMALL, "/root/testdata/sf0.01"])
def folder(request):
    return request.param


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql_twin(spark, folder, name):
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    columns, got = rows_of(QUERIES[name](spark, folder))
    expected_columns, expected = duck_rows(connection, SQL[name])
    assert columns == expected_columns
    assert got == expected


def test_one_query_an_operator():
    assert [f"op{n}" for n in range(1, 14)] == sorted(
        (q.split("_")[0] for q in QUERIES if q != "pipeline"), key=lambda q: int(q[2:])
    )
    assert "pipeline" in QUERIES


def test_nothing_else_imports_the_package():
    others = [p for p in ROOT.rglob("*.py") if "llm" not in p.parts and p.name not in ("__spark_entry__.py", "corpus_pipeline.py")]
    assert not [p for p in others if "threadlens.llm" in p.read_text()]


def test_entry_stands_without_the_package(tmp_path):
    code = (
        "import sys\n"
        "class Gone:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name.startswith('threadlens.llm'):\n"
        "            raise ModuleNotFoundError(name, name=name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "assert e.queries() and all(q.startswith('q_') for q in e.queries())\n"
        "assert set(e.oracle_sql()) == set(e.queries())\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=300)
