"""Every registered query of the subpackage against its SQL on the smallest tables."""

import pytest
from oracle import compare, connect

from merchantry.llm.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, FOLDER)
    if name in SQL:
        assert compare(df, connect(FOLDER), SQL[name]) == ""
    else:
        tables = {"op2_byte_bpe", "op3_pii", "op4_token_index", "op6_toxicity", "op10_quality", "op12_piece_bpe"}
        assert name in tables
        assert df.count() == spark.read.parquet(f"{FOLDER}/documents.parquet").count()


def test_all_are_registered():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))


def test_the_rest_stands_alone(tmp_path):
    """Without this subpackage and the pipeline, the entry point has the other queries."""
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    shutil.copytree(f"{root}/merchantry", tmp_path / "merchantry", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); print(len(q), any(n.startswith('op') or n == 'pipeline' for n in q))"
    out = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
    assert out.stdout.split()[1] == "False" and int(out.stdout.split()[0]) > 100, out.stderr
