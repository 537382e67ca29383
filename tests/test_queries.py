"""Every query against its SQL on the smallest tables."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from umbra.plans.oracle import ORACLE
from umbra.plans.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def rows(df):
    columns = sorted(df.columns)
    plain = df[columns].astype(object).where(df[columns].notna(), None)
    return columns, sorted(repr([float(x) if isinstance(x, float) else x for x in r]) for r in plain.values.tolist())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, sql, name):
    assert rows(QUERIES[name](spark, FOLDER).toPandas()) == rows(sql.execute(ORACLE[name]).df())


def test_verification_passes(spark):
    row = QUERIES["verification_summary"](spark, FOLDER).first()
    assert row.passed and row.residual_original_value_count == 0 and row.prediction_count == 13


def test_entry_without_the_training_data_folders(tmp_path):
    """On a copy without the folders: all else imports, and nothing of theirs is registered."""
    root = Path(__file__).resolve().parents[1]
    for drop in (("corpus_pipeline.py",), ()):
        copy = tmp_path / f"copy{len(drop)}"
        shutil.copytree(root / "umbra", copy / "umbra", ignore=shutil.ignore_patterns("llm", "__pycache__"))
        for name in ("__spark_entry__.py", "corpus_pipeline.py"):
            if name not in drop and (root / name).exists():
                shutil.copy(root / name, copy)
        code = "import __spark_entry__ as e; print(*sorted(e.queries()), '|', *sorted(e.oracle_sql()))"
        said = subprocess.run([sys.executable, "-c", code], cwd=copy, env=os.environ | {"PYTHONPATH": str(copy)}, capture_output=True, text=True, check=True).stdout
        assert said.split("|")[0].split() == sorted(QUERIES) and said.split("|")[1].split() == sorted(ORACLE)
