"""The entry points with and without the training-data operators."""

import os
import shutil
import subprocess
import sys

import pytest

from conftest import ROOT

CODE = """
import sys, __spark_entry__ as e
from orbweave.plans.catalogue import ORACLE_SQL, QUERIES
assert set(e.queries()) == set(QUERIES) and set(e.oracle_sql()) == set(ORACLE_SQL), sorted(e.queries())
if sys.argv[1] == "run":
    from pyspark.sql import SparkSession
    spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
    print(e.entry(spark).count())
"""


@pytest.mark.parametrize("pipeline,how", [(True, "run"), (False, "look")])
def test_entry_without_the_training_data_operators(tmp_path, pipeline, how):
    def left_out(folder, names):
        return [n for n in names if n in {"llm", ".git", "__pycache__"} or (n == "corpus_pipeline.py" and not pipeline)]

    shutil.copytree(ROOT, tmp_path / "copy", ignore=left_out)
    env = {k: v for k, v in os.environ.items() if k not in {"PYTHONPATH", "PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET"}} | {"PYTHONPATH": str(tmp_path / "copy")}
    done = subprocess.run([sys.executable, "-c", CODE, how], cwd=tmp_path / "copy", env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert how == "look" or int(done.stdout.split()[-1]) > 0


def test_every_sql_has_a_query():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
