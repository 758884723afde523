"""The entry point of a copy without the corpus operators."""

import os
import shutil
import subprocess
import sys

from tests.conftest import DATA, ROOT

RUN = f"""
import __spark_entry__ as entry
from pyspark.sql import SparkSession

assert not any(k.startswith("op") or k == "pipeline" for k in entry.queries()), list(entry.queries())
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
assert entry.queries()["e1_detection_kpis"](spark, "{DATA}/sf0.001").count() > 0
spark.stop()
"""


def test_land_queries_run_without_the_corpus_operators(tmp_path):
    """The pipeline's module may stay behind; it is left out with the operators that it needs."""
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__"))
    assert not (copy / "landmesh/llm").exists()
    for there in (True, False):
        assert (copy / "corpus_pipeline.py").exists() == there
        env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
        out = subprocess.run([sys.executable, "-c", RUN], cwd=copy, env=env | {"PYTHONPATH": str(copy)}, capture_output=True, text=True, timeout=300)
        assert out.returncode == 0, out.stderr[-2000:]
        if there:
            (copy / "corpus_pipeline.py").unlink()
