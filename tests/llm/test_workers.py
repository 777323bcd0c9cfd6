"""The workers get the package from the driver, wherever both were started."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

CODE = """
import sys
sys.path.insert(0, {root!r})
import __spark_entry__ as entry
import corpus_pipeline
from pyspark.sql import SparkSession

spark = (
    SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false")
    .config("spark.checkpoint.dir", {shared!r}).config("spark.driver.memory", "2g").getOrCreate()
)
spark.sparkContext.setLogLevel("ERROR")
queries = entry.queries()
for name in {names!r}:
    assert queries[name](spark, {sf!r}).count() >= 0, name
docs = spark.read.parquet({sf!r} + "/documents.parquet")
assert corpus_pipeline.toxicity(spark, docs, {sf!r}).count() > 0
print("all ran")
"""


@pytest.mark.parametrize("names", [["op1_toxicity", "op3_near_dedup", "op4_fingerprints", "op5_token_files", "op8_packing", "op9_warc", "op10_chat_trees", "op11_merkle_manifest", "op12_byte_bpe", "op13_periodic_runs"]])
def test_started_from_another_folder(tmp_path, sf_dir, names):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    code = CODE.format(root=ROOT, shared=str(tmp_path / "shared"), names=names, sf=sf_dir)
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert "all ran" in done.stdout, done.stderr[-3000:]
