"""A session that names no shared folder."""

import os
import subprocess
import sys

CODE = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
assert not spark.conf.get("spark.checkpoint.dir", None)
from barloom.catalog import QUERIES
from barloom.session import cut_lineage, shared_root
assert QUERIES["rm2_segments"](spark, "/root/testdata/sf0.001").count() >= 0
assert cut_lineage(spark.range(5)).count() == 5
root = shared_root(spark)
assert root == shared_root(spark) and root.startswith("file://")
print("OK", root)
"""


def test_without_a_checkpoint_folder(tmp_path):
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {**os.environ, "SPARK_CONF_DIR": str(tmp_path)}
    out = subprocess.run([sys.executable, "-c", CODE.format(repo=repo)], env=env, capture_output=True, text=True, timeout=600, check=False)
    assert out.returncode == 0, out.stderr[-2000:]
    root = next(line for line in out.stdout.splitlines() if line.startswith("OK")).split()[1].removeprefix("file://")
    assert not os.path.exists(root)
