"""Executors whose Python workers cannot import the package."""

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SCRIPT = """
import sys, tempfile
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local-cluster[1,2,1024]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2")
         .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", "file:" + tempfile.mkdtemp()).getOrCreate())
spark.sparkContext.setLogLevel("ERROR")
import __spark_entry__ as e
q = e.queries()
for name in {names!r}:
    print("ran", name, q[name](spark, "/root/testdata/sf0.001").count(), flush=True)
"""


def test_workers_need_not_import_the_package(tmp_path):
    names = ["bootstrap_multi_coef", "final_ranking"]
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYSPARK_PYTHON": sys.executable}
    done = subprocess.run([sys.executable, "-c", SCRIPT.format(repo=REPO, names=names)], cwd=tmp_path, env=env,
                          capture_output=True, text=True, timeout=300)
    assert [line.split()[1] for line in done.stdout.splitlines() if line.startswith("ran")] == names, done.stdout[-2000:] + done.stderr[-3000:]
