"""Tables in the shared folder go with their application."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = """
import os, sys
from pyspark.sql import SparkSession
shared = sys.argv[1]
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", f"file://{shared}").getOrCreate()
from braidlog.storage import discard, written
one, two = (written(spark.range(100).groupBy("id").count(), n) for n in ("one", "two"))
assert one.count() == two.count() == 100
discard(one)
held = [d for _, ds, _ in os.walk(shared) for d in ds]
assert any(d.startswith("two-") for d in held) and not any(d.startswith("one-") for d in held), held
assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
spark.stop()
print("LEFT", [x for x in os.listdir(shared) if x.startswith("braidlog-")])  # Spark keeps a folder of its own there
"""


def test_nothing_is_left_after_stop(tmp_path):
    run = subprocess.run([sys.executable, "-c", SCRIPT, str(tmp_path)], cwd=ROOT, env=os.environ | {"PYTHONPATH": ROOT}, capture_output=True, text=True, timeout=120)
    assert "LEFT []" in run.stdout, run.stdout + run.stderr
