"""The entry points run in a session without any setting of ours."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SCRIPT = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").getOrCreate()
import __spark_entry__ as E
q = E.queries()
print("ENTRY", E.entry(spark).count())
for k in ("win_lag_timediff", "filter_on_lag", "win_row_number_nth", "agg_min_check", "movement_metrics", "page_assign"):
    print("ROWS", k, q[k](spark, "/root/testdata/sf0.001").count())
"""


def test_entry_and_window_queries_run():
    done = subprocess.run([sys.executable, "-c", SCRIPT, ROOT], capture_output=True, text=True, timeout=400)
    assert done.returncode == 0, done.stderr[-2000:]
    assert done.stdout.count("ROWS") == 6 and "ENTRY" in done.stdout
