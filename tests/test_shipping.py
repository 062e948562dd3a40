"""Operators work on frames that no reader of this package made, started from a folder without it."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from talus.session import local_session
from talus.operators import chunking, schema_drift
spark = local_session("2")
df = spark.createDataFrame([("s", "some text")], "id string, text string")
assert chunking.boundary_chunks(df, "id", "text").count() == 1
records = spark.createDataFrame([("r", "f", "a", "t", None, 1, "{{}}", None)], "record_id string, feed string, file_name string, target_table string, exported_at timestamp, line_no int, payload string, ingest_ts timestamp")
assert schema_drift.schema_changes(records).count() == 0
"""


def test_operators_ship_the_package(tmp_path):
    r = subprocess.run([sys.executable, "-c", SCRIPT.format(root=ROOT)], cwd=tmp_path, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, capture_output=True, text=True, timeout=300)
    assert r.returncode == 0, r.stderr[-2000:]
