"""Operators work on frames that no reader of this package made, started from a folder without it."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from talus.session import local_session
from talus.llm import ocr_repair, pii
spark = local_session("2")
df = spark.createDataFrame([("s", None, "This line breaks\\nin the middle of it.\\n- 3 -", None, True)], "section_id string, section_path string, content string, ingest_ts timestamp, flag boolean")
assert [r.noise_kind for r in ocr_repair.found_noise(df, "flag").collect()] == ["page_furniture"]
t = spark.createDataFrame([("t", "write to a.b@c.example please")], "id string, text string")
assert [r.pii_kind for r in pii.find_pii(t, "id", ["text"]).collect()] == ["email"]
"""


def test_operators_ship_the_package(tmp_path):
    r = subprocess.run([sys.executable, "-c", SCRIPT.format(root=ROOT)], cwd=tmp_path, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, capture_output=True, text=True, timeout=300)
    assert r.returncode == 0, r.stderr[-2000:]
