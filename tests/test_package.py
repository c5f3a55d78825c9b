import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]

# the driver finds the package by its own path; the workers, started elsewhere, do not
SCRIPT = f"""
import sys
sys.path.insert(0, {str(ROOT)!r})
from pyspark.sql import SparkSession
import __spark_entry__ as entry
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
found = entry.queries()
for name in ("u1_apply_handler", "s4_demux_captures", "t2_decode_raw_tensors", "b1_decode_bodies"):
    assert len(found[name](spark, "/root/testdata/sf0.001").collect()) > 0, name
print("all ran")
"""


def test_workers_need_no_package(tmp_path):
    done = subprocess.run(
        [sys.executable, "-c", SCRIPT], cwd=tmp_path, capture_output=True, text=True, timeout=300
    )
    assert "all ran" in done.stdout, done.stderr[-2000:]
