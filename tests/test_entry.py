import os
import subprocess
import sys

HOME = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

CODE = """
import sys
sys.path.insert(0, sys.argv[1])
import __spark_entry__ as entry
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
for name in ("allele_freq", "grm_samples", *(q for q in entry.queries() if q.startswith("op1_"))):
    print("ROWS", name, entry.queries()[name](spark, "/root/testdata/sf0.001").count())
print("AFTER", spark.range(5).count())
"""


def test_queries_from_another_folder(tmp_path):
    """Without the repository on any path, executors get the package from the driver."""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", CODE, HOME], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert done.returncode == 0, done.stderr[-2000:]
    lines = done.stdout.splitlines()
    assert "AFTER 5" in lines and all(int(x.split()[2]) > 0 for x in lines if x.startswith("ROWS"))
    assert sum(x.startswith("ROWS") for x in lines) >= 2


def test_a_missing_dependency_of_the_subpackage_leaves_the_other_queries(tmp_path):
    code = "import sys; sys.modules['xxhash'] = None; sys.path.insert(0, sys.argv[1]); import __spark_entry__ as e; print(len(e.queries()), any(q.startswith('op') for q in e.queries()))"
    done = subprocess.run([sys.executable, "-c", code, HOME], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-2000:]
    assert done.stdout.split()[-1] == "False" and int(done.stdout.split()[0]) > 60
