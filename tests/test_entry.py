import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

ALONE = """
import sys
import __spark_entry__ as entry
from pyspark.sql import SparkSession
names = entry.queries()
assert names and not [n for n in names if n.startswith("op") or n == "pipeline"], names
assert set(entry.oracle_sql()) <= set(names)
assert not [m for m in sys.modules if m.startswith("pagelens.llm")]
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
print("ROWS", names["e7_title"](spark, "/root/testdata/sf0.001").count())
"""


def test_everything_else_works_without_the_training_data_part(tmp_path):
    to = tmp_path / "tree"
    shutil.copytree(ROOT, to, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    assert not (to / "pagelens" / "llm").exists()
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYTHONPATH": str(to)}
    done = subprocess.run([sys.executable, "-c", ALONE], cwd=to, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0 and "ROWS" in done.stdout, done.stderr[-2000:]


def test_names_of_queries_and_statements():
    sys.path.insert(0, ROOT)
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
