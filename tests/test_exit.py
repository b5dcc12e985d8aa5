"""What direct calls leave behind is gone when the driver ends."""

import os
import subprocess
import sys

SCRIPT = """
import sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
spark.sparkContext.setCheckpointDir(sys.argv[1])
from hearlog.session import durable
durable(spark.range(5)).count()
spark.stop()
"""


def test_tables_outside_of_blocks_go_with_the_driver(tmp_path):
    env = os.environ | {"PYTHONPATH": os.path.dirname(os.path.dirname(os.path.abspath(__file__)))}
    subprocess.run([sys.executable, "-c", SCRIPT, str(tmp_path)], check=True, env=env, capture_output=True, timeout=180)
    assert not [name for _, folders, files in os.walk(tmp_path) for name in [*folders, *files] if name.startswith("hearlog-")]
