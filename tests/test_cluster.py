"""What differs between one JVM and a cluster: a small cluster of executors, in a process of its own."""

import os
import subprocess
import sys
from pathlib import Path

import pyspark

RUN = """
import sys
from pyspark.sql import SparkSession
from marlwick.queries import ORACLE, QUERIES
from marlwick.session import Session

tmp, data = sys.argv[1:]
conf = {"spark.master": "local-cluster[2,1,1024]", "spark.executor.memory": "700m", "spark.ui.enabled": "false", "spark.checkpoint.dir": f"{tmp}/shared", "spark.sql.shuffle.partitions": "4", "spark.driver.host": "127.0.0.1"}
conf |= {"spark.eventLog.enabled": "true", "spark.eventLog.dir": f"file://{tmp}/events", "spark.eventLog.compress": "false", "spark.eventLog.rolling.enabled": "false", "spark.sql.session.timeZone": "UTC"}
spark = SparkSession.builder.config(map=conf).getOrCreate()
spark.read.parquet(f"{data}/customer.parquet").createOrReplaceTempView("customer")
rows = sorted(map(tuple, QUERIES["encrypted_column"](spark, data).collect()))
assert rows == sorted(map(tuple, spark.sql(ORACLE["encrypted_column"].replace("5000.0", "5000.0D")).collect())) and rows
s = Session(spark, encryption_key="fedcba9876543210")
s.execute("CREATE TABLE secrets (id INT64, pin TEXT ENCRYPTED)")
s.execute("INSERT INTO secrets (id, pin) VALUES (1, '1234')")
assert [tuple(r) for r in s.sql("SELECT id, pin FROM secrets WHERE pin > '1'").collect()] == [(1, "1234")]
spark.stop()
"""


def test_encrypted_columns_on_a_cluster(tmp_path, data):
    root = Path(__file__).resolve().parent.parent
    (tmp_path / "home/work").mkdir(parents=True)
    (tmp_path / "events").mkdir()
    for p in Path(pyspark.__file__).parent.iterdir():  # executors write their logs to work in Spark's home
        if p.name != "work":
            (tmp_path / "home" / p.name).symlink_to(p)
    env = os.environ | {"PYTHONPATH": str(root), "SPARK_HOME": str(tmp_path / "home"), "PYSPARK_PYTHON": sys.executable, "SPARK_LOCAL_DIRS": str(tmp_path), "SPARK_LOCAL_IP": "127.0.0.1"}
    env = {k: v for k, v in env.items() if not k.startswith("PYSPARK_GATEWAY")}
    done = subprocess.run([sys.executable, "-c", RUN, str(tmp_path), data], env=env, capture_output=True, text=True, timeout=240)
    assert done.returncode == 0, done.stderr[-3000:]
    written = [p.read_text(errors="replace") for d in ("events", "home/work") for p in (tmp_path / d).rglob("*") if p.is_file() and p.suffix != ".jar"]
    assert len(written) > 1 and "fedcba9876543210" not in done.stdout + done.stderr + "".join(written)
