"""What the pipeline's stages leave in memory: the executors' heaps and the workers' tables."""

from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest

from tessera.llm import common

ROOT = Path(__file__).resolve().parents[2]

CLUSTER = """
import re
from pathlib import Path
from pyspark.sql import SparkSession, functions as F
from tessera.llm.common import lean_workers, release

conf = {"spark.master": "local-cluster[2,2,1200]", "spark.executor.memory": "1000m", "spark.ui.enabled": "false", "spark.driver.host": "127.0.0.1", "spark.sql.shuffle.partitions": "16"}
spark = SparkSession.builder.config(map=conf).getOrCreate()
own = f"--app-id\\0{spark.sparkContext.applicationId}\\0".encode()


def held():
    found = []
    for p in Path("/proc").glob("[0-9]*"):
        try:
            line = (p / "cmdline").read_bytes()
            if b"CoarseGrainedExecutorBackend" in line and own in line:
                found.append(int(re.search(r"Pss_Anon:\\s+(\\d+)", (p / "smaps_rollup").read_text())[1]) // 1024)
        except OSError:
            pass
    return found


def work():
    rows = spark.range(0, 4_000_000, 1, 16).select((F.col("id") % 1_000_000).alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("s"))
    rows.groupBy("k").agg(F.collect_list("s").alias("l")).write.format("noop").mode("overwrite").save()


work()
print("HELD", *held(), flush=True)
lean_workers(spark)
print("HELD", *held(), flush=True)
work()
print("HELD", *held(), flush=True)
release(spark)
print("HELD", *held(), flush=True)
spark.stop()
"""


@pytest.mark.skipif(not Path("/proc/self/smaps_rollup").exists(), reason="memory can't be read here")
def test_executors_give_heap_back(tmp_path):
    env = os.environ | {"PYTHONPATH": f"{ROOT}:{os.environ.get('PYTHONPATH', '')}", "PYSPARK_PYTHON": sys.executable, "SPARK_SCALA_VERSION": "2.13"}
    env.pop("PYSPARK_SUBMIT_ARGS", None)
    done = subprocess.run([sys.executable, "-c", CLUSTER], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=240)
    held = [[int(x) for x in line.split()[1:]] for line in done.stdout.splitlines() if line.startswith("HELD")]
    assert len(held) == 4 and all(len(x) == 2 for x in held), done.stderr[-2000:]
    for before, after in (held[:2], held[2:]):  # at a stage's start, and inside one
        assert sum(after) < 0.75 * sum(before), held


def test_trim_drops_the_powers():
    common.prefix_hash(np.ones(1 << 18, np.uint64))
    assert common._powers
    common.trim()
    assert not common._powers
    units = np.arange(1, 9, dtype=np.uint64)
    h = common.prefix_hash(units)
    assert common.run_hash(h, np.array([0]), np.array([3]))[0] == common.run_hash(common.prefix_hash(units[:3]), np.array([0]), np.array([3]))[0]
