"""run() on several executors, each a process of its own, against the stages written one by one.

It starts three more JVMs, so ``conftest.py`` puts it before the tests that share a session.
"""

import json
import os
import subprocess
import sys
import tempfile
from pathlib import Path

from tests.llm.helpers import SMALL

REPO = Path(__file__).resolve().parents[2]
CHILD = """
import json, sys
from collections import Counter
from pyspark.sql import SparkSession
import corpus_pipeline
from vibrata.llm.common import table

scratch, sf = sys.argv[1:]
spark = (
    SparkSession.builder.master("local-cluster[2,1,768]").config("spark.executor.memory", "768m").config("spark.driver.memory", "768m").config("spark.ui.enabled", "false")
    .config("spark.sql.shuffle.partitions", "5").config("spark.driver.host", "127.0.0.1").config("spark.sql.warehouse.dir", f"{scratch}/warehouse")
    .config("spark.checkpoint.dir", f"file://{scratch}/shared").config("spark.sql.files.maxPartitionBytes", "100k").getOrCreate()
)
spark.sparkContext.setLogLevel("ERROR")
stages, read = corpus_pipeline.STAGES, []
corpus_pipeline.STAGES = [(name, lambda s, docs, d, f=f: read.append(docs.inputFiles()) or f(s, docs, d)) for name, f in stages]
got = Counter(map(tuple, corpus_pipeline.run(spark, sf).collect()))
docs = table(spark, sf, "documents")
for k, (_, stage) in enumerate(stages):
    stage(spark, docs, sf).write.parquet(f"{scratch}/{k}")
    docs = spark.read.parquet(f"{scratch}/{k}")
want = Counter(map(tuple, docs.collect()))
print(json.dumps({"same": got == want, "rows": sum(want.values()), "read": read}))
spark.stop()
"""


def test_run_writes_every_stage_and_agrees_with_the_stages_one_by_one():
    scratch = tempfile.mkdtemp(prefix="spark-")
    env = os.environ | {"PYTHONPATH": f"{REPO}:{os.environ.get('PYTHONPATH', '')}"}
    done = subprocess.run([sys.executable, "-c", CHILD, scratch, SMALL], cwd=scratch, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-3000:]
    found = json.loads(done.stdout.strip().splitlines()[-1])
    assert found["same"] and found["rows"]
    # Each stage after the first reads what the one before wrote to the shared folder.
    folders = [{str(Path(f).parent) for f in files} for files in found["read"]]
    assert len(folders) == 5 and all(len(f) == 1 for f in folders[1:])
    assert all(f"{scratch}/shared/" in next(iter(f)) for f in folders[1:])
    assert len(set.union(*folders[1:])) == 4
