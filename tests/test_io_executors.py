"""Sources and sinks as executors in processes of their own see them."""

import importlib.util
import os
import subprocess
import sys
from pathlib import Path

from tessel.sources import files as S
from tessel.sources import sinks as W

RUN = """
from pyspark.sql import SparkSession
import __spark_entry__
spark = SparkSession.builder.master("local-cluster[2,1,1024]").config("spark.checkpoint.dir", "file://{at}/shared").config("spark.ui.enabled", "false").getOrCreate()
print("rows", __spark_entry__.queries()["io_jdbc"](spark, "{sf}").repartition(2).count())
"""


def test_jdbc_from_executors(tmp_path, sf):
    home, repo = Path(importlib.util.find_spec("pyspark").origin).parent, Path(__file__).resolve().parent.parent
    (tmp_path / "home/work").mkdir(parents=True)
    for p in home.iterdir():
        if p.name != "work":
            (tmp_path / "home" / p.name).symlink_to(p)
    env = os.environ | {"SPARK_HOME": str(tmp_path / "home"), "SPARK_SCALA_VERSION": "2.13", "PYTHONPATH": str(repo), "PYSPARK_PYTHON": sys.executable, "SPARK_LOCAL_IP": "127.0.0.1"}
    env.pop("PYSPARK_GATEWAY_PORT", None)
    out = subprocess.run([sys.executable, "-c", RUN.format(at=tmp_path, sf=sf)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert "rows 25" in out.stdout, out.stderr[-2000:]


def test_chunk_files_are_files(spark, tmp_path):
    rows = [(1, 0, 0, "a\n"), (1, 0, 1, "b\n\nc\r\n"), (1, 2, 0, "片"), (None, 0, 0, ""), (2, 0, 0, None)]
    d = spark.createDataFrame(rows, "doc_id long, node_idx int, chunk_index int, content string")
    at = f"file://{tmp_path}/chunks"
    for _ in range(2):
        W.write_chunk_files(d, at, "part")
    assert (tmp_path / "chunks/doc_id=1/part_0002.txt").read_bytes() == b"b\n\nc\r\n" and (tmp_path / "chunks/_SUCCESS").exists()
    got = {(r.doc_id, r.file_name): r.value for r in S.read_chunk_files(spark, at).collect()}
    assert got == {("1", "part_0001.txt"): "a\n", ("1", "part_0002.txt"): "b\n\nc\r\n", ("1", "part_0003.txt"): "片", (None, "part_0001.txt"): "", ("2", "part_0001.txt"): ""}
    W.write_chunk_files(d.where("doc_id = 9"), at, "part")
    assert S.read_chunk_files(spark, at).count() == 0
