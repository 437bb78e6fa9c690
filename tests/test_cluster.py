"""Queries whose executors are processes of their own."""

import json
import os
import subprocess
import sys
from pathlib import Path

import pyspark

NATIONS = [(n, f"NATION_{n}") for n in range(25)] + [(None, "no key"), (-7, None), (99, ""), (25, "Đà Nẵng, \"O'Hare\"\nsecond line"), (26, "x" * 1_000), (3, "NATION_3")]

SCRIPT = """
import json, sys
from pyspark.sql import SparkSession
import __spark_entry__ as entry
from corpusloom import session
from tests.test_cluster import NATIONS

folder = sys.argv[1]
conf = {"spark.master": "local-cluster[2,1,1024]", "spark.executor.memory": "512m", "spark.ui.enabled": "false", "spark.driver.host": "127.0.0.1"}
mounts = {"spark.hadoop.fs.viewfs.mounttable.default.link./mounted": f"file://{folder}/mounted"}
spark = SparkSession.builder.config(map=conf | mounts).getOrCreate()
spark.createDataFrame(NATIONS, "n_nationkey int, n_name string").repartition(3).write.parquet(f"{folder}/nation.parquet")
found = {}
for shared in (f"file://{folder}/shared", "viewfs:///mounted"):
    session.work_folder = lambda _, folder=shared: folder
    found[shared.split(":")[0]] = [tuple(r) for r in entry.queries()["database_scan"](spark, folder).collect()]
print("found", json.dumps(found))
spark.stop()
"""


def test_database_scan_in_a_cluster(tmp_path):
    repo, home = Path(__file__).resolve().parent.parent, tmp_path / "home"
    (home / "work").mkdir(parents=True)  # a local cluster writes its logs here
    (tmp_path / "mounted").mkdir()
    for p in Path(pyspark.__file__).parent.iterdir():
        if p.name != "work":
            (home / p.name).symlink_to(p)
    env = os.environ | {"SPARK_HOME": str(home), "SPARK_LOCAL_IP": "127.0.0.1", "SPARK_SCALA_VERSION": "2.13", "PYTHONPATH": str(repo), "PYSPARK_PYTHON": sys.executable}
    ran = subprocess.run([sys.executable, "-c", SCRIPT, str(tmp_path)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    lines = [x for x in ran.stdout.splitlines() if x.startswith("found ")]
    assert lines, ran.stderr[:5000]
    key = lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or "")
    want = sorted(([k, name, None] for k, name in NATIONS), key=key)
    got = json.loads(lines[0][6:])
    assert {c: sorted(rows, key=key) for c, rows in got.items()} == {"file": want, "viewfs": want}
