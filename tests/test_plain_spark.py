"""The engine on a Spark without any configuration, and what it leaves behind."""

import os
import subprocess
import sys

import pytest

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
RUN = """
import sys, __spark_entry__
from tidewrack.session import local_session
spark = local_session(2, shuffle_partitions=2, memory="2g")
for name in sys.argv[1:]:
    if name in __spark_entry__.queries():
        print(name, __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001").count())
"""


@pytest.mark.parametrize("names", [["cluster_rollup", "reach_production"], ["op7_nearest_neighbours", "op9_simhash"]])
def test_runs_and_leaves_no_file(tmp_path, names):
    conf, tmp = tmp_path / "conf", tmp_path / "tmp"
    conf.mkdir(), tmp.mkdir()
    env = os.environ | {"SPARK_CONF_DIR": str(conf), "TMPDIR": str(tmp), "PYTHONPATH": REPO, "SPARK_LOCAL_DIRS": str(tmp_path / "local")}
    done = subprocess.run([sys.executable, "-c", RUN, *names], env=env, cwd=REPO, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-3000:]
    assert [p for p in tmp.rglob("*") if "tidewrack" in str(p)] == []
