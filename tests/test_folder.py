"""Stored tables without a folder in the session's settings: one of this machine in local mode, an error on a cluster."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

from folioq import store

RUN = """
from folioq.session import session
import __spark_entry__ as entry
spark = session("local[2]", 2)
assert spark.conf.get("spark.checkpoint.dir", None) is None
for name in NAMES:
    assert entry.queries()[name](spark, "/root/testdata/sf0.001").count() > 0, name
from folioq.store import shared_folder
assert shared_folder(spark) == shared_folder(spark)
"""


def run(names, tmp_path):
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": str(Path(__file__).resolve().parents[1])}
    done = subprocess.run([sys.executable, "-c", f"NAMES = {names!r}\n{RUN}"], env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-2000:]


def test_without_a_folder(tmp_path):
    run(["bm25_documents", "components"], tmp_path)


class Settings:
    """A session's settings and nothing else of it."""

    def __init__(self, **values):
        self.conf, self.values = self, values

    def get(self, key, default=None):
        return self.values.get(key.rpartition(".")[2], default)


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "local-cluster[2,1,1024]"])
def test_refused_on_a_cluster(master):
    with pytest.raises(ValueError):
        store.shared_folder(Settings(master=master))
    assert store.shared_folder(Settings(master=master, dir="hdfs://x/y/")) == "hdfs://x/y"
