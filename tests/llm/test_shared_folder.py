"""An operator that stores tables, in a session without a folder for them."""

import importlib.util
from pathlib import Path

import pytest

from folioq.llm import common

_spec = importlib.util.spec_from_file_location("core_test_folder", Path(__file__).resolve().parents[1] / "test_folder.py")
core = importlib.util.module_from_spec(_spec)
_spec.loader.exec_module(core)


def test_without_a_folder(tmp_path):
    core.run(["op2_source_mix"], tmp_path)


def test_refused_on_a_cluster():
    with pytest.raises(ValueError):
        common.shared_folder(core.Settings(master="local-cluster[2,1,1024]"))
