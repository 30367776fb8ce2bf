import importlib
import sys

import pytest

import __spark_entry__ as entry
from tallyframe.shared import shared_folder


class _Session:
    """What shared_folder asks of a session."""
    def __init__(self, master, folder=None):
        self.conf, self.sparkContext, self.master = self, self, master
        self.get = lambda name, default: folder or default


def test_shared_folder():
    assert shared_folder(_Session("yarn", "hdfs://x/y/")).startswith("hdfs://x/y/tallyframe-")
    for master in ("local", "local[4]", "local[*]"):
        assert shared_folder(_Session(master))
    for master in ("yarn", "local-cluster[3,2,1024]", "spark://h:1"):
        with pytest.raises(ValueError):
            shared_folder(_Session(master))


def test_core_queries_do_without_the_optional_parts(monkeypatch):
    """A library that only they need is missing: the other queries stay."""
    real = importlib.import_module

    def missing(name, *rest):
        if name.startswith("tallyframe.llm"):
            raise ModuleNotFoundError(name)
        return real(name, *rest)

    monkeypatch.setattr(importlib, "import_module", missing)
    names = set(entry.queries())
    assert "top_customers_net_sales" in names and not [n for n in names if n.startswith("op") and n[2:3].isdigit()] and "pipeline" not in names
    assert set(entry.oracle_sql()) <= names
    assert sys.modules["__spark_entry__"] is entry
