"""The entry module without the training-data operators or what they import."""

import os
import subprocess
import sys

import pytest

from orderlens.catalog import all_queries

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
BLOCKED = """
import sys
class Block:
    def find_spec(self, name, path=None, target=None):
        if name == {name!r}:
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Block())
import __spark_entry__ as e
print("QUERIES", len(e.queries()), len(e.oracle_sql()), any(q.startswith("op") for q in e.queries() if q[2:3].isdigit()))
"""


@pytest.mark.parametrize("name", ["orderlens.llm", "corpus_pipeline", "xxhash"])
def test_other_queries_stay_without_them(name):
    done = subprocess.run([sys.executable, "-c", BLOCKED.format(name=name)], cwd=ROOT, capture_output=True,
                          text=True, timeout=120)
    n = len(all_queries())
    assert f"QUERIES {n} {n} False" in done.stdout, done.stderr[-1500:]
