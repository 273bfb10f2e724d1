"""The driver's entry point with and without the training-data subpackage."""

import os
import subprocess
import sys

TOP = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
BLOCKED = """
import sys
class Absent:
    def find_spec(self, name, path=None, target=None):
        if name.split(".")[0] in {names!r} or name in {names!r}:
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Absent())
import __spark_entry__ as e
print(len(e.queries()), sum(k.startswith("op") for k in e.queries()), "pipeline" in e.queries(), set(e.oracle_sql()) <= set(e.queries()))
"""


def with_blocked(*names):
    run = subprocess.run([sys.executable, "-c", BLOCKED.format(names=names)], cwd=TOP, capture_output=True, text=True, timeout=120)
    assert run.returncode == 0, run.stderr
    return run.stdout.split()


def test_core_queries_survive_a_failing_import():
    for names in (("tidewell.llm",), ("corpus_pipeline", "tidewell.llm"), ("xxhash",), ("zstandard", "ahocorasick")):
        found = with_blocked(*names)
        assert int(found[0]) > 60 and found[1:] == ["0", "False", "True"]
