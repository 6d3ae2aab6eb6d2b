"""The entry module with parts missing: the core queries stay."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = """
import sys
blocked = {blocked!r}
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == blocked or name.startswith(blocked + "."):
            raise ModuleNotFoundError("No module named " + repr(name), name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as entry
from visitloom.plans.catalog import ORACLES, QUERIES
have, said = entry.queries(), entry.oracle_sql()
assert set(QUERIES) <= set(have) and set(ORACLES) <= set(said) <= set(have)
print(sorted(set(have) - set(QUERIES)))
"""


@pytest.mark.parametrize("blocked", ["visitloom.llm", "public_tokenizers", "corpus_pipeline", "xxhash", "tokenizers"])
def test_core_without(blocked):
    run = subprocess.run([sys.executable, "-c", CODE.format(blocked=blocked)], cwd=ROOT, capture_output=True, text=True)
    assert run.returncode == 0, run.stderr[-2000:]
    if blocked in ("visitloom.llm", "public_tokenizers"):
        assert run.stdout.strip() == "[]"
