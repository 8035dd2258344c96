"""The entry without the corpus operators, or without what they import: the other queries are all there."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
BLOCK = """
import sys
class Block:
    def find_spec(self, name, path=None, target=None):
        if name in {names!r} or any(name.startswith(n + ".") for n in {names!r}):
            raise ImportError(f"{{name}} is blocked")
sys.meta_path.insert(0, Block())
import __spark_entry__ as e
print("QUERIES", len(e.queries()), len(e.oracle_sql()), sum(k.startswith("op") or k == "pipeline" for k in e.queries()))
"""


@pytest.mark.parametrize("names", [["lexiflow.llm", "corpus_pipeline"], ["lexiflow.llm"], ["ahocorasick"], ["zstandard"], ["public_tokenizers"]])
def test_other_queries_stay(names):
    if names == ["public_tokenizers"] and not os.path.isdir(os.path.join(ROOT, "lexiflow", "llm")):
        pytest.skip("only the corpus operators use it")
    out = subprocess.run([sys.executable, "-c", BLOCK.format(names=names)], cwd=ROOT, capture_output=True, text=True, timeout=300)
    n, sql, corpus = map(int, out.stdout.split("QUERIES")[1].split())
    assert n >= 64 and sql >= 64, out.stderr[-500:]
    if names != ["public_tokenizers"]:
        assert corpus == 0 and n == sql
