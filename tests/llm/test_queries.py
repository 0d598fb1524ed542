"""Registered queries against their SQL, and the entry without this subpackage."""

import subprocess
import sys
from pathlib import Path

import pytest
from oracle import compare

from factorlake.llm import load

REG = load()


@pytest.mark.parametrize("name", sorted(REG.ORACLES))
def test_query_equals_sql(spark, duck, sf, name):
    assert compare(REG.QUERIES[name](spark, sf), duck, REG.ORACLES[name]) == ""


def test_all_operators():
    assert sorted(int(n[2:].split("_")[0]) for n in REG.QUERIES) == list(range(1, 14))


def test_entry_without_the_subpackage(tmp_path):
    """The driver deletes the folders: the entry still gives the other queries."""
    root = Path(__file__).resolve().parents[2]
    code = (
        "import sys\n"
        "class Gone:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name == 'corpus_pipeline' or name.startswith('factorlake.llm'):\n"
        "            raise ModuleNotFoundError(f'No module named {name!r}', name=name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        f"sys.path.insert(0, {str(root)!r})\n"
        "import __spark_entry__ as e\n"
        "assert len(e.queries()) > 200 and not [n for n in e.queries() if n.startswith('op1_')] and 'pipeline' not in e.queries()\n"
    )
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path)
