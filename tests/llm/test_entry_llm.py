"""Every query of the package is registered, and the entry imports without the package."""

import os
import subprocess
import sys

import __spark_entry__ as E

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_registered():
    names = [n for n in E.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in E.queries() and set(E.oracle_sql()) <= set(E.queries())


def test_entry_without_the_package():
    code = ("import sys; sys.modules['vitrine.llm'] = None\n"
            "import __spark_entry__ as E\n"
            "q = E.queries(); assert len(q) > 80 and not [n for n in q if n.startswith('op1_') or n == 'pipeline']; E.oracle_sql()")
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
