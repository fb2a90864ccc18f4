"""The library without its optional folders."""

import shutil
import subprocess
import sys
from pathlib import Path


def test_entry_without_the_subpackage(tmp_path):
    top = Path(__file__).resolve().parent.parent
    shutil.copy(top / "__spark_entry__.py", tmp_path)
    shutil.copytree(top / "helixframe", tmp_path / "helixframe", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; from helixframe import plans; assert set(e.queries()) == set(plans.QUERIES) and set(e.oracle_sql()) == set(plans.ORACLES)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)


def test_nothing_else_imports_it():
    top = Path(__file__).resolve().parent.parent / "helixframe"
    assert not [p for p in top.rglob("*.py") if "llm" not in p.parts and "helixframe.llm" in p.read_text()]
