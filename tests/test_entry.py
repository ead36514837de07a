"""The entry works without the training-data subpackage and without the libraries that only it needs."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
SHOW = "import __spark_entry__ as e; q = e.queries(); print(len(q), any(n[:2] in ('p4', 'p9') for n in q), 'p1_found' in q, set(e.oracle_sql()) <= set(q))"


def shown(folder, before=""):
    run = subprocess.run([sys.executable, "-c", before + SHOW], cwd=folder, capture_output=True, text=True, check=True)
    return run.stdout.split()[1:]


def test_entry_without_a_library():
    assert shown(ROOT, "import sys; sys.modules['xxhash'] = None; ") == ["False", "True", "True"]


def test_entry_without_the_subpackage(tmp_path):
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    shutil.copytree(ROOT / "ledgerloom", tmp_path / "ledgerloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    assert shown(tmp_path) == ["False", "True", "True"]
