import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
LIST = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q); print(len(q), any(n.startswith('op') or n == 'pipeline' for n in q))"


@pytest.mark.parametrize("without_pipeline", [False, True])
def test_entry_imports_without_the_training_data_folders(tmp_path, without_pipeline):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__"))
    for folder in ("panelyard/llm", "tests/llm"):
        shutil.rmtree(copy / folder, ignore_errors=True)
    if without_pipeline:
        (copy / "corpus_pipeline.py").unlink(missing_ok=True)
    done = subprocess.run([sys.executable, "-c", LIST], cwd=copy, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    n, others = done.stdout.split()
    assert int(n) > 150 and others == "False"
