import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
CODE = """
import __spark_entry__ as e
names = set(e.queries())
assert names == set(e.base.QUERIES) and set(e.oracle_sql()) <= names
import sys
assert not [m for m in sys.modules if m.startswith(("chanspark.llm", "corpus_pipeline"))]
"""


@pytest.mark.parametrize("with_pipeline", [True, False])
def test_contract_without_the_training_operators(tmp_path, with_pipeline):
    """The rest stands when the subpackage is deleted, with corpus_pipeline.py or without it."""
    shutil.copytree(ROOT / "chanspark", tmp_path / "chanspark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ["__spark_entry__.py", *["corpus_pipeline.py"] * with_pipeline]:
        if (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path)
    done = subprocess.run([sys.executable, "-c", CODE], cwd=tmp_path, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"}, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
