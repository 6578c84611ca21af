import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent

CODE = """
import __spark_entry__ as e
names = e.queries()
assert "q_avg_by_dim" in names and "pipeline" not in names and not any(n.startswith("op") for n in names), names
assert set(e.oracle_sql()) <= set(names)
"""


def test_the_rest_works_without_the_corpus_operators(tmp_path):
    for name in ("__spark_entry__.py", "lakeweave"):
        (shutil.copytree if (ROOT / name).is_dir() else shutil.copy)(ROOT / name, tmp_path / name)
    shutil.rmtree(tmp_path / "lakeweave/llm", ignore_errors=True)
    done = subprocess.run([sys.executable, "-B", "-c", CODE], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin", "PYTHONPATH": str(tmp_path)})
    assert done.returncode == 0, done.stderr


def test_nothing_else_imports_the_corpus_operators():
    for path in (ROOT / "lakeweave").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "lakeweave.llm" not in path.read_text(), path
