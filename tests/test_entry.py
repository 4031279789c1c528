"""The driver's entry with and without the training-data part."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).parent.parent
SHOW = "import __spark_entry__ as e; print(len(e.queries()), sorted(n for n in e.queries() if n.startswith('op') or n == 'pipeline'), set(e.oracle_sql()) <= set(e.queries()))"


def shown(folder):
    return subprocess.run([sys.executable, "-c", SHOW], cwd=folder, capture_output=True, text=True, check=True).stdout.split(" ", 1)


@pytest.mark.parametrize("left", ["nothing", "pipeline", "empty folder"])
def test_entry_without_the_part(tmp_path, left):
    shutil.copytree(ROOT / "loomtext", tmp_path / "loomtext", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    if left != "nothing":
        (tmp_path / "corpus_pipeline.py").write_text("from loomtext.llm.common import read\n")
    if left == "empty folder":
        (tmp_path / "loomtext" / "llm" / "__pycache__").mkdir(parents=True)
    n, rest = shown(tmp_path)
    assert int(n) >= 60 and rest.strip() == "[] True"


def test_faults_inside_the_part_are_raised(tmp_path):
    shutil.copytree(ROOT / "loomtext", tmp_path / "loomtext", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    (tmp_path / "loomtext" / "llm").mkdir()
    (tmp_path / "loomtext" / "llm" / "__init__.py").write_text("")
    (tmp_path / "loomtext" / "llm" / "queries.py").write_text("import loomtext.llm.nowhere\n")
    with pytest.raises(subprocess.CalledProcessError):
        shown(tmp_path)
