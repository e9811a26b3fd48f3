"""The entry module without the optional subpackage: in a copy from which its folders are deleted."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
PROBE = ("import __spark_entry__ as e; names = set(e.queries()); "
         "assert 'process_point' in names and set(e.oracle_sql()) <= names; "
         "assert not [n for n in names if n.startswith('op') or n == 'pipeline'], names; print(len(names))")


@pytest.mark.parametrize("pipeline_file", [True, False])
def test_imports_without_the_optional_subpackage(tmp_path, pipeline_file):
    skip = shutil.ignore_patterns("llm", "__pycache__", ".git", *([] if pipeline_file else ["corpus_pipeline.py"]))
    shutil.copytree(ROOT, tmp_path / "copy", ignore=skip)
    done = subprocess.run([sys.executable, "-B", "-c", PROBE], cwd=tmp_path / "copy", capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    assert int(done.stdout.split()[-1]) > 80
