import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("gone", [("sievewright/llm", "tests/llm"), ("sievewright/llm", "tests/llm", "corpus_pipeline.py")])
def test_library_stands_without_the_llm_folders(tmp_path, gone):
    copy = str(tmp_path / "copy")
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    for name in gone:
        path = os.path.join(copy, name)
        if os.path.isdir(path):
            shutil.rmtree(path)
        elif os.path.exists(path):
            os.remove(path)
    say = "import __spark_entry__ as e; q = e.queries(); print(len(q), 'pipeline' in q, any(x.startswith('op') for x in q), set(e.oracle_sql()) <= set(q))"
    done = subprocess.run([sys.executable, "-B", "-c", say], cwd=copy, env=os.environ | {"PYTHONPATH": copy}, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    n, *flags = done.stdout.split()
    assert int(n) >= 70 and flags == ["False", "False", "True"]


def test_every_oracle_has_its_query():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
