import os
import subprocess
import sys

import pytest

from textloom.llm import store


def test_scopes_delete_all_but_what_is_kept(spark):
    with store.Scope(spark) as s:
        s.table(spark.range(3))
        kept = s.keep(spark.range(4))
    root = s.root.removeprefix("file:")
    assert not os.path.exists(root) and kept.count() == 4
    with pytest.raises(ZeroDivisionError), store.Scope(spark) as failed:
        failed.keep(spark.range(2))
        1 / 0
    assert not os.path.exists(failed.kept.removeprefix("file:"))
    store.drop_results(spark)
    assert not os.path.exists(s.kept.removeprefix("file:"))


def test_a_missing_library_is_no_missing_subpackage(tmp_path):
    """Only the subpackage itself may be absent; an import that fails inside it shows."""
    here = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    (tmp_path / "zstandard.py").write_text("raise ImportError('not installed')")
    run = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=here, env={**os.environ, "PYTHONPATH": f"{tmp_path}:{here}"}, capture_output=True, text=True)
    assert run.returncode and "not installed" in run.stderr
