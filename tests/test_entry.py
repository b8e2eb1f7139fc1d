"""The driver's contract, and that nothing but the llm subpackage needs the llm subpackage."""

import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__

ROOT = Path(__file__).resolve().parent.parent


def test_flagship(spark):
    assert __spark_entry__.entry(spark).columns


def test_every_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("pipeline", [False, True])
def test_without_the_subpackage(tmp_path, pipeline):
    """The folders of the subpackage are gone, and corpus_pipeline.py with them or not."""
    (tmp_path / "harrow").mkdir()
    for path in (ROOT / "harrow").iterdir():
        if path.name not in ("llm", "__pycache__"):
            (tmp_path / "harrow" / path.name).symlink_to(path)
    (tmp_path / "__spark_entry__.py").write_text((ROOT / "__spark_entry__.py").read_text())
    if pipeline:
        (tmp_path / "corpus_pipeline.py").write_text((ROOT / "corpus_pipeline.py").read_text())
    code = "import __spark_entry__ as e; assert 'inbox_list' in e.queries() and not any(n.startswith('op') or n == 'pipeline' for n in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
