"""The rest works where the training-data operators are not installed."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

HERE = Path(__file__).resolve().parents[1]


def test_without_training_data(tmp_path):
    shutil.copytree(HERE, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "llm", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 90 and set(e.oracle_sql()) <= set(q) and not any(n.startswith('op') or n == 'pipeline' for n in q)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    for pipeline in (True, False):  # with the pipeline's file left behind, and without it
        if not pipeline:
            (tmp_path / "repo" / "corpus_pipeline.py").unlink()
        subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", env=env, check=True)
