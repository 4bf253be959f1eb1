"""The entry points without the folders that may be deleted."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _keys(folder):
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), sum(k.startswith(('op', 'pipeline')) for k in e.queries()))"
    return tuple(map(int, subprocess.run([sys.executable, "-c", code], cwd=folder, check=True, capture_output=True, text=True).stdout.split()))


def test_queries_without_the_deleted_folders(tmp_path):
    for drop in (("tidemark/llm", "corpus_pipeline.py"), ("tidemark/llm",), ("corpus_pipeline.py",)):
        folder = tmp_path / str(len(list(tmp_path.iterdir())))
        folder.mkdir()
        for name in ("__spark_entry__.py", "corpus_pipeline.py"):
            if name not in drop and os.path.exists(f"{ROOT}/{name}"):
                shutil.copy(f"{ROOT}/{name}", folder)
        leave_out = shutil.ignore_patterns("__pycache__", *(["llm"] if "tidemark/llm" in drop else []))
        shutil.copytree(f"{ROOT}/tidemark", folder / "tidemark", ignore=leave_out)
        every, oracles, dealt = _keys(folder)
        assert every >= oracles > 0
        if "tidemark/llm" in drop:
            assert dealt == 0
