"""The rest imports and lists its queries when the llm folders are absent."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry_without_llm(tmp_path):
    import shutil

    for name in ("threadlake", "__spark_entry__.py"):
        src = ROOT / name
        if src.is_dir():
            shutil.copytree(src, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(src, tmp_path / name)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'agg02_daily' in q and not any(k.startswith('op') for k in q) and 'pipeline' not in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path), "HOME": str(tmp_path)})


def test_entry_when_a_library_is_missing(tmp_path):
    """A library that only the llm folders need takes no other query with it."""
    import shutil

    shutil.copytree(ROOT / "threadlake", tmp_path / "threadlake", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    (tmp_path / "threadlake/llm").mkdir()
    (tmp_path / "threadlake/llm/__init__.py").write_text("")
    (tmp_path / "threadlake/llm/queries.py").write_text("import a_library_that_is_not_there\n")
    code = "import __spark_entry__ as e; q = e.queries(); assert 'agg02_daily' in q and 'pipeline' not in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path), "HOME": str(tmp_path)})
