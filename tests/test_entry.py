import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
COUNT = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(len(q), sum(n.startswith('p') and n[1].isdigit() for n in q))"


def listed(folder, before=""):
    return subprocess.run([sys.executable, "-c", before + COUNT], cwd=folder, capture_output=True, text=True, timeout=120)


def test_without_the_llm_package(tmp_path):
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    shutil.copytree(ROOT / "corpusloom", tmp_path / "corpusloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    done = listed(tmp_path)
    assert done.returncode == 0 and done.stdout.split()[1] == "0" and int(done.stdout.split()[0]) > 50


def test_a_missing_library_is_not_hidden(tmp_path):
    llm = tmp_path / "corpusloom" / "llm"
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    shutil.copytree(ROOT / "corpusloom", tmp_path / "corpusloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    llm.mkdir()
    (llm / "__init__.py").write_text("")
    (llm / "queries.py").write_text("import a_library_that_is_not_there\n")
    done = listed(tmp_path)
    assert done.returncode != 0 and "a_library_that_is_not_there" in done.stderr
