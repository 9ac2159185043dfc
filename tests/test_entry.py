import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_flagship(spark):
    import __spark_entry__ as entry

    (row,) = entry.entry(spark).collect()
    assert row.records == 1500 and row.profile is not None
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_it_imports_without_the_training_data_part(tmp_path):
    shutil.copytree(f"{ROOT}/readloom", tmp_path / "readloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not [n for n in q if not n.startswith('q_')]; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})


def test_nothing_else_imports_it():
    for folder, _, names in os.walk(f"{ROOT}/readloom"):
        if os.path.basename(folder) != "llm":
            for n in names:
                if n.endswith(".py"):
                    with open(f"{folder}/{n}") as f:
                        assert "readloom.llm" not in f.read()
