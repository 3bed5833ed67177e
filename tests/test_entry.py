import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF = "/root/testdata/sf0.001"


def test_oracles_belong_to_queries():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) >= 95
    rows = {int(n[1:].split("_")[0]) for n in e.queries() if n[0] == "r"}
    assert rows == set(range(1, 89))


def test_works_without_the_training_data_operators(tmp_path):
    for name in ("__spark_entry__.py", "quizmill"):
        os.symlink(os.path.join(ROOT, name), tmp_path / name) if name.endswith(".py") else subprocess.run(["cp", "-r", os.path.join(ROOT, name), tmp_path / name], check=True)
    os.unlink(tmp_path / "__spark_entry__.py")
    (tmp_path / "__spark_entry__.py").write_text(open(os.path.join(ROOT, "__spark_entry__.py")).read())
    import shutil

    shutil.rmtree(tmp_path / "quizmill" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and not any(n.startswith('op') for n in q); print(len(q))"
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr


@pytest.mark.skipif(not os.path.isdir(SF), reason="the given tables are not here")
def test_entry(spark):
    import __spark_entry__ as e

    out = e.entry(spark)
    assert out.count() > 0 and out.columns[0] == "company_id"
