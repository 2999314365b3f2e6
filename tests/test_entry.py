"""The entry module imports without a session, and its names and twins agree."""

import subprocess
import sys


def test_import_without_session():
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(len(q))"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=__file__.rsplit("/tests/", 1)[0], timeout=120)
    assert out.returncode == 0 and int(out.stdout) > 80, out.stderr


def test_flagship(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["doc_a", "doc_b", "distance", "copies_a", "copies_b"] and df.count() > 0
