"""queries() must load without Spark's jars in the pyspark folder and without a session, and Python
workers must run without the package on their path (driver started from another folder)."""
import subprocess
import sys
import textwrap
from pathlib import Path

REPO = str(Path(__file__).resolve().parent.parent)


def run_elsewhere(tmp_path, body: str) -> str:
    script = tmp_path / "driver.py"
    script.write_text(textwrap.dedent(f"""
        import glob, sys
        real = glob.glob
        glob.glob = lambda p, *a, **k: [] if "jars" in p else real(p, *a, **k)
        sys.path.insert(0, {REPO!r})
        import __spark_entry__ as E
    """) + textwrap.dedent(body))
    import os
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-3000:]
    return done.stdout


def test_queries_load_without_jars_and_without_a_session(tmp_path):
    out = run_elsewhere(tmp_path, """
        import warnings
        warnings.simplefilter("ignore")
        q, o = E.queries(), E.oracle_sql()
        assert "F11_detect_language" in q and "F11_detect_language" not in o
        print("loaded", len(q), len(o))
    """)
    assert out.strip().startswith("loaded")


def test_workers_need_no_package_on_their_path(tmp_path):
    out = run_elsewhere(tmp_path, f"""
        from pyspark.sql import SparkSession
        s = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
             .config("spark.sql.shuffle.partitions", "2").getOrCreate())
        s.sparkContext.setCheckpointDir({str(tmp_path)!r} + "/ckpt")
        assert "F11_detect_language" in E.oracle_sql()
        print("rows", E.queries()["A15_multinomial_nb"](s, "/root/testdata/sf0.001").count())
    """)
    assert int(out.split("rows")[-1]) > 0
