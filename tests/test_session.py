"""Where intermediate tables go, and models and imputation through it."""

import os
import subprocess
import sys
import tempfile
from pathlib import Path

from panelwright.operators import impute as I
from panelwright.operators import mixed as M
from panelwright.session import build_session, scratch_dir


def fitted(spark):
    """A fit and an imputation of an invented panel."""
    rows = [(f"c{c}", t, float(c + t + (c * 7 + t * 3) % 5), None if (c + t) % 4 == 0 else float(c * t % 3)) for c in range(6) for t in range(5)]
    df = spark.createDataFrame(rows, "country string, year int, y double, z double")
    fit = M.Model(df, "y", ["year"], [M.Level(("country",))]).fit()[""]
    filled = I.impute(df, {"z": ["y"]}, key=["country", "year"], group="country", m=2, cycles=1)
    assert (fit.rows, fit.groups, filled.count(), filled.where("z IS NULL").count()) == (30, 6, 60, 0)


def unstated():
    """In a process of its own, whose Spark has no default settings."""
    spark = build_session("unstated", "2", **{"spark__driver__memory": "1g"})
    assert spark.conf.get("spark.checkpoint.dir", None) is None
    fitted(spark)
    assert scratch_dir(spark) == scratch_dir(spark.newSession())
    assert scratch_dir(spark).startswith(f"file://{tempfile.gettempdir()}/run-")


def test_no_stated_folder(tmp_path):
    """A local session without spark.checkpoint.dir writes to a temporary folder."""
    (tmp_path / "conf").mkdir()
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path / "conf"), "TMPDIR": str(tmp_path), "PYTHONPATH": str(Path(__file__).parents[1])}
    done = subprocess.run([sys.executable, "-c", "from tests.test_session import unstated; unstated()"], env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]


def test_plain_folder_on_a_cluster(spark, monkeypatch):
    """A stated folder without a scheme does under any master."""
    monkeypatch.setattr(type(spark.conf), "get", lambda conf, key, default=None, got=type(spark.conf).get: "/tmp/stated" if key == "spark.checkpoint.dir" else got(conf, key, default))
    monkeypatch.setattr(spark.sparkContext, "master", "spark://somewhere:7077")
    assert scratch_dir(spark) == "file:///tmp/stated"
