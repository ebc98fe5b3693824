"""Where written tables go."""

from __future__ import annotations

import os
import subprocess
import sys
from types import SimpleNamespace

import pytest

from textmatch.config import materialize, scratch_path, spread

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def stand_in(base, master="local[2]"):
    conf = SimpleNamespace(get=lambda key, default=None: base or default)
    context = SimpleNamespace(master=master, applicationId="app-1")
    return SimpleNamespace(conf=conf, sparkContext=context)


@pytest.fixture(autouse=True)
def no_exit_hooks(monkeypatch):
    monkeypatch.setattr("textmatch.config.atexit.register", lambda *a: None)


def test_scratch_follows_the_setting():
    assert scratch_path(stand_in("/shared/x/"), "t").startswith("/shared/x/textmatch-app-1/t-")


def test_scratch_without_a_setting_is_made_once():
    session = stand_in(None)
    first, second = scratch_path(session, "t"), scratch_path(session, "t")
    assert first != second and os.path.dirname(first) == os.path.dirname(second)


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "local-cluster[3,2,1000]"])
def test_other_sessions_need_a_shared_folder(master):
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch_path(stand_in(None, master), "t")
    assert scratch_path(stand_in("hdfs:///x/", master), "t").startswith("hdfs:///x/textmatch-")


def test_what_was_written_goes_with_the_program(tmp_path):
    code = f"""
from textmatch.config import local_session, materialize
spark = local_session(1, "t", **{{"spark__checkpoint__dir": "{tmp_path}/shared"}})
assert materialize(spark.range(3), "t").count() == 3
import os
assert any(x.startswith("textmatch-") for x in os.listdir("{tmp_path}/shared"))
spark.stop()
"""
    run = subprocess.run(
        [sys.executable, "-c", code], cwd=REPO, capture_output=True, text=True, timeout=120
    )
    assert run.returncode == 0, run.stderr
    assert not any(x.startswith("textmatch-") for x in os.listdir(f"{tmp_path}/shared"))


def test_materialize_keeps_schema_and_rows(spark):
    df = spark.range(5).selectExpr("id", "array(id) AS v")
    out = materialize(df, "t")
    assert out.schema.simpleString() == df.schema.simpleString() and out.count() == 5


def test_spread_only_touches_small_inputs(spark):
    cores = spark.sparkContext.defaultParallelism
    assert spread(spark.range(10).coalesce(1), "id").rdd.getNumPartitions() == cores
    wide = spark.range(0, 100, 1, 3 * cores)
    assert spread(wide, "id") is wide
