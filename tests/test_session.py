"""The shared folder and the tables written to it."""

import os
from types import SimpleNamespace

import pytest

from visitloom.session import fresh_path, materialize, shared_dir


def session(setting, master="local[2]", app="app-1"):
    made = []
    context = SimpleNamespace(master=master, applicationId=app, setCheckpointDir=made.append)
    return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: setting), sparkContext=context), made


def test_the_setting_of_the_session_is_used():
    spark, made = session("hdfs://host/shared/", "spark://host:1")
    assert shared_dir(spark) == "hdfs://host/shared" and made == []
    assert fresh_path(spark, "x").startswith("hdfs://host/shared/x-")
    assert fresh_path(spark, "x") != fresh_path(spark, "x")


def test_a_cluster_without_the_setting_is_an_error():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(session(None, "yarn")[0])


def test_a_local_session_without_the_setting_gets_one_folder():
    spark, made = session(None, app="app-2")
    folder = shared_dir(spark)
    assert os.path.isdir(folder) and shared_dir(spark) == folder and made == [folder]


def test_a_written_table_reads_no_lineage(spark):
    stored = materialize(spark.range(5).selectExpr("id * 2 as twice"))
    plan = stored._jdf.queryExecution().optimizedPlan().toString()
    assert "Range" not in plan and stored.schema.names == ["twice"] and stored.count() == 5
