from __future__ import annotations

from types import SimpleNamespace

import pytest

from tidemark.session import materialized, scratch_path, shared_folder


def session(named, application="app-1", master="local[2]"):
    conf = SimpleNamespace(get=lambda key, default=None: named if key == "spark.checkpoint.dir" else default)
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(applicationId=application, master=master))


def test_the_named_folder_is_used():
    assert shared_folder(session("hdfs://nn/check/")) == "hdfs://nn/check"
    assert scratch_path(session("hdfs://nn/check"), "x").startswith("hdfs://nn/check/x-")


def test_without_one_an_application_keeps_its_choice():
    first = shared_folder(session(None))
    assert shared_folder(session(None)) == first
    assert shared_folder(session(None, "app-2")) != first


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "local-cluster[2,1,1024]"])
def test_a_cluster_has_to_name_one(master):
    with pytest.raises(ValueError, match="shared folder"):
        shared_folder(session(None, "app-3", master))
    assert shared_folder(session("hdfs://nn/x", "app-3", master)) == "hdfs://nn/x"


def test_materialized_frames_read_back_what_was_written(spark):
    df = spark.range(5).selectExpr("id", "cast(null as string) AS note")
    back = materialized(df, "rows")
    assert back.dtypes == df.dtypes and sorted(back.collect()) == sorted(df.collect())
