"""Folders for intermediate tables."""

import types

import pytest

from isoloom import storage


def test_a_cluster_needs_a_shared_folder():
    conf = types.SimpleNamespace(get=lambda k, d=None: d, set=lambda k, v: None)
    context = types.SimpleNamespace(getConf=lambda: conf, master="spark://host:7077")
    with pytest.raises(ValueError, match="checkpoint"):
        storage.shared_folder(types.SimpleNamespace(sparkContext=context, conf=conf))


def test_folders_go(spark):
    path = storage.shared_folder(spark)
    spark.range(3).write.parquet(path)
    keep, storage._made[:] = storage._made[:-1], [path]
    storage.tidy()
    storage._made.extend(keep)
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        spark.read.parquet(path).count()
