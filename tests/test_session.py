"""The checkpoint folder, and landed layers that can be dropped."""

import types

import pytest

from conftest import SF_SMALL
from marketlens.plans import catalog
from marketlens.session import ensure_checkpoint_dir


def _session(master, folder=None):
    conf = types.SimpleNamespace(get=lambda key, default=None: folder or default)
    made = []
    sc = types.SimpleNamespace(master=master, getCheckpointDir=lambda: None, setCheckpointDir=made.append)
    return types.SimpleNamespace(conf=conf, sparkContext=sc), made


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "k8s://x", "local-cluster[3,2,1024]"])
def test_other_masters_must_name_a_shared_folder(master):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(_session(master)[0])
    session, made = _session(master, "hdfs:///shared")
    assert ensure_checkpoint_dir(session) == "hdfs:///shared" and made == ["hdfs:///shared"]


@pytest.mark.parametrize("master", ["local", "local[8]", "local[*]"])
def test_local_sessions_get_a_scratch_folder(master):
    session, made = _session(master)
    assert [ensure_checkpoint_dir(session)] == made


def test_close_drops_landed_layers(spark):
    m = catalog.marketplace(spark, SF_SMALL)
    assert catalog.marketplace(spark, SF_SMALL) is m
    assert m.raw["orders"].count() > 0
    folder = m._folder
    m.close()
    other = catalog.marketplace(spark, SF_SMALL)
    assert other is not m and other._folder != folder
    with pytest.raises(Exception, match="(?i)not exist|not found|no such"):
        spark.read.parquet(f"{folder}/raw/orders").count()


def test_caches_are_keyed_by_application(spark):
    catalog.marketplace(spark, SF_SMALL)
    assert all(key[0] == spark.sparkContext.applicationId for key in catalog._CACHE if key[1] == SF_SMALL)
