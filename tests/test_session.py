from types import SimpleNamespace

import pytest

from lectern.session import checkpoint_dir


def session(master, named=None):
    made = []
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: None, setCheckpointDir=made.append, getConf=lambda: SimpleNamespace(get=lambda _: None))
    return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda _, default: named)), made


def test_checkpoints_need_a_shared_folder_on_a_cluster():
    for master in ("local", "local[4]", "local[*]"):
        spark, made = session(master)
        checkpoint_dir(spark)
        assert len(made) == 1
    for master in ("local-cluster[3,2,1024]", "yarn", "spark://host:7077", "k8s://https://host"):
        spark, made = session(master)
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            checkpoint_dir(spark)
        spark, made = session(master, "/shared/folder")
        checkpoint_dir(spark)
        assert made == ["/shared/folder"]
