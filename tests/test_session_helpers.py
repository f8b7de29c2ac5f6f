import pytest

from revlens import session
from revlens.session import checkpoint_dir, materialize


def test_materialize_round_trip(spark):
    df = spark.range(10)
    back = materialize(df, "t")
    assert back.count() == 10 and back.dtypes == df.dtypes and checkpoint_dir(spark)


class _NoSharedFolder:
    """A session on a cluster master without spark.checkpoint.dir."""

    class sparkContext:  # noqa: N801
        master = "yarn"

        @staticmethod
        def getConf():
            return {}

    class conf:  # noqa: N801
        @staticmethod
        def get(key, default=None):
            return default


def test_cluster_without_shared_folder_raises():
    with pytest.raises(ValueError):
        session.ensure_checkpoint_dir(_NoSharedFolder())
