import pytest

from tessera.llm import common


@pytest.fixture
def resplit(spark, monkeypatch):
    """A function after which the first table that is settled changes how all later reads split files.

    Spark splits files by the cores there are when they are read, so a lost executor has this effect.
    """
    settle, key = common.settle, "spark.sql.files.maxPartitionBytes"

    def settled(*args):
        out = settle(*args)
        spark.conf.set(key, "64k")
        return out

    monkeypatch.setattr(common, "settle", settled)
    yield lambda: spark.conf.unset(key)
    spark.conf.unset(key)
