"""Written stages: where they go, when they are made anew, and that they are removed."""

import os

import pytest

from conftest import SMALL_TABLES

from queuelens.plans.workspace import star_schema_workspace
from queuelens.session import remove_path, shared_dir


class Conf:
    def __init__(self, **settings):
        self.settings = {k.replace("_", "."): v for k, v in settings.items()}

    def get(self, key, default=None):
        return self.settings.get(key, default)


class Session:
    """What ``shared_dir`` asks a session for."""

    def __init__(self, master="local[4]", **settings):
        self.conf = Conf(**settings)
        self.sparkContext = type("Context", (), {"applicationId": "app-1", "master": master})


def test_the_shared_folder():
    both = Session(spark_checkpoint_dir="store:/shared/", spark_sql_warehouse_dir="file:/w")
    assert shared_dir(both) == "store:/shared/queuelens-app-1"
    assert shared_dir(Session(spark_sql_warehouse_dir="file:/w/")) == "file:/w/stages/queuelens-app-1"
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]", "k8s://host"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_dir(Session(master, spark_sql_warehouse_dir="file:/w"))
        assert shared_dir(Session(master, spark_checkpoint_dir="s:/c")) == "s:/c/queuelens-app-1"


def copy_tables(spark, folder, orders):
    for name in ("orders", "customer"):
        table = spark.read.parquet(f"{SMALL_TABLES}/{name}.parquet")
        rows = table.filter(orders) if name == "orders" else table
        rows.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


def test_replaced_tables_are_read_again(spark, tmp_path):
    folder = str(tmp_path)
    copy_tables(spark, folder, "o_orderkey % 2 = 0")
    first = star_schema_workspace(spark, folder)
    even = first.tickets.count()
    assert star_schema_workspace(spark, folder) is first
    copy_tables(spark, folder, "o_orderkey % 10 = 0")
    second = star_schema_workspace(spark, folder)
    assert second is not first and 0 < second.tickets.count() < even / 3
    assert not os.path.exists(first.folder)


def test_closing_removes_the_stages(spark, tmp_path):
    copy_tables(spark, str(tmp_path), "o_orderkey < 50")
    ws = star_schema_workspace(spark, str(tmp_path))
    before = ws.tickets.count()
    stages = f"{ws.folder}/stages"
    assert os.path.exists(stages)
    ws.close()
    assert not os.path.exists(stages)
    # made anew when asked for again
    assert ws.tickets.count() == before
    remove_path(spark, ws.folder)
