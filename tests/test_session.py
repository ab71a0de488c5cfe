"""Where written tables go."""

from types import SimpleNamespace

import pytest

from crawlgrain import session as S


def session_with(folder, master):
    values = {"spark.checkpoint.dir": folder, "spark.sql.warehouse.dir": "hdfs://x/warehouse"}
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: values.get(key) or default),
                           sparkContext=SimpleNamespace(master=master))


def test_the_clusters_folder_is_used():
    assert S.shared_folder(session_with("hdfs://x/check/", "yarn")) == "hdfs://x/check"
    assert S.shared_folder(session_with("/shared", "local[2]")) == "/shared"
    assert S.shared_folder(session_with(None, "yarn")) == "hdfs://x/warehouse/_scratch"


def test_no_operator_keeps_tables_in_memory():
    import pathlib

    folder = pathlib.Path(S.__file__).parent
    assert not [p for p in folder.rglob("*.py") if ".persist(" in p.read_text() or ".cache(" in p.read_text() or "localCheckpoint" in p.read_text()]


def test_excluded_rules_of_the_caller_stay(spark):
    key, rule = S.EXCLUDED_RULES, "org.apache.spark.sql.catalyst.optimizer.PruneFilters"
    old = spark.conf.get(key)
    try:
        spark.conf.set(key, rule)
        S.configure(spark)
        S.configure(spark)
        assert spark.conf.get(key).split(",") == [rule, S.RUNTIME_SETTINGS[key]]
    finally:
        spark.conf.set(key, old)


@pytest.mark.parametrize("folder, master, local", [
    ("file:/x/_scratch", "spark://a:7077", True), ("/x", "yarn", True), ("hdfs://n/x", "yarn", False), ("s3a://b/x", "k8s://h", False),
    ("file:/x", "local[4]", False), ("file:/x", "local-cluster[2,1,1024]", False)])
def test_folders_that_executors_may_not_see(folder, master, local):
    assert S.is_machine_local(folder, master) == local
