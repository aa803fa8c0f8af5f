import os

import pytest

from attesta import session


def test_tables_are_written_forgotten_and_released(spark):
    rows = spark.createDataFrame([(1, ["a"], {"k": 2})], "id long, words array<string>, m map<string,int>")
    a, b = session.settle(rows), session.settle(rows)
    assert a.collect() == rows.collect() and a.schema == rows.schema
    folders = [f._folder.removeprefix("file:") for f in (a, b)]
    assert all(map(os.path.isdir, folders))
    session.forget(a)
    assert [os.path.isdir(f) for f in folders] == [False, True] and b.count() == 1
    session.release(spark)
    assert not os.path.isdir(folders[1]) and not session._written


def test_an_empty_table_keeps_its_columns(spark):
    empty = session.settle(spark.createDataFrame([], "a long, b string"))
    assert empty.columns == ["a", "b"] and empty.count() == 0


@pytest.mark.parametrize(("master", "fine"), [("local[4]", True), ("local-cluster[3,2,1024]", False), ("yarn", False), ("spark://h:7077", False)])
def test_a_cluster_needs_a_shared_folder(master, fine):
    class Context:
        def __init__(self):
            self.master, self.folder = master, None

        def getCheckpointDir(self):
            return self.folder

        def setCheckpointDir(self, folder):
            self.folder = folder

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default):
                return default

    if fine:
        assert session.shared_folder(Session()) == session.shared_folder(Session())
    else:
        with pytest.raises(RuntimeError):
            session.shared_folder(Session())
