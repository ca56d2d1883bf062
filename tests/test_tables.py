"""Tables kept in the shared folder."""

import os
import threading

import pytest

from palimpsest import tables


def there(df):
    return os.path.exists(df.kept_at.removeprefix("file:"))


def test_scratch_deletes_its_own_tables_only(spark):
    df = spark.range(3)
    outside = tables.materialize(df, "outside")
    with tables.scratch(spark) as keep:
        first = tables.materialize(df, "first")
        with tables.scratch(spark) as keep_inner:
            inner, given = tables.materialize(df, "inner"), keep_inner(tables.materialize(df, "given"))
        assert not there(inner) and there(given)
        other = []
        thread = threading.Thread(target=lambda: other.append(tables.materialize(df, "other")))
        thread.start()
        thread.join()
        last = keep(tables.materialize(df, "last"))
        gone = tables.materialize(df, "gone")
        tables.discard(gone, gone, df)
        assert not there(gone)
    assert not there(first) and not there(given) and there(last) and there(outside) and there(other[0])
    assert last.count() == 3
    with pytest.raises(ValueError), tables.scratch(spark):
        failed = tables.materialize(df, "failed")
        raise ValueError
    assert there(failed)  # what a failed job left may be wanted to see why
    tables.discard(outside, last, other[0], failed)


def test_a_cluster_must_name_its_folder(spark):
    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):  # noqa: N802  the name is Spark's
            return None

    class Session:
        conf, sparkContext = {}, Context()  # noqa: N815

    with pytest.raises(RuntimeError, match="checkpoint"):
        tables.shared_dir(Session())
