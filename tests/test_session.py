from pathlib import Path
from types import SimpleNamespace

import pytest

from chainweft import session


def test_written_tables_are_released(spark):
    tables = session.WrittenTables(spark, "some")
    session.release(spark)
    tables = session.WrittenTables(spark, "some")
    df, path = tables.write(spark.range(5))
    assert df.count() == 5 and Path(path.removeprefix("file://")).exists()
    session.release(spark)
    assert not Path(tables.root.removeprefix("file://")).exists()


def test_a_cluster_needs_a_shared_folder():
    fake = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://somewhere:7077"))
    with pytest.raises(RuntimeError):
        session.shared_dir(fake)
