"""The HDF5 data source, over a stand-in for h5py that keeps datasets in an .npz file."""

import sys

import numpy as np
import pytest

from molquarry.sources import catalog, hdf5

STAND_IN = '''
import numpy as np


class File(dict):
    def __init__(self, path, mode):
        with np.load(path, allow_pickle=False) as held:
            super().__init__({k: held[k] for k in held.files})

    def __enter__(self):
        return self

    def __exit__(self, *args):
        return False
'''


@pytest.fixture(scope="module")
def file(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("h5")
    (folder / "h5py.py").write_text(STAND_IN)
    spark.sparkContext.addPyFile(str(folder / "h5py.py"))
    sys.path.insert(0, str(folder))
    wide = np.zeros(25, [("k", "i8"), ("name", "S5"), ("v", "f4", (3,))])
    wide["k"], wide["name"] = np.arange(25), [f"n{i}".encode() for i in range(25)]
    wide["v"] = np.arange(75).reshape(25, 3)
    np.savez(folder / "t.npz", wide=wide, flat=np.arange(7.0), square=np.arange(6).reshape(3, 2), none=np.empty(0, "i4"))
    yield str(folder / "t.npz")
    sys.path.remove(str(folder))
    sys.modules.pop("h5py", None)


def test_tables_and_ranges(spark, file):
    assert hdf5.table_shapes(file) == {"wide": (25,), "flat": (7,), "square": (3, 2), "none": (0,)}
    rows = catalog.Hdf5Loader(file, "wide").load(spark)
    assert rows.dtypes == [("k", "bigint"), ("name", "string"), ("v", "array<float>")]
    assert {r["k"]: (r["name"], r["v"]) for r in rows.collect()}[4] == ("n4", [12.0, 13.0, 14.0])
    assert [r[0] for r in catalog.Hdf5Loader(file, "wide", ["name"], (3, 5)).load(spark).collect()] == ["n3", "n4"]
    assert catalog.Hdf5Loader(file, "wide", None, (20, 99)).load(spark).count() == 5
    assert sorted(r[0] for r in catalog.Hdf5Loader(file, "flat").load(spark).collect()) == list(range(7))
    assert sorted(r["value"] for r in catalog.Hdf5Loader(file, "square").load(spark).collect()) == [[0, 1], [2, 3], [4, 5]]
    assert catalog.Hdf5Loader(file, "none").load(spark).count() == 0


def test_many_partitions(spark, file):
    spark.dataSource.register(hdf5.Hdf5Source)
    rows = spark.read.format("molquarry_hdf5").option("path", file).option("table", "wide").option("part", 4).option("batch", 3).load()
    assert rows.rdd.getNumPartitions() == 7 and sorted(r["k"] for r in rows.collect()) == list(range(25))
