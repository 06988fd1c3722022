import pytest

from locusloom.sources import tables


def test_large_registry_is_not_cut(spark):
    rows = [("hg1", "region", f"/p{i}", f"t{i}") for i in range(1001)]
    registry = spark.createDataFrame(rows, "genome string, analysis string, path string, type string")
    with pytest.raises(ValueError):
        tables.locations(registry, "hg1", "region")
    assert len(tables.locations(registry.where("path != '/p0'"), "hg1", "region")) == 1000
