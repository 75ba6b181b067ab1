"""The general read builder."""

import pytest
from pyspark.sql import functions as F

from larkspur.operators import reads


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(1, "a", None), (2, "b", 5), (3, "a", 7)], "id long, kind string, n long")


def test_match_and_in(spark, rows):
    assert [r["id"] for r in reads.match(rows, {"kind": "a", "n": None}).collect()] == [1]
    assert reads.match(rows, {}).count() == 3
    assert sorted(r["id"] for r in reads.is_in(rows, "id", [3, 3, None, 2]).collect()) == [2, 3]
    assert reads.is_in(rows, "id", spark.createDataFrame([(1,), (9,)], "x long")).count() == 1
    assert [r["id"] for r in reads.page(rows, [F.desc("id")], 1, F.col("kind") == "a").collect()] == [3]


def test_cardinality(rows):
    assert reads.single(rows.where("id = 2"))["kind"] == "b"
    assert reads.maybe_single(rows.where("id = 9")) is None
    for wrong, ask in ((rows, reads.maybe_single), (rows.where("id = 9"), reads.single)):
        with pytest.raises(ValueError):
            ask(wrong)


def test_files_by_key(spark, tmp_path):
    for name in ("a/one.pdf", "a/two.pdf", "b/three.pdf"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(name.encode())
    catalogue = spark.createDataFrame([("a/one.pdf",), ("b/three.pdf",), ("../x.pdf",)], "key string")
    got = {r["key"]: bytes(r["content"]) for r in reads.files(spark, str(tmp_path), catalogue).collect()}
    assert got == {"a/one.pdf": b"a/one.pdf", "b/three.pdf": b"b/three.pdf"}
