"""The shuffle is a permutation that can be computed both ways; shards are even, and nothing of the layout shows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from revlens.llm import sharding

from .conftest import doc, prose


@pytest.mark.parametrize("n", [1, 2, 3, 7, 16, 17, 100, 1001, 4096, 99_991])
@pytest.mark.parametrize("seed", [0, 20])
def test_permutation_and_back(n, seed):
    shuffle = sharding.Shuffle(n, 16, seed)
    shard, slot = shuffle.place_of(np.arange(n))
    assert len(set(zip(shard.tolist(), slot.tolist(), strict=True))) == n and shard.max() < 16
    counts = np.bincount(shard, minlength=16)
    assert counts.max() - counts.min() <= 1 and all(sorted(slot[shard == s]) == list(range(counts[s])) for s in range(16))
    assert (shuffle.row_at(shard, slot) == np.arange(n)).all()


def test_large_numbers_and_spread():
    shuffle = sharding.Shuffle(10**15, 1000)
    rows = np.array([0, 1, 2, 10**15 - 1, 10**14])
    shard, slot = shuffle.place_of(rows)
    assert (shuffle.row_at(shard, slot) == rows).all() and len(set(slot.tolist())) == 5
    shard, slot = sharding.Shuffle(100_000, 16).place_of(np.arange(100_000))
    place = slot * 16 + shard
    assert abs(np.corrcoef(np.arange(100_000), place)[0, 1]) < 0.02  # order is gone
    assert abs((np.diff(place) > 0).mean() - 0.5) < 0.01
    assert (sharding.Shuffle(100_000, 16, 1).place_of(np.arange(100_000))[1] != slot).mean() > 0.9
    with pytest.raises(ValueError, match="too many"):
        sharding.Shuffle(1 << 63)


def test_rows_of_a_table(make_docs, edge_rows):
    rows = edge_rows + [doc(500, prose(1, 9))] * 300 + [doc(k, None) for k in range(600, 700)]
    docs = make_docs(rows).withColumn("shard", F.lit("mine"))
    got = sharding.assign_shards(docs, 8, keep=["doc_id", F.length("text").alias("size"), "shard", "row"])
    assert got.columns == ["doc_id", "size", "row", "shard", "slot"]
    one = sorted(map(tuple, got.collect()), key=repr)
    places = [r[3:] for r in one]
    assert len(one) == len(rows) == len(set(places)) and sorted(set(p[0] for p in places)) == list(range(8))
    assert all(sorted(s for k, s in places if k == shard) == list(range(sum(k == shard for k, _ in places))) for shard in range(8))
    for other in (docs.repartition(7), docs.orderBy(F.desc("doc_id")).coalesce(1)):
        assert sorted(map(tuple, sharding.assign_shards(other, 8, keep=["doc_id", F.length("text").alias("size"), "row"]).collect()), key=repr) == one
    numbers = sharding.Shuffle(len(rows), 8).row_at(*np.array(places).T)
    by_number = [r[0] for _, r in sorted(zip(numbers.tolist(), one, strict=True))]
    assert by_number == sorted((r[0] for r in rows), key=lambda k: (k is not None, k or 0))
    assert sharding.assign_shards(make_docs([])).count() == 0


def test_written_shards_are_read_in_slot_order(spark, make_docs, tmp_path):
    docs = make_docs([doc(k, prose(k, 5)) for k in range(203)])
    sharding.write_shards(docs, str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(back.drop("shard", "slot").columns) == sorted(docs.columns)
    want = {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.assign_shards(docs, 4).collect()}
    assert {r["doc_id"]: (r["shard"], r["slot"]) for r in back.collect()} == want
    assert {r["doc_id"]: r["text"] for r in back.collect()} == {k: prose(k, 5) for k in range(203)}
