"""Sharding by a Feistel permutation of global row numbers.

Rows are numbered from 0 in the order of their key, then of their text (rows equal in both are alike, so which of them comes first doesn't matter). The number is split
into two digits of a mixed base, rows and columns of a rectangle that just holds all rows; each round adds a keyed hash of one digit to the other,
which permutes the rectangle. A number that lands beyond the last row walks on along its cycle until it lands inside: rare, since the rectangle has less than one
row to spare. Position v of the shuffle is slot v // shards of shard v % shards, so counts differ by one at most, slots have no gaps, and
both directions can be computed from a number, the count of rows, the seed and the number of shards alone: `place_of` and `row_at`.

Only the key, a digest of the text and what `keep` names go through the numbering's exchange, a range partition by key and digest that a repeated key can't overfill: it
is split by a number that each row has of its own. Numbers of rows before a partition come from one count a partition.

Defined results: null, empty and very long texts, repeated rows and repeated or null keys all get places of their own (null keys first); an empty table gives an empty one; other columns may have any
name, and `shard` and `slot` replace columns of those names. More than 2^31 rows times 2^31 is refused.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, materialize

SHARDS = 16
SEED = 20
ROUNDS = 6
_PART_BITS = 33  # monotonically_increasing_id: partition above, row in it below
_LOW = np.uint64(0xFFFFFFFF)


def _mixed(x: np.ndarray, key: int) -> np.ndarray:
    """A 32-bit hash of numbers below 2^32; all products stay below 2^63."""
    x = (x * np.uint64(1_540_483_477) + np.uint64(key)) & _LOW
    x ^= x >> np.uint64(15)
    x = (x * np.uint64(2_146_121_005)) & _LOW
    x ^= x >> np.uint64(13)
    x = (x * np.uint64(1_103_515_245)) & _LOW
    return x ^ (x >> np.uint64(16))


class Shuffle:
    """A reproducible permutation of range(n), and the shards it is dealt to."""

    def __init__(self, n: int, shards: int = SHARDS, seed: int = SEED):
        self.n, self.shards = n, shards
        self.wide = max(1, math.isqrt(max(0, n - 1)) + 1)
        self.high = max(1, -(-n // self.wide))
        if self.wide >= 1 << 31:
            raise ValueError("too many rows to number")
        self.keys = [(seed * 1_000_003 + r * 7_919_317 + 12_345) % (1 << 31) for r in range(ROUNDS)]

    def _once(self, v: np.ndarray, back: bool) -> np.ndarray:
        digits, sizes = [v // np.uint64(self.wide), v % np.uint64(self.wide)], [np.uint64(self.high), np.uint64(self.wide)]
        for r in range(ROUNDS)[:: -1 if back else 1]:
            one, other, size = r % 2, 1 - r % 2, sizes[r % 2]
            add = _mixed(digits[other], self.keys[r]) % size
            digits[one] = (digits[one] + (size - add if back else add)) % size
        return digits[0] * np.uint64(self.wide) + digits[1]

    def _walk(self, v: np.ndarray, back: bool) -> np.ndarray:
        v = self._once(v.astype(np.uint64), back)
        while len(out := np.flatnonzero(v >= np.uint64(self.n))):
            v[out] = self._once(v[out], back)
        return v.astype(np.int64)

    def place_of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Shard and slot of row numbers."""
        v = self._walk(np.asarray(rows), False)
        return v % self.shards, v // self.shards

    def row_at(self, shard: np.ndarray, slot: np.ndarray) -> np.ndarray:
        """The row numbers at these places, which must exist."""
        return self._walk(np.asarray(slot) * self.shards + np.asarray(shard), True)


def _dealt(shuffle: Shuffle, columns: Sequence[str]):
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard, slot = shuffle.place_of(batch.column("_number").to_numpy())
            yield pa.RecordBatch.from_arrays([*[batch.column(f"c{k}") for k in range(len(columns))], pa.array(shard, pa.int32()), pa.array(slot, pa.int64())], names=[*[f"c{k}" for k in range(len(columns))], "shard", "slot"])

    return deal


def assign_shards(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, keep: Sequence[str | Column] = ("doc_id",), key: str = "doc_id", text: str = "text") -> DataFrame:
    """The columns (or named expressions) `keep` of docs with `shard` and `slot`, a row a row. The exchange carries these alone, so texts stay where they are unless they are kept."""
    spark = docs.sparkSession
    chosen = docs.select(*[F.col(f"`{c}`") if isinstance(c, str) else c for c in keep])
    columns = [c for c in chosen.columns if c not in ("shard", "slot")]
    types = ", ".join(f"c{k} {chosen.schema[c].dataType.simpleString()}" for k, c in enumerate(columns))
    kept = [(F.col(f"`{c}`") if isinstance(c, str) else c) for c in keep]
    kept = [c.alias(f"c{k}") for k, c in enumerate(x for x, name in zip(kept, chosen.columns, strict=True) if name not in ("shard", "slot"))]
    rows = docs.select(F.col(f"`{key}`").alias("_key"), F.md5(as_bytes(text)).alias("_digest"), F.col(f"`{text}`").isNull().alias("_none"), F.monotonically_increasing_id().alias("_own"), *kept)
    order = ["_key", "_digest", "_none", "_own"]
    sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("_key", "_digest", "_none", "_own")
    numbered = materialize(sorted_.withColumn("_place", F.monotonically_increasing_id()), "numbered-rows")
    part = F.shiftright("_place", _PART_BITS)
    counts = {r["part"]: r["n"] for r in numbered.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}  # a row a partition
    before, at = {}, 0
    for p in sorted(counts):
        before[p], at = at, at + counts[p]
    starts = spark.createDataFrame(list(before.items()), "part long, before long")
    number = F.col("before") + F.col("_place").bitwiseAND((1 << _PART_BITS) - 1)
    wide = numbered.withColumn("part", part).join(F.broadcast(starts), "part").select(*[f"c{k}" for k in range(len(columns))], number.alias("_number"))
    out = wide.mapInArrow(_dealt(Shuffle(at, shards, seed), columns), f"{types}{', ' if types else ''}shard int, slot long")
    return out.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(columns)], "shard", "slot")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED) -> None:
    """Write docs as `path`/shard=k, each shard in slot order: whole rows move once to be numbered and once to their shard, which may be of several files."""
    placed = assign_shards(docs, shards, seed, docs.columns)
    placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
