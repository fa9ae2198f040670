"""SimHash near-dedup with covering locality-sensitive hashing.

A document's fingerprint is the bitwise majority of the XXH64 hashes of its word shingles. Fingerprints that differ in at
most ``radius`` bits are linked. Each bit gets a non-zero vector of radius + 1 bits; table v keeps the bits whose
vector has an odd product with v. For any ``radius`` differing bits some v is orthogonal to all their vectors, so the pair agrees
on all bits that table v keeps: no pair is missed, whatever the data. Only distinct fingerprints enter the tables.

A bucket of up to BUCKET fingerprints is compared in its task, and only a spanning set of links leaves it. A larger
bucket never meets in one task: two of its members are within 2 bits exactly if they share a value at most one bit away from both,
so each member is dealt by those values and linked to the least of each (radius 2; the values differ only in bits the table
doesn't keep). Components of the links come from star steps.

Defined results: null or empty text has fingerprint 0, linked like any other; repeated rows and ties share a component; rows
without doc_id take the component of their fingerprint, null if no row with a doc_id is in reach; an empty table gives an empty
result. Other columns of the input are ignored by `near_duplicates` and kept by `keep_one`.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, join_back, materialize, packed, unpacked
from .graph import components

RADIUS = 2
#: Fingerprints of a bucket that one task compares.
BUCKET = 512
_BLOCK = 1 << 16


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """As an unsigned 64-bit number; 0 if there are no words."""
    words = text.lower().split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = list(accumulate((len(w) + 1 for w in words), initial=-1))[1:]
    starts = [0, *(e + 1 for e in ends[:-1])]
    last = ends[min(shingle, len(words)) - 1 :]
    ones, n = np.zeros(64, np.int64), len(last)
    for k in range(0, n, _BLOCK):
        part = [digest(joined[s:e], 42) for s, e in zip(starts[k : k + _BLOCK], last[k : k + _BLOCK], strict=False)]
        bits = np.array(part, "<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(bits, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.fromiter((fingerprint(x.as_py()) for x in batch.column(2)), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(prints.view(np.int64))], names=["doc_id", "row", "fp"])


def covering_masks(radius: int = RADIUS) -> list[int]:
    """2^(radius+1) - 1 masks of 64 bits; the vectors of the bits go round all non-zero ones, so every mask keeps half or more."""
    size = 1 << (radius + 1)
    vector = [1 + i % (size - 1) for i in range(64)]
    return [sum(1 << i for i in range(64) if (vector[i] & v).bit_count() % 2) for v in range(1, size)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _close_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row is a bucket of fingerprints. Out: a forest of links within the radius."""
    for batch in batches:
        left, right = [], []
        for fps in batch.column(0):
            ids = fps.as_py()
            f = np.array(ids, np.int64).view(np.uint64)
            reached = np.zeros(len(f), bool)
            for root in range(len(f)):
                if reached[root]:
                    continue
                reached[root], front = True, [root]
                while front:
                    k = front.pop()
                    near = np.flatnonzero((np.bitwise_count(f ^ f[k]) <= RADIUS) & ~reached)
                    reached[near] = True
                    front.extend(near.tolist())
                    left.extend([ids[k]] * len(near))
                    right.extend(ids[j] for j in near.tolist())
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])


def _links(distinct: DataFrame) -> DataFrame:
    """distinct (fp) -> a, b: fingerprints within the radius; enough of them to span every component."""
    masks = covering_masks()
    tables = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for t, m in enumerate(masks)])
    dealt = distinct.select("fp", F.inline(tables))
    sizes = dealt.groupBy("t", "key").agg(F.count("*").alias("members")).filter("members > 1")
    members = materialize(join_back(dealt, sizes, ["t", "key"]), "buckets")
    small = members.filter(F.col("members") <= BUCKET).groupBy("t", "key").agg(F.collect_list("fp").alias("fps"))
    pairs = small.select("fps").mapInArrow(_close_pairs, "a long, b long")
    free = F.array(*[F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << i)) for i in range(64) if not m >> i & 1]) for m in masks])
    around = members.filter(F.col("members") > BUCKET).select("fp", F.explode(F.element_at(free, F.col("t") + 1)).alias("flip"))
    around = around.select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("value"))
    least = around.groupBy("value").agg(F.min("fp").alias("least"), F.max("fp").alias("most")).filter("least < most").drop("most")
    return pairs.union(join_back(around, least, ["value"]).filter("fp <> least").select("fp", "least"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, row (hash of the text), fp (long), group (least fingerprint reachable), component_id (smallest doc_id reachable)."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(as_bytes()).alias("row"), as_bytes().alias("text"))
    prints = materialize(slim.mapInArrow(_fingerprints, "doc_id long, row long, fp long"), "fingerprints")
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct-fingerprints")
    found = components(_links(distinct.select("fp")))
    groups = distinct.join(found, F.col("fp") == F.col("node"), "left").select("fp", "rep", F.coalesce("component", "fp").alias("least"))
    names = groups.groupBy("least").agg(F.min("rep").alias("component_id"))
    named = join_back(groups.select("fp", "least"), names, ["least"]).select("fp", F.col("least").alias("group"), "component_id")
    return prints.join(named, "fp").select("doc_id", "row", "fp", "group", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """docs, all columns: of each group of near duplicates the row with the smallest doc_id, once."""
    first = near_duplicates(docs).groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")).alias("one"))
    kept = materialize(first.select(F.col("one.doc_id").alias("r_doc"), F.col("one.row").alias("r_row")), "kept")
    left = docs.select(packed(docs).alias("d"), F.col("doc_id").cast("long").alias("l_doc"), F.xxhash64(as_bytes()).alias("l_row"))
    same = F.col("l_doc").eqNullSafe(F.col("r_doc")) & (F.col("l_row") == F.col("r_row"))
    return left.join(kept, same, "left_semi").dropDuplicates(["l_doc", "l_row"]).select(*unpacked("d", docs.columns))
