"""SimHash near-dedup with covering tables, widened to a similarity of word shingles: every link is an exact comparison.

A document is the set of its runs of ``shingle`` words (ASCII case folded; a shorter text is one run). Two sets whose Jaccard
similarity reaches the limit are linked. Candidates share a table of the covering masks (`simhash`) of their fingerprints, the bitwise
majority of the set's hashes, which finds every pair within RADIUS bits; pairs of similarity 0.8 differ in 3 to 11 bits as a rule, too far for
covering tables (2^12 - 1 of them for 11 bits), so candidates may also share a band: ROWS of the BANDS * ROWS minhashes of a set; at similarity 0.8 a pair
shares none with probability 1e-5, above it less. Each candidate pair is compared set with set, unless links already join it.

Large buckets are not gathered: in two rounds each member is compared with one leader of each of its buckets (first the one with the least
shingles that no other set has, the centre of a group of copies), and links of near copies settle most buckets so. Pairs of a bucket that are in
different components after that are all compared, but for those that two exact bounds keep below the limit: the shingles no other set has, and the counts of shingles by FOLD cells.

Defined results: texts without words are equal; repeated rows and ties share a component; of a component the smallest doc_id stays, a row without
doc_id only if there is no other; an empty table gives an empty result. Very long texts are whole sets, a batch of them at a time; all columns pass through packed, so any may have the name of one that is
used here; ids are integers, and what can't be cast to one fails the job. Sets are exact up to 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, drop_table, join_back, materialize, packed, pieces, unpacked
from .graph import components
from .simhash import covering_masks

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 16, 3
#: Cells that the shingles of a set are counted in.
FOLD = 64
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9))
_SEEDS = np.random.default_rng(17).integers(0, 1 << 63, (2, BANDS * ROWS), np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of the runs of words, ascending; empty if there are no words."""
    words = text.lower().split()
    size = min(size, len(words))
    if not size:
        return np.empty(0, np.uint64)
    codes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    count = len(words) - size + 1
    h = np.full(count, size, np.uint64)
    for k in range(size):
        h = (h ^ codes[k : k + count]) * _MIX[0]
        h ^= h >> np.uint64(29)
    h *= _MIX[1]
    return np.unique(h ^ h >> np.uint64(32))


def bands(shingle_set: np.ndarray) -> list[int]:
    """A hash for each band of minhashes."""
    if not len(shingle_set):
        return []
    least = np.array([((shingle_set ^ a) * b).min() for a, b in _SEEDS.T], "<u8")
    return [xxhash.xxh64_intdigest(least[k : k + ROWS].tobytes(), k) - (1 << 63) for k in range(0, len(least), ROWS)]


_COVERS = np.array(covering_masks(), np.uint64)


def covers(shingle_set: np.ndarray) -> list[int]:
    """A hash for each covering table of the set's fingerprint."""
    if not len(shingle_set):
        return []
    ones = np.zeros(64, np.int64)
    for k in range(0, len(shingle_set), 1 << 16):
        part = shingle_set[k : k + (1 << 16)].astype("<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    fingerprint = np.packbits(2 * ones > len(shingle_set), bitorder="little").view("<u8")[0]
    return [xxhash.xxh64_intdigest((fingerprint & mask).tobytes(), BANDS * ROWS + k) - (1 << 63) for k, mask in enumerate(_COVERS)]


def _signatures(shingle: int):
    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, keys = [], []
            for x in batch.column(2):
                found = shingles(x.as_py(), shingle)
                nodes.append(xxhash.xxh64_intdigest(found.tobytes()) - (1 << 63))
                keys.append(bands(found) + covers(found))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(nodes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "row", "node", "bands"])

    return signed


def _sets(shingle: int):
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                found = [shingles(x.as_py(), shingle) for x in piece.column(1)]
                folds = [np.bincount((f & np.uint64(FOLD - 1)).astype(np.int64), minlength=FOLD).tolist() for f in found]
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array([f.tobytes() for f in found], pa.binary()), pa.array(folds, pa.list_(pa.int32()))], names=["node", "set", "fold"])

    return made


def _similar(similarity: float):
    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for one, two in zip(batch.column(2), batch.column(3), strict=True):
                a, b = (np.frombuffer(x.as_buffer(), np.uint64) for x in (one, two))
                both = 0
                if min(len(a), len(b)) >= similarity * max(len(a), len(b)) - 1e-9:
                    merged = np.sort(np.concatenate([a, b]), kind="stable")
                    both = int((merged[1:] == merged[:-1]).sum())
                good.append(both >= similarity * (len(a) + len(b) - both) - 1e-9)
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return compared


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in pieces(batch, "set"):
            found = [np.frombuffer(x.as_buffer(), np.int64) for x in piece.column(1)]
            nodes = np.repeat(piece.column(0).to_numpy(), [len(x) for x in found])
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(np.concatenate(found))], names=["node", "token"])


def _measured(sets: DataFrame) -> DataFrame:
    """sets -> node, n: shingles, shared: those that another of the sets has, too."""
    tokens = sets.mapInArrow(_tokens, "node long, token long").groupBy("token").agg(F.min("node").alias("node"), F.max("node").alias("most"))
    alone = tokens.filter("node = most").groupBy("node").agg(F.count("*").alias("alone"))
    sizes = sets.select("node", F.expr("octet_length(set) div 8").alias("n"))
    return sizes.join(alone, "node", "left").select("node", "n", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("shared"))


def _possible(one: str, two: str, similarity: float) -> F.Column:
    """No more shingles than either set shares with anyone can be common to both; whether the similarity could then be reached."""
    both = F.least(F.col(one)["shared"], F.col(two)["shared"])
    return both >= similarity * (F.col(one)["n"] + F.col(two)["n"] - both) - 1e-9


def _folds_near(one: str, two: str, similarity: float) -> F.Column:
    """Sets differ in as many shingles at least as their counts by cell do; whether the similarity could then be reached."""
    apart = F.aggregate(F.zip_with(f"{one}_fold", f"{two}_fold", lambda x, y: F.abs(x - y)), F.lit(0), lambda total, x: total + x)
    return apart * (1 + similarity) <= (1 - similarity) * (F.col(one)["n"] + F.col(two)["n"]) + 1e-6


def _links(members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """members (key, node) of buckets, sets (node, set) -> node, component of those that have a link to a smaller node."""
    links = found = None
    made: list[DataFrame] = []
    measures = materialize(_measured(sets), "near-measures")
    members = materialize(join_back(members, measures, ["node"]), "near-measured")
    drop_table(measures)
    for step in ("centre", "least", "all"):
        named = members.withColumn("component", F.col("node"))
        if found is not None:
            named = join_back(members, found, ["node"], "left").withColumn("component", F.coalesce("component", "node"))
        me = F.struct("node", "n", "shared", "component")
        named = materialize(named.select("key", me.alias("me")), "near-members")
        if found is not None:
            drop_table(found)
        done = [named]
        best = F.max_by("me", F.struct(F.col("me.shared") / F.col("me.n"), F.col("me.node"))) if step == "centre" else F.min("me")
        open_ = named.groupBy("key").agg(best.alias("lead"), F.min("me.component").alias("low"), F.max("me.component").alias("high")).filter("low < high").select("key", "lead")
        open_ = join_back(named, open_, ["key"])
        if step == "all":
            folded = join_back(open_.select("key", "me", F.col("me.node").alias("node")), sets.select("node", "fold"), ["node"])
            left, right = (materialize(folded.select("key", F.col("me").alias(x), F.col("fold").alias(f"{x}_fold")), "near-open") for x in ("me", "lead"))
            done += [left, right]
            same = (F.col("l.key") == F.col("r.key")) & (F.col("me.component") < F.col("lead.component")) & _possible("me", "lead", similarity) & _folds_near("me", "lead", similarity)
            open_ = left.alias("l").join(right.alias("r"), same)
        pairs = open_.filter((F.col("me.component") != F.col("lead.component")) & _possible("me", "lead", similarity))
        pairs = materialize(pairs.select(F.least("me.node", "lead.node").alias("a"), F.greatest("me.node", "lead.node").alias("b")).distinct(), "near-pairs")
        held = join_back(pairs, sets.select(F.col("node").alias("a"), F.col("set").alias("set_a")), ["a"])
        held = join_back(held, sets.select(F.col("node").alias("b"), F.col("set").alias("set_b")), ["b"]).select("a", "b", "set_a", "set_b")
        new = materialize(held.mapInArrow(_similar(similarity), "a long, b long"), "near-links")
        made.append(new)
        for table in (*done, pairs):
            drop_table(table)
        links = new if links is None else links.union(new)
        found = components(links)
    for table in (members, *made):
        drop_table(table)
    return found


def keep_one(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """docs, all columns: of each group of near copies the row with the smallest doc_id, once."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(as_bytes()).alias("row"), as_bytes().alias("text"))
    signed = materialize(slim.mapInArrow(_signatures(shingle), "doc_id long, row long, node long, bands array<long>"), "signatures")
    one = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")).alias("one")
    nodes = materialize(signed.groupBy("node").agg(one, F.any_value("bands").alias("bands")), "near-nodes")
    drop_table(signed)
    dealt = nodes.select("node", F.explode("bands").alias("key"))
    sizes = dealt.groupBy("key").agg(F.count("*").alias("members")).filter("members > 1").select("key")
    members = materialize(join_back(dealt, sizes, ["key"], "left_semi"), "near-buckets")
    wanted = join_back(nodes.select("node", "one"), members.select("node").distinct(), ["node"], "left_semi").select("node", F.col("one.doc_id").alias("w_doc"), F.col("one.row").alias("w_row"))
    texts = slim.join(wanted, F.col("doc_id").eqNullSafe(F.col("w_doc")) & (F.col("row") == F.col("w_row"))).select("node", "text")
    sets = materialize(texts.mapInArrow(_sets(shingle), "node long, set binary, fold array<int>").dropDuplicates(["node"]), "near-sets")
    found = _links(members, sets, similarity)
    grouped = join_back(nodes.select("node", "one"), found, ["node"], "left").groupBy(F.coalesce("component", "node").alias("group"))
    kept = materialize(grouped.agg(F.min("one").alias("one")).select(F.col("one.doc_id").alias("r_doc"), F.col("one.row").alias("r_row")), "kept")
    for table in (nodes, members, sets, found):
        drop_table(table)
    left = docs.select(packed(docs).alias("d"), F.col("doc_id").cast("long").alias("l_doc"), F.xxhash64(as_bytes()).alias("l_row"))
    same = F.col("l_doc").eqNullSafe(F.col("r_doc")) & (F.col("l_row") == F.col("r_row"))
    return left.join(kept, same, "left_semi").dropDuplicates(["l_doc", "l_row"]).select(*unpacked("d", docs.columns))
