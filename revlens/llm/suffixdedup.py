"""Removal of byte strings that occur more than once, with sampled suffix arrays.

Of every LENGTH-byte window the 32-byte gram with the least hash is its anchor; equal windows have it at the same
place, so only windows that share an anchor's gram can be equal, and about one byte in 85 anchors a run of windows. A gram that occurs
once clears its windows. Of the others every distinct context (the bytes that an anchor's windows cover) is cut from one text that holds it, with the
number of times it occurs. The contexts meet by gram; two suffix arrays a group (from the anchor onwards, and backwards from it) are sorted by deep-shallow
sorting, and their common prefixes tell for every offset which windows are equal. What is decided about a context holds wherever it occurs. A gram
with more than GROUP distinct contexts (the edge of a passage that very many documents hold) is never gathered. Its windows are narrowed down by 128-bit
hashes: for CHUNK offsets from the anchor at a time, what their windows have in common and what they cover together are counted; a common part that has one cover
clears or condemns the chunk as a whole, and only the windows of the other chunks are counted one by one.

Defined results: null text is empty; texts below LENGTH bytes lose nothing; every row counts as a document, so a repeated row loses
all that has LENGTH bytes; an empty table gives an empty result. Contexts are told apart by 128 bits (their gram's hash and their own); rows
of one doc_id, or of none, are told apart by 64-bit hashes of their texts. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, drop_table, join_back, materialize
from .suffixsort import deep_shallow_order

LENGTH, GRAM = 200, 32
SPAN = LENGTH - GRAM + 1
#: Contexts of one gram that may meet in a task.
GROUP = 4096
#: Offsets that are narrowed down together where they may not.
CHUNK = 8
_BLOCK = 1 << 18
_LOW = np.uint64((1 << 20) - 1)
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)]
_SHIFT = [np.uint64(x) for x in (29, 32, 29, 32)]


def _gram_hashes(text: bytes) -> np.ndarray:
    """A hash of the GRAM bytes at every place."""
    padded, n = text + bytes(8), len(text)
    words = np.empty((n + 7) // 8 * 8, np.uint64)
    for k in range(8):
        part = np.frombuffer(padded, "<u8", (len(padded) - k) // 8, k)
        slot = words[k::8]
        slot[: len(part)] = part[: len(slot)]
    count = n - GRAM + 1
    h = np.zeros(count, np.uint64)
    for k, (mix, shift) in enumerate(zip(_MIX, _SHIFT, strict=True)):
        h += words[8 * k : 8 * k + count]
        h *= mix
        h ^= h >> shift
    return h


def _block_anchors(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    h = _gram_hashes(text)
    low = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)  # the first of equal grams is the least
    step = 1
    while step * 2 <= SPAN:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    rest = SPAN - step
    if rest:
        low = np.minimum(low[:-rest], low[rest:])
    at = (low & _LOW).astype(np.int64)
    first = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1])
    last = np.concatenate([first[1:] - 1, [len(at) - 1]])
    return at[first], first, last, h[at[first]]


def anchors(text: bytes) -> Iterator[tuple[int, int, int, int]]:
    """(anchor, first window, last window, gram's hash): runs of windows that share an anchor, in order."""
    for start in range(0, len(text) - LENGTH + 1, _BLOCK):
        part = text if len(text) <= _BLOCK + LENGTH - 1 else text[start : start + _BLOCK + LENGTH - 1]
        at, first, last, keys = _block_anchors(part)
        yield from zip((at + start).tolist(), (first + start).tolist(), (last + start).tolist(), keys.view(np.int64).tolist(), strict=True)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _pack(first: int, last: int, anchor: int) -> int:
    return first << 16 | (last - first) << 8 | anchor - first


def _unpack(place: int) -> tuple[int, int, int]:
    """first window, windows - 1, anchor - first window"""
    return place >> 16, place >> 8 & 255, place & 255


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A few rows at a time, so that what Python holds of them stays small."""
    return (batch.slice(k, 256) for batch in batches for k in range(0, max(1, batch.num_rows), 256))


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    digest = xxhash.xxh64_intdigest
    for batch in batches:
        for piece in (batch.slice(k, 256) for k in range(0, batch.num_rows, 256)):
            docs, tags, places, keys, contexts = [], [], [], [], []
            for doc, tag, text in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), piece.column(2), strict=True):
                text = text.as_py()
                for at, first, last, key in anchors(text):
                    docs.append(doc)
                    tags.append(tag)
                    places.append(_pack(first, last, at))
                    keys.append(key)
                    contexts.append(_signed(digest(text[first : last + LENGTH], (at - first) << 8 | last - first)))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (docs, tags, places, keys, contexts)], names=["doc_id", "tag", "place", "gram", "context"])


def _cut_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in _slices(batches):
        out: list[tuple] = []
        for text, picks in zip(piece.column(0), piece.column(1).to_pylist(), strict=True):
            text = text.as_py()
            for p in picks:
                first, more, before = _unpack(p["place"])
                out.append((p["gram"], p["context"], before, more, p["times"], p["large"], text[first : first + more + LENGTH]))
        types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.binary())
        columns = zip(*out, strict=True) if out else [[] for _ in types]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["gram", "context", "before", "more", "times", "large", "bytes"])


def _neighbours(strings: list[bytes], order: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Common prefix of each string with the one before it in the order; -1 where the group changes."""
    sizes = np.fromiter(map(len, strings), np.int64, len(strings))
    width = int(sizes.max()) + 1
    table = np.frombuffer(b"".join(s.ljust(width, b"\0") for s in strings), np.uint8).reshape(-1, width)[order]
    differ = table[1:] != table[:-1]
    prefix = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    prefix = np.minimum(prefix, np.minimum(sizes[order][1:], sizes[order][:-1]))
    return np.where(group[order][1:] == group[order][:-1], prefix, -1)


def _classes(order: np.ndarray, prefix: np.ndarray, depth: int) -> np.ndarray:
    """Equal numbers for strings of a group that agree in `depth` bytes."""
    out = np.zeros(len(order), np.int64)
    out[order[1:]] = np.cumsum(prefix < depth)
    return out


def repeated_windows(group: list[int], before: list[int], more: list[int], times: list[int], contexts: list[bytes]) -> np.ndarray:
    """For each context and each offset back from the anchor: does the window that starts there occur twice or more? Contexts of a group are
    consecutive; before: anchor - first window; more: windows - 1; times: how often the context occurs."""
    m = len(contexts)
    number, top = np.array(group), np.array(before)
    least, weight = top - np.array(more), np.array(times)
    edges = [0, *(np.flatnonzero(number[1:] != number[:-1]) + 1).tolist(), m]
    onwards = [c[b:] for c, b in zip(contexts, before, strict=True)]
    backwards = [c[:b][::-1] for c, b in zip(contexts, before, strict=True)]
    sorted_both = []
    for strings, shared in ((onwards, GRAM), (backwards, 0)):
        order = np.array([k for a, b in zip(edges, edges[1:], strict=False) for k in deep_shallow_order(strings, range(a, b), shared)])
        sorted_both.append((order, _neighbours(strings, order, number)))
    found = np.zeros((m, SPAN), bool)
    for offset in range(int(least.min()), int(top.max()) + 1):
        here = np.flatnonzero((least <= offset) & (offset <= top))
        if not len(here):
            continue
        code = _classes(*sorted_both[0], LENGTH - offset)[here] * (m + 1) + _classes(*sorted_both[1], offset)[here]
        _, inverse = np.unique(code, return_inverse=True)
        found[here, offset] = np.bincount(inverse, weights=weight[here])[inverse] >= 2
    return found


_RUNS = "gram long, context long, low int, high int"


def _runs(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in range(4)]
    types = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["gram", "context", "low", "high"])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts sorted by gram; whole groups are compared, many at a time. Out: runs of offsets back from the anchor whose windows are repeated."""

    def settle(rows: list[tuple]) -> pa.RecordBatch:
        group, context, before, more, times, texts = zip(*rows, strict=True)
        found = repeated_windows(list(group), list(before), list(more), list(times), list(texts))
        out: list[tuple] = []
        for k in np.flatnonzero(found.any(axis=1)).tolist():
            offsets = np.flatnonzero(found[k])
            for run in np.split(offsets, np.flatnonzero(np.diff(offsets) > 1) + 1):
                out.append((group[k], context[k], int(run[0]), int(run[-1])))
        return _runs(out)

    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("gram", "context", "before", "more", "times", "bytes")), strict=True):
            if len(held) >= GROUP and row[0] != held[-1][0]:
                yield settle(held)
                held = []
            held.append(row)
    if held:
        yield settle(held)


def _hash(data: bytes, seed: int) -> tuple[int, int]:
    h = xxhash.xxh3_128_intdigest(data, seed)
    return _signed(h >> 64), _signed(h & (1 << 64) - 1)


_CHUNKS, _WINDOWS = "gram context chunk times i1 i2 u1 u2 low high", "gram context offset times h1 h2"


def _longs(names: str) -> str:
    return ", ".join(f"{c} long" for c in names.split())


def _batch(rows: list[tuple], names: str) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in names.split()]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names.split())


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each chunk of a context's offsets: the hashes of the part common to all windows at such offsets, and of what the context's own
    windows there cover."""
    for batch in batches:
        for piece in (batch.slice(k, 256) for k in range(0, batch.num_rows, 256)):
            out: list[tuple] = []
            for gram, name, before, more, times, context in zip(*(piece.column(c).to_pylist() for c in ("gram", "context", "before", "more", "times", "bytes")), strict=True):
                for j in range((before - more) // CHUNK, before // CHUNK + 1):
                    low, high = max(CHUNK * j, before - more), min(CHUNK * j + CHUNK - 1, before)
                    common = context[before - CHUNK * j : before - CHUNK * j - CHUNK + 1 + LENGTH]
                    cover = context[before - high : before - low + LENGTH]
                    out.append((gram, name, j, times, *_hash(common, j), *_hash(cover, (low << 8 | high) + 1), low, high))
            yield _batch(out, _CHUNKS)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each window of the chunks asked for."""
    for batch in batches:
        for piece in (batch.slice(k, 256) for k in range(0, batch.num_rows, 256)):
            out: list[tuple] = []
            for gram, name, before, more, context, parts in zip(*(piece.column(c).to_pylist() for c in ("gram", "context", "before", "more", "bytes", "parts")), strict=True):
                for part in parts:
                    j = part["chunk"]
                    for offset in range(max(CHUNK * j, before - more), min(CHUNK * j + CHUNK - 1, before) + 1):
                        out.append((gram, name, offset, part["times"], *_hash(context[before - offset : before - offset + LENGTH], 0)))
            yield _batch(out, _WINDOWS)


def _narrowed(contexts: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """contexts that are too many to meet -> (runs of offsets whose windows are repeated, the tables to drop afterwards)."""
    chunks = materialize(contexts.mapInArrow(_chunks, _longs(_CHUNKS)), "chunks")
    covers = materialize(chunks.groupBy("i1", "i2", "u1", "u2").agg(F.sum("times").alias("times"), F.min(F.struct("gram", "context", "chunk")).alias("one")), "covers")
    twice = covers.filter("times > 1").select("u1", "u2")
    whole = join_back(chunks, twice, ["u1", "u2"], "left_semi").select("gram", "context", F.col("low").cast("int"), F.col("high").cast("int"))
    several = covers.groupBy("i1", "i2").agg(F.count("*").alias("covers")).filter("covers > 1").select("i1", "i2")
    open_ = join_back(covers, several, ["i1", "i2"], "left_semi").select("one.gram", "one.context", F.struct(F.col("one.chunk").alias("chunk"), "times").alias("part"))
    asked = open_.groupBy("gram", "context").agg(F.collect_list("part").alias("parts"))
    windows = materialize(join_back(contexts, asked, ["gram", "context"]).select("gram", "context", "before", "more", "bytes", "parts").mapInArrow(_windows, _longs(_WINDOWS)), "windows")
    again = windows.groupBy("h1", "h2").agg(F.sum("times").alias("all")).filter("all > 1").drop("all")
    single = join_back(windows, again, ["h1", "h2"], "left_semi").select("gram", "context", F.col("offset").cast("int").alias("low"), F.col("offset").cast("int").alias("high"))
    return whole.union(single), [chunks, covers, windows]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of covered bytes."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in _slices(batches):
        out: list[tuple] = []
        for doc, text, spans in zip(piece.column(0).to_pylist(), piece.column(1), piece.column(2).to_pylist(), strict=True):
            text = text.as_py()
            runs = merged([(s["start"], s["stop"]) for s in spans or ()])
            kept, at = [], 0
            for a, b in runs:
                kept.append(text[at:a])
                at = b
            rest = b"".join([*kept, text[at:]])
            out.append((doc, len(text), len(text) - len(rest), [{"start": a, "stop": b} for a, b in runs], hashlib.sha256(rest).hexdigest()))
        run = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        types = (pa.int64(), pa.int64(), pa.int64(), run, pa.string())
        columns = zip(*out, strict=True) if out else [[] for _ in types]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "n_bytes", "n_removed", "removed", "kept_sha256"])


def _numbered(docs: DataFrame) -> DataFrame:
    """The tag, a 64-bit hash of the text, tells apart rows that share a doc_id (or have none) but not the text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(as_bytes()).alias("tag"), as_bytes().alias("text"))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """doc_id, tag, spans: array<struct<start, stop>> (they may overlap), for documents that hold repeated windows. Written when this returns;
    the tables on the way there are gone again."""
    found = materialize(_numbered(docs).mapInArrow(_anchor_rows, "doc_id long, tag long, place long, gram long, context long"), "anchors")
    again = found.groupBy("gram").agg(F.count("*").alias("all")).filter("all > 1").select("gram")
    rows = materialize(join_back(found, again, ["gram"], "left_semi"), "repeated-anchors")
    drop_table(found)
    distinct = materialize(rows.groupBy("gram", "context").agg(F.min(F.struct("doc_id", "tag", "place")).alias("one"), F.count("*").alias("times")), "distinct-contexts")
    large = distinct.groupBy("gram").agg((F.count("*") > GROUP).alias("large"))
    picks = join_back(distinct, large, ["gram"]).select("one.doc_id", "one.tag", F.struct("one.place", "gram", "context", "times", "large").alias("pick"))
    by_doc = picks.groupBy(F.col("doc_id").alias("_doc"), F.col("tag").alias("_tag")).agg(F.collect_list("pick").alias("picks"))
    cut = _numbered(docs).join(by_doc, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("tag") == F.col("_tag"))).select("text", "picks")
    contexts = materialize(cut.mapInArrow(_cut_contexts, "gram long, context long, before int, more int, times long, large boolean, bytes binary"), "contexts")
    drop_table(distinct)
    compared = contexts.filter("NOT large").repartition("gram").sortWithinPartitions("gram").mapInArrow(_compare, _RUNS)
    edge, tables = _narrowed(contexts.filter("large"))
    runs = materialize(compared.union(edge).groupBy("gram", "context").agg(F.collect_set(F.struct("low", "high")).alias("runs")), "runs")
    for table in (contexts, *tables):
        drop_table(table)
    anchor = F.shiftright("place", 16) + F.col("place").bitwiseAND(F.lit(255).cast("long"))
    spans = F.transform("runs", lambda r: F.struct((F.col("anchor") - r["high"]).alias("start"), (F.col("anchor") - r["low"] + LENGTH).alias("stop")))
    placed = join_back(rows, runs, ["gram", "context"]).withColumn("anchor", anchor).select("doc_id", "tag", F.explode(spans).alias("span"))
    result = materialize(placed.groupBy("doc_id", "tag").agg(F.collect_set("span").alias("spans")), "spans")
    for table in (rows, runs):
        drop_table(table)
    return result


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, removed (maximal runs: array<struct<start, stop>>), kept_sha256: a row for each of docs."""
    spans = repeated_spans(docs).withColumnsRenamed({"doc_id": "_doc", "tag": "_tag"})
    joined = _numbered(docs).join(spans, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("tag") == F.col("_tag")), "left")
    schema = "doc_id long, n_bytes long, n_removed long, removed array<struct<start: long, stop: long>>, kept_sha256 string"
    return joined.select("doc_id", "text", "spans").mapInArrow(_cut, schema)
