"""Benchmark decontamination with suffix arrays over the training documents.

Each Arrow batch of documents is a shard. Its words become numbers (0 for words that no benchmark item has), and the
suffixes that start like some test suffix form the shard's suffix array; every distinct test window is searched in it by bisection. From a
hit the range of test suffixes is narrowed down word by word in the block's own suffix array, which gives the longest verbatim match at
that place; `matches` holds those that no other one contains, with their places in item and document (one of the places in the
benchmark if it has several). Hit words are marked as intervals, so an item that repeats itself costs no more than its distinct windows.

The benchmark is the stated query set. It is read in blocks of at most BLOCK_WORDS words (a longer item is split, its pieces share a window's
words but one, and a match ends with its piece), so the driver and a task hold one block whatever the benchmark's size. A benchmark of one block is matched in one pass
over the documents. Of several, each is broadcast, matched, its hits written by hash of the text, and released before the next one; the hits come
together by a join on the hash.

Defined results: null text has no words and no matches; an item without words has no window; items that share an id count once; a null
item_id is called "null"; repeated documents are judged alike, each on its own; empty tables give empty or clean results. Columns named in
``keep`` pass through; the result column `decon` replaces one of that name.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_back, materialize, packed, pieces, unpacked

WINDOW = 13
HEAD = 3
BLOCK_WORDS = 1_000_000
_PIECE = 1 << 20
#: A-Z to lower case; what is no word character becomes a space.
_TABLE = bytes((b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32) for b in range(256))
MATCHES = "array<struct<item: string, item_word: int, doc_word: int, n_words: int>>"
DECON = f"struct<n_words: bigint, n_hit: bigint, items: array<string>, matches: {MATCHES}, contaminated: boolean>"
_MATCH = pa.struct([("item", pa.string()), ("item_word", pa.int32()), ("doc_word", pa.int32()), ("n_words", pa.int32())])
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
_DECON = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("matches", pa.list_(_MATCH)), ("contaminated", pa.bool_())])


def split_words(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def numbers_of(text: bytes, vocabulary: dict[bytes, int]) -> np.ndarray:
    """The words of a text as numbers, a piece of it at a time."""
    plain, out, at = text.translate(_TABLE), [], 0
    while at < len(plain):
        end = min(at + _PIECE, len(plain))
        if end < len(plain):
            cut = plain.rfind(b" ", at, end)
            end = cut + 1 if cut >= at else (plain.find(b" ", end) + 1 or len(plain))
        words = plain[at:end].split()
        out.append(np.fromiter(map(vocabulary.get, words, repeat(0)), np.int32, len(words)))
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.int32)


def _keys(rows: np.ndarray) -> np.ndarray:
    """Rows of numbers as byte strings that sort alike."""
    return np.ascontiguousarray(rows.astype(">u4")).view(f"S{4 * rows.shape[1]}").ravel()


def suffix_order(words: np.ndarray) -> np.ndarray:
    """The suffix array of a sequence of numbers, by doubling the length that ranks tell apart."""
    rank, step = np.unique(words, return_inverse=True)[1].astype(np.int64), 1
    while step < len(words):
        after = np.concatenate([rank[step:] + 1, np.zeros(step, np.int64)])
        pairs = rank * (int(rank.max()) + 2) + after
        rank = np.unique(pairs, return_inverse=True)[1]
        if int(rank.max()) == len(words) - 1:
            break
        step *= 2
    return np.argsort(rank, kind="stable")


class Item(NamedTuple):
    """A benchmark item, or a piece of a long one that starts at word `offset`."""

    name: str
    offset: int
    words: list[bytes]


class TestSuffixes:
    """A block of benchmark items: the vocabulary, the suffix array, and the distinct windows, ready to be searched."""

    def __init__(self, items: Sequence[Item], window: int = WINDOW):
        self.window, self.items = window, [(i.name, i.offset) for i in items]
        self.vocabulary: dict[bytes, int] = {}
        parts, starts, owners, at = [], [], [], 0
        for number, item in enumerate(items):
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in item.words]
            if ids:
                size = min(window, len(ids))
                starts.append(np.arange(at, at + len(ids) - size + 1))
                owners.append(np.full(len(ids) - size + 1, number))
            parts.append(np.array([*ids, 0], np.int32))
            at += len(ids) + 1
        self.words = np.concatenate([*parts, np.zeros(window, np.int32)])
        owner, first = np.full(len(self.words), -1), np.zeros(len(items) + 1, np.int64)
        if starts:
            owner[np.concatenate(starts)] = np.concatenate(owners)
        first[1:] = np.cumsum([len(p) for p in parts])
        self.begins = first[:-1]
        order = suffix_order(self.words)
        self.starts = order[owner[order] >= 0]  # of all windows, in the order of their suffixes
        self.owner = owner[self.starts].astype(np.int32)
        table = self.words[self.starts[:, None] + np.arange(window)].reshape(-1, window)
        table[np.cumsum(table == 0, axis=1) > 0] = 0  # a short item ends its window
        new = np.ones(len(table), bool)
        new[1:] = (table[1:] != table[:-1]).any(axis=1)
        self.first = np.append(np.flatnonzero(new), len(table))  # distinct window -> its range in starts
        table = table[new]
        self.lengths = (table > 0).sum(axis=1)
        self.low = _keys(table)
        self.high = _keys(np.where(np.arange(window) < self.lengths[:, None], table.astype(np.int64), 2**32 - 1))
        before = np.where(self.starts > 0, self.words[self.starts - 1], 0)
        same = np.maximum.reduceat(before, self.first[:-1]) == np.minimum.reduceat(before, self.first[:-1]) if len(table) else np.zeros(0, bool)
        self.before = np.where(same & (before[self.first[:-1]] > 0), before[self.first[:-1]], -1)  # the word in front of all of a window's places
        self.base = len(self.vocabulary) + 1
        self.heads = {}  # length -> the codes with which windows of that length or longer begin
        for size in sorted({min(HEAD, int(n)) for n in np.unique(self.lengths)}):
            mine = table[np.minimum(self.lengths, HEAD) == size]
            self.heads[size] = np.unique(self._code([mine[:, k] for k in range(size)]))

    def _code(self, columns: Sequence[np.ndarray]) -> np.ndarray:
        code = columns[0].astype(np.int64)
        for c in columns[1:]:
            code = code * self.base + c
        return code

    def search(self, padded: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(distinct window, place in the shard) of every occurrence. padded: numbers, documents parted by a 0, and `window` more at the end."""
        known = np.flatnonzero(padded)
        chosen = []
        for size, codes in self.heads.items():
            at = known
            for k in range(1, size):
                at = at[padded[at + k] > 0]
            code = self._code([padded[at + k] for k in range(size)])
            spot = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
            chosen.append(at[codes[spot] == code])
        places = np.unique(np.concatenate(chosen)) if chosen else known[:0]
        if not len(places):
            return places, places
        keys = _keys(padded[places[:, None] + np.arange(self.window)])
        order = np.argsort(keys, kind="stable")
        suffixes = keys[order]
        first, last = np.searchsorted(suffixes, self.low, "left"), np.searchsorted(suffixes, self.high, "right")
        found = np.flatnonzero(last > first)
        tests = np.repeat(found, (last - first)[found])
        spots = np.concatenate([np.arange(first[t], last[t]) for t in found]) if len(found) else found
        return tests, places[order[spots]]

    def _bound(self, word: np.ndarray, low: np.ndarray, high: np.ndarray, depth: np.ndarray, right: bool) -> np.ndarray:
        """For each range of suffixes that agree in `depth` words: where its suffixes with the next `word` begin, or end."""
        low, high = low.copy(), high.copy()
        while (open_ := low < high).any():
            middle = (low + high) // 2
            value = self.words[self.starts[np.minimum(middle, len(self.starts) - 1)] + depth]
            below = open_ & ((value <= word) if right else (value < word))
            low, high = np.where(below, middle + 1, low), np.where(open_ & ~below, middle, high)
        return low

    def longest(self, padded: np.ndarray, tests: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, number of words, range's first suffix) of the longest matches from the places given that no other one contains."""
        starts = (self.before[tests] < 0) | (self.before[tests] != np.where(places > 0, padded[places - 1], 0))  # else the match from the place before holds this one
        tests, places = tests[starts], places[starts]
        low, high, depth = self.first[tests], self.first[tests + 1], self.lengths[tests]
        going = np.flatnonzero(depth == self.window)
        while len(going):
            alone = high[going] - low[going] == 1
            for k in going[alone].tolist():  # one suffix is left: it is compared in growing steps
                test, step = int(self.starts[low[k]]), 64
                while True:
                    one, two = padded[places[k] + depth[k] : places[k] + depth[k] + step], self.words[test + depth[k] : test + depth[k] + step]
                    n = min(len(one), len(two))
                    differ = np.flatnonzero((one[:n] != two[:n]) | (one[:n] == 0))
                    depth[k] += differ[0] if len(differ) else n
                    if len(differ) or n < step:
                        break
                    step *= 2
            going = going[~alone]
            word = padded[places[going] + depth[going]]
            a = self._bound(word, low[going], high[going], depth[going], False)
            b = self._bound(word, low[going], high[going], depth[going], True)
            more = (word > 0) & (a < b)
            going = going[more]
            low[going], high[going] = a[more], b[more]
            depth[going] += 1
        order = np.lexsort((-depth, places))
        places, depth, low = places[order], depth[order], low[order]
        ends = places + depth
        upto = np.maximum.accumulate(np.concatenate([[-1], ends[:-1]])) if len(ends) else ends
        outer = ends > upto
        return places[outer], depth[outer], low[outer]


class _Found(NamedTuple):
    """What a shard's documents have in common with a block: per document the numbers of words and of hit words, hit intervals, items, matches."""

    words: np.ndarray
    spans: list[np.ndarray]
    items: list[list[str]]
    matches: list[list[dict]]


def _found(tests: TestSuffixes, texts: list[bytes]) -> _Found:
    numbers = [numbers_of(t, tests.vocabulary) for t in texts]
    sizes = np.array([len(x) for x in numbers], np.int64)
    begins = np.concatenate([[0], np.cumsum(sizes + 1)])
    zero = np.zeros(1, np.int32)
    padded = np.concatenate([*(x for n in numbers for x in (n, zero)), np.zeros(tests.window, np.int32)])
    spans, items, matches = [np.zeros((0, 2), np.int64)] * len(texts), [[] for _ in texts], [[] for _ in texts]
    which, places = tests.search(padded)
    if len(which):
        edge = np.zeros(len(padded) + 1, np.int64)
        np.add.at(edge, places, 1)
        np.add.at(edge, places + tests.lengths[which], -1)
        covered = np.diff(np.concatenate([[0], np.cumsum(edge) > 0, [0]]))
        runs = np.column_stack([np.flatnonzero(covered > 0), np.flatnonzero(covered < 0)])  # no run crosses the 0 between documents
        of = np.searchsorted(begins, runs[:, 0], "right") - 1
        for d in np.unique(of).tolist():
            spans[d] = runs[of == d] - begins[d]
        pairs = np.unique(np.column_stack([np.searchsorted(begins, places, "right") - 1, which]), axis=0)
        for d, t in pairs.tolist():
            items[d].extend(np.unique(tests.owner[tests.first[t] : tests.first[t + 1]]).tolist())
        for d in np.unique(pairs[:, 0]).tolist():
            items[d] = sorted({tests.items[k][0] for k in set(items[d])})
        at, length, suffix = tests.longest(padded, which, places)
        of, owner = np.searchsorted(begins, at, "right") - 1, tests.owner[suffix]
        inside = tests.starts[suffix] - tests.begins[owner]
        for d, k, w, p, n in zip(of.tolist(), owner.tolist(), inside.tolist(), (at - begins[of]).tolist(), length.tolist(), strict=True):
            name, offset = tests.items[k]
            matches[d].append({"item": name, "item_word": offset + w, "doc_word": p, "n_words": n})
    return _Found(sizes, spans, items, matches)


def _verdict(n_words: int, hit: int, items: list[str], matches: list[dict]) -> dict:
    return {"n_words": n_words, "n_hit": hit, "items": items, "matches": matches, "contaminated": hit > 0 and 20 * hit >= n_words}


def _shards(batches: Iterator[pa.RecordBatch], texts_in: str) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for batch in (piece for whole in batches for piece in pieces(whole, texts_in)):
        yield batch, [x.as_py() or b"" for x in batch.column(texts_in)]


def _judged(block, keep: Sequence[str], texts_in: str):
    """One block is all there is: the verdicts at once. block: a broadcast of TestSuffixes; texts_in: the column of texts."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _shards(batches, texts_in):
            found = _found(block.value, texts)
            out = [
                _verdict(n, int((s[:, 1] - s[:, 0]).sum()), items, matches)
                for n, s, items, matches in zip(found.words.tolist(), found.spans, found.items, found.matches, strict=True)
            ]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(out, _DECON)], names=[*keep, "decon"])

    return judge


_HITS = f"h1 long, h2 long, spans array<struct<start: int, stop: int>>, items array<string>, matches {MATCHES}"


def _hits(block):
    """Rows of texts that share something with the block: h1, h2 (of the text), spans, items, matches."""

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _shards(batches, "text"):
            found = _found(block.value, texts)
            hit = [d for d, s in enumerate(found.spans) if len(s)]
            spans = [[{"start": a, "stop": b} for a, b in found.spans[d].tolist()] for d in hit]
            columns = [batch.column("h1").take(pa.array(hit, pa.int64())), batch.column("h2").take(pa.array(hit, pa.int64()))]
            columns += [pa.array(spans, _SPANS), pa.array([found.items[d] for d in hit], pa.list_(pa.string())), pa.array([found.matches[d] for d in hit], pa.list_(_MATCH))]
            yield pa.RecordBatch.from_arrays(columns, names=["h1", "h2", "spans", "items", "matches"])

    return match


def _counted(keep: Sequence[str], texts_in: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _shards(batches, texts_in):
            n = pa.array([len(numbers_of(t, {})) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], n], names=[*keep, "_n_words"])

    return count


def _joined(keep: Sequence[str]):
    """Verdicts from all blocks' hits together."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for n, spans, items, matches in zip(*(batch.column(c).to_pylist() for c in ("_n_words", "_spans", "_items", "_matches")), strict=True):
                hit = upto = 0
                for s in sorted(spans or (), key=lambda s: s["start"]):
                    hit += max(0, s["stop"] - max(s["start"], upto))
                    upto = max(upto, s["stop"])
                out.append(_verdict(n, hit, sorted(set(items or ())), matches or []))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(out, _DECON)], names=[*keep, "decon"])

    return judge


def _blocks(benchmark: DataFrame) -> Iterator[tuple[list[Item], bool]]:
    """The benchmark a block at a time, and whether it is the last one. The driver holds no more than one block and the item after it."""
    most = max(BLOCK_WORDS, 2 * WINDOW)
    block: list[Item] = []
    held = 0
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("i"), F.col("text").cast("binary").alias("t"))
    for row in items.toLocalIterator():
        words = split_words(bytes(row["t"] or b""))
        for at in range(0, max(1, len(words) - WINDOW + 1), most - WINDOW + 1):
            item = Item(row["i"], at, words[at : at + most])
            if held and held + len(item.words) > most:
                yield block, False
                block, held = [], 0
            block.append(item)
            held += len(item.words) + 1
    yield block, True


def find_contamination(docs: DataFrame, benchmark: DataFrame, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns `keep` of docs and `decon`: n_words, n_hit, items, matches (longest verbatim, with places), contaminated."""
    context = docs.sparkSession.sparkContext
    keep = [c for c in keep if c != "decon"]
    text = "text_"
    while text in keep:
        text += "_"
    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*[F.col(f"`{c}`") for c in keep]).schema)
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").cast("binary").alias(text))
    h1, h2 = F.xxhash64(F.col(text)), F.xxhash64(F.lit(1), F.col(text))
    parts: list[DataFrame] = []
    for block, last in _blocks(benchmark):
        shared = context.broadcast(TestSuffixes(block))
        if last and not parts:
            return rows.mapInArrow(_judged(shared, keep, text), f"{kept}decon {DECON}")
        texts = rows.select(h1.alias("h1"), h2.alias("h2"), F.col(text).alias("text"))
        parts.append(materialize(texts.mapInArrow(_hits(shared), _HITS).dropDuplicates(["h1", "h2"]), "block-hits"))
        shared.destroy()
    hits = parts[0]
    for part in parts[1:]:
        hits = hits.union(part)
    both = hits.groupBy(F.col("h1").alias("_h1"), F.col("h2").alias("_h2")).agg(*[F.flatten(F.collect_list(c)).alias(f"_{c}") for c in ("spans", "items", "matches")])
    wide = rows.withColumn("_h1", h1).withColumn("_h2", h2)
    counted = wide.mapInArrow(_counted([*keep, "_h1", "_h2"], text), f"{kept}_h1 long, _h2 long, _n_words long")
    joined = join_back(counted, materialize(both, "hits"), ["_h1", "_h2"], "left")
    return joined.mapInArrow(_joined(keep), f"{kept}decon {DECON}")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs, all columns, without contaminated documents."""
    rows = docs.select(packed(docs).alias("d"), "text")
    return find_contamination(rows, benchmark, ["d"]).filter(~F.col("decon.contaminated")).select(*unpacked("d", docs.columns))
