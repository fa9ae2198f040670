"""Periodic runs of words, by bit-parallel lags.

A text's words become numbers, and bit b of all of them one big integer, a plane. A plane XOR itself shifted by q words has a bit
wherever words q apart differ in that bit; the OR over all planes marks every mismatch at lag q. ANDing the matches with themselves, shifted by
doubled distances, leaves the places from which a stretch of the needed length matches: these are the runs of period q.

A run is a stretch with smallest period q and at least max(SHORTEST, REPEATS * q) words that can't be extended. Lags below DIRECT are all tried. Of longer ones
only those are that can hold a run: in a run of smallest period q, a gram of k words (q < k <= 2q) comes again after exactly q words and not
before, so the distances between successive equal grams of 16, 32, 64... words name every lag that is needed, and most texts have none. The names of grams are
exact (ranks by doubling, no hashes), so no run is lost, and a text of n words takes about n^1.5 / 64 steps at worst.

Defined results: null and empty texts have no words and no runs; repeated rows and rows that share an id are judged each on their own; a very long text is
one row's work (its words and planes, about 100 bytes a word, are held at once); an empty table gives an empty one. Columns named in ``keep`` pass through, so other columns
may have any name; the result column `periodic` replaces one of that name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, packed, pieces, unpacked

SHORTEST = 24
REPEATS = 3
DIRECT = 8  # SHORTEST // REPEATS: from here on a run has REPEATS * q words at least
PERIODIC = "struct<n_words: bigint, runs: array<struct<start: bigint, length: bigint, period: bigint>>, strongest: struct<start: bigint, length: bigint, period: bigint>, collapsed: string>"
_RUN = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])
_PERIODIC = pa.struct([("n_words", pa.int64()), ("runs", pa.list_(_RUN)), ("strongest", _RUN), ("collapsed", pa.string())])


class Run(NamedTuple):
    start: int
    length: int
    period: int


def _named(names: np.ndarray, k: int, times: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """names: of the k-grams at each place. The names of (k * times)-grams, places in the order of those names, and whether a place there has the same name as the one before."""
    n, base = len(names) - k * (times - 1), int(names.max()) + 1
    code = names[:n].astype(np.int64)
    for t in range(1, times):
        code = code * base + names[t * k : t * k + n]
    order = np.argsort(code, kind="stable")
    code = code[order]
    same = np.concatenate([[False], code[1:] == code[:-1]])
    out = np.empty(n, np.int64)
    out[order] = np.cumsum(~same) - 1
    return out, order, same


def _lags(ids: np.ndarray) -> list[int]:
    """All lags from DIRECT on that may be the smallest period of a run, ascending."""
    k, names, found = 1, ids, []
    while 2 * k <= len(ids):
        room = 62 // max(1, (int(names.max()) + 1).bit_length())
        times = 4 if k < DIRECT // 2 and room >= 4 and 4 * k <= len(ids) else 2
        if room < times:
            raise ValueError("a text of more than 2^31 words")
        names, order, same = _named(names, k, times)
        if not same.any():  # no gram of this length comes twice, so no longer one does
            break
        k *= times
        if k >= 2 * DIRECT:
            apart = (order - np.roll(order, 1))[same]
            found.append(np.unique(apart[(apart >= k // 2) & (apart < k)]))
    return np.concatenate(found).tolist() if found else []


def _planes(ids: np.ndarray) -> list[int]:
    return [int.from_bytes(np.packbits((ids >> b & 1).astype(np.uint8), bitorder="little").tobytes(), "little") for b in range(max(1, int(ids.max()).bit_length()))]


def _places(bits: int, n: int) -> list[int]:
    return np.flatnonzero(np.unpackbits(np.frombuffer(bits.to_bytes((n + 7) // 8, "little"), np.uint8), bitorder="little")).tolist()


def find(ids: np.ndarray) -> list[Run]:
    """All runs in a sequence of word numbers, by start, then period."""
    n = len(ids)
    if n < SHORTEST:
        return []
    planes, runs, seen = _planes(ids), [], set()
    for q in [*range(1, DIRECT), *_lags(ids)]:
        if REPEATS * q > n:
            break
        differ = 0
        for plane in planes:
            differ |= plane ^ (plane >> q)
        equal, need, have = ~differ & ((1 << (n - q)) - 1), max(SHORTEST, REPEATS * q) - q, 1
        while have < need and equal:
            step = min(have, need - have)
            equal &= equal >> step
            have += step
        if equal:
            for first, last in zip(_places(equal & ~(equal << 1), n), _places(equal & ~(equal >> 1), n), strict=True):
                run = Run(first, last - first + need + q, q)
                if run[:2] not in seen:  # else a shorter period makes the same stretch
                    seen.add(run[:2])
                    runs.append(run)
    return sorted(runs, key=lambda r: (r.start, r.period))


def strongest(runs: Sequence[Run]) -> Run | None:
    """The run of the greatest length / period; of equal ones that with the smallest start, then period."""
    best = None
    for run in runs:
        if best is None or run.length * best.period > best.length * run.period:
            best = run
    return best


def collapse(words: list[bytes], runs: Sequence[Run]) -> bytes:
    """The words joined by a space, of each run only its first period."""
    out, at = [], 0
    for begin, end in sorted((r.start + r.period, r.start + r.length) for r in runs):
        if end > at:
            out += words[at : max(at, begin)]
            at = end
    return b" ".join(out + words[at:])


#: (a row's key, its number of words) -> (place, period): from the place on, the words are repeated with the period.
Tiling = Callable[[int | None, int], tuple[int, int] | None]


def _judged(keep: Sequence[str], text: str, key: str | None, tiling: Tiling | None):
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in pieces(whole, text)):
            keys = batch.column(key).to_pylist() if key else [None] * batch.num_rows
            out = []
            for k, value in zip(keys, batch.column(text), strict=True):
                words = value.as_py().split()  # at the six ASCII white-space characters
                numbers: dict[bytes, int] = {}
                ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
                if tiling and words and (tile := tiling(k, len(words))):
                    a, p = tile
                    at = np.arange(len(words))
                    at[a:] = a + (at[a:] - a) % p
                    ids, words = ids[at], [words[i] for i in at.tolist()]
                runs = find(ids)
                best = strongest(runs)
                out.append({"n_words": len(words), "runs": [r._asdict() for r in runs], "strongest": best and best._asdict(), "collapsed": collapse(words, runs).decode("utf-8", "replace")})
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(out, _PERIODIC)], names=[*keep, "periodic"])

    return judge


def find_runs(docs: DataFrame, keep: Sequence[str] = ("doc_id",), tiling: Tiling | None = None, key: str = "doc_id") -> DataFrame:
    """The columns `keep` of docs and `periodic`: n_words, runs (word number, words, period), the strongest one, and the text collapsed to one period of each.
    With a `tiling`, runs are planted first where it says so for a row's `key`."""
    keep = [c for c in keep if c != "periodic"]
    text, row_key = "text_", "key_"
    while text in keep or row_key in keep:
        text, row_key = text + "_", row_key + "_"
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], as_bytes().alias(text), *([F.col(f"`{key}`").alias(row_key)] if tiling else []))
    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.select(*[F.col(f"`{c}`") for c in keep]).schema)
    return rows.mapInArrow(_judged(keep, text, row_key if tiling else None, tiling), f"{kept}periodic {PERIODIC}")


def collapse_runs(docs: DataFrame) -> DataFrame:
    """docs, all columns, with one period left of each run; a text without runs stays as it is, white space and all."""
    found = find_runs(docs.select(packed(docs).alias("d"), "text"), ["d"])
    text = F.when(F.size("periodic.runs") > 0, F.col("periodic.collapsed")).otherwise(F.col("d")["text"])
    return found.select(*[text.alias("text") if c == "text" else column for c, column in zip(docs.columns, unpacked("d", docs.columns), strict=True)])
