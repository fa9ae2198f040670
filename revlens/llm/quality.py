"""Quality rules of documents and of their hosts.

Each document is measured once (bytes in Arrow batches). Rule failures are summed by host; a host's failure rates are
shrunk towards a beta prior fitted to all hosts by moments, and a host is rejected as a whole if the shrunk rate of a judge passes a
limit: any rule's rate or that of the base failures, or with BASE_ONLY the latter alone. The verdict goes back to its documents by a join on the host.

Defined results: null or empty text has no words and fails; a null host is a host of its own; repeated rows count as often as they
occur; without hosts (empty table) the result is empty. Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import as_bytes, materialize, unpacked

SYMBOLS = b"#*$%&|<>"
_WHITE, _CONTINUATION = b" \t\n\x0b\x0c\r", bytes(range(0x80, 0xC0))
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
#: rule -> SQL condition of failure; the first two are the base rules.
RULES = {
    "too_short": "n_words < 10",
    "repetitive": "100 * n_repeat_words > 20 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "dup_lines": "10 * n_dup_lines > 3 * n_lines",
}
BASE = ("too_short", "repetitive")
#: Rates that may reject a host: of base failures alone, or of every rule as well.
BASE_ONLY, EVERY_RULE = ("base",), ("base", *RULES)
#: What the prior of a rate may weigh, in documents, and the least rate that it expects.
LEAST_WEIGHT, MOST_WEIGHT, LEAST_RATE = 10.0, 1000.0, 1e-3


def repeated_words(words: list[bytes], window: int = 5) -> int:
    """Words inside windows that occur twice or more in the list, the first occurrence included."""
    n = len(words)
    if n <= window:
        return 0
    ids: dict[bytes, int] = {}
    code = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    base, grown = len(ids), code
    for k in range(1, window):  # exact: ranks are renewed before a code can overflow
        top = int(grown.max()) + 1
        if top * base >= 2**62:
            grown = np.unique(grown, return_inverse=True)[1]
        grown = grown[:-1] * base + code[k:]
    _, inverse, times = np.unique(grown, return_inverse=True, return_counts=True)
    if len(times) == len(grown):
        return 0
    starts = np.flatnonzero(times[inverse] > 1)
    edge = np.zeros(n + 1, np.int64)
    edge[starts] += 1
    edge[starts + window] -= 1
    return int((np.cumsum(edge)[:n] > 0).sum())


def measure(text: bytes) -> tuple[int, ...]:
    """The MEASURES of a text in UTF-8."""
    words = text.split()
    lines, seen, again = text.split(b"\n"), set(), 0
    for line in lines:
        if line in seen:
            again += 1
        elif line and not line.isspace():
            seen.add(line)
    chars = len(text.translate(None, _WHITE + _CONTINUATION))
    return len(words), chars, len(text) - len(text.translate(None, SYMBOLS)), len(lines), again, repeated_words(words)


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [measure(x.as_py()) for x in batch.column(2)]
        columns = zip(*rows, strict=True) if rows else [[] for _ in MEASURES]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), *[pa.array(c, pa.int64()) for c in columns]], names=["doc_id", "host", *MEASURES]
        )


def measured_docs(docs: DataFrame, host: str) -> DataFrame:
    """doc_id, host, MEASURES; written, since it is read for the rates and for the verdicts."""
    schema = "doc_id long, host string, " + ", ".join(f"{m} long" for m in MEASURES)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"), as_bytes().alias("text"))
    return materialize(slim.mapInArrow(_measured, schema), "measured")


def host_rates(measured: DataFrame) -> DataFrame:
    """host, docs and for each rule, and for `base` (either base rule), the failures and the shrunk rate."""
    names = [*RULES, "base"]
    conditions = RULES | {"base": " OR ".join(f"({RULES[r]})" for r in BASE)}
    hosts = measured.groupBy("host").agg(
        F.count("*").alias("docs"), *[F.count_if(F.expr(conditions[r])).alias(f"{r}_failures") for r in names]
    )
    hosts = materialize(hosts, "host-failures")
    moments = hosts.agg(
        F.count("*").alias("hosts"),
        F.sum("docs").alias("docs"),
        *[F.sum(f"{r}_failures").alias(f"{r}_sum") for r in names],
        *[F.sum(F.col(f"{r}_failures") * F.col(f"{r}_failures") / F.col("docs")).alias(f"{r}_square") for r in names],
    ).first()
    out = hosts
    for r in names:
        a, b = beta_prior(moments["hosts"], moments["docs"] or 0, moments[f"{r}_sum"] or 0, moments[f"{r}_square"] or 0.0)
        out = out.withColumn(f"{r}_rate", (F.col(f"{r}_failures") + F.lit(a)) / (F.col("docs") + F.lit(a + b)))
    return out


def beta_prior(hosts: int, docs: int, failures: int, square: float) -> tuple[float, float]:
    """alpha, beta by moments of the rates over hosts; square is the sum of failures^2 / docs. The prior weighs as much as
    LEAST_WEIGHT to MOST_WEIGHT documents: moments of a few hosts may ask for less than none or for infinitely much, and a host of a few documents
    is never condemned by them alone. No rate is taken for impossible (LEAST_RATE)."""
    if not docs:
        return 0.5, 0.5
    mean = failures / docs
    spread = max(square / docs - mean * mean, 0.0)  # between hosts, weighed by documents
    noise = mean * (1 - mean)
    between = spread - noise * hosts / docs
    weight = (noise - spread) / between if between > 0 else MOST_WEIGHT
    weight = min(max(weight, LEAST_WEIGHT), MOST_WEIGHT)
    return max(mean, LEAST_RATE) * weight, max(1 - mean, LEAST_RATE) * weight


def _passes_limit(judges: tuple[str, ...], host_limit: float) -> F.Column:
    """Whether the shrunk rate of any of the judges passes the limit."""
    return F.exists(F.array(*[F.col(f"{r}_rate") for r in judges]), lambda rate: rate > host_limit)


def apply_rules(docs: DataFrame, host: str = "source", host_limit: float = 0.5, judges: tuple[str, ...] = EVERY_RULE) -> DataFrame:
    """doc_id, host, the MEASURES, base_failed, host_rate (shrunk, of base failures), host_rejected, kept: a row for each of docs."""
    measured = measured_docs(docs, host)
    verdicts = materialize(
        host_rates(measured).select(F.col("host").alias("of"), F.col("base_rate").alias("host_rate"), _passes_limit(judges, host_limit).alias("host_rejected")),
        "host-verdicts",
    )
    failed = F.expr(" OR ".join(f"({RULES[r]})" for r in BASE))
    joined = measured.join(verdicts, F.col("host").eqNullSafe(F.col("of"))).drop("of").withColumn("base_failed", failed)
    return joined.withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected"))


def _measured_rows(docs: DataFrame, host: str) -> DataFrame:
    """d (the whole row), host, MEASURES; written, so that each text is measured once."""
    columns = docs.columns
    text, of = columns.index("text"), columns.index(host)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [measure(x.as_py() or b"") for x in batch.column(text).cast(pa.binary())]
            counts = zip(*rows, strict=True) if rows else [[] for _ in MEASURES]
            whole = pa.StructArray.from_arrays(batch.columns, names=columns)
            yield pa.RecordBatch.from_arrays([whole, batch.column(of).cast(pa.string()), *[pa.array(c, pa.int64()) for c in counts]], names=["d", "host", *MEASURES])

    fields = [StructField("d", docs.schema), StructField("host", StringType()), *[StructField(m, LongType()) for m in MEASURES]]
    return materialize(docs.mapInArrow(measured, StructType(fields)), "measured-docs")


def keep_good(docs: DataFrame, host: str = "source", host_limit: float = 0.5, judges: tuple[str, ...] = EVERY_RULE) -> DataFrame:
    """docs, all columns, without documents that fail a base rule or whose host is rejected. Only the table of rejected hosts is joined, so the
    texts stay where they are."""
    rows = _measured_rows(docs, host)
    rejected = materialize(host_rates(rows.select("host", *MEASURES)).filter(_passes_limit(judges, host_limit)).select(F.col("host").alias("rejected")), "rejected-hosts")
    failed = F.expr(" OR ".join(f"({RULES[r]})" for r in BASE))
    good = rows.filter(~failed).select("d", "host")
    return good.join(rejected, F.col("host").eqNullSafe(F.col("rejected")), "left_anti").select(*unpacked("d", docs.columns))
