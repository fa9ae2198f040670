"""The pipeline against the plain versions of its stages, one after the other; and the registered queries."""

import pytest

import __spark_entry__

from . import brute
from .conftest import doc, prose

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def _plain(rows, items):
    host = {}
    for r in rows:
        host.setdefault(r[3], []).append(brute.quality(r[1])[-1])
    assert all(sum(v) < 0.4 * len(v) for v in host.values())  # no host is rejected here
    rows = [list(r) for r in rows if not brute.quality(r[1])[-1]]
    holders = {}
    for r in rows:
        for line in (r[1] or "").split("\n"):
            holders.setdefault(brute.line_key(line), set()).add(r[0])
    common = {k: max(v) for k, v in holders.items() if len(k) >= 40 and len(v) >= 5}
    for r in rows:
        r[1] = "\n".join(x for x in (r[1] or "").split("\n") if common.get(brute.line_key(x), r[0]) == r[0])
    stay = set(brute.near_copies_kept(rows))
    rows = [r for r in rows if r[0] in stay]
    bad = {r[0] for r in brute.contamination(rows, items) if r[-1]}
    return brute.mix([r for r in rows if r[0] not in bad])


def test_pipeline(spark, make_docs, tmp_path):
    shared, passage = prose(1, 40), prose(2, 30)
    rows = []
    for k in range(60):
        text = prose(10 + k, 40 + k)
        if k % 6 == 0:
            text += "\n" + shared
        if k % 15 == 1:
            text += "\n" + passage
        rows.append(doc(k, text, "en", f"s{k % 4}"))
    rows += [doc(100, rows[3][1]), doc(101, rows[4][1] + " lamp"), doc(102, "too short"), doc(103, "again and again " * 9)]
    items = [(1, passage), (2, prose(3, 20))]
    make_docs(rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    wanted = _plain(rows, items)
    assert sorted((r["doc_id"], r["source"], r["size"], round(r["target"], 6), r["taken"]) for r in got) == sorted((a, b, c, round(d, 6), e) for a, b, c, d, e in wanted)
    assert len(got) < 60 and not {100, 101, 102, 103} & {r["doc_id"] for r in got}


def test_stages_keep_columns_and_survive_edges(spark, make_docs, edge_rows, tmp_path):
    spark.createDataFrame([(1, "x")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for rows in (edge_rows, []):
        docs = make_docs(rows)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == docs.columns, name
            assert out.count() <= len(rows)
        assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == len(rows)


def test_registered():
    names = list(__spark_entry__.queries())
    assert [n for k in range(1, 14) for n in names if n.startswith(f"op{k}_")] and sum(n.startswith("op") for n in names) == 13 and "pipeline" in names
    assert corpus_pipeline.ORACLE_SQL is None
    assert {n for n in __spark_entry__.oracle_sql() if n.startswith("op")} == {"op1_mix_sources", "op2_quality_rules", "op4_line_dedup", "op9_decontaminate", "op10_warc_archive", "op11_ranked_search", "op12_sharding"}
