"""Hosts that only the rules beside the base ones can reject."""

import pytest

from revlens.llm import quality

from .conftest import doc, prose


def test_every_rule_judges_hosts(spark, make_docs, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rows = [doc(k, prose(k, 40), "en", f"h{k % 12}") for k in range(240)]
    rows += [doc(1000 + k, prose(k, 40) + " <|> #" * 4, "en", "markup") for k in range(60)]
    rows += [doc(2000 + k, "\n".join([prose(k, 4), *["y"] * 4, prose(k + 900, 20)]), "en", "lines") for k in range(60)]
    docs = make_docs(rows)
    stage = corpus_pipeline.STAGES[0][1]
    assert sorted(r["doc_id"] for r in stage(spark, docs, str(tmp_path)).collect()) == list(range(240))
    got = quality.apply_rules(docs, judges=quality.EVERY_RULE).collect()
    assert {r["host"] for r in got if r["host_rejected"]} == {"markup", "lines"} and not any(r["base_failed"] for r in got)


def _hosts():
    rows = [doc(k, prose(k, 40), "en", f"h{k % 12}") for k in range(240)]
    rows += [doc(1000 + k, prose(k, 40) + " <|> #" * 4, "en", "markup") for k in range(60)]
    rows += [doc(2000 + k, "\n".join([prose(k, 4), *["y"] * 4, prose(k + 900, 20)]), "en", "lines") for k in range(60)]
    rows += [doc(3000 + k, "short one" if k % 4 else prose(k, 30), "en", "brief") for k in range(60)]
    return rows + [doc(4000, None, None, None), doc(4001, "", "en", "tiny"), doc(4002, prose(3, 50), None, None), doc(4003, prose(4, 50), None, None)]


def test_the_query_and_its_sql_reject_the_same_hosts(spark, make_docs, tmp_path):
    """On the driver's tables no host is rejected; here three are."""
    duckdb = pytest.importorskip("duckdb")
    from revlens.llm import oracles, queries

    make_docs(_hosts()).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op2_quality_rules(spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    wanted = con.sql(f"SELECT {', '.join(got.columns)} FROM ({oracles.OP2})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(wanted)
    kept = {r[0]: r[-1] for r in wanted}
    assert all(kept[k] for k in range(240)) and not any(kept[k] for k in kept if 1000 <= k < 4000) and kept[4002]


def test_each_text_is_measured_once(make_docs, monkeypatch):
    written = []
    kept = quality.materialize
    monkeypatch.setattr(quality, "materialize", lambda df, name: written.append(name) or kept(df, name))
    docs = make_docs(_hosts())
    good = quality.keep_good(docs)
    assert written == ["measured-docs", "host-failures", "rejected-hosts"] and good.columns == docs.columns
    told = {r["doc_id"] for r in quality.apply_rules(docs).filter("kept").collect()}
    assert {r["doc_id"] for r in good.collect()} == told
