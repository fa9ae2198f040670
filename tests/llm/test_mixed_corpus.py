"""The mix as a corpus: whole rows, repeated as decided."""

from collections import Counter, defaultdict

import pytest

from revlens.llm import mixing

from . import brute
from .conftest import doc, prose


@pytest.fixture(scope="module")
def rows():
    out = [doc(k, prose(k, 5 + k % 40), "en", "hot" if k % 3 == 0 else f"s{k % 7}") for k in range(300)]
    return out + [doc(1000, None, "en", "hot"), doc(1001, "", None, None), doc(1002, prose(1, 30), None, None), doc(None, prose(2, 30), "en", "s1")]


def test_whole_rows_are_repeated(make_docs, rows):
    docs = make_docs(rows)
    mixed = mixing.mixed_docs(docs)
    assert [c for c in mixed.columns if c not in mixing.ADDED] == [c for c in docs.columns if c != "size"]
    decided = {r["doc_id"]: r for r in mixed.collect()}
    assert {k: r["text"] for k, r in decided.items()} == {r[0]: r[1] for r in rows}
    wanted = {r[0]: r[-1] for r in brute.mix(rows)}
    assert {k: r["taken"] for k, r in decided.items()} == wanted
    corpus = mixing.repeated(mixed).collect()
    assert Counter(r["doc_id"] for r in corpus) == {k: r["repeats"] for k, r in decided.items() if r["repeats"]}
    epochs = defaultdict(list)
    for r in corpus:
        epochs[r["doc_id"]].append(r["epoch"])
    assert all(sorted(e) == list(range(1, len(e) + 1)) and len(e) <= 3 for e in epochs.values())
    words = Counter()
    for r in corpus:
        words[r["source"]] += r["size"]
    for source in {r["source"] for r in decided.values()}:
        target = next(r["target"] for r in decided.values() if r["source"] == source)
        assert abs(words[source] - target) <= 45
    assert mixing.repeated(mixing.mixed_docs(docs.limit(0))).count() == 0


def test_pipeline_gives_a_corpus(spark, make_docs, rows, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    make_docs(rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, prose(7, 12))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    decided = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    corpus = corpus_pipeline.corpus(spark, str(tmp_path)).collect()
    assert Counter(r["doc_id"] for r in corpus) == {k: r["repeats"] for k, r in decided.items() if r["repeats"]}
    assert all(r["text"] == decided[r["doc_id"]]["text"] and r["text"] for r in corpus)
