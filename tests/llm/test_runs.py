"""Intermediate tables belong to the run that wrote them: runs and queries at the same time leave each other's alone."""

import os
import threading
from urllib.parse import urlparse

import pytest

from revlens.llm import common, linededup

from .conftest import doc, prose


def folders(spark):
    top = urlparse(f"{common.shared_dir(spark)}/revlens/{spark.sparkContext.applicationId}").path
    return set(os.listdir(top)) if os.path.isdir(top) else set()


def test_a_run_drops_its_own_tables(spark):
    rows, before = spark.range(10), folders(spark)
    mine = common.materialize(rows, "outside")
    theirs = []
    with common.Run(spark) as run:
        thread = threading.Thread(target=lambda: theirs.append(common.materialize(rows, "thread")))
        first = common.materialize(rows, "first")
        thread.start()
        thread.join()
        last = common.materialize(rows, "last")
        run.drop(but=1)
        assert last.count() == 10 == theirs[0].count() == mine.count() and len(run.paths) == 1
        with pytest.raises(Exception, match="(?i)not.*exist"):
            first.count()
    assert last.count() == 10  # a result stays after its run
    with pytest.raises(ValueError), common.Run(spark):
        common.materialize(rows, "lost")
        raise ValueError
    assert {name.partition("-")[0] for name in folders(spark) - before} == {"outside", "thread", "last"}
    with common.Run(spark) as outer:
        with common.Run(spark) as inner:
            common.materialize(rows, "inner")
        common.materialize(rows, "outer")
        assert (len(inner.paths), len(outer.paths)) == (1, 1)


def test_pipeline_beside_other_work(spark, make_docs, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    shared = prose(1, 40)
    rows = [doc(k, prose(k, 30 + k % 50) + "\n" + (shared if k % 2 else ""), "en", f"s{k % 3}") for k in range(120)]
    make_docs(rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, prose(7, 12))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    wanted = sorted(map(str, corpus_pipeline.run(spark, str(tmp_path)).collect()))
    docs, failed, done = spark.read.parquet(str(tmp_path / "documents.parquet")), [], threading.Event()

    def others():
        while not done.is_set():
            try:
                assert linededup.dedup_lines(docs.select("doc_id", "text")).count() == 120
            except Exception as e:  # noqa: BLE001
                failed.append(e)

    thread = threading.Thread(target=others)
    thread.start()
    two = []
    second = threading.Thread(target=lambda: two.append(sorted(map(str, corpus_pipeline.run(spark, str(tmp_path)).collect()))))
    second.start()
    assert sorted(map(str, corpus_pipeline.run(spark, str(tmp_path)).collect())) == wanted
    second.join()
    done.set()
    thread.join()
    assert not failed and two == [wanted]
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
