"""Answers are logged by the tasks that ask: one job a run, a case in one task, and a run that is killed loses a flush a task."""

import json
import os
import re
from collections import defaultdict

import pandas as pd
import pytest

from revlens.sources import answerlog

KIND = "case_id string, ord long, text string, error string"


def asking(folder, kill=None, fail=()):
    """Notes every call in a file of its own, and ends the whole process at one of them."""

    def answer(batches):
        for batch in batches:
            for row in batch.to_pylist():
                case, n = row["case_id"], row["ord"]
                if (case, n) == kill:
                    os._exit(9)
                with open(f"{folder}/{case}-{n}-{os.getpid()}-{os.urandom(4).hex()}", "w"):
                    pass
                yield {"case_id": case, "ord": n, "text": f"about {case}", "error": "no answer" if (case, n) in fail else ""}

    return answerlog.Asker(lambda wanted: wanted.select("case_id", "ord"), answer)


@pytest.fixture(scope="module")
def wanted(spark):
    return spark.createDataFrame([(f"c{k}", n) for k in range(12) for n in range(5)], "case_id string, ord long").cache()


def asked(folder):
    return [tuple(name.split("-")[:2]) for name in os.listdir(folder)]


def test_one_job_with_a_case_in_one_task(spark, wanted, tmp_path):
    calls, log = tmp_path / "calls", str(tmp_path / "log")
    calls.mkdir()
    got = answerlog.answered(wanted, asking(calls), KIND, log, ["case_id", "ord"], batch_rows=2)
    assert got.count() == 60 == len(asked(calls)) and {r["error"] for r in got.collect()} == {""}
    (run,) = os.listdir(log)
    told = json.loads((tmp_path / "log" / run / answerlog.COMMITTED).read_text())
    assert sum(x["answers"] for x in told) == 60 and len([x for x in told if x["answers"]]) > 1
    tasks, files = defaultdict(set), [f for f in os.listdir(f"{log}/{run}") if f.endswith(".parquet")]
    for f in files:
        rows = pd.read_parquet(f"{log}/{run}/{f}")
        assert 0 < len(rows) <= 2 and re.fullmatch(r"\d{5}-\d+-\d{6}\.parquet", f)
        for case in rows["case_id"]:
            tasks[case].add(f[:5])
    assert all(len(t) == 1 for t in tasks.values()) and sum(x["files"] for x in told) == len(files)
    again = answerlog.answered(wanted, asking(calls), KIND, log, ["case_id", "ord"])
    assert again.count() == 60 == len(asked(calls)) and os.listdir(log) == [run]  # nothing was left to ask, so no job ran


def test_a_killed_process_loses_a_flush_a_task(spark, wanted, tmp_path):
    calls, log = tmp_path / "calls", str(tmp_path / "log")
    calls.mkdir()
    with pytest.raises(Exception, match="(?i)crashed|exited|EOF|Python worker|WRITER_JOB_ABORTED|aborted"):
        answerlog.answered(wanted, asking(calls, kill=("c7", 3)), KIND, log, ["case_id", "ord"], batch_rows=1)
    before = set(asked(calls))
    kept = {(r["case_id"], str(r["ord"])) for r in answerlog.logged(spark, log, KIND).collect()}
    assert kept <= before and len(before - kept) <= spark.sparkContext.defaultParallelism
    got = answerlog.answered(wanted, asking(calls), KIND, log, ["case_id", "ord"], batch_rows=1)
    assert got.count() == 60 == got.select("case_id", "ord").distinct().count()
    after = asked(calls)
    assert all(after.count(key) == 1 for key in kept)  # what the log had was not asked again


def test_errors_are_asked_again_and_told(spark, wanted, tmp_path):
    calls, log = tmp_path / "calls", str(tmp_path / "log")
    calls.mkdir()
    first = answerlog.answered(wanted, asking(calls, fail={("c1", 1), ("c2", 2)}), KIND, log, ["case_id", "ord"])
    assert {(r["case_id"], r["ord"]) for r in first.filter("error <> ''").collect()} == {("c1", 1), ("c2", 2)} and first.count() == 60
    second = answerlog.answered(wanted, asking(calls), KIND, log, ["case_id", "ord"])
    assert second.filter("error <> ''").count() == 0 and second.count() == 60 and len(asked(calls)) == 62
