"""Pull requests as a stream of polls: only what moved comes, nothing is passed over, and a replay has the same rows."""

import random
import shutil

from revlens.sources import forge
from revlens.streaming.pulls import Position, case_batches, moved, pull_stream

from .cases import make_case
from .fake_forge import FakeForge


def _client(fake):
    return forge.ForgeClient(fake.url, "u", "s", wait=0.001)


def _take(stream, out, checkpoint):
    """One run over what there is; each batch under its number."""

    def write(batch, n):
        batch.select("repository", "id", "title", "updated_on").write.mode("overwrite").parquet(f"{out}/batch={n}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def _batches(spark, out):
    rows = {}
    for r in spark.read.parquet(out).collect():
        rows.setdefault(r["batch"], set()).add((r["repository"], r["id"], r["title"]))
    return rows


def test_only_what_moved_comes_and_a_replay_is_the_same(spark, tmp_path):
    out, ck, log = (str(tmp_path / x) for x in ("out", "ck", "log"))
    with FakeForge() as fake:
        for n in range(7):
            fake.pull("a", n, n)
        fake.pull("b", 3, 50)
        run = lambda: _take(pull_stream(spark, fake.url, "w", "a,b,empty", log, overlap=5), out, ck)
        run()
        first = {("a", n, f"T{n} at {n}") for n in range(7)} | {("b", 3, "T3 at 50")}
        assert _batches(spark, out) == {0: first}
        run()  # nothing has moved
        assert _batches(spark, out) == {0: first}
        fake.pull("a", 2, 100)
        fake.pull("a", 9, 4)  # a late one, older than the last seen by less than the overlap
        run()
        second = {("a", 2, "T2 at 100"), ("a", 9, "T9 at 4")}
        assert _batches(spark, out) == {0: first, 1: second}
        # The batch is run again, as after a crash before its commit, when more has moved: it has the rows it had, and the rest comes behind it.
        fake.pull("a", 2, 200)
        for place in (tmp_path / "ck" / "commits" / "1", tmp_path / "ck" / "commits" / ".1.crc"):
            place.unlink(missing_ok=True)
        shutil.rmtree(tmp_path / "out" / "batch=1")
        run()
        assert {n: rows for n, rows in _batches(spark, out).items() if n < 2} == {0: first, 1: second}
        run()  # a run that takes what there is may end with the repeated batch
        assert _batches(spark, out) == {0: first, 1: second, 2: {("a", 2, "T2 at 200")}}


def test_polls_that_spark_had_not_noted_come_once(spark, tmp_path):
    """The driver died after two polls were logged, before any batch: both are in the first one, each pull request in its last state."""
    from revlens.sources.answerlog import qualified
    from revlens.streaming.pulls import _Polls

    log = str(tmp_path / "log")
    with FakeForge() as fake:
        options = {"url": fake.url, "workspace": "w", "repositories": "a", "log": qualified(spark, log), "overlap": "5"}
        fake.pull("a", 1, 1)
        fake.pull("a", 2, 2)
        assert _Polls(options, None).latestOffset() == {"polls": 1}
        fake.pull("a", 1, 30)
        assert _Polls(options, None).latestOffset() == {"polls": 2} == _Polls(options, None).latestOffset()
        _take(pull_stream(spark, fake.url, "w", "a", log, overlap=5), str(tmp_path / "out"), str(tmp_path / "ck"))
    assert _batches(spark, str(tmp_path / "out")) == {0: {("a", 1, "T1 at 30"), ("a", 2, "T2 at 2")}}


def test_no_pull_request_is_passed_over_while_pages_shift():
    r = random.Random(5)
    for _ in range(25):
        with FakeForge(page=r.choice([1, 2, 3])) as fake:
            for n in range(r.randint(1, 9)):
                fake.pull("a", n, r.randint(0, 4))  # many at the same time
            seen, position, at = {}, Position(), 10
            for _ in range(4):
                def shift(f):
                    for n in r.sample(sorted(f.pulls["a"]), r.randint(0, len(f.pulls["a"]))):
                        f.pull("a", n, at)

                fake.between = shift if r.random() < 0.7 else None
                for pull in moved(_client(fake), "w", "a", ["OPEN"], position, r.choice([0, 3])):
                    seen[pull["id"]] = pull["title"]
                position = Position(**position.state())
                at += r.randint(0, 3)
            for pull in moved(_client(fake), "w", "a", ["OPEN"], position, 3):
                seen[pull["id"]] = pull["title"]
            assert seen == {n: p["title"] for n, p in fake.pulls["a"].items()}
            assert list(moved(_client(fake), "w", "a", ["OPEN"], position, 3)) == []


def test_cases_of_moved_pull_requests(spark, tmp_path):
    out, ck, log = (str(tmp_path / x) for x in ("out", "ck", "log"))
    with FakeForge() as fake:
        def change(n, at, value):
            files = {"a.py": f"x = {value}\n", "k.py": "k\n"}
            fake.pull("r", n, at, f"c{n}-{value}", files, make_case("z", {"a.py": "x = 1\n", "k.py": "k\n"}, files)["diff"])

        run = lambda: case_batches(pull_stream(spark, fake.url, "w", "r", log), out, ck, fake.url, "w", "r").awaitTermination()
        change(1, 1, 2)
        change(2, 2, 3)
        run()
        change(2, 200, 4)
        asked = len(fake.asked)
        run()
        assert sorted(p.rsplit("/", 1)[1].split("?")[0] for _, p in fake.asked[asked:] if "sort=" not in p) == ["c2-4.tar.gz", "diff"]  # what did not move isn't fetched
    rows = spark.read.parquet(out).collect()
    assert sorted((r["batch"], r["case_id"], r["head_commit"], r["head_files"]["a.py"]) for r in rows) == [(0, "PR-1", "c1-2", "x = 2\n"), (0, "PR-2", "c2-3", "x = 3\n"), (1, "PR-2", "c2-4", "x = 4\n")]
