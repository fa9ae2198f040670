"""Comments are posted by tasks, one a pull request whatever is repeated."""

import threading

import pytest

from revlens.plans import reports
from revlens.sources import answerlog, comments, forge

from .fake_forge import FakeForge

PLAN = "case_id string, pull_id long, findings int, body string, head_commit string"


def _plan(spark, text="x", ns=range(12)):
    return spark.createDataFrame([(f"PR-{n}", n, 1, f"{reports.HEADING}\n{text} {n}", f"c{n}") for n in ns], PLAN)


def _told(rows):
    return {r["pull_id"]: (r["action"], r["comment_id"]) for r in rows.collect()}


@pytest.fixture
def fake():
    with FakeForge() as f:
        for n in range(12):
            f.pull("r", n, n)
        yield f


def test_each_pull_request_has_one_comment(spark, fake, tmp_path):
    run = lambda plan, log: comments.posted(plan, fake.url, "w", "r", reports.is_ours, str(tmp_path / log), tasks=4, calls_a_minute=60000, wait=0.001)
    fake.comments[3] = [{"id": 900, "content": {"raw": "of somebody else"}}, {"id": 901, "inline": {"path": "a"}, "content": {"raw": reports.HEADING}}]
    first = _told(run(_plan(spark), "a"))
    assert {a for a, _ in first.values()} == {"created"} and len(first) == 12
    posts = sum(m == "POST" for m, _ in fake.asked)
    # the log of a run that was killed is taken up; without it the forge itself says what is there
    assert _told(run(_plan(spark), "a")) == first and sum(m == "POST" for m, _ in fake.asked) == posts == 12
    assert _told(run(_plan(spark), "b")) == {n: ("unchanged", i) for n, (_, i) in first.items()}
    assert _told(run(_plan(spark, "y"), "c")) == {n: ("updated", i) for n, (_, i) in first.items()}
    assert {n: [c["id"] for c in there if reports.is_ours(c)] for n, there in fake.comments.items()} == {n: [i] for n, (_, i) in first.items()}
    assert len(fake.comments[3]) == 3
    fake.pulls["r"][5]["source"]["commit"]["hash"] = "ffff"
    assert _told(run(_plan(spark, "z"), "d"))[5] == ("moved", None) and fake.comments[5][0]["content"]["raw"].endswith("y 5")
    assert comments.posted(_plan(spark).limit(0), fake.url, "w", "r", reports.is_ours, str(tmp_path / "e")).count() == 0


def test_a_task_that_is_tried_again_posts_nothing_twice(spark, fake, tmp_path):
    """A task dies after it has posted and before it has logged; the next one meets what it left."""
    client = forge.ForgeClient(fake.url, "u", "s", wait=0.001)
    for n in range(0, 12, 2):
        forge.upsert(client, "w", "r", n, f"{reports.HEADING}\nx {n}", reports.is_ours)
    rows = _told(comments.posted(_plan(spark), fake.url, "w", "r", reports.is_ours, str(tmp_path / "log"), calls_a_minute=60000))
    assert {n: a for n, (a, _) in rows.items()} == {n: "created" if n % 2 else "unchanged" for n in range(12)}
    assert all(len(there) == 1 for there in fake.comments.values())
    assert answerlog.logged(spark, str(tmp_path / "log"), comments.POSTS).count() == 12


def test_a_lost_answer_is_looked_for(fake):
    client = forge.ForgeClient(fake.url, "u", "s", wait=0.001)
    fake.lose = 1
    assert forge.upsert(client, "w", "r", 1, f"{reports.HEADING}\nx", reports.is_ours) == ("created", 1) and len(fake.comments[1]) == 1


def test_two_tasks_at_the_same_time(fake):
    """Both see no comment, both post: one stays, and both name it."""
    together, got = threading.Barrier(2), []

    class Slow(forge.ForgeClient):
        waits = True

        def comments(self, *where):
            found = super().comments(*where)
            if self.waits:
                self.waits = False
                together.wait(10)
            return found

    def run():
        got.append(forge.upsert(Slow(fake.url, "u", "s", wait=0.001), "w", "r", 2, f"{reports.HEADING}\nx", reports.is_ours))

    threads = [threading.Thread(target=run) for _ in range(2)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert got == [("created", 1)] * 2 and [c["id"] for c in fake.comments[2]] == [1]


def test_faults_and_pace(spark, fake, tmp_path):
    fake.refuse = 404
    rows = comments.posted(_plan(spark, ns=range(3)), fake.url, "w", "r", reports.is_ours, str(tmp_path / "a"), calls_a_minute=60000).collect()
    assert {r["action"] for r in rows} == {"failed"} and all("404" in r["error"] for r in rows)
    fake.refuse = 401
    with pytest.raises(Exception, match="401"):
        comments.posted(_plan(spark, ns=range(3)), fake.url, "w", "r", reports.is_ours, str(tmp_path / "b"), calls_a_minute=60000).collect()
    fake.refuse = None
    del fake.times[:]
    # what failed is posted, under the limit: 20 calls a second over all tasks, so no ten calls within less than about half a second
    assert {a for a, _ in _told(comments.posted(_plan(spark, ns=range(8)), fake.url, "w", "r", reports.is_ours, str(tmp_path / "a"), tasks=4, calls_a_minute=1200)).values()} == {"created"}
    times = sorted(fake.times)
    assert len(times) == 32 and min(b - a for a, b in zip(times, times[12:])) > 0.35


def test_the_command_posts(spark, fake, tmp_path):
    from revlens.__main__ import main
    from revlens.sources import tables

    from .cases import frame, make_case

    case = make_case("PR-1", {"a.py": "x = 1\n"}, {"a.py": "x = 2\n"}) | {"pull_request": {"id": 1, "url": "", "source_branch": "b", "destination_branch": "m"}, "head_commit": "c1"}
    out = str(tmp_path / "runs")
    tables.write_rows(frame(spark, [case]), str(tmp_path / "cases.jsonl"), ["case_id"])
    assert main(["rules", "--cases", str(tmp_path / "cases.jsonl"), "--id", "r", "--repo", "r", "--out", out], spark) == 0
    for action in ("created", "unchanged"):
        assert main(["comment", "--run", "r", "--id", "c", "--post", "--workspace", "w", "--url", fake.url, "--calls-a-minute", "6000", "--out", out], spark) == 0
        assert [(x["pull_request"], x["action"]) for x in tables.read_manifest(f"{out}/c")["log"]] == [(1, action)]
    assert len(fake.comments[1]) == 1
