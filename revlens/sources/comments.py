"""The sink of comments: planned comments are dealt to tasks by pull request, posted there, and logged one by one as they are made.

What a task did survives it in the log; what it had posted without logging it is found on the forge by the task that is tried in its place.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .answerlog import Asker, answered
from .forge import SECRET, USER, ForgeClient, ForgeError, upsert

POSTS = "case_id string, pull_id long, findings int, action string, comment_id long, error string"
#: Tasks that post, and calls a minute that they make together: each keeps to its own share, so none has to know of the others.
TASKS, CALLS_A_MINUTE = 8, 600


def same_commit(one: str | None, other: str | None) -> bool:
    """Commits may be shortened; one that isn't known is no other."""
    return not one or not other or one.startswith(other) or other.startswith(one)


def posted(
    plan: DataFrame, url: str, workspace: str, repo: str, is_ours: Callable[[dict], bool], log: str, tasks: int = TASKS, calls_a_minute: float = CALLS_A_MINUTE, wait: float = 1.0
) -> DataFrame:
    """plan (case_id, pull_id, findings, body, head_commit) -> POSTS: created, updated, unchanged, moved (the source is no longer the commit that was read; nothing is posted) or failed. One failure doesn't stop
    the others; a refused credential fails the job. `log` is a folder of the shared storage: what it has without error is not posted again. Tasks take credentials from their environment."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        client = ForgeClient(url, os.environ.get(USER, ""), os.environ.get(SECRET, ""), wait=wait, pace=60.0 * tasks / calls_a_minute)
        for batch in batches:
            for row in batch.to_pylist():
                told = {k: row[k] for k in ("case_id", "pull_id", "findings")} | {"comment_id": None, "error": ""}
                try:
                    now = client.pull_request(workspace, repo, row["pull_id"])["source"]["commit"]["hash"]
                    if same_commit(now, row["head_commit"]):
                        told["action"], told["comment_id"] = upsert(client, workspace, repo, row["pull_id"], row["body"], is_ours)
                    else:
                        told["action"] = "moved"
                except ForgeError as e:
                    if e.status in (401, 403):
                        raise
                    told |= {"action": "failed", "error": str(e)}
                yield told

    deal = Asker(lambda rows: rows.repartition(tasks, "pull_id").sortWithinPartitions("pull_id", "case_id"), post)
    return answered(plan.select("case_id", "pull_id", "findings", "body", "head_commit"), deal, POSTS, log)
