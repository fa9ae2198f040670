"""Pull requests as they move: a stream whose offsets count polls, and cases made of each batch.

A poll asks every repository for what was updated since the last one and logs the answer under a folder of the shared storage before Spark hears of it; batches are read from that
log. So a batch that is run again has the same rows, whatever has moved since, and a poll that Spark had not noted when the driver died is in the next batch.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from datetime import datetime, timedelta
from itertools import chain
from urllib.parse import quote

import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery

from .. import schemas
from ..operators.changes import nested
from ..plans import stages
from ..sources import forge
from ..sources.answerlog import qualified
from ..sources.scratch import Owned

#: A poll asks again for so much before the last update it saw: updates may become visible in another order than that of their times.
OVERLAP_SECONDS = 60
_DONE = "_polled.json"


def _time(pull: dict) -> datetime:
    return datetime.fromisoformat(pull["updated_on"])


class Position:
    """How far a repository has been read: the last update, and the updates within the overlap before it, by pull request."""

    def __init__(self, last: str | None = None, seen: dict[str, str] | None = None):
        self.last, self.seen = last, dict(seen or {})

    def since(self, overlap: float) -> str | None:
        return self.last and (datetime.fromisoformat(self.last) - timedelta(seconds=overlap)).isoformat()

    def fresh(self, pull: dict) -> bool:
        return self.seen.get(str(pull["id"])) != pull["updated_on"]

    def take(self, pull: dict, overlap: float) -> None:
        self.seen[str(pull["id"])] = pull["updated_on"]
        if self.last is None or _time(pull) > datetime.fromisoformat(self.last):
            self.last = pull["updated_on"]
            start = datetime.fromisoformat(self.since(overlap))
            self.seen = {k: t for k, t in self.seen.items() if datetime.fromisoformat(t) >= start}

    def state(self) -> dict:
        return {"last": self.last, "seen": self.seen}


def moved(client: forge.ForgeClient, workspace: str, repository: str, states: list[str], position: Position, overlap: float) -> Iterator[dict]:
    """Pull requests updated since the position, which moves along, oldest first. A page that had news is followed by a new question from the new position, not by its next page: pages
    shift while pull requests move, and one would be passed over."""
    base = f"repositories/{workspace}/{repository}/pullrequests?{'&'.join(f'state={s}' for s in states)}&pagelen=50&sort=updated_on"
    url = None
    while True:
        start = position.since(overlap)
        url = url or base + (f"&q={quote(f'updated_on >= {start}')}" if start else "")
        page = json.loads(client.send("GET", url))
        least = start and datetime.fromisoformat(start)
        news = [p for p in page.get("values", []) if (least is None or _time(p) >= least) and position.fresh(p)]
        for pull in news:
            position.take(pull, overlap)
            yield pull
        url = None if news else page.get("next")
        if not news and not url:
            return


class _Part(InputPartition):
    def __init__(self, repository: str, files: list[str]):
        super().__init__(repository)
        self.repository, self.files = repository, files


class _Polls(DataSourceStreamReader):
    """Options: url, workspace, repositories (a,b), log, state (OPEN or several, by comma), overlap (seconds). Credentials come from the environment, as for pull_requests."""

    def __init__(self, options: dict, kind):
        self.options, self.kind = options, kind
        self.overlap = float(options.get("overlap", OVERLAP_SECONDS))

    def _store(self) -> tuple[pyarrow.fs.FileSystem, str]:
        store, folder = pyarrow.fs.FileSystem.from_uri(self.options["log"])
        store.create_dir(folder, recursive=True)
        return store, folder

    def _polls(self, store: pyarrow.fs.FileSystem, folder: str) -> int:
        """How many polls have ended; they are numbered without gaps."""
        there = store.get_file_info(pyarrow.fs.FileSelector(folder))
        return sum(i.type == pyarrow.fs.FileType.Directory and i.base_name.isdigit() for i in there)

    def initialOffset(self) -> dict:
        return {"polls": 0}

    def latestOffset(self) -> dict:
        store, folder = self._store()
        n = self._polls(store, folder)
        before = json.loads(store.open_input_stream(f"{folder}/{n - 1:08d}/{_DONE}").read()) if n else {}
        client, fresh, positions = forge.client_of(self.options), f"{folder}/.{n:08d}-{os.getpid()}", dict(before)
        store.create_dir(fresh, recursive=True)
        any_moved = False
        for repository in forge.names_of(self.options):
            position = Position(**before.get(repository, {}))
            found = moved(client, self.options["workspace"], repository, self.options.get("state", "OPEN").split(","), position, self.overlap)
            first = next(found, None)
            if first is None:
                continue
            any_moved = True
            with store.open_output_stream(f"{fresh}/{quote(repository, safe='')}.jsonl") as out:
                for pull in chain([first], found):
                    out.write(json.dumps(pull).encode() + b"\n")
            positions[repository] = position.state()
        if not any_moved:
            store.delete_dir(fresh)
            return {"polls": n}
        with store.open_output_stream(f"{fresh}/{_DONE}") as out:
            out.write(json.dumps(positions).encode())
        store.move(fresh, f"{folder}/{n:08d}")
        return {"polls": n + 1}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        store, folder = self._store()
        parts = []
        for repository in forge.names_of(self.options):
            names = [f"{folder}/{n:08d}/{quote(repository, safe='')}.jsonl" for n in range(start["polls"], end["polls"])]
            there = [i.path for i in store.get_file_info(names) if i.type == pyarrow.fs.FileType.File] if names else []
            if there:
                parts.append(_Part(repository, there))
        return parts

    def read(self, partition: _Part) -> Iterator[tuple]:
        """Of a pull request that moved more than once within a batch, the last state."""
        store, _ = pyarrow.fs.FileSystem.from_uri(self.options["log"])
        last: dict[int, dict] = {}
        for path in partition.files:
            for line in store.open_input_stream(path).read().splitlines():
                pull = json.loads(line)
                last[pull["id"]] = pull
        for pull in last.values():
            yield forge.shaped({**pull, "repository": partition.repository, "updated_on": _time(pull)}, self.kind)


class PullUpdates(DataSource):
    """spark.readStream.format("pull_updates").option(...).load(): repository, updated_on, and the fields of a pull request."""

    @classmethod
    def name(cls) -> str:
        return "pull_updates"

    def schema(self) -> str:
        return f"repository string, updated_on timestamp, {schemas.PULLS}"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Polls(dict(self.options), schema)


def pull_stream(spark: SparkSession, url: str, workspace: str, repositories: str, log: str, state: str = "OPEN", overlap: float = OVERLAP_SECONDS) -> DataFrame:
    """Pull requests (of repositories a,b) that moved, poll by poll. `log` belongs to one stream: a second one over the same folder would take its polls."""
    spark.dataSource.register(PullUpdates)
    options = {"url": url, "workspace": workspace, "repositories": repositories, "log": qualified(spark, log), "state": state, "overlap": str(overlap)}
    return spark.readStream.format("pull_updates").options(**options).load()


def case_batches(stream: DataFrame, out: str, checkpoint: str, url: str, workspace: str, repository: str, web_url: str | None = None, every: str | None = None) -> StreamingQuery:
    """Cases of the pull requests of one repository that moved, written under batch=<id>; a replayed batch overwrites its own output. Diffs and snapshots are fetched once a batch, by
    tasks. With `every` ("30 seconds") it polls on; without, it takes what there is and ends."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark, own = batch.sparkSession, Owned(batch.sparkSession)
        pulls = own.keep(batch.filter(F.col("repository") == repository), "moved")
        files = own.keep(forge.pull_files(forge.pull_ends(pulls), url, workspace, web_url), "moved_files")
        diffs = files.filter("path IS NULL").select("pull_id", F.col("text").alias("diff"))
        trees = files.filter("path IS NOT NULL").select("commit", "path", "text").dropDuplicates(["commit", "path"])
        keys = spark.createDataFrame([], f"pull_id long, head_commit string, is_defective boolean, findings array<{schemas.FINDING}>")
        cases = nested(stages.ingest_changes(pulls, diffs, trees, keys, keep=own.keep)).select(*stages.CASE_COLUMNS)
        cases.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        own.drop()

    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
