"""Repository snapshots in tar.gz archives, one a commit: read from front to back, so no more than one member and a buffer are in memory."""

from __future__ import annotations

import gzip
import tarfile
from collections.abc import Iterator
from typing import BinaryIO

import pandas as pd
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text that a task hands on at once, and what is read of an archive at once.
BATCH_CHARS, BUFFER = 8 << 20, 1 << 20


def tar_members(packed: BinaryIO) -> Iterator[tuple[str, str]]:
    """(path without its top folder, text) of regular files that are UTF-8, as they come out of the stream. An archive that breaks off fails, at the latest behind its last member."""
    with gzip.GzipFile(fileobj=packed) as plain, tarfile.open(fileobj=plain, mode="r|", bufsize=BUFFER) as archive:
        for member in archive:
            archive.members = []  # the archive would keep the headers of all that were read
            path = member.name.partition("/")[2]
            if not member.isfile() or not path:
                continue
            try:
                yield path, archive.extractfile(member).read().decode("utf-8")
            except UnicodeDecodeError:
                continue
        while plain.read(BUFFER):  # up to the checksum
            pass


def batched(members: Iterator[tuple[str, str]]) -> Iterator[list[tuple[str, str]]]:
    """Members in lists of some megabytes."""
    rows, size = [], 0
    for path, text in members:
        rows.append((path, text))
        size += len(text)
        if size >= BATCH_CHARS:
            yield rows
            rows, size = [], 0
    if rows:
        yield rows


def unpack(archives: DataFrame) -> DataFrame:
    """archives (commit, place: where the archive is) -> commit, path, text. Tasks open the archives themselves; their bytes are in no row."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for commit, place in frame.itertuples(index=False):
                store, path = pyarrow.fs.FileSystem.from_uri(place)
                with store.open_input_file(path) as packed:
                    for rows in batched(tar_members(packed)):
                        yield pd.DataFrame([(commit, path, text) for path, text in rows], columns=["commit", "path", "text"])

    return archives.select("commit", "place").mapInPandas(read, "commit string, path string, text string")


def read_trees(spark: SparkSession, folder: str) -> DataFrame:
    """Archives named <commit>.tar.gz -> commit, path, text."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tar.gz").load(folder)
    place = F.regexp_replace("path", "^file:/+", "file:///")
    return unpack(files.select(F.regexp_extract("path", r"([^/]+)\.tar\.gz$", 1).alias("commit"), place.alias("place")))
