"""Members of tar archives as records, without unpacking to disk.

A compressed tar cannot be split: there is one task per archive. Of a plain one the headers are read
first, and its members are dealt over tasks. Records leave a task one by one, so shuffling or writing
them afterwards spreads them over the cluster.
"""
from __future__ import annotations

import fnmatch
import io
import json
import tarfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from tabscout.session import written
from tabscout.sources.files import BATCH_ROWS, csv_records, filesystem, json_tables, list_files, open_stream


class _Member(io.RawIOBase):
    """A member of a streamed archive; tarfile's own object cannot be buffered there."""

    def __init__(self, member):
        self.member = member

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        data = self.member.read(len(buffer))
        buffer[:len(data)] = data
        return len(data)


def _plain(value):
    return value.decode("utf-8", errors="replace") if isinstance(value, (bytes, bytearray)) else str(value)


def _member_records(name: str, stream) -> Iterator[str]:
    """Each record of one member as JSON text."""
    if name.endswith(".jsonl"):
        for line in io.TextIOWrapper(stream, encoding="utf-8", errors="replace"):
            if line.strip():
                yield line.strip()
    elif name.endswith(".parquet"):
        import pyarrow.parquet as pq

        for batch in pq.ParquetFile(io.BytesIO(stream.read())).iter_batches(BATCH_ROWS):
            for row in batch.to_pylist():
                yield json.dumps(row, default=_plain)
    elif name.endswith(".csv"):
        header = None
        for record in csv_records(stream):
            if header is None:
                header = record
            else:
                yield json.dumps(dict(zip(header, record + [None] * (len(header) - len(record)))))
    elif name.endswith(".json"):
        for entry in json_tables(stream.read().decode("utf-8", errors="replace")):
            yield json.dumps(entry)


def _wanted(name: str, globs, but) -> bool:
    return any(fnmatch.fnmatch(name, g) for g in globs) and not any(fnmatch.fnmatch(name, g) for g in but)


COLUMNS = ["archive", "member_no", "member", "idx", "record", "error"]


class _Stretch(io.RawIOBase):
    """``length`` bytes of a seekable file from ``offset`` on."""

    def __init__(self, file, offset: int, length: int):
        file.seek(offset)
        self.file, self.left = file, length

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        data = self.file.read(min(len(buffer), self.left))
        buffer[:len(data)] = data
        self.left -= len(data)
        return len(data)


def _told(broken: Exception) -> str:
    return f"{type(broken).__name__}: {broken}"


def _records(path: str, number: int, name: str, stream) -> Iterator[tuple]:
    """Rows of one member; a last one tells where it breaks off."""
    i = -1
    try:
        for i, record in enumerate(_member_records(name, io.BufferedReader(stream))):
            yield path, number, name, i, record, None
    except ValueError as broken:  # not what the name says; other members are read
        yield path, number, name, i + 1, None, _told(broken)


def _frames(rows: Iterator[tuple], columns: list[str]) -> Iterator[pd.DataFrame]:
    batch = []
    for r in rows:
        batch.append(r)
        if len(batch) == BATCH_ROWS:
            yield pd.DataFrame(batch, columns=columns)
            batch = []
    if batch:
        yield pd.DataFrame(batch, columns=columns)


_SCHEMA = "archive string, member_no int, member string, idx bigint, record string, error string"
_INDEX = ["archive", "member_no", "member", "offset", "length", "error"]


def member_index(spark: SparkSession, root: str, members: list[str], exclude: list[str] = (), glob: str = "*.tar") -> DataFrame:
    """(archive, member_no, member, offset, length, error) of uncompressed archives, from their headers alone.

    A file that is called .tar but is compressed has one row, numbered -1.
    """
    members, exclude = list(members), list(exclude)

    def headers(path: str) -> Iterator[tuple]:
        number = -1
        try:
            where, inner = filesystem(path)
            with where.open_input_file(inner) as raw, tarfile.open(fileobj=raw, mode="r:") as tar:
                number = 0
                for info in tar:  # seeks from header to header
                    if info.isfile() and _wanted(info.name, members, exclude):
                        yield path, number, info.name, info.offset_data, info.size, None
                        number += 1
        except (OSError, EOFError, tarfile.TarError) as broken:  # the rest of the archive is lost
            yield path, number, None, -1, -1, _told(broken)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path in pdf["path"]:
                yield from _frames(headers(path), _INDEX)

    plain = list_files(spark, root, glob).where(F.col("path").endswith(".tar"))
    return plain.mapInPandas(read, "archive string, member_no int, member string, offset bigint, length bigint, error string")


def _streamed(path: str, members: list[str], exclude: list[str]) -> Iterator[tuple]:
    """Rows of all members, in the order of the archive."""
    number = 0
    try:
        with open_stream(path) as raw, tarfile.open(fileobj=raw, mode="r|*") as tar:
            for info in tar:
                if info.isfile() and _wanted(info.name, members, exclude):
                    yield from _records(path, number, info.name, _Member(tar.extractfile(info)))
                    number += 1
    except (OSError, EOFError, tarfile.TarError) as broken:  # the rest of the archive is lost
        yield path, number, None, -1, None, _told(broken)


def _scan(spark: SparkSession, root: str, members: list[str], exclude: list[str], glob: str) -> DataFrame:
    """COLUMNS: records of the members matching a pattern, and where a member or archive breaks off."""
    members, exclude = list(members), list(exclude)

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path in pdf["path"]:
                yield from _frames(_streamed(path, members, exclude), COLUMNS)

    def one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, number, name, offset, length, error in pdf[_INDEX].itertuples(index=False):
                if number < 0:
                    yield from _frames(_streamed(path, members, exclude), COLUMNS)
                elif name is None:
                    yield pd.DataFrame([(path, number, None, -1, None, error)], columns=COLUMNS)
                else:
                    where, inner = filesystem(path)
                    with where.open_input_file(inner) as raw:
                        yield from _frames(_records(path, number, name, _Stretch(raw, offset, length)), COLUMNS)

    streams = list_files(spark, root, glob).where(~F.col("path").endswith(".tar")).mapInPandas(whole, _SCHEMA)
    index = written(member_index(spark, root, members, exclude, glob), "members")
    n = index.count()
    if not n:
        return streams
    # a given number of tasks: by their size alone these few rows would end up in one
    tasks = min(n, 4 * spark.sparkContext.defaultParallelism)
    return streams.unionByName(index.repartition(tasks, "archive", "member_no").mapInPandas(one, _SCHEMA))


def read_archives(
    spark: SparkSession, root: str, members: list[str], exclude: list[str] = (), glob: str = "*.tar*"
) -> DataFrame:
    """(archive, member_no, member, idx, record): records of the members matching a pattern.

    JSON and JSONL entries, Parquet rows and CSV rows all come as JSON text; a member that cannot
    be parsed is left where it breaks. ``archive_errors`` tells which.
    """
    return _scan(spark, root, members, exclude, glob).where("error is null").drop("error")


def archive_errors(
    spark: SparkSession, root: str, members: list[str], exclude: list[str] = (), glob: str = "*.tar*"
) -> DataFrame:
    """(archive, member_no, member, idx, error): where members or whole archives cannot be read on."""
    return _scan(spark, root, members, exclude, glob).where("error is not null").drop("record")


# member patterns by dataset format (fixed values)
TABLES_JSON = ["*tables.json", "*.jsonl"]
FORMATS = {
    "tables_json": (TABLES_JSON, []),
    "schema_json": (["*tables.json"], ["*checkpoint*"]),
    "corpus_parquet": (["*/corpus/*.parquet"], []),
    "validation_parquet": (["*validation.parquet"], []),
    "folder_csv": (["*/tables/*.csv"], ["*/tables_with_ids/*"]),
    "folder_json": (["*.json"], ["*metadata.json"]),
}


def read_archive_format(spark: SparkSession, root: str, fmt: str, glob: str = "*.tar*") -> DataFrame:
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}; known: {sorted(FORMATS)}")
    members, exclude = FORMATS[fmt]
    return read_archives(spark, root, members, exclude, glob)


def collection_of(member: str = "member"):
    """``database__table`` of a CSV member, ``corpus_{split}`` of a corpus split."""
    m = F.col(member)
    folder = F.concat(
        F.regexp_extract(m, r"([^/]+)/tables/[^/]+$", 1), F.lit("__"), F.regexp_extract(m, r"([^/]+)\.csv$", 1)
    )
    split = F.concat(F.lit("corpus_"), F.regexp_extract(m, r"([^/]+)\.parquet$", 1))
    return F.when(m.endswith(".csv"), folder).otherwise(split)
