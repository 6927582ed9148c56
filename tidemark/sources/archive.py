"""Members of tar archives as rows, from their headers alone.

A Python data source: archives are listed by Spark, each is one partition, and a reader goes from header to
header, so that members' contents are never read. It goes on from an offset if an index has been begun. Archives are opened through
pyarrow's file systems (local files, HDFS, S3).
"""

from __future__ import annotations

import io
import tarfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

BLOCK = 512
INDEX = "archive string, name string, kind string, header_offset bigint, data_offset bigint, size bigint, next_offset bigint"


def opened(path: str):
    """A file of any file system that pyarrow knows, to be read from any place."""
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    return system.open_input_file(at)


def created(path: str):
    """A new file of any file system that pyarrow knows, written from front to back."""
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    system.create_dir(at.rsplit("/", 1)[0], recursive=True)
    return system.open_output_stream(at)


def write_archives(rows: DataFrame, path: str) -> DataFrame:
    """(archive, members): tar files at ``path`` of (archive, place, name, data), members in the order of their
    place. Each archive is one task's stream; no more than a member of it is held. A task that is run again
    writes its archives anew."""
    def run(batches):
        out, name, n = None, None, 0

        def close():
            out.close()
            stream.close()
            return pa.RecordBatch.from_arrays([pa.array([name], pa.string()), pa.array([n], pa.int64())], names=["archive", "members"])

        for batch in batches:
            for archive, member, data in zip(batch.column("archive").to_pylist(), batch.column("name").to_pylist(), batch.column("data")):
                if archive != name:
                    if out is not None:
                        yield close()
                    name, n, stream = archive, 0, created(f"{path}/{archive}.tar")
                    out = tarfile.open(fileobj=stream, mode="w|")
                raw, info = data.as_py() or b"", tarfile.TarInfo(member)
                info.size = len(raw)
                out.addfile(info, io.BytesIO(raw))
                n += 1
        if out is not None:
            yield close()

    dealt = rows.select("archive", "place", "name", "data").repartition("archive").sortWithinPartitions("archive", "place")
    return dealt.select("archive", "name", "data").mapInArrow(run, "archive string, members bigint")


def number(field: bytes) -> int:
    """A number of a header: octal digits, or binary where the first bit is set."""
    if field[:1] >= b"\x80":
        return int.from_bytes(bytes([field[0] & 0x7F]) + field[1:], "big")
    digits = field.strip(b" \0")
    return int(digits, 8) if digits else 0


def text(field: bytes) -> str:
    return field.split(b"\0", 1)[0].decode("utf-8", "surrogateescape").encode("utf-8", "replace").decode()


def extended(data: bytes) -> dict[str, str]:
    """The records ``length key=value`` of an extended header."""
    out, at = {}, 0
    while at < len(data) and data[at : at + 1] not in (b"", b"\0"):
        size, _, _ = data[at:].partition(b" ")
        record = data[at + len(size) + 1 : at + int(size) - 1]
        key, _, value = record.partition(b"=")
        out[key.decode()] = value.decode("utf-8", "replace")
        at += int(size)
    return out


def header(block: bytes, where: str) -> dict | None:
    """What a header says; None for the block of zeros at the end. A wrong checksum is an error."""
    if len(block) < BLOCK:
        raise ValueError(f"{where}: the archive ends within a header")
    if not any(block):
        return None
    if sum(block[:148]) + 8 * 32 + sum(block[156:]) != number(block[148:156]):
        raise ValueError(f"{where}: no header here, the checksum differs")
    folder = text(block[345:500]) if block[257:262] == b"ustar" and block[257:265] != b"ustar  \0" else ""
    return {"name": f"{folder}/{text(block[:100])}" if folder else text(block[:100]), "size": number(block[124:136]), "kind": chr(block[156] or 48)}


def members(path: str, start: int = 0) -> Iterator[tuple]:
    """INDEX rows of an archive from the header at ``start`` on."""
    with opened(path) as file:
        end, at, long_name, more = file.size(), start, None, {}
        begun = at
        while at < end:
            file.seek(at)
            own = header(file.read(BLOCK), f"{path} at {at}")
            if own is None:
                return
            size = int(more.get("size", own["size"]))
            data, after = at + BLOCK, at + BLOCK + -(-size // BLOCK) * BLOCK
            if data + size > end:
                raise ValueError(f"{path} at {at}: the member goes past the archive's end")
            if own["kind"] in "LKxg":  # what they hold is about the next member, which they belong to
                held = file.read(size)
                if own["kind"] == "L":
                    long_name = text(held)
                elif own["kind"] == "x":
                    more = extended(held)
            else:
                name = more.get("path") or long_name or own["name"]
                yield path, name.rstrip("/"), own["kind"], begun, data, size, after
                long_name, more, begun = None, {}, after
            at = after


class Archives(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tar_members"

    def schema(self) -> str:
        return INDEX

    def reader(self, schema) -> DataSourceReader:
        return Reader(self.options)


class Reader(DataSourceReader):
    def __init__(self, options):
        self.places = [x.rsplit("|", 1) for x in options["places"].split("\n")]

    def partitions(self):
        return [InputPartition((path, int(start))) for path, start in self.places]

    def read(self, partition):
        yield from members(*partition.value)


def archive_index(spark: SparkSession, path: str | list[str], begun: DataFrame | None = None) -> DataFrame:
    """INDEX rows of all archives at these paths. With ``begun``, an index of before, only members
    after its last ones are read; its archives are taken to have grown at the end only."""
    found = spark.read.format("binaryFile").load(path).select("path")  # names alone: contents are not read
    last = None if begun is None else begun.groupBy("archive").agg(F.max("next_offset").alias("start"))
    places = found.withColumn("start", F.lit(0)) if last is None else found.join(last, found.path == last.archive, "left").select("path", F.coalesce("start", F.lit(0)).alias("start"))
    rows = sorted((r.path, r.start) for r in places.collect())  # a row an archive
    if not rows:
        return spark.createDataFrame([], INDEX)
    spark.dataSource.register(Archives)
    return spark.read.format("tar_members").option("places", "\n".join(f"{p}|{s}" for p, s in rows)).load()
