"""A folder of lines as a stream that runs over it several times and can be stopped anywhere.

An offset is (epoch, place in the file list, byte).  The list of files with their sizes is taken once, when the stream first
starts, and kept beside the stream's checkpoint, so that a restarted stream cuts the same bytes; files that come later belong to
another stream.  A batch takes at most ``max_bytes`` from where the last one ended, also across files and epochs, and is cut in
pieces of ``part_bytes``, each read by one task.  A line belongs to the piece that holds its first byte.
"""

from __future__ import annotations

import io
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

NAME = "turnmill_epochs"
SCHEMA = "value string, epoch int, file string, offset long"
ARROW = pa.schema([("value", pa.string()), ("epoch", pa.int32()), ("file", pa.string()), ("offset", pa.int64())])
MAX_BYTES = 256 << 20
PART_BYTES = 32 << 20
# Rows and bytes that a task holds before it sends them on.
ROWS, HELD_BYTES = 4096, 1 << 22


def store_of(path: str):
    """``(file system, path)`` as pyarrow sees them; a path without a scheme is a mounted folder."""
    from pyarrow import fs
    path = re.sub("^file:/(?!/)", "file:///", path)
    return fs.FileSystem.from_uri(path) if re.match(r"[a-z0-9]+://", path) else (fs.LocalFileSystem(), path)


def listing(path: str, suffix: str) -> list[tuple[str, int]]:
    """``(path, bytes)`` of the files below a folder that end in ``suffix`` and hold anything, by name."""
    from pyarrow import fs
    store, root = store_of(path)
    found = store.get_file_info(fs.FileSelector(root, recursive=True))
    keep = [(f.path, f.size) for f in found if f.is_file and f.size and f.path.endswith(suffix) and not f.base_name.startswith(("_", "."))]
    return sorted(keep)


def advance(files: list[tuple[str, int]], at: dict, limit: int, epochs: int) -> dict:
    """The offset ``limit`` bytes behind ``at``, or the end of the last epoch."""
    epoch, place, byte = at["epoch"], at["file"], at["byte"]
    while epoch < epochs and files:
        rest = files[place][1] - byte
        if limit < rest:
            return {"epoch": epoch, "file": place, "byte": byte + limit}
        limit -= rest
        place, byte = place + 1, 0
        if place == len(files):
            epoch, place = epoch + 1, 0
    return {"epoch": epoch, "file": place, "byte": byte}


@dataclass
class Piece(InputPartition):
    path: str
    epoch: int
    start: int
    stop: int


def pieces(files: list[tuple[str, int]], start: dict, end: dict, part_bytes: int) -> list[Piece]:
    """What lies between two offsets, in pieces of at most ``part_bytes``."""
    out = []
    epoch, place, byte = start["epoch"], start["file"], start["byte"]
    goal = (end["epoch"], end["file"], end["byte"])
    while (epoch, place, byte) < goal:
        stop = min(byte + part_bytes, files[place][1])
        if (epoch, place) == goal[:2]:
            stop = min(stop, goal[2])
        out.append(Piece(files[place][0], epoch, byte, stop))
        byte = stop
        if byte == files[place][1]:
            place, byte = place + 1, 0
            if place == len(files):
                epoch, place = epoch + 1, 0
    return out


def lines_of(store, path: str, start: int, stop: int) -> Iterator[tuple[int, bytes]]:
    """``(offset, line)`` of the lines whose first byte lies in ``start .. stop``; the line feed is taken off."""
    with store.open_input_file(path) as raw:
        raw.seek(max(start - 1, 0))
        stream = io.BufferedReader(raw, 1 << 20)
        at = start
        if start:  # the line that began before belongs to the piece before, unless it ended just here
            at = start - 1 + len(stream.readline())
        while at < stop:
            line = stream.readline()
            if not line:
                return
            yield at, line[:-1] if line.endswith(b"\n") else line
            at += len(line)


class EpochReader(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.path, self.checkpoint = options["path"], options["checkpoint"].rstrip("/")
        self.suffix, self.epochs = options.get("suffix", ""), int(options.get("epochs", 1))
        self.max_bytes, self.part_bytes = int(options.get("max_bytes", MAX_BYTES)), int(options.get("part_bytes", PART_BYTES))
        self.files: list[tuple[str, int]] | None = None
        self.upto: dict | None = None

    def _start(self) -> None:
        """The kept file list, and the last offset that the checkpoint's log has planned."""
        from pyarrow import fs
        store, root = store_of(self.checkpoint)
        kept = f"{root}/lines-listing.json"
        if store.get_file_info(kept).type == fs.FileType.NotFound:
            store.create_dir(root)
            with store.open_output_stream(f"{kept}.writing") as out:
                out.write(json.dumps(listing(self.path, self.suffix)).encode())
            store.move(f"{kept}.writing", kept)
        with store.open_input_file(kept) as f:
            self.files = [(p, n) for p, n in json.loads(f.read())]
        self.upto = self.initialOffset()
        logged = store.get_file_info(fs.FileSelector(f"{root}/offsets", allow_not_found=True))
        numbers = sorted(int(f.base_name) for f in logged if f.base_name.isdigit())
        if numbers:
            with store.open_input_file(f"{root}/offsets/{numbers[-1]}") as f:
                last = f.read().decode().strip().split("\n")[-1]
            if last.startswith("{"):
                self.upto = json.loads(last)

    def initialOffset(self) -> dict:
        return {"epoch": 0, "file": 0, "byte": 0}

    def latestOffset(self) -> dict:
        if self.files is None:
            self._start()
        return advance(self.files, self.upto, self.max_bytes, self.epochs)

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        if self.files is None:
            self._start()
        self.upto = end
        return pieces(self.files, start, end, self.part_bytes)

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        store, _ = store_of(self.path)
        held: list[tuple[int, bytes]] = []
        size = 0

        def batch() -> pa.RecordBatch:
            n = len(held)
            return pa.RecordBatch.from_arrays([
                pa.array([line.decode("utf-8", "replace") for _, line in held], pa.string()), pa.array([partition.epoch] * n, pa.int32()),
                pa.array([partition.path] * n, pa.string()), pa.array([at for at, _ in held], pa.int64())], schema=ARROW)
        for found in lines_of(store, partition.path, partition.start, partition.stop):
            held.append(found)
            size += len(found[1])
            if len(held) == ROWS or size >= HELD_BYTES:
                yield batch()
                held, size = [], 0
        if held:
            yield batch()


class EpochSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> EpochReader:
        return EpochReader(self.options)


def epoch_stream(spark: SparkSession, path: str, checkpoint: str, *, epochs: int = 1, suffix: str = "", max_bytes: int = MAX_BYTES,
                 part_bytes: int = PART_BYTES) -> DataFrame:
    """``(value, epoch, file, offset)``: every line below ``path``, once per epoch.

    ``checkpoint`` is the checkpoint folder of the query that reads the stream, its only source; started again with the same
    folder, the query goes on where it stopped.
    """
    spark.dataSource.register(EpochSource)
    reader = spark.readStream.format(NAME).option("path", path).option("checkpoint", checkpoint).option("epochs", epochs)
    return reader.option("suffix", suffix).option("max_bytes", max_bytes).option("part_bytes", part_bytes).load()


def run_epochs(lines: DataFrame, out: str, checkpoint: str, batches: int | None = None) -> None:
    """Write the stream to Parquet until its last epoch ends, or until ``batches`` more batches are done."""
    query = lines.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).start()
    try:
        if batches is None:
            query.processAllAvailable()
        else:
            seen = 0
            while seen < batches and query.isActive:
                query.awaitTermination(0.05)
                seen = len([p for p in query.recentProgress if p["numInputRows"]])
    finally:
        query.stop()
        if query.exception():
            raise query.exception()
