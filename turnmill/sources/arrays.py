"""JSON arrays as a sink: many files, each one valid array, all or none of them.

Tasks write below ``<path>/_writing-<job>/`` and report what they wrote; the job's end gives the reported files their final names
and then writes ``_manifest/<job>.json``, their list.  A task that fails removes its files; files of lost attempts are reported by
nobody and go with the job's folder, which both ends of the job remove.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from contextlib import suppress
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from turnmill.streaming.epochs import store_of

NAME = "turnmill_json_arrays"
SHARD_BYTES = 64 << 20


@dataclass
class Written(WriterCommitMessage):
    """``files``: (temporary name, records, bytes) of one task."""

    files: list[tuple[str, int, int]] = field(default_factory=list)


class ArrayWriter(DataSourceArrowWriter):
    def __init__(self, path: str, shard_bytes: int) -> None:
        self.path, self.shard_bytes, self.job = path.rstrip("/"), shard_bytes, uuid.uuid4().hex[:12]

    def _folder(self):
        store, root = store_of(self.path)
        return store, root, f"{root}/_writing-{self.job}"

    def write(self, iterator: Iterator) -> Written:
        store, _, folder = self._folder()
        store.create_dir(folder, recursive=True)
        done = Written()
        out, name, records, size = None, "", 0, 0
        try:
            for batch in iterator:
                for text in batch.column(0).to_pylist():
                    data = text.encode("utf-8", "surrogatepass")
                    if out is not None and size + len(data) > self.shard_bytes:
                        out.write(b"\n]\n")
                        out.close()
                        done.files.append((name, records, size + 3))
                        out = None
                    if out is None:
                        name, records, size = f"{uuid.uuid4().hex}.json", 0, 0
                        out = store.open_output_stream(f"{folder}/{name}")
                    lead = b",\n" if records else b"[\n"
                    out.write(lead + data)
                    records, size = records + 1, size + len(lead) + len(data)
            if out is not None:
                out.write(b"\n]\n")
                out.close()
                done.files.append((name, records, size + 3))
                out = None
        except BaseException:
            if out is not None:
                out.close()
                done.files.append((name, 0, 0))
            for made, _, _ in done.files:
                with suppress(FileNotFoundError):  # the job's end may have been quicker
                    store.delete_file(f"{folder}/{made}")
            raise
        return done

    def commit(self, messages: list[Written | None]) -> None:
        store, root, folder = self._folder()
        store.create_dir(root, recursive=True)
        listed = []
        for k, (name, records, size) in enumerate(f for m in messages if m for f in m.files):
            final = f"part-{self.job}-{k:06d}.json"
            store.move(f"{folder}/{name}", f"{root}/{final}")
            listed.append({"name": final, "records": records, "bytes": size})
        store.create_dir(f"{root}/_manifest", recursive=True)
        with store.open_output_stream(f"{root}/_manifest/{self.job}.json") as out:
            out.write(json.dumps(listed).encode())
        self._clear(store, folder)

    def abort(self, messages: list[Written | None]) -> None:
        store, _, folder = self._folder()
        self._clear(store, folder)

    @staticmethod
    def _clear(store, folder: str) -> None:
        from pyarrow import fs
        # Tasks that are being stopped may remove or add files meanwhile.
        for _ in range(20):
            if store.get_file_info(folder).type == fs.FileType.NotFound:
                return
            with suppress(OSError):
                store.delete_dir(folder)
            time.sleep(0.05)


class ArraySink(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "value string"

    def writer(self, schema, overwrite: bool) -> ArrayWriter:
        if overwrite:
            raise ValueError("arrays are added to a folder, never written over")
        return ArrayWriter(self.options["path"], int(self.options.get("shard_bytes", SHARD_BYTES)))


def write_arrays(rows: DataFrame, path: str, *, shard_bytes: int = SHARD_BYTES) -> None:
    """Every row as one JSON object of an array; shards are closed before they exceed ``shard_bytes``.

    A single larger record is a shard of its own.  Null columns are left out of their object.
    """
    rows.sparkSession.dataSource.register(ArraySink)
    value = F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns])).alias("value")
    rows.select(value).write.format(NAME).mode("append").option("path", path).option("shard_bytes", shard_bytes).save()


def committed(spark: SparkSession, path: str) -> DataFrame:
    """``(name, records, bytes)`` of the shards of all committed jobs below ``path``."""
    return spark.read.schema("name string, records long, bytes long").json(f"{path.rstrip('/')}/_manifest", multiLine=True)
