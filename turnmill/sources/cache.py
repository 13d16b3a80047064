"""Reuse of what has been computed per file: line offsets and token counts, keyed by content and encoder version.

Layout of a cache folder::

    entries/run-<id>/    Parquet: cache_key, line_no, offset, bytes, num_tokens; one folder per run that had work to do
    manifest/run-<id>/   Parquet: cache_key, run, n_lines, n_bytes, n_tokens; one row per file content of that run

A run writes its entries first, then its manifest under a name that readers pass over, and gives the manifest its final name by
one rename.  Readers go by the manifests alone, so a run that was lost in between has left nothing that counts; ``sweep``
removes such leftovers.  Two runs may compute the same content at the same time; the one with the smallest run id is read.

A key says what the bytes are (``content_keys``) and which encoder counted them, so a renamed or copied file is known again,
and a changed byte or another encoder is not.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnmill.session import if_small, stage
from turnmill.sources.readers import content_keys, not_done, number_lines, read_lines

ENTRY = "cache_key string, line_no long, offset long, bytes long, num_tokens long"
MANIFEST = "cache_key string, run string, n_lines long, n_bytes long, n_tokens long"
# Text of this many bytes of paths is read by name; beyond it the whole folder is scanned and filtered.
NAMED_FILES = 1 << 14


class FileCache:
    """A cache folder that driver and executors share.

    ``count`` gives the tokens of a line from its text column (carriage returns included); ``version`` names the encoder
    and all its settings, as ``HashEncoder().version`` does.
    """

    def __init__(self, spark: SparkSession, folder: str, version: str, count: Callable[[Column], Column]) -> None:
        self.spark, self.folder, self.version, self.count = spark, folder.rstrip("/"), version, count

    # ---- the folder

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *parts]))

    def _fs(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _runs(self, part: str) -> list[str]:
        fs, path = self._fs(), self._path(part)
        names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(n for n in names if n.startswith("run-"))

    def manifest(self) -> DataFrame:
        """``MANIFEST``: one row per known content of any encoder version."""
        runs = self._runs("manifest")
        if not runs:
            return self.spark.createDataFrame([], MANIFEST)
        rows = self.spark.read.schema(MANIFEST).parquet(*[f"{self.folder}/manifest/{r}" for r in runs])
        whole = F.min_by(F.struct("run", "n_lines", "n_bytes", "n_tokens"), "run").alias("of")
        return rows.groupBy("cache_key").agg(whole).select("cache_key", "of.*")

    def sweep(self) -> int:
        """Removes entries whose run has no manifest, and unfinished manifests.  Not to be called while a run works."""
        fs, known, gone = self._fs(), set(self._runs("manifest")), 0
        for part in ("entries", "manifest"):
            path = self._path(part)
            for status in fs.listStatus(path) if fs.exists(path) else ():
                name = status.getPath().getName()
                if (part == "entries" and name not in known) or (part == "manifest" and not name.startswith("run-")):
                    gone += bool(fs.delete(status.getPath(), True))
        return gone

    # ---- a run

    def index(self, source: str, suffix: str = "") -> DataFrame:
        """``(path, cache_key, reused, n_lines, n_bytes, n_tokens)`` of every file below ``source``, staged.

        Files whose content is known are only hashed; the others are read, counted and added to the cache.
        """
        keys = stage(content_keys(self.spark, source, self.version, suffix).select("path", "cache_key"), "cache-keys")
        known = self.manifest().select("cache_key")
        todo = stage(not_done(keys, known), "cache-todo")
        if not todo.isEmpty():
            self._compute(source, todo)
        fresh = todo.select(F.col("cache_key").alias("new_key")).distinct()
        rows = keys.join(self.manifest(), "cache_key").join(fresh, F.col("cache_key") == F.col("new_key"), "left")
        return stage(rows.select("path", "cache_key", F.col("new_key").isNull().alias("reused"), "n_lines", "n_bytes", "n_tokens"), "cache-index")

    def lines(self, index: DataFrame) -> DataFrame:
        """``(path, line_no, offset, bytes, num_tokens)`` of the files of ``index``, read back from the entries.

        Only folders of runs that the files belong to are opened.
        """
        wanted = index.select("path", "cache_key").join(self.manifest().select("cache_key", "run"), "cache_key")
        wanted = stage(wanted, "cache-wanted")
        runs = sorted(r["run"] for r in wanted.select("run").distinct().collect())  # one name per run
        if not runs:
            return self.spark.createDataFrame([], "path string, line_no long, offset long, bytes long, num_tokens long")
        entries = self.spark.read.schema(f"{ENTRY}, run string").option("basePath", f"{self.folder}/entries").parquet(
            *[f"{self.folder}/entries/{r}" for r in runs])
        entries = entries.withColumn("run", F.regexp_extract("_metadata.file_path", "/entries/(run-[^/]+)/", 1))
        return entries.join(if_small(wanted), ["cache_key", "run"]).select("path", "line_no", "offset", "bytes", "num_tokens")

    def _compute(self, source: str, todo: DataFrame) -> None:
        run = f"run-{uuid.uuid4().hex}"
        # One path per content: copies are counted once.
        names = stage(todo.groupBy("cache_key").agg(F.min("path").alias("path")), "cache-names")
        if names.count() <= NAMED_FILES:
            listed = [r["path"] for r in names.select("path").collect()]
            lines = read_lines(self.spark, listed)
        else:
            lines = read_lines(self.spark, source)
        # Spark names a local file in two ways; both are brought to one.
        plain = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
        keyed = names.select("cache_key", plain("path").alias("_file"))
        lines = lines.join(if_small(keyed), plain("file") == F.col("_file"), "left_semi")
        numbered = number_lines(lines).join(if_small(keyed), plain("file") == F.col("_file"))
        rows = numbered.select("cache_key", "line_no", "offset", (F.octet_length("value") + 1).cast("long").alias("bytes"),
                               self.count(F.col("value")).cast("long").alias("num_tokens"))
        rows.write.parquet(f"{self.folder}/entries/{run}")
        back = self.spark.read.schema(ENTRY).parquet(f"{self.folder}/entries/{run}")
        # A file without a line has a manifest row as well.
        sums = back.groupBy("cache_key").agg(F.count(F.lit(1)).alias("n_lines"), F.sum("bytes").alias("n_bytes"), F.sum("num_tokens").alias("n_tokens"))
        zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
        manifest = names.join(sums, "cache_key", "left").select("cache_key", F.lit(run).alias("run"), zero("n_lines"), zero("n_bytes"), zero("n_tokens"))
        self._publish(manifest, run)

    def _publish(self, manifest: DataFrame, run: str) -> None:
        manifest.write.parquet(f"{self.folder}/manifest/writing-{run}")
        if not self._fs().rename(self._path("manifest", f"writing-{run}"), self._path("manifest", run)):
            raise OSError(f"{self.folder}/manifest/{run} could not be published")
