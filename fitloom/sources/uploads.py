"""Gate for uploaded documents."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fitloom import rules
from fitloom.functions.text import is_blank, truncate
from fitloom.plans.materialize import cut


# Files that a task of Spark's reader takes.
TASK_FILES = 256
# Tasks that list the folders of a mounted disk, and about how many bytes they hand over at a time.
MOST_TASKS = 1024
BATCH_BYTES = 4_000_000


def utf8(content: Column) -> Column:
    """Plain text; null for bytes that are no UTF-8."""
    return F.try_validate_utf8(content.cast("string"))


def file_extension(name):
    """Lower-case suffix of the file name, '' when there is none."""
    return F.lower(F.regexp_extract(name, r"[^/](\.[^./]+)$", 1))


def _local_path(spark: SparkSession, folder: str) -> str | None:
    """Plain path of a folder on a mounted disk, None on any other file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    uri = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toUri()
    return uri.getPath() if uri.getScheme() == "file" else None


def _files_written(folder: str):
    """Function that writes rows (bucket, place, name, value) as files of their own and returns them without the value.
    A file gets its name when it is whole, so a task that runs again changes nothing."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        home = None
        for batch in batches:
            for bucket, place, value in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3))):
                if home != (home := f"{folder}/bucket={bucket}"):
                    os.makedirs(home, exist_ok=True)
                part = f"{home}/_{uuid.uuid4().hex}"
                with open(part, "wb") as f:
                    f.write((value or b"") + b"\n")
                os.replace(part, f"{home}/part-c{place:03d}.txt")
            yield batch.select(["bucket", "place", "name"])
    return run


def write_uploads(named: DataFrame, folder: str, per_folder: int = 250, mounted: bool = True) -> DataFrame:
    """Write each row of ``named`` (name, value) to a file of its own below ``folder``: its text and a line end.

    Files have names of their own; about ``per_folder`` of them lie together, and one task writes those. Returns the
    names that `read_uploads` needs: (bucket, place, name). On a mounted disk tasks write the files themselves:
    without its native library Hadoop starts a process for each local file. Elsewhere, or if ``mounted`` is
    false, Spark's writer makes the same files from stored rows, so a task that runs again writes the same ones.
    """
    n = max(1, -(-named.count() // per_folder))
    bucket = F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    place = F.row_number().over(Window.partitionBy("bucket").orderBy("row")) - 1
    rows = named.select("name", "value", F.monotonically_increasing_id().alias("row")).withColumn("bucket", bucket)
    placed = rows.select("bucket", place.alias("place"), "name", F.col("value").cast("binary").alias("value"))
    local = _local_path(named.sparkSession, folder) if mounted else None
    if local is not None:
        os.makedirs(local, exist_ok=True)
        return cut(placed.mapInArrow(_files_written(local), "bucket int, place int, name string"))
    placed = cut(placed)
    (placed.repartitionById(n, "bucket").sortWithinPartitions("bucket", "place").select("bucket", F.col("value").cast("string"))
     .write.partitionBy("bucket").option("maxRecordsPerFile", 1).text(folder))
    return placed.select("bucket", "place", "name")


def _listed(files: DataFrame) -> list[str]:
    """Path of every file that was listed, empty ones too, fetched in one call instead of one for each."""
    uris = files.sparkSession._jvm.org.apache.hadoop.util.StringUtils.join("\n", files._jdf.inputFiles())
    return [re.sub(r"^(\w+):///", r"\1:/", unquote(uri)) for uri in uris.split("\n") if uri]


def _folders(top: str) -> list[str]:
    """A folder and all below it whose names Spark's readers don't skip."""
    found = []
    for home, below, _ in os.walk(top, followlinks=True):
        below[:] = [n for n in below if not _hidden(n)]
        found.append(home)
    return found


def _hidden(name: str) -> bool:
    """Whether Spark's readers skip a file or folder of this name."""
    return name[0] == "." or name[0] == "_" and "=" not in name or name.endswith("._COPYING_")


def _files_read(max_bytes: int):
    """Function that turns folders into their files: path, n_bytes, and the content of those with 1 to ``max_bytes`` bytes."""
    def rows(folder: str) -> Iterator[tuple[str, int, bytes | None]]:
        with os.scandir(folder) as entries:
            for entry in entries:
                if not _hidden(entry.name) and entry.is_file():
                    size, content = entry.stat().st_size, None
                    if 0 < size <= max_bytes:
                        with open(entry.path, "rb") as f:
                            content = f.read()
                        size = len(content)
                    yield f"file:{entry.path}", size, content

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.int64(), pa.binary())

        def batch(held):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=["path", "n_bytes", "content"])

        held, room = [], BATCH_BYTES
        for folder in (f for b in batches for f in b.column(0).to_pylist()):
            for row in rows(folder):
                held.append(row)
                room -= 256 + len(row[2] or b"")
                if room <= 0:
                    yield batch(held)
                    held, room = [], BATCH_BYTES
        if held:
            yield batch(held)
    return run


def _read_mounted(spark: SparkSession, top: str, max_bytes: int, text: Callable[[Column], Column]) -> DataFrame:
    """(path, n_bytes, body) of the files below a folder of a mounted disk: tasks list folders of their own, look at
    each file once and open it only if the gate can pass it. The driver holds the names of folders alone."""
    folders = _folders(top)
    listed = spark.createDataFrame(pa.table({"folder": pa.array(folders, pa.string())}))
    tasks = max(spark.sparkContext.defaultParallelism, min(len(folders), MOST_TASKS))
    found = listed.repartition(tasks).mapInArrow(_files_read(max_bytes), "path string, n_bytes long, content binary")
    return found.select("path", "n_bytes", text(F.col("content")).alias("body"))


def read_uploads(spark: SparkSession, path: str, max_bytes: int = rules.MAX_UPLOAD_BYTES, text: Callable[[Column], Column] = utf8,
                 names: DataFrame | None = None, mounted: bool = True) -> DataFrame:
    """Files below ``path``: (path, filename, n_bytes, body).

    Only files that the gate can pass by their size are opened, so an oversized one is never read; ``text`` turns a
    file's content into text, null where it has none. ``names`` of `write_uploads` replace the names of its files, which
    tasks list and read themselves on a mounted disk (`_read_mounted`). Else, or if ``mounted`` is false, sizes come from
    the listing, which Spark's reader makes on the driver; it leaves out empty files, so these are added.
    """
    local = _local_path(spark, path) if mounted and names is not None else None
    found = _read_by_spark(spark, path, max_bytes, text) if local is None else _read_mounted(spark, local, max_bytes, text)
    filename = F.element_at(F.split("path", "/"), -1)
    if names is None:
        return found.select("path", filename.alias("filename"), "n_bytes", "body")
    own = found.withColumns({"bucket": F.regexp_extract("path", r"/bucket=(\d+)/[^/]*$", 1).try_cast("int"),
                             "place": F.regexp_extract("path", r"[-.]c(\d+)\.[^/]*$", 1).try_cast("int")})
    return own.join(names, ["bucket", "place"], "left").select("path", F.coalesce("name", filename).alias("filename"), "n_bytes", "body")


def _read_by_spark(spark: SparkSession, path: str, max_bytes: int, text: Callable[[Column], Column]) -> DataFrame:
    """(path, n_bytes, body) of the files below a path of any file system."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    paths = _listed(files)
    listed = spark.createDataFrame(pa.table({"path": pa.array(paths, pa.string())}))
    # Spark reads a few dozen small files in a task at most; each task would leave shuffle files of its own
    tasks = max(spark.sparkContext.defaultParallelism, len(paths) // TASK_FILES)
    # by the listing's size, so that each file is looked at by one scan only
    size = F.col("_metadata.file_size")
    small = files.filter((size <= max_bytes) & (F.col("length") <= max_bytes)).select("path", F.col("length").alias("n_bytes"), text(F.col("content")).alias("body")).coalesce(tasks)
    none = F.lit(None).cast(small.schema["body"].dataType)
    large = files.filter((size > max_bytes) & (F.col("length") > max_bytes)).select("path", F.col("length").alias("n_bytes"), none.alias("body")).coalesce(tasks)
    empty = listed.join(files.select("path").coalesce(tasks), "path", "left_anti").select("path", F.lit(0).cast("long").alias("n_bytes"), none.alias("body"))
    return small.union(large).union(empty)


def ingest_gate(uploads: DataFrame, groups: DataFrame, max_chars: int | None = None, max_bytes: int = rules.MAX_UPLOAD_BYTES) -> DataFrame:
    """Status of every upload: the first failed check decides, 200 passes.

    ``section_text`` of passing ones is the whole body, or its first ``max_chars`` characters.

    ``uploads``: filename, n_bytes, body (extracted text), target_key; ``groups``: key.
    """
    known = groups.select(F.col("key").alias("target_key")).distinct().withColumn("known", F.lit(True))
    status = (
        F.when(F.col("n_bytes") == 0, 400)
        .when(F.col("n_bytes") > max_bytes, 413)
        .when(F.col("known").isNull(), 404)
        .when(~file_extension(F.col("filename")).isin(*rules.UPLOAD_EXTENSIONS), 415)
        .when(is_blank(F.col("body")), 422)
        .otherwise(200))
    return (uploads.join(known, "target_key", "left").withColumn("status", status).drop("known")
            .withColumn("section_text", F.when(
                F.col("status") == 200, F.col("body") if max_chars is None else truncate(F.col("body"), max_chars))))
