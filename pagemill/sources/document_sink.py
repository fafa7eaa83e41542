"""A file per document, written aside first and moved into place when all of them are there."""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Callable, Iterator
from functools import reduce
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from pagemill.operators.scale import durable

_STAGING = "_staging"
_LISTED, _READ_BYTES = 8192, 16 << 20  # names, and bytes of files, that a task hands on at once


def open_root(root: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder given as a path or an address (``file:``, ``hdfs:``, ``s3:``, ...)."""
    if root.startswith("file:"):
        root = "file:///" + root.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(root)


def document_path(job_id: str, rel_path: str) -> str:
    """Where a document lies below the root; an address that leads out of its job's folder is refused."""
    path = posixpath.normpath(rel_path)
    if path.startswith(("/", "..")) or path == ".":
        raise ValueError(f"no path below a job: {rel_path}")
    return f"{quote(job_id, safe=':')}/{path}"


def _stage(root: str, run: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task that writes its files to a folder of its attempt's own, and names that folder when all are there."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = open_root(root)
        context = TaskContext.get()
        folder, n = f"{_STAGING}/{run}/{context.partitionId()}-{context.taskAttemptId()}", 0
        made = set()
        try:
            for batch in batches:
                for job_id, rel_path, text in zip(*(batch.column(name).to_pylist() for name in ("job_id", "rel_path", "text")), strict=True):
                    target = f"{base}/{folder}/{document_path(job_id, rel_path)}"
                    parent = posixpath.dirname(target)
                    if parent not in made:
                        files.create_dir(parent, recursive=True)
                        made.add(parent)
                    with files.open_output_stream(target) as out:
                        out.write((text or "").encode())
                    n += 1
        except BaseException:
            if made:
                files.delete_dir(f"{base}/{folder}")
            raise
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([folder])], ["folder"])

    return write


def _clear(root: str, run: str) -> None:
    files, base = open_root(root)
    if files.get_file_info(f"{base}/{_STAGING}/{run}").type != fs.FileType.NotFound:
        files.delete_dir(f"{base}/{_STAGING}/{run}")


def _publish(spark: SparkSession, root: str, folders: list[str]) -> None:
    """Move the files of the attempts that count into place, a task for each attempt's folder.

    A repeated attempt at it moves what is left, and a move replaces a file as a whole.
    """
    if not folders:
        return

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = open_root(root)
        for batch in batches:
            for folder in batch.column("folder").to_pylist():
                moved, made = 0, set()
                for found in files.get_file_info(fs.FileSelector(f"{base}/{folder}", recursive=True, allow_not_found=True)):
                    if found.type != fs.FileType.File:
                        continue
                    target = f"{base}/{found.path.split(f'{folder}/', 1)[1]}"
                    if (parent := posixpath.dirname(target)) not in made:
                        files.create_dir(parent, recursive=True)
                        made.add(parent)
                    files.move(found.path, target)
                    moved += 1
                yield pa.RecordBatch.from_arrays([pa.array([moved], pa.int64())], ["moved"])

    rows = spark.createDataFrame([(folder,) for folder in folders], "folder string").repartition(len(folders), "folder")
    rows.mapInArrow(move, "moved long").agg(F.sum("moved")).first()


def write_files(documents: DataFrame, root: str) -> None:
    """Write ``job_id, rel_path, text`` rows, one for each path, as files ``root/job_id/rel_path``.

    Every task writes below ``root/_staging``, whose attempts that count are then
    moved into place. When a task fails for good, what was staged goes and the
    files in place are as they were.
    """
    spark, run = documents.sparkSession, uuid.uuid4().hex
    files, base = open_root(root)
    files.create_dir(f"{base}/{_STAGING}/{run}", recursive=True)
    try:
        # One row for each task, from the attempt whose result counts.
        staged = documents.select("job_id", "rel_path", "text").mapInArrow(_stage(root, run), "folder string").collect()
        _publish(spark, root, [row["folder"] for row in staged])
    finally:
        _clear(root, run)


# --- reading back ------------------------------------------------------------------


def _hidden(name: str) -> bool:
    """Names that Spark's readers pass over."""
    return name.startswith(".") or name.endswith("._COPYING_") or (name.startswith("_") and "=" not in name)


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """``path`` of every file with content below a folder, or below those a pattern names; hidden ones are left out.

    Spark's file sources list on the driver, a kilobyte for each file. Here tasks
    list the folders, one level of the tree at a time, and the names stay in
    tables. Only a store that Arrow's file systems do not reach is listed by Spark.
    """
    pattern = spark._jvm.org.apache.hadoop.fs.Path(root)
    starts = [str(found.getPath().toString()) for found in pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern) or []]
    try:
        # A local path is taken as it is, without decoding.
        bases = [start.removeprefix("file:") if start.startswith("file:") else open_root(start)[1] for start in starts]
        open_root(root)
    except (pa.ArrowException, OSError):
        bases = []
    if not bases:  # Spark also has the words for a missing path
        return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = open_root(root)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                one = files.get_file_info(path)
                below = [one] if one.type == fs.FileType.File else files.get_file_info(fs.FileSelector(path, allow_not_found=True))
                for k in range(0, len(below), _LISTED):
                    rows = []
                    for found in below[k : k + _LISTED]:
                        if found.type == fs.FileType.Directory:
                            if not _hidden(found.base_name) or found.base_name.startswith(("_metadata", "_common_metadata")):
                                rows.append((found.path, True))
                        elif found.type == fs.FileType.File and found.size and not _hidden(found.base_name):
                            rows.append((found.path, False))
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.bool_())], ["path", "is_folder"])

    tasks, levels = int(spark.conf.get("spark.sql.shuffle.partitions")), []
    folders = spark.createDataFrame([(base,) for base in bases], "path string")
    n = len(bases)
    while n:
        listed = durable(folders.repartition(min(n, tasks)).mapInArrow(names, "path string, is_folder boolean"))
        levels.append(listed.filter("NOT is_folder").select("path"))
        folders = listed.filter("is_folder").select("path")
        n = folders.count()
    return reduce(DataFrame.unionAll, levels)


def read_files(listed: DataFrame, root: str) -> DataFrame:
    """Adds ``content``, the bytes of each file, to rows with the ``path`` that ``list_files`` gives for files below ``root``."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = open_root(root)
        for batch in batches:
            start, contents, size = 0, [], 0
            for end, path in enumerate(batch.column("path").to_pylist(), 1):
                with files.open_input_stream(path.removeprefix("file:"), compression=None) as stream:
                    contents.append(stream.read())
                size += len(contents[-1])
                if size >= _READ_BYTES or end == batch.num_rows:
                    columns = [*batch.slice(start, end - start).columns, pa.array(contents, pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "content"])
                    start, contents, size = end, [], 0

    # A folder's names come from one task; its files are read by many.
    dealt = listed.repartition(int(listed.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path")
    return dealt.mapInArrow(read, StructType([*dealt.schema.fields, StructField("content", BinaryType())]))
