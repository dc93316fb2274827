"""Asset folders: writing files from a table and digesting files of any size."""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tastemill.session import materialise

CHUNK_BYTES = 1 << 20
LISTED_ROWS = 10_000  # files per Arrow batch of a listing


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a local path or a URI, also with a single slash."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def write_assets(files: DataFrame, folder: str) -> None:
    """One file per row of ``(relative_path, content binary)`` below a shared folder.

    Tasks write their own rows; a file is written under a name of its own and then
    renamed, so a task that runs again leaves the same files. Paths must be unique;
    a NULL content gives an empty file, a NULL path is refused.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = opened(folder)
        own = uuid.uuid4().hex
        made: set[str] = set()
        written = 0
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                if not path:
                    raise ValueError("an asset needs a path")
                target = f"{root}/{path}"
                parent, name = target.rsplit("/", 1)
                if parent not in made:
                    store.create_dir(parent, recursive=True)
                    made.add(parent)
                    if len(made) > 10_000:
                        made = {parent}
                draft = f"{parent}/.{name}.{own}"
                with store.open_output_stream(draft) as out:
                    if content.is_valid:
                        out.write(content.as_buffer())
                store.move(draft, target)
                written += 1
        yield pa.RecordBatch.from_pydict({"files": pa.array([written], pa.int64())})

    rows = files.select("relative_path", F.col("content").cast("binary"))
    rows.mapInArrow(write, "files bigint").agg(F.sum("files")).collect()


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """``(full_path, size_bytes, modificationTime)`` of all files below a folder.

    Folders are listed level by level, each level's folders dealt over the tasks;
    no folder name reaches the driver. Unlike Spark's own file sources this keeps
    empty files. Names that start with a dot or an underscore are left out, with
    all that lies below such a folder, as Spark does. A missing folder raises.
    """
    store, root = opened(folder)
    if store.get_file_info(root).type != fs.FileType.Directory:
        raise FileNotFoundError(folder)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = opened(folder)
        for batch in batches:
            for parent in batch.column(0).to_pylist():
                infos = [
                    i for i in store.get_file_info(fs.FileSelector(parent))
                    if not i.base_name.startswith((".", "_"))
                ]
                for at in range(0, len(infos), LISTED_ROWS):
                    part = infos[at : at + LISTED_ROWS]
                    yield pa.RecordBatch.from_pydict({
                        "full_path": pa.array([i.path for i in part], pa.string()),
                        "is_folder": pa.array([not i.is_file for i in part], pa.bool_()),
                        "size_bytes": pa.array([i.size for i in part], pa.int64()),
                        "modificationTime": pa.array(
                            [i.mtime for i in part], pa.timestamp("us", "UTC")
                        ),
                    })

    kinds = "full_path string, is_folder boolean, size_bytes bigint, modificationTime timestamp"
    folders = spark.createDataFrame([(root,)], "full_path string")
    levels = []
    while not folders.isEmpty():
        level = materialise(folders.mapInArrow(listed, kinds))
        levels.append(level.where(~F.col("is_folder")).drop("is_folder"))
        deeper = level.where("is_folder").select("full_path")
        folders = deeper.repartition(spark.sparkContext.defaultParallelism)
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out


def digest_files(listing: DataFrame, path: str = "full_path", root: str = "/") -> DataFrame:
    """``(path, size_bytes, checksum, error, valid)`` of listed files.

    The MD5 is taken over chunks, so a long video is never held in memory; a file
    that cannot be read has its problem in ``error`` and no checksum. Paths are
    local or URIs, or bare paths of the file system that ``root`` names.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [digest_file(p, root) for p in batch.column(0).to_pylist()]
            sizes, sums, errors = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_pydict({
                "path": batch.column(0),
                "size_bytes": pa.array(sizes, pa.int64()),
                "checksum": pa.array(sums, pa.string()),
                "error": pa.array(errors, pa.string()),
            })

    kinds = "path string, size_bytes bigint, checksum string, error string"
    out = listing.select(F.col(path).alias("path")).mapInArrow(digest, kinds)
    return out.withColumn("valid", F.col("error").isNull())


def digest_file(
    uri: str | None, root: str = "/"
) -> tuple[int | None, str | None, str | None]:
    """Size, MD5 and problem of one file."""
    if not uri:
        return None, None, "File not found"
    store, path = opened(uri) if re.match("[a-z0-9]+:/", uri) else (opened(root)[0], uri)
    total, md5 = 0, hashlib.md5()
    try:
        with store.open_input_stream(path) as source:
            while chunk := source.read(CHUNK_BYTES):
                total += len(chunk)
                md5.update(chunk)
    except FileNotFoundError:
        return None, None, "File not found"
    except OSError as problem:
        return None, None, f"File cannot be read: {problem.strerror or problem}"
    return total, md5.hexdigest(), None if total else "File is empty"
