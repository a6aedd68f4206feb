"""Files of any store that pyarrow opens, from inside Spark tasks: ranged reads, listings folder by folder, writes."""

from __future__ import annotations

import os
import posixpath
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavelake.plans.batches import plain
from wavelake.session import settled

#: Store names of Hadoop that pyarrow knows by another one.
SCHEMES = {"s3a": "s3", "s3n": "s3", "gs": "gs"}
LISTED = "rel STRING, path STRING, size BIGINT, mtime TIMESTAMP, folder BOOLEAN"


def open_store(path: str) -> tuple[fs.FileSystem, str, str]:
    """The file system of a path or URI, the path inside it, and what stands before that path in a URI."""
    scheme, colon, rest = path.partition(":/")
    if not colon:
        return fs.LocalFileSystem(), os.path.abspath(path), "file:"
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/"), "file:"
    store, inside = fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}:/{rest}")
    return store, inside, path[: path.index(inside)] if inside in path else f"{scheme}://"


def exists(path: str) -> bool:
    store, inside, _ = open_store(path)
    return store.get_file_info(inside).type != fs.FileType.NotFound


class RangedFile:
    """Reads parts of a file. The head is fetched once; what lies in it costs no further request."""

    def __init__(self, path: str, head: int = 4096):
        store, inside, _ = open_store(path)
        self.file = store.open_input_file(inside)
        self.size = self.file.size()
        self.head = self.file.read_at(min(head, self.size), 0)

    def read(self, start: int, length: int) -> bytes:
        length = max(0, min(length, self.size - start))
        if start + length <= len(self.head):
            return self.head[start : start + length]
        return self.file.read_at(length, start) if length else b""

    def close(self) -> None:
        self.file.close()


def _is_link(store: fs.FileSystem, path: str) -> bool:
    return isinstance(store, fs.LocalFileSystem) and os.path.islink(path)


def list_tree(spark: SparkSession, root: str, subdir: str = "") -> DataFrame:
    """All files below ``root``/``subdir``: (rel, path, size, mtime), ``rel`` being the path below ``root``.

    Folders are rows: the tasks list the folders of one depth, and what they find is written before the next depth, so a
    tree of any width is listed in parallel and the driver holds no names. Names that start with a dot are skipped, also
    as folders; linked folders are not followed.
    """
    _, _, before = open_store(root)

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, top, _ = open_store(root)
        for batch in batches:
            for rel in batch["rel"]:
                found = store.get_file_info(fs.FileSelector(posixpath.join(top, rel) if rel else top))
                rows = [
                    (posixpath.join(rel, i.base_name), f"{before}{i.path}", i.size or 0, i.mtime, i.type == fs.FileType.Directory)
                    for i in found
                    if not i.base_name.startswith(".")
                    and i.type in (fs.FileType.File, fs.FileType.Directory)
                    and not (i.type == fs.FileType.Directory and _is_link(store, i.path))
                ]
                frame = pd.DataFrame(rows, columns=["rel", "path", "size", "mtime", "folder"])
                yield plain(frame.astype({"size": "int64", "mtime": "datetime64[us, UTC]", "folder": "bool"}))

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    folders, depths = spark.createDataFrame([(subdir.strip("/"),)], "rel STRING"), []
    while True:
        depth = settled(folders.repartition(tasks, "rel").mapInPandas(listed, LISTED))
        depths.append(depth.where("not folder").drop("folder"))
        folders = depth.where("folder").select("rel")
        if folders.isEmpty():
            break
    rows = depths[0]
    for more in depths[1:]:
        rows = rows.unionByName(more)
    return rows
