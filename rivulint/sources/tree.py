"""A directory tree as corpus.

Spark's own file listing skips names beginning with ``_`` or ``.`` (so ``__init__.py`` too),
hence a small Python data source that only lists.  The driver looks at directories until
there are enough of them for the tasks; the tasks walk the subtrees.  The listed names are
then dealt out evenly before the files are read, so a huge folder is one task's listing but
never one task's reading.  A plain path must lie on a file system that every executor mounts; a
root with a scheme (``s3://``, ``gs://``, ``hdfs://``, ``file://``) is listed and read through pyarrow's
file systems, by the same tasks and with the same pruning.  A folder that may not be listed is
passed over, a file that cannot be read (a broken link, one that is gone by then) gives its error.
"""

from __future__ import annotations

import os
from collections import deque

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from rivulint.functions.text import decode_dropping, decode_replacing

CONTENT_SCHEMA = "path string, content_bytes binary, read_error string"


class Subtree(InputPartition):
    def __init__(self, folder: str, deep: bool):
        self.folder, self.deep = folder, deep


class TreeReader(DataSourceReader):
    def __init__(self, root: str, pruned: list[str], tasks: int):
        self.root, self.pruned, self.tasks = root, set(pruned), tasks

    def partitions(self):
        if not os.path.isdir(self.root):
            raise ValueError(f"not a directory: {self.root}")
        shallow, open_folders = [], deque([self.root])
        # Folders already looked into give their own files only; the rest are walked.
        while open_folders and len(open_folders) < self.tasks:
            folder = open_folders.popleft()
            shallow.append(folder)
            open_folders.extend(self._subfolders(folder))
        return [Subtree(f, False) for f in shallow] + [Subtree(f, True) for f in open_folders]

    def _entries(self, folder: str) -> list[os.DirEntry]:
        """What is in a folder; nothing where it may not be listed or is gone."""
        try:
            with os.scandir(folder) as entries:
                return list(entries)
        except OSError:
            return []

    def _is_file(self, entry: os.DirEntry) -> bool:
        """Files, and links that lead nowhere: reading those gives their error."""
        return os.path.isfile(entry.path) or (
            entry.is_symlink() and not os.path.exists(entry.path))

    def _subfolders(self, folder: str):
        return [e.path for e in self._entries(folder)
                if e.is_dir(follow_symlinks=False) and e.name not in self.pruned]

    def read(self, partition):
        pending = [partition.folder]
        while pending:
            for entry in self._entries(pending.pop()):
                if entry.is_dir(follow_symlinks=False):
                    if partition.deep and entry.name not in self.pruned:
                        pending.append(entry.path)
                elif self._is_file(entry):
                    yield (os.path.relpath(entry.path, self.root), entry.path)


class StoreReader(DataSourceReader):
    """The same through a file system that a root's scheme names."""

    def __init__(self, root: str, pruned: list[str], tasks: int):
        self.root, self.pruned, self.tasks = root, set(pruned), tasks

    def _opened(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.root.rstrip("/"))

    def _entries(self, system, folder: str):
        from pyarrow import fs

        try:
            return system.get_file_info(fs.FileSelector(folder))
        except OSError:
            return []

    def _subfolders(self, system, folder: str) -> list[str]:
        return [e.path for e in self._entries(system, folder)
                if not e.is_file and e.base_name not in self.pruned]

    def partitions(self):
        from pyarrow import fs

        system, base = self._opened()
        if system.get_file_info(base).type != fs.FileType.Directory:
            raise ValueError(f"not a directory: {self.root}")
        shallow, open_folders = [], deque([base])
        while open_folders and len(open_folders) < self.tasks:
            folder = open_folders.popleft()
            shallow.append(folder)
            open_folders.extend(self._subfolders(system, folder))
        return [Subtree(f, False) for f in shallow] + [Subtree(f, True) for f in open_folders]

    def read(self, partition):
        system, base = self._opened()
        pending = [partition.folder]
        while pending:
            for entry in self._entries(system, pending.pop()):
                if entry.is_file:
                    yield (entry.path[len(base):].lstrip("/"), entry.path)
                elif partition.deep and entry.base_name not in self.pruned:
                    pending.append(entry.path)


class TreeSource(DataSource):
    @classmethod
    def name(cls):
        return "source_tree"

    def schema(self):
        return "path string, full_path string"

    def reader(self, schema):
        root, pruned = self.options["path"], self.options.get("pruned", "")
        kind = StoreReader if "://" in root else TreeReader
        return kind(root, [p for p in pruned.split("|") if p],
                    int(self.options.get("tasks", "64")))


def list_tree(spark: SparkSession, root: str, pruned: list[str] | None = None) -> DataFrame:
    """(path, full_path) of the files below a root; pruned folder names are not entered."""
    import rivulint.sources.tree as here

    # Executors need not have this package installed.
    cloudpickle.register_pickle_by_value(here)
    spark.dataSource.register(TreeSource)
    return (
        spark.read.format("source_tree").option("path", root)
        .option("pruned", "|".join(pruned or [])).load()
    )


def _read_contents(root: str):
    """Reads the files of batches of names, each with the error if there is one."""
    def run(batches):
        import pyarrow as pa
        from pyarrow import fs

        system = fs.FileSystem.from_uri(root.rstrip("/"))[0] if "://" in root else None
        for batch in batches:
            for path, full_path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data, error = None, None
                try:
                    with (system.open_input_file(full_path) if system is not None
                          else open(full_path, "rb")) as handle:
                        data = handle.read()
                except OSError as problem:
                    error = str(problem)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path], pa.string()), pa.array([data], pa.binary()),
                     pa.array([error], pa.string())],
                    names=["path", "content_bytes", "read_error"],
                )

    return run


def read_tree(listing: DataFrame, tasks: int | None = None, root: str = "") -> DataFrame:
    """(path, content_bytes, read_error); a file is read by whichever task its name falls to.

    ``root`` is that of the listing where it has a scheme.

    The number of tasks is given outright: names are small, and adaptive execution would
    merge them into few partitions without knowing how much there is to read behind them.
    """
    spark = listing.sparkSession
    if tasks is None:
        tasks = max(
            4 * spark.sparkContext.defaultParallelism,
            int(spark.conf.get("spark.sql.shuffle.partitions")),
        )
    spread = listing.select("path", "full_path").repartition(tasks, "path")
    return spread.mapInArrow(_read_contents(root), CONTENT_SCHEMA)


def tree_corpus(
    spark: SparkSession, root: str, pruned: list[str] | None = None, keep=None,
    bad_bytes: str = "replace", tasks: int | None = None,
) -> DataFrame:
    """(path, content, read_error) of a tree.

    ``keep`` narrows the listing (for instance ``review_files``) before anything is read;
    bad bytes become U+FFFD or are dropped.
    """
    listing = list_tree(spark, root, pruned)
    if keep is not None:
        listing = keep(listing)
    decode = decode_replacing if bad_bytes == "replace" else decode_dropping
    return read_tree(listing, tasks, root).select(
        "path", decode(F.col("content_bytes")).alias("content"), "read_error"
    )
