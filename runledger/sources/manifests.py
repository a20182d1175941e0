"""File-manifest sources (S7): name and byte size of every file under a glob.

``file_manifest`` uses Spark's ``binaryFile`` listing (any store that Spark
reads); selecting only ``path`` and ``length`` keeps ``content`` out of the scan,
so no file is read.  Spark's file scan skips zero-byte files and names that
begin with ``_`` or ``.``.

``list_files`` is the complete listing: a Python data source whose partitions
are folders, so folders are listed by tasks, and the driver only sees the roots.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

LISTING_SCHEMA = "path string, file_nm string, file_size long"
#: Files given by name that one task looks up.
FILES_PER_TASK = 1000


def base_name(path_col: str = "path"):
    return F.element_at(F.split(F.col(path_col), "/"), -1)


def file_manifest(spark: SparkSession, glob: str | list[str], recursive: bool = False) -> DataFrame:
    """Name and size of each file of a glob or a list of paths, as Spark's file scan
    sees them: without zero-byte files and hidden names."""
    df = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", str(recursive).lower())
        .load(glob)
    )
    return df.select(
        F.col("path"),
        base_name("path").alias("file_nm"),
        F.col("length").alias("file_size"),
    )


def _listing_source() -> type[DataSource]:
    """The data source class.  It is defined in a function so that it travels to the
    workers by value: they need no installed copy of this package."""
    import fnmatch
    import re

    wildcard = re.compile(r"[*?\[{]")

    def filesystem(uri: str):
        """The store of a path, the path as the store has it (wildcards included), and
        what stands before such a path in a full one (as Spark writes it)."""
        from pyarrow import fs

        if not re.match(r"[A-Za-z][A-Za-z0-9+.-]+:", uri):
            return fs.LocalFileSystem(), uri, "file:"
        wild = wildcard.search(uri)
        plain = uri[:wild.start()].rpartition("/")[0] if wild else uri.rstrip("/")
        store, path = fs.FileSystem.from_uri(plain)
        before = plain[:-len(path)] if path and plain.endswith(path) and not uri.startswith("file:") else "file:"
        return store, path + uri[len(plain):] if wild else path, before

    def alternatives(part: str) -> list[str]:
        braces = re.search(r"\{([^{}]*)\}", part)
        if not braces:
            return [part]
        return [y for x in braces[1].split(",") for y in alternatives(part[:braces.start()] + x + part[braces.end():])]

    def names(store, folder):
        from pyarrow import fs

        return store.get_file_info(fs.FileSelector(folder, allow_not_found=False))

    def is_file(info):
        from pyarrow import fs

        return info.type == fs.FileType.File

    def is_folder(info):
        from pyarrow import fs

        return info.type == fs.FileType.Directory

    def files(store, folder, recursive):
        from pyarrow import fs

        for info in store.get_file_info(fs.FileSelector(folder, recursive=recursive)):
            if is_file(info):
                yield info

    def matching(store, folder, parts, recursive):
        """Files that a pattern names, level by level; a folder that it names gives its files."""
        for info in names(store, folder or "/"):
            if any(fnmatch.fnmatchcase(info.base_name, x) for x in alternatives(parts[0])):
                if len(parts) > 1:
                    if is_folder(info):
                        yield from matching(store, info.path, parts[1:], recursive)
                elif is_file(info):
                    yield info
                else:
                    yield from files(store, info.path, recursive)

    class Folder(InputPartition):
        def __init__(self, uri, path, pattern, recursive, given=()):
            self.uri, self.path, self.pattern, self.recursive, self.given = uri, path, pattern, recursive, given

    class Reader(DataSourceReader):
        def __init__(self, options):
            self.paths = json.loads(options["paths"])
            self.recursive = options.get("recursive", "false").lower() == "true"
            self.per_task = int(options.get("filesPerTask", "1000"))

        def partitions(self):
            from pyarrow import fs

            out, given = [], {}
            for uri in self.paths:
                store, path, _ = filesystem(uri)
                if wild := wildcard.search(path):
                    folder = path[:wild.start()].rpartition("/")[0]
                    out.append(Folder(uri, folder, path[len(folder) + 1:], self.recursive))
                    continue
                info = store.get_file_info([path.rstrip("/") or "/"])[0]
                if info.type == fs.FileType.NotFound:
                    raise FileNotFoundError(uri)
                if is_file(info):
                    given.setdefault(uri.split(":", 1)[0] if ":" in uri else "", []).append((uri, info.path))
                else:
                    # Each subfolder is a task of its own; the folder's own files are one more.
                    out.append(Folder(uri, info.path, None, False))
                    if self.recursive:
                        out += [Folder(uri, i.path, None, True) for i in names(store, info.path) if is_folder(i)]
            for found in given.values():
                for i in range(0, len(found), self.per_task):
                    part = found[i:i + self.per_task]
                    out.append(Folder(part[0][0], None, None, False, [p for _, p in part]))
            return out or [Folder("/", None, None, False, [])]

        def read(self, partition):
            store, _, before = filesystem(partition.uri)
            if partition.path is None:
                found = [i for i in store.get_file_info(list(partition.given)) if is_file(i)]
            elif partition.pattern is None:
                found = files(store, partition.path, partition.recursive)
            else:
                found = matching(store, partition.path, partition.pattern.split("/"), partition.recursive)
            for info in found:
                yield (before + info.path, info.base_name, info.size)

    class FileListing(DataSource):
        @classmethod
        def name(cls):
            return "file_listing"

        def schema(self):
            return LISTING_SCHEMA

        def reader(self, schema):
            return Reader(self.options)

    return FileListing


def list_files(spark: SparkSession, paths: str | list[str], recursive: bool = False) -> DataFrame:
    """Path, name and size of every file, zero-byte and hidden ones included.

    ``paths`` are files, folders (their files; with ``recursive`` those below too) or
    patterns with ``*``, ``?``, ``[]`` and ``{a,b}`` (within a name).  A named path that does not exist raises; a
    pattern may match nothing.  A file named twice is listed twice.  Stores: local
    paths and what ``pyarrow.fs`` opens (``s3``, ``gs``, ``hdfs``, ``abfs``); for others
    there is ``file_manifest``.
    """
    spark.dataSource.register(_listing_source())
    given = [paths] if isinstance(paths, str) else list(paths)
    return (spark.read.format("file_listing").option("paths", json.dumps(given))
            .option("recursive", str(recursive).lower()).option("filesPerTask", str(FILES_PER_TASK)).load())
