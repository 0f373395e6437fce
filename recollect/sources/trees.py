"""Source trees, tag dumps and git logs as a data source of Spark, to be read as a table or as a stream of changed files.

    spark.dataSource.register(trees.SourceTree)
    spark.read.format("sourcetree").option("path", root).option("extensions", "py,lua").load()
    spark.readStream.format("sourcetree").option("path", root).load()

Folders are listed on the driver, names and sizes only; each partition reads its share of the files. A stream's offset is
the time of change that has been read up to, and the paths at that very time, so a file that is written again comes again.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from .files import MOST_BYTES

SCHEMA = "path string, size long, changed long, text string"
#: Bytes of files that a partition reads, unless one file has more.
SHARE_BYTES = 16 << 20


class Share(InputPartition):
    """Files (path, size, time of change) that one task reads."""

    def __init__(self, files: list[tuple[str, int, int]]):
        super().__init__(None)
        self.files = files


class Tree:
    """The files below a root that options pick; root is a URI or a path that driver and executors share."""

    def __init__(self, options: dict[str, str]):
        if not options.get("path"):
            raise ValueError("option path names the root of the tree")
        self.root = options["path"]
        self.extensions = {x.strip().lower() for x in options.get("extensions", "*").split(",")}
        self.most = int(options.get("mostbytes", options.get("mostBytes", MOST_BYTES)))
        self.share = int(options.get("sharebytes", options.get("shareBytes", SHARE_BYTES)))

    def opened(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.root) if "://" in self.root or self.root.startswith("file:") else (fs.LocalFileSystem(), self.root.rstrip("/"))

    def listed(self) -> list[tuple[str, int, int]]:
        """(path below the root, size, microseconds of change), by path; hidden folders and what is too long are left out."""
        from pyarrow import fs

        store, base = self.opened()
        found = []
        for x in store.get_file_info(fs.FileSelector(base, recursive=True)):
            path = x.path[len(base) :].lstrip("/")
            if x.type != fs.FileType.File or x.size > self.most or any(p.startswith(".") for p in path.split("/")):
                continue
            if "*" in self.extensions or path.rpartition(".")[2].lower() in self.extensions:
                found.append((path, x.size, (x.mtime_ns or 0) // 1000))
        return sorted(found)

    def shares(self, files: list[tuple[str, int, int]]) -> list[Share]:
        out, size = [[]], 0
        for x in files:
            if out[-1] and size + x[1] > self.share:
                out.append([])
                size = 0
            out[-1].append(x)
            size += x[1]
        return [Share(x) for x in out]

    def read(self, share: Share) -> Iterator[tuple]:
        store, base = self.opened()
        for path, size, changed in share.files:
            try:
                with store.open_input_stream(f"{base}/{path}") as source:
                    raw = source.read()
            except FileNotFoundError:  # it went after it was listed
                continue
            if b"\0" not in raw[:256]:
                yield path, size, changed, raw.decode("utf-8", "replace")


class TreeReader(DataSourceReader):
    def __init__(self, tree: Tree):
        self.tree = tree

    def partitions(self) -> list[Share]:
        return self.tree.shares(self.tree.listed())

    def read(self, partition: Share) -> Iterator[tuple]:
        return self.tree.read(partition)


class TreeStream(DataSourceStreamReader):
    """A batch has the files that changed after the last one; what the planner sees between two offsets is read again alike."""

    def __init__(self, tree: Tree):
        self.tree = tree

    def initialOffset(self) -> dict:
        return {"changed": -1, "paths": "[]"}

    def latestOffset(self) -> dict:
        found = self.tree.listed()
        last = max((x[2] for x in found), default=-1)
        return {"changed": last, "paths": json.dumps([x[0] for x in found if x[2] == last])}

    def partitions(self, start: dict, end: dict) -> list[Share]:
        before, known = start["changed"], set(json.loads(start["paths"]))
        new = [x for x in self.tree.listed() if before < x[2] <= end["changed"] or x[2] == before and x[0] not in known]
        return self.tree.shares(new)

    def read(self, partition: Share) -> Iterator[tuple]:
        return self.tree.read(partition)

    def commit(self, end: dict) -> None:
        pass


class SourceTree(DataSource):
    """Options: path; extensions (comma-separated, * by default); mostBytes of a file; shareBytes of a partition."""

    @classmethod
    def name(cls) -> str:
        return "sourcetree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(Tree(dict(self.options)))

    def streamReader(self, schema) -> TreeStream:
        return TreeStream(Tree(dict(self.options)))

