"""Data sources ``codetree`` (source files below a folder) and ``gitlog`` (change history).

Spark's own file readers skip names that begin with a dot or an underscore, so
a tree is listed here: once on the driver, read in slices by the executors.
"""

from __future__ import annotations

import os
import re
import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import constants as K


def scan(root: str, max_bytes: int | None = K.MAX_FILE_BYTES) -> list[tuple[str, int, float]]:
    """(path, size, mtime) of searchable files, by path; links aren't followed, unreadable folders are passed over."""
    found, todo = [], [root]
    while todo:
        try:
            entries = list(os.scandir(todo.pop()))
        except OSError:
            continue
        for e in entries:
            try:
                if e.is_dir(follow_symlinks=False):
                    if e.name not in K.SKIP_DIRS:
                        todo.append(e.path)
                elif e.is_file(follow_symlinks=False) and os.path.splitext(e.name)[1].lower() in K.SEARCHABLE_EXTS:
                    s = e.stat(follow_symlinks=False)
                    if max_bytes is None or s.st_size <= max_bytes:
                        found.append((e.path, s.st_size, s.st_mtime))
            except OSError:
                continue
    return sorted(found)


def in_repository(path: str) -> bool:
    """Whether the folder or one above it holds a git repository."""
    at = os.path.abspath(path)
    while not os.path.exists(os.path.join(at, ".git")):
        at, below = os.path.dirname(at), at
        if at == below:
            return False
    return True


class Slice(InputPartition):
    def __init__(self, rows):
        self.rows = rows


class _TreeReader(DataSourceReader):
    def __init__(self, options):
        self.root = options["path"]
        self.max_bytes = None if options.get("maxBytes", "") == "none" else int(options.get("maxBytes", K.MAX_FILE_BYTES))
        self.slice_bytes = int(options.get("sliceBytes", 16 << 20))

    def partitions(self):
        files = [(self.root, os.path.getsize(self.root), os.path.getmtime(self.root))] if os.path.isfile(self.root) else scan(self.root, self.max_bytes)
        out, held = [[]], 0
        for f in files:
            if held > self.slice_bytes:
                out.append([])
                held = 0
            out[-1].append(f)
            held += f[1]
        return [Slice(rows) for rows in out]

    def read(self, partition):
        for path, size, mtime in partition.rows:
            try:
                with open(path, "rb") as f:
                    yield path, f.read().decode("utf-8", "replace"), size, mtime
            except OSError:
                continue


class CodeTree(DataSource):
    """Options: path (file or folder), maxBytes (a number or none), sliceBytes."""

    @classmethod
    def name(cls):
        return "codetree"

    def schema(self):
        return "file string, text string, size long, mtime double"

    def reader(self, schema):
        return _TreeReader(self.options)


_HUNK = re.compile(r"^@@[^@]*@@")


def parse_numstat(text: str):
    """(cid, ts, file, changed) of a log with records ``\\x1e<id> <seconds>``; binary files count 0."""
    for record in text.split("\x1e")[1:]:
        head, *rows = record.split("\n")
        cid, ts = head.split()[:2]
        for row in rows:
            cells = row.split("\t")
            if len(cells) == 3:
                yield cid, int(ts), cells[2], sum(int(c) for c in cells[:2] if c.isdigit())


def parse_headers(text: str):
    """(cid, ts, line) of the hunk headers of a log with patches."""
    for record in text.split("\x1e")[1:]:
        head, *rows = record.split("\n")
        cid, ts = head.split()[:2]
        for row in rows:
            if _HUNK.match(row):
                yield cid, int(ts), row


class _LogReader(DataSourceReader):
    def __init__(self, options):
        self.root, self.kind = options["path"], options.get("kind", "files")
        self.commits = int(options.get("commits", 600 if self.kind == "files" else 200))
        self.seconds = int(options.get("timeout", 30 if self.kind == "files" else 60))

    def read(self, partition):
        shape = ["--numstat"] if self.kind == "files" else ["-p", "-U0"]
        try:
            done = subprocess.run(["git", "-C", self.root, "log", "--relative", *shape, "--pretty=%x1e%H %ct", "-n", str(self.commits)], capture_output=True, timeout=self.seconds)
        except (OSError, subprocess.TimeoutExpired):
            return
        if done.returncode == 0:
            yield from (parse_numstat if self.kind == "files" else parse_headers)(done.stdout.decode("utf-8", "replace"))


class GitLog(DataSource):
    """Options: path, kind (files or symbols), commits, timeout.  No repository: no rows."""

    @classmethod
    def name(cls):
        return "gitlog"

    def schema(self):
        return "cid string, ts long, file string, changed long" if self.options.get("kind", "files") == "files" else "cid string, ts long, line string"

    def reader(self, schema):
        return _LogReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(CodeTree)
    spark.dataSource.register(GitLog)


def read_tree(spark: SparkSession, path: str, **options) -> DataFrame:
    register(spark)
    return spark.read.format("codetree").options(path=path, **options).load()


def read_log(spark: SparkSession, path: str, kind: str = "files", **options) -> DataFrame:
    register(spark)
    return spark.read.format("gitlog").options(path=path, kind=kind, **options).load()
