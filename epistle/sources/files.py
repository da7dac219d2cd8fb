"""Inventory of files: what is there, what it seems to be, which copies are alike."""

from __future__ import annotations

import datetime
import hashlib
import itertools
import os
import re
import stat
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import staged

#: Types that are listed but not read, with the code of the finding raised for them.
DECLINED = {".ost": "unsupported_cache", ".dbx": "unsupported_store", ".pab": "unsupported_store", ".pst": "unsupported_store", ".msg": "unsupported_store"}
HEAD = 32
CHUNK = 1 << 20


def outermost(roots: list[str]) -> list[str]:
    """Roots that lie in no other one, without repeats."""
    trimmed = sorted({r.rstrip("/") or "/" for r in roots})
    return [r for r in trimmed if not any(r != o and r.startswith(o.rstrip("/") + "/") for o in trimmed)]


def excluded(path: Column, patterns: list[str]) -> Column:
    """Whether a folder of ``path`` has one of these names or ends like one of these part paths, in any case of letters."""
    folder = F.lower(F.regexp_replace(path, "[^/]*$", ""))
    hit = F.lit(False)
    for p in patterns:
        hit = hit | F.contains(folder, F.lit("/" + p.strip("/").lower() + "/"))
    return hit


def looked_at(path: str, hashed: bool) -> tuple[bytes | None, str | None, str | None]:
    """The first bytes of a file, its SHA-256 if wanted, and the error where it cannot be read."""
    try:
        if "://" in path and not path.startswith("file:"):
            scheme, rest = path.split("://", 1)
            host, _, _ = rest.partition("/")
            fs, place = pafs.FileSystem.from_uri(f"{scheme}://{host}/")[0], rest if scheme in ("s3", "gs") else rest[len(host) :]
        else:
            fs, place = pafs.LocalFileSystem(), re.sub("^file:/*", "/", path)
        with fs.open_input_stream(place) as f:
            head = f.read(HEAD)
            if not hashed:
                return head, None, None
            h = hashlib.sha256(head)
            while part := f.read(CHUNK):
                h.update(part)
            return head, h.hexdigest(), None
    except (OSError, ValueError) as e:
        return None, None, f"{type(e).__name__}: {e}"[:300]


def _children(path: str, follow: bool) -> Iterator[tuple]:
    """(kind, path, identity, size, modified, error) of what a folder holds; one row of kind ``error`` where it cannot be read.

    The identity is that of the file system (device and number), so two ways to one folder are seen as one. Links are
    passed over unless ``follow``; places of other file systems have no links and are their own identity.
    """
    try:
        if "://" in path and not path.startswith("file:"):
            scheme, rest = path.split("://", 1)
            host, _, _ = rest.partition("/")
            fs, place = pafs.FileSystem.from_uri(f"{scheme}://{host}/")[0], rest if scheme in ("s3", "gs") else rest[len(host) :]
            stem = path[: len(path) - len(place)]
            for i in fs.get_file_info(pafs.FileSelector(place)):
                folder = i.type == pafs.FileType.Directory
                yield "folder" if folder else "file", stem + i.path, stem + i.path, i.size, i.mtime, None
            return
        with os.scandir(re.sub("^file:/*", "/", path)) as found:
            for i in found:
                if i.is_symlink() and not follow:
                    continue
                try:
                    s = i.stat()
                except OSError as e:  # a link that leads nowhere, or to itself
                    yield "error", i.path, None, None, None, f"{type(e).__name__}: {e}"[:300]
                    continue
                yield "folder" if i.is_dir() else "file", i.path, f"{s.st_dev}:{s.st_ino}", s.st_size, datetime.datetime.fromtimestamp(s.st_mtime, datetime.UTC), None
    except (OSError, ValueError) as e:
        yield "error", path, None, None, None, f"{type(e).__name__}: {e}"[:300]


FOUND = "root string, kind string, path string, identity string, size long, modified timestamp, read_error string"


def walk(spark: SparkSession, roots: list[str], exclude: list[str] = (), follow: bool = False) -> DataFrame:
    """(root, kind, path, identity, size, modified, read_error) of every file and unreadable folder (kind ``error``) under ``roots``.

    A round lists the folders that the round before found, in the executors, and stages what they hold; a folder is
    listed once, by whichever path is first by name, so links that lead back end. Excluded names count below a root
    only: a folder that was asked for is read. Rounds are as many as folders are deep, and no list of folders or files
    passes the driver. Roots that are files are given as they are, missing ones as errors.
    """

    def listing(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in FOUND.split(", ")]
        for b in batches:
            for root, path in zip(b["root"], b["path"], strict=True):
                rows = ((root, *r) for r in _children(path, follow))
                while some := list(itertools.islice(rows, 10_000)):
                    yield pd.DataFrame(some, columns=columns).astype({"size": "Int64", "modified": "datetime64[us, UTC]"})

    def start(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(r, *_place(r)) for r in b["root"]], columns=["root", "kind", "path", "identity", "size", "modified", "read_error"]).astype({"size": "Int64", "modified": "datetime64[us, UTC]"})

    n = spark.sparkContext.defaultParallelism
    below = F.concat(F.expr("substring(path, length(root) + 1)"), F.lit("/"))
    new = staged(spark.createDataFrame([(r,) for r in outermost(roots)], "root string").mapInPandas(start, FOUND), "walk")
    every = seen = None
    while True:
        every = new if every is None else every.union(new)
        fresh = new.where("kind = 'folder'").groupBy("identity").agg(F.min(F.struct("path", "root")).alias("first")).select("identity", "first.path", "first.root")
        fresh = staged(fresh if seen is None else fresh.join(seen, "identity", "left_anti"), "folders")
        if not fresh.take(1):
            return every.where("kind <> 'folder'").groupBy("kind", "path").agg(*(F.min(c).alias(c) for c in ("root", "identity", "size", "modified", "read_error"))).select(*[c.split()[0] for c in FOUND.split(", ")])
        seen = fresh.select("identity") if seen is None else seen.union(fresh.select("identity"))
        found = fresh.repartition(n, "path").mapInPandas(listing, FOUND)
        new = staged(found.where((F.col("kind") != "folder") | ~excluded(below, exclude)), "walk")


def _place(root: str) -> tuple:
    """(kind, path, identity, size, modified, error) of a root itself."""
    try:
        if "://" in root and not root.startswith("file:"):
            return "folder", root, root, None, None, None
        s = os.stat(re.sub("^file:/*", "/", root))
        facts = f"{s.st_dev}:{s.st_ino}", s.st_size, datetime.datetime.fromtimestamp(s.st_mtime, datetime.UTC), None
        return "folder" if stat.S_ISDIR(s.st_mode) else "file", re.sub("^file:/*", "/", root), *facts
    except OSError as e:
        return "error", root, None, None, None, f"{type(e).__name__}: {e}"[:300]


def scan(spark: SparkSession, roots: list[str], exclude: list[str] = (), hashed: bool = False, walked: bool = False, follow: bool = False, most: int | None = None) -> DataFrame:
    """(path, name, ext, size, modified, head[, content_hash], read_error) of every file under ``roots``.

    Spark's file source lists them, or with ``walked`` the executors do (``walk``), which ends at loops of links and gives
    folders that cannot be read as rows. Listing reads no content. The first HEAD bytes, or where a hash is wanted the
    whole file a stretch at a time, are read in the executors, so a file may be of any size; what cannot be read has null
    ``head`` and hash and its ``read_error``. Files of more than ``most`` bytes keep their head, and say why they have no hash.
    """
    if walked:
        found = walk(spark, roots, exclude, follow).select("path", F.col("size").alias("length"), F.col("modified").alias("modificationTime"), F.col("read_error").alias("unread"))
    else:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(outermost(roots)).where(~excluded(F.col("path"), exclude)).withColumn("unread", F.lit(None).cast("string"))
    name = F.element_at(F.split("path", "/"), -1)
    out = [
        "path", name.alias("name"), F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1)).alias("ext"), F.col("length").alias("size"),
        F.col("modificationTime").alias("modified"), "unread",
    ]
    listed_ = found.select(*out)

    def facts(path: str, size: int, unread: str | None) -> tuple:
        if unread is not None:
            return None, None, unread
        if hashed and most is not None and size > most:
            head, _, error = looked_at(path, False)
            return head, None, error or f"not hashed: more than {most} bytes"
        return looked_at(path, hashed)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [facts(p, s, None if pd.isna(u) else u) for p, s, u in zip(b["path"], b["size"], b["unread"], strict=True)]
            yield b.drop(columns="unread").assign(**{c: [g[k] for g in got] for k, c in enumerate(("head", "content_hash", "read_error"))})

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in listed_.schema if f.name != "unread")
    n = listed_.sparkSession.sparkContext.defaultParallelism
    read_ = listed_.repartition(n, "path").mapInPandas(read, f"{schema}, head binary, content_hash string, read_error string")
    return read_ if hashed else read_.drop("content_hash")


def listed(inventory: DataFrame, seen: DataFrame) -> DataFrame:
    """The inventory after a scan ``seen``: facts are refreshed, and each path keeps its user's note and parse state."""
    old = inventory.select("path", "note", "state", *(F.col(c).alias(f"old_{c}") for c in seen.columns if c != "path"))
    j = seen.withColumn("here", F.lit(True)).join(old, "path", "full_outer")
    facts = [F.when(F.col("here"), F.col(c)).otherwise(F.col(f"old_{c}")).alias(c) for c in seen.columns if c != "path"]
    return j.select("path", *facts, "note", F.coalesce("state", F.lit("new")).alias("state"), F.coalesce("here", F.lit(False)).alias("present"))


def copies(inventory: DataFrame) -> DataFrame:
    """(path, content_hash, keeper, wasted) of files alike in content: the shortest path stays, then the first by name."""
    groups = inventory.where("content_hash is not null and size > 0").groupBy("content_hash").agg(F.min(F.struct(F.length("path").alias("n"), "path")).alias("k"), F.count("*").alias("n")).where("n > 1")
    j = inventory.join(groups.select("content_hash", F.col("k.path").alias("keeper")), "content_hash")
    return j.where("path <> keeper").select("path", "content_hash", "keeper", F.col("size").alias("wasted"))


def declined(inventory: DataFrame) -> DataFrame:
    """(path, code) of files that are listed but that no reader takes."""
    code = F.coalesce(*(F.when(F.col("ext") == e, c) for e, c in DECLINED.items()))
    return inventory.select("path", code.alias("code")).where("code is not null")
