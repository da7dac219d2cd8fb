"""Mail files as a Spark data source: ``register(spark)``, then ``spark.read.format("mailfiles").load(folder)``, or ``"mbox"``, ``"eml"``.

Each ending has a reader with the kind of records that it gives. A filter on ``kind``, ``path`` or ``ext`` is taken at planning, so that
files which cannot match are never opened. Mailboxes are cut into byte ranges: a message belongs to the range that its separator
begins in, and a task reads on to the next separator behind its end. The option ``limit`` gives the first messages of each
file only, and a file is read no further than to the last of them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from . import mail

SCHEMA = f"kind string, ext string, offset long, {mail.MESSAGE}"
#: Bytes of a mailbox that a task reads, and bytes that it reads at a time.
RANGE, CHUNK = 64 << 20, 1 << 20
SEPARATOR = b"\nFrom "
#: Messages that are parsed at a time.
PARSED = 200


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path and the path within it; a path without a scheme is one of this machine."""
    if re.match(r"^\w[\w+.-]+://", path) and not path.startswith("file:"):
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), re.sub("^file:/*", "/", path)


@dataclass
class Range(InputPartition):
    path: str
    ext: str
    start: int
    stop: int
    size: int


def whole(f, part: Range) -> Iterator[tuple[int, bytes]]:
    yield 0, f.read()


def between_separators(f, part: Range) -> Iterator[tuple[int, bytes]]:
    """(offset, message) of the messages whose separator line begins in the range; the first of a file needs no line break before it."""
    f.seek(max(0, part.start - 1))
    at = max(0, part.start - 1)  # where ``held`` begins in the file
    held, begin = (b"\n" if part.start == 0 else b""), None
    at -= len(held)
    ended, look = False, 0
    while True:
        hit = held.find(SEPARATOR, look)
        if hit < 0 and not ended:
            chunk = f.read(CHUNK)
            ended = not chunk
            look = max(look, len(held) - len(SEPARATOR) + 1)
            if begin is None:  # nothing before the first separator is needed
                drop = look
                held, at, look = held[drop:], at + drop, 0
            held += chunk
            continue
        if begin is not None:
            line = held.find(b"\n", 1)  # the separator's own line; one that nothing follows holds no message
            if 0 < line and (hit < 0 or line < hit):
                yield begin, held[line + 1 : len(held) if hit < 0 else hit]
        if hit < 0 or at + hit + 1 >= part.stop:
            return
        begin, held, at, look = at + hit + 1, held[hit:], at + hit, 1


@dataclass(frozen=True)
class Form:
    """How files of an ending are read: the kind of their records, and whether one file can be cut into ranges."""

    kind: str
    cut: bool


#: Readers by ending. What is not here is passed over.
FORMS = {".eml": Form("message", False), ".mbox": Form("message", True), ".mbx": Form("message", True)}


class MailReader(DataSourceReader):
    def __init__(self, endings: list[str], options: dict):
        self.endings, self.options = endings, options
        self.limit = int(options["limit"]) if options.get("limit") else None
        self.range = int(options.get("range") or RANGE)
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Equalities of kind, ending and path are taken here; all others are Spark's."""
        for f in filters:
            name = f.attribute[0] if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else None
            if name in ("kind", "ext", "path"):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted[name] = self.wanted[name] & values if name in self.wanted else values
            else:
                yield f

    def takes(self, name: str, value: str) -> bool:
        return name not in self.wanted or value in self.wanted[name]

    def files(self) -> Iterator[tuple[str, str, int]]:
        """(path, ending, size) of the files that a reader takes and no filter leaves out, in order."""
        fs, root = opened(self.options["path"])
        info = fs.get_file_info(root)
        local = isinstance(fs, pafs.LocalFileSystem)
        found = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(root, recursive=True))
        for i in sorted(found, key=lambda x: x.path):
            ext = "." + i.extension.lower()
            path = f"file:{i.path}" if local else i.path
            if i.type == pafs.FileType.File and ext in self.endings and self.takes("ext", ext) and self.takes("kind", FORMS[ext].kind) and self.takes("path", path):
                yield path, ext, i.size

    def partitions(self) -> list[Range]:
        # with a limit a file is one range: how many messages lie before an offset is not known without reading them
        step = lambda ext, size: self.range if FORMS[ext].cut and self.limit is None else max(size, 1)
        return [Range(path, ext, at, min(at + step(ext, size), size), size) for path, ext, size in self.files() for at in range(0, size, step(ext, size))]

    def read(self, partition: Range | None) -> Iterator[tuple]:
        if partition is None:  # what Spark asks for where there is no range
            return
        fs, place = opened(partition.path)
        form = FORMS[partition.ext]

        def parsed(some: list[tuple[int, bytes]]) -> Iterator[tuple]:
            for b in mail._parsed(iter([pd.DataFrame({"path": [partition.path] * len(some), "raw": [raw for _, raw in some]})])):
                for (offset, _), row in zip(some, b.itertuples(index=False, name=None), strict=True):
                    yield form.kind, partition.ext, offset, *row

        try:
            with fs.open_input_file(place) as f:
                found = (between_separators if form.cut else whole)(f, partition)
                waiting: list[tuple[int, bytes]] = []
                for offset, raw in islice(found, self.limit):
                    waiting.append((offset, re.sub(rb"(?m)^>(>*From )", rb"\1", raw) if form.cut else raw))
                    if len(waiting) == PARSED:
                        yield from parsed(waiting)
                        waiting = []
                yield from parsed(waiting)
        except OSError as e:  # a file that cannot be read is a row with its error, never a failed job
            empty = dict.fromkeys(mail.COLUMNS) | {"path": partition.path, "refs": [], "receivers": [], "attachments": [], "people": [], "tz_known": False, "error": f"{type(e).__name__}: {e}"[:300]}
            yield (form.kind, partition.ext, partition.start, *empty.values())


class MailFiles(DataSource):
    """All files that have a reader."""

    ENDINGS = list(FORMS)

    @classmethod
    def name(cls) -> str:
        return "mailfiles"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> MailReader:
        return MailReader(self.ENDINGS, dict(self.options))


class Mbox(MailFiles):
    """Mailboxes alone."""

    ENDINGS = [".mbox", ".mbx"]

    @classmethod
    def name(cls) -> str:
        return "mbox"


class Eml(MailFiles):
    """Single messages alone."""

    ENDINGS = [".eml"]

    @classmethod
    def name(cls) -> str:
        return "eml"


def register(spark: SparkSession) -> None:
    """Make the formats known to a session, and let filters reach them."""
    for source in (MailFiles, Mbox, Eml):
        spark.dataSource.register(source)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
