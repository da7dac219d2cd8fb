"""Text of attachments: a row for each part (sheet, slide, page, member) of each attachment, and a row with its status for each attachment.

Office files are zips of XML and are read member by member as streams, so that a member that swells beyond bounds is given up with
its attachment's other members kept. PDF files are read stream by stream: literal and hexadecimal strings of text operators.
"""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Endings by how their text is found, the size from which an attachment is passed over, and bounds of packed members.
PLAIN = (".txt", ".text", ".log", ".md", ".csv", ".tsv", ".json", ".xml", ".ics", ".vcf", ".eml")
MARKUP = (".html", ".htm", ".xhtml")
MOST_BYTES = 50 << 20
MEMBER_BYTES, SWELL = 256 << 20, 200

PARTS = "attachment_id long, part int, name string, text string, status string, detail string"


class GivenUp(ValueError):
    """A part that is not read to its end, and why."""


def decoded(raw: bytes) -> str:
    """Text by its byte-order mark, as UTF-8 where it is that, else as a western code page."""
    for mark, encoding in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if raw.startswith(mark):
            return raw.decode(encoding, "replace")
    try:
        return raw.decode()
    except UnicodeDecodeError:
        return raw.decode("cp1252", "replace")


def plain(raw: bytes) -> Iterator[tuple[str, str]]:
    yield "text", decoded(raw)


def markup(raw: bytes) -> Iterator[tuple[str, str]]:
    from ..functions.text import html_text

    yield "page", html_text.func(pd.Series([decoded(raw)]))[0]


def rich(raw: bytes) -> Iterator[tuple[str, str]]:
    from ..functions import repair

    yield "text", repair.rtf_text.func(pd.Series([raw]))[0]


def local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def members(raw: bytes, wanted: str) -> Iterator[tuple[str, Iterator]]:
    """(name, events of its XML) of a zip's members whose name matches, numbers within names in their order."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        number = lambda i: [int(x) if x.isdigit() else x for x in re.split(r"(\d+)", i.filename)]
        for i in sorted((i for i in z.infolist() if re.fullmatch(wanted, i.filename)), key=number):
            if i.file_size > MEMBER_BYTES or i.file_size > SWELL * max(i.compress_size, 1) + (1 << 20):
                raise GivenUp(f"{i.filename} would unpack to {i.file_size} bytes")
            with z.open(i) as f:
                yield i.filename, ElementTree.iterparse(f)


def runs_of_text(events: Iterator, text: set[str], block: set[str], blank: set[str] = frozenset()) -> str:
    """What stands in elements named in ``text``; each of ``block`` ends a line, each of ``blank`` is a blank."""
    out: list[str] = []
    for _, e in events:
        name = local(e.tag)
        if name in text:
            out.append(e.text or "")
        elif name in blank:
            out.append(" ")
        elif name in block:
            out.append("\n")
            e.clear()
    return re.sub(r"[ \t]*\n\s*", "\n", "".join(out)).strip()


def document(raw: bytes) -> Iterator[tuple[str, str]]:
    for name, events in members(raw, r"word/(?:document|header\d*|footer\d*|footnotes|endnotes|comments)\.xml"):
        yield name, runs_of_text(events, {"t"}, {"p"}, {"tab", "br"})


def slides(raw: bytes) -> Iterator[tuple[str, str]]:
    for name, events in members(raw, r"ppt/(?:slides/slide|notesSlides/notesSlide)\d+\.xml"):
        yield name, runs_of_text(events, {"t"}, {"p"})


def workbook(raw: bytes) -> Iterator[tuple[str, str]]:
    """Cells of each sheet, a row a line; numbers of shared texts are looked up."""
    shared: list[str] = []
    for _, events in members(raw, r"xl/sharedStrings\.xml"):
        own: list[str] = []
        for _, e in events:
            if local(e.tag) == "t":
                own.append(e.text or "")
            elif local(e.tag) == "si":
                shared.append("".join(own))
                own = []
                e.clear()
    for name, events in members(raw, r"xl/worksheets/sheet\d+\.xml"):
        rows: list[str] = []
        cells: list[str] = []
        value, inline = "", ""
        for _, e in events:
            tag = local(e.tag)
            if tag == "v":
                value = e.text or ""
            elif tag == "t":
                inline += e.text or ""
            elif tag == "c":
                told = e.get("t") == "s" and value.isdigit() and int(value) < len(shared)
                cells.append(shared[int(value)] if told else inline or value)
                value, inline = "", ""
            elif tag == "row":
                rows.append("\t".join(c for c in cells if c))
                cells = []
                e.clear()
        yield name, "\n".join(r for r in rows if r)


def open_document(raw: bytes) -> Iterator[tuple[str, str]]:
    for name, events in members(raw, r"content\.xml"):
        out: list[str] = []
        for _, e in events:
            if local(e.tag) in ("p", "h"):
                out.append("".join(e.itertext()))
                e.clear()
        yield name, "\n".join(x for x in out if x.strip())


_STREAM = re.compile(rb"<<((?:[^<>]|<<[^<>]*>>|<[^<>]*>)*)>>\s*stream\r?\n")
_SHOWN = re.compile(rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<[0-9A-Fa-f\s]*>|-?\d+(?:\.\d+)?|\b(?:Tj|TJ|Td|TD|Tm|BT|ET)\b|T\*|['\"\[\]]", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"", b"f": b"", b"(": b"(", b")": b")", b"\\": b"\\"}


def shown(token: bytes) -> str:
    """The characters of a PDF string."""
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        raw = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    else:
        raw = re.sub(rb"\\([0-7]{1,3}|\r?\n|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else _ESCAPES.get(m[1], b"" if m[1].strip() == b"" else m[1]), token[1:-1], flags=re.S)
    return raw[2:].decode("utf-16-be", "replace") if raw.startswith(b"\xfe\xff") else raw.decode("cp1252", "replace")


def shown_text(content: bytes) -> str:
    """What the text operators of a content stream show: moves end a line, wide gaps within a line are blanks."""
    out: list[str] = []
    waiting: list[str] = []
    listed = False
    for m in _SHOWN.finditer(content):
        t = m.group()
        if t[:1] in (b"(", b"<"):
            waiting.append(shown(t))
        elif t == b"[":
            listed = True
        elif t == b"]":
            listed = False
        elif t in (b"Tj", b"TJ"):
            out += waiting
            waiting = []
        elif t in (b"'", b'"'):
            out += ["\n", *waiting]
            waiting = []
        elif t in (b"Td", b"TD", b"T*", b"Tm", b"ET"):
            out.append("\n")
            waiting = []
        elif listed and t[:1] == b"-" and float(t) < -200:
            waiting.append(" ")
    return re.sub(r"[ \t]*\n\s*", "\n", "".join(out)).strip()


def pdf(raw: bytes) -> Iterator[tuple[str, str]]:
    """Text of each content stream in its order; fonts with codes of their own give no readable text and are not guessed."""
    if b"/Encrypt" in raw:
        raise GivenUp("it is encrypted")
    at = 0
    while m := _STREAM.search(raw, at):
        end = raw.find(b"endstream", m.end())
        end = len(raw) if end < 0 else end
        content, head, at = raw[m.end() : end], m[1], end
        if b"/FlateDecode" in head:
            unpack = zlib.decompressobj()
            try:
                content = unpack.decompress(content, min(MEMBER_BYTES, SWELL * len(content) + (1 << 20)))
            except zlib.error:
                continue
            if unpack.unconsumed_tail:
                raise GivenUp("a stream unpacks beyond bounds")
        elif b"/Filter" in head:
            continue
        if re.search(rb"\bBT\b", content) and (text := shown_text(content)):
            yield f"stream at {m.start()}", text


def of_messages(raw: DataFrame) -> DataFrame:
    """(path, message_id, place, filename, content_hash, data): the attachments of mails (path, raw), with their bytes and the SHA-256 of these.

    Attached mails are attachments, named by their subject; a mail that cannot be read has none.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib
        from email import message_from_bytes, policy

        def of(path: str, mail: bytes) -> Iterator[tuple]:
            try:
                m = message_from_bytes(mail, policy=policy.default)
                mid, place, todo = m["message-id"], 0, [m]
                while todo:
                    part = todo.pop()
                    inner = part is not m and part.get_content_type() == "message/rfc822"
                    if part.is_multipart() and not inner:
                        todo += reversed(list(part.iter_parts()))
                        continue
                    name = part.get_filename()
                    if inner:
                        sub = part.get_payload(0)
                        name, data = name or f"{str(sub['subject'] or 'message').strip()}.eml", sub.as_bytes()
                    elif part is not m and (name or part.get_content_disposition() == "attachment"):
                        data = part.get_payload(decode=True) or b""
                    else:
                        continue
                    yield path, mid and str(mid).strip(), place, name, hashlib.sha256(data).hexdigest(), data
                    place += 1
            except Exception:  # the mail's own reader tells of it
                return

        for b in batches:
            for path, mail in zip(b["path"], b["raw"], strict=True):
                yield pd.DataFrame(of(path, bytes(mail)), columns="path message_id place filename content_hash data".split())

    return raw.mapInPandas(run, "path string, message_id string, place int, filename string, content_hash string, data binary")


#: Characters of text from which the parts found so far are handed on.
FRAME = 1 << 22

READERS: dict[str, Callable[[bytes], Iterator[tuple[str, str]]]] = (
    dict.fromkeys(PLAIN, plain) | dict.fromkeys(MARKUP, markup) | {".rtf": rich, ".docx": document, ".pptx": slides, ".xlsx": workbook, ".odt": open_document, ".ods": open_document, ".odp": open_document, ".pdf": pdf}
)


def parts(attachments: DataFrame, id_col: str = "attachment_id", name_col: str = "filename", data_col: str = "data") -> DataFrame:
    """A row (PARTS) for each part of each attachment that is read, and one without text where none is.

    Status is ``done``, ``unsupported`` (no reader for the ending), ``skipped`` (no bytes, or over MOST_BYTES) or ``failed`` with its
    reason; what was read of a file before it failed stays. Repeated rows are attachments of their own; ids may be null; other columns
    are ignored. A row may be as large as Spark's rows are.
    """

    def one(name: str | None, raw: bytes | None) -> Iterator[tuple[str | None, str | None, str, str | None]]:
        if not raw:
            yield None, None, "skipped", "it has no bytes"
            return
        if len(raw) > MOST_BYTES:
            yield None, None, "skipped", f"it has {len(raw)} bytes"
            return
        ending = re.search(r"(\.[^./\\]+)\s*$", name or "")
        reader = READERS.get(ending[1].lower()) if ending else None
        if reader is None:
            yield None, None, "unsupported", None
            return
        some = False
        try:
            for part, text in reader(raw):
                some = True
                yield part, text, "done", None
        except Exception as e:  # a broken attachment is a row with its error, never a failed job
            yield None, None, "failed", (str(e) if isinstance(e, GivenUp) else f"{type(e).__name__}: {e}")[:300]
            return
        if not some:
            yield None, "", "done", "it shows no text"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in PARTS.split(", ")]
        frame = lambda rows: pd.DataFrame(rows, columns=names).astype({"attachment_id": "Int64"})
        for b in batches:
            found, chars = [], 0
            for i, name, raw in zip(b["id"], b["name"], b["data"], strict=True):
                for n, x in enumerate(one(name, None if raw is None else bytes(raw))):
                    found.append((i, n, *x))
                    chars += len(x[1] or "")
                # many small attachments make one frame, large ones one of their own
                if chars > FRAME:
                    yield frame(found)
                    found, chars = [], 0
            yield frame(found)

    slim = attachments.select(F.col(id_col).cast("long").alias("id"), F.col(name_col).alias("name"), F.col(data_col).alias("data"))
    return slim.mapInPandas(run, PARTS)


def extracted(found: DataFrame) -> DataFrame:
    """(attachment_id, status, text, parts, detail) of each attachment of ``parts``: failed if a part failed, its other parts' text kept in order."""
    told = F.sort_array(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("part", "text"))))
    worst = F.when(F.bool_or(F.col("status") == "failed"), "failed").otherwise(F.first("status"))
    return found.groupBy("attachment_id").agg(
        worst.alias("status"), F.array_join(F.transform(told, lambda x: x["text"]), "\n").alias("text"), F.count("text").alias("parts"), F.max("detail").alias("detail")
    )
