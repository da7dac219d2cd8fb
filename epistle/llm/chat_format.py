"""Chat formatting into prefix trees.

Conversations are sorted by the hashes of all their turns, so that those which share initial turns stand side by
side, and take their rank in that order; one pass over each partition of ranks then writes a tree depth first: a turn that continues the path of the
conversation before is not written again. Every written turn has its token ids, the position of its first
token on its path, and the intervals of the pack that its ancestors occupy, to which it may attend. A pack is
a tree sequence of about PACK tokens; the next pack, and each partition, starts with whole paths again, so a first
turn that a third of all conversations share is spread over as many tasks as the table needs.

Template: ``### <role>\\n<text></turn>\\n``. A backslash goes before every backslash, ``</turn>`` and ``###``
that texts contain, and line feeds in roles become ``\\n``; dropping those restores the text exactly.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged
from .packing import encoder

OPEN, MID, CLOSE = "### ", "\n", "</turn>\n"
PACK = 1 << 18
#: A pack is also closed after so many conversations: equal ones add no tokens.
MOST = 2000

_CONTROL = re.compile(r"\\|</turn>|###")
_ESCAPED = re.compile(r"\\(\\|</turn>|###|n)")
_TURN = re.compile(r"### ((?:[^\\\n]|\\.)*)\n((?:[^\\<]|\\(?:\\|</turn>|###)|<(?!/turn>))*)</turn>\n", re.S)

NODES = "pack long, seq long, conv_id long, turn int, ended boolean, start int, length int, position int, loss_start int, loss_end int, ancestors array<struct<start:int,stop:int>>, ids array<int>"


def escaped(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\" + m[0], text)


def unescaped(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], text)


def parsed(text: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation; raises where it is not one."""
    out, at = [], 0
    while at < len(text):
        m = _TURN.match(text, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        body = text[m.end(1) + 1 : m.end() - len(CLOSE)]
        out.append((unescaped(m[1]), unescaped(body)))
        at = m.end()
    return out


def trees(conversations: DataFrame, tokenizer: str, loss_role: str = "assistant") -> DataFrame:
    """The table NODES: a row for each turn that is written, and one with ``ended`` for each conversation.

    Rows of a conversation are ordered by turn (null first), then role and text, so repeated rows are turns of
    their own in a fixed order. Null texts and roles are empty; each row without an id is a conversation of its own.
    Whole texts are used; a conversation, however long, is written by one task, row by row. Further columns are ignored; an empty table gives no rows. ``loss_start`` and ``loss_end`` bound the tokens of a
    ``loss_role`` text, relative to the pack; the last row of a conversation has its whole path as ``ancestors``.
    """
    t = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    # rows without an id are told apart by number, so they are never one group
    t = staged(t.withColumn("lone", F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id()).otherwise(-1)), "rows")
    order = Window.partitionBy("conv_id", "lone").orderBy("turn", "role", "text")
    t = staged(t.withColumn("i", F.row_number().over(order) - 1), "turns")
    hashes = t.select("conv_id", "lone", "i", F.lpad(F.hex(F.xxhash64("role", "text")), 16, "0").alias("h"))
    path = hashes.groupBy("conv_id", "lone").agg(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("i", "h"))), lambda x: x["h"])).alias("path"))
    n = max(1, int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # a path stands once for each conversation; its turns carry the rank alone
    ranked = path.repartitionByRange(n, "path", "conv_id", "lone").sortWithinPartitions("path", "conv_id", "lone")
    ranked = staged(ranked.select(F.col("conv_id").alias("c"), F.col("lone").alias("l"), F.monotonically_increasing_id().alias("rank")), "ranks")
    rows = staged(t.join(ranked, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("lone") == F.col("l"))).drop("c", "l", "lone", "turn"), "paths")
    rows = rows.repartitionByRange(n, "rank").sortWithinPartitions("rank", "i")

    def grow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, pack, seq, size = encoder(tokenizer), TaskContext.get().partitionId() << 32, 0, 0
        ids_of = lambda s: np.frombuffer(encode(s), "<u4").astype(np.int32)
        stack: list[tuple[bytes, int, tuple]] = []  # digest, position after it, intervals up to and with it
        now, depth, sharing, begun, held = None, 0, True, False, 0
        out: list[tuple] = []

        def end() -> None:
            nonlocal seq
            out.append((pack, seq, now, depth, True, size, 0, stack[depth - 1][1], None, None, stack[depth - 1][2], None))
            seq += 1

        for batch in batches:
            for conv, i, role, text in zip(batch["conv_id"], batch["i"], batch["role"], batch["text"], strict=True):
                if i == 0:  # rows come in order, so a conversation starts
                    if begun:
                        end()
                    if size > PACK or held >= MOST:
                        pack, seq, size, stack, held = pack + 1, 0, 0, [], 0
                    held += 1
                    now, depth, sharing, begun = None if pd.isna(conv) else int(conv), 0, True, True
                digest = hashlib.blake2b(f"{len(role)} {role}{text}".encode("utf-8", "surrogatepass"), digest_size=16).digest()
                sharing = sharing and depth < len(stack) and stack[depth][0] == digest
                if not sharing:
                    del stack[depth:]
                    head = ids_of(OPEN + escaped(role).replace("\n", "\\n") + MID)
                    body, tail = ids_of(escaped(text)), ids_of(CLOSE)
                    ids = np.concatenate([head, body, tail])
                    above = stack[-1][2] if stack else ()
                    place = stack[-1][1] if stack else 0
                    loss = (size + len(head), size + len(head) + len(body)) if role == loss_role else (None, None)
                    out.append((pack, seq, now, int(i), False, size, len(ids), place, *loss, above, ids))
                    seq += 1
                    stop = size + len(ids)
                    if above and above[-1][1] == size:
                        spans = (*above[:-1], (above[-1][0], stop))
                    else:
                        spans = (*above, (size, stop))
                    stack.append((digest, place + len(ids), spans))
                    size = stop
                depth += 1
                if len(out) >= 2000:
                    yield framed(out)
                    out.clear()
        if begun:
            end()
        if out:
            yield framed(out)

    return rows.select("conv_id", "i", "role", "text").mapInPandas(grow, NODES)


def framed(rows: list[tuple]) -> pd.DataFrame:
    names = [c.split()[0] for c in NODES.replace("start:int", "start_int").replace("array<struct<start_int,stop:int>>", "x").split(", ")]
    df = pd.DataFrame(rows, columns=names)
    df["ancestors"] = [[{"start": a, "stop": b} for a, b in x] for x in df["ancestors"]]
    return df.astype({"conv_id": "Int64", "loss_start": "Int32", "loss_end": "Int32"})


def read_back(nodes: DataFrame, tokenizer: str) -> DataFrame:
    """From the trees alone, for each conversation: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""

    def pack(df: pd.DataFrame) -> pd.DataFrame:
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(tokenizer)
        text = lambda ids: tok.decode(ids, skip_special_tokens=False)
        df = df.sort_values("seq")
        written = df[~df["ended"]]
        ids = np.concatenate([np.zeros(0, np.int32), *written["ids"]])
        loss = written[written["loss_start"].notna()]
        begins, stops = loss["loss_start"].to_numpy(np.int64), loss["loss_end"].to_numpy(np.int64)
        out = []
        for conv, spans in zip(df["conv_id"][df["ended"]], df["ancestors"][df["ended"]], strict=True):
            whole = text(np.concatenate([ids[s["start"] : s["stop"]] for s in spans]))
            turns = parsed(whole)
            heard = [unescaped(text(ids[b:e])) for s in spans for b, e in zip(*(x[slice(*np.searchsorted(begins, [s["start"], s["stop"]]))] for x in (begins, stops)), strict=True)]
            said = "".join(heard)
            sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
            out.append((conv, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(said), sha(said), len(whole)))
        return pd.DataFrame(out, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]).astype({"conv_id": "Int64"})

    return nodes.groupBy("pack").applyInPandas(pack, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
