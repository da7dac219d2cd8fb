"""Repair of legacy text: charsets, text decoded twice, RTF and its compressed form, word stems."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .charsets import detected

_DECODED = T.StructType().add("text", T.StringType()).add("encoding", T.StringType()).add("confidence", T.DoubleType())


def _unfold_utf8(text: str) -> str:
    """Text whose UTF-8 bytes were read as cp1252, read again as UTF-8; unchanged where that does not work out."""
    if not re.search("[ÃÂâ][\u0080-\u00bf\u0152-\u0192\u02c6\u02dc\u2013-\u2122]", text):
        return text
    try:
        return bytes(ord(c) if 0x80 <= ord(c) < 0xA0 else c.encode("cp1252")[0] for c in text).decode("utf-8")
    except (UnicodeEncodeError, UnicodeDecodeError):
        return text


def _decode(raw: bytes, declared: str | None) -> tuple[str, str, float]:
    named = (declared or "").strip().lower()
    named = "cp1252" if named in ("latin-1", "latin1", "iso-8859-1", "ascii", "us-ascii") else named
    short = [("cp1252", 0.7)] if len(raw) < 64 else []
    known = [("ascii", 1.0), (named, 1.0), ("utf-8", 0.9), *short]
    guessed = [("cp1252", 0.6), ("cp1250", 0.6), ("cp1251", 0.6)]
    for ladder in (lambda: known, lambda: [(e, 0.8) for e in [detected(raw)] if e], lambda: guessed):
        for encoding, confidence in ladder():
            try:
                return raw.decode(encoding), encoding, confidence
            except (UnicodeDecodeError, LookupError):
                continue
    return raw.decode("utf-8", "replace"), "utf-8", 0.5


@F.pandas_udf(_DECODED)
def decoded(raw: pd.Series, declared: pd.Series) -> pd.DataFrame:
    """struct<text, encoding, confidence> of bytes and the charset they claim, in NFC, with plain line ends and no NUL.

    Confidence: 1.0 for ASCII or a claim that holds, 0.9 for UTF-8, 0.7 for short text, 0.8 where longer text reads like a
    language in one code page (``charsets.detected``), 0.6 for other text of a legacy page, 0.5 with replaced characters; at most 0.85 where text decoded twice was mended. Null bytes give nulls.
    """
    import unicodedata

    def one(r, d) -> tuple:
        if r is None:
            return None, None, None
        text, encoding, confidence = _decode(bytes(r), d)
        mended = _unfold_utf8(text)
        confidence = min(confidence, 0.85) if mended != text else confidence
        return unicodedata.normalize("NFC", mended).replace("\r\n", "\n").replace("\r", "\n").replace("\0", ""), encoding, confidence

    return pd.DataFrame([one(r, d) for r, d in zip(raw, declared, strict=True)], columns=["text", "encoding", "confidence"])


# The text that compressed RTF refers back to, and RTF groups that hold no text of the document.
RTF_SEED = (
    b"{\\rtf1\\ansi\\mac\\deff0\\deftab720{\\fonttbl;}{\\f0\\fnil \\froman \\fswiss \\fmodern \\fscript \\fdecor MS Sans SerifSymbolArialTimes New RomanCourier"
    b"{\\colortbl\\red0\\green0\\blue0\r\n\\par \\pard\\plain\\f0\\fs20\\b\\i\\u\\tab\\tx"
)
RTF_SILENT = {"fonttbl", "colortbl", "stylesheet", "info", "pict", "object", "header", "footer", "generator", "themedata", "xmlnstbl"}


def _inflated(raw: bytes) -> bytes:
    """RTF out of its compressed form; bytes without that header are given back."""
    if raw[8:12] == b"MELA":
        return raw[16 : 16 + int.from_bytes(raw[4:8], "little")]
    if raw[8:12] != b"LZFu":
        return raw
    out, at = bytearray(RTF_SEED), 16
    while at < len(raw):
        control, at = raw[at], at + 1
        for bit in range(8):
            if at >= len(raw):
                break
            if not control >> bit & 1:
                out.append(raw[at])
                at += 1
                continue
            pair, at = int.from_bytes(raw[at : at + 2], "big"), at + 2
            # places count round a ring of 4096 bytes; one that points at the ring's own end closes the text
            back = (len(out) - (pair >> 4)) % 4096
            if back == 0 or back > len(out):
                return bytes(out[len(RTF_SEED) :])
            for _ in range((pair & 15) + 2):
                out.append(out[-back])
    return bytes(out[len(RTF_SEED) :])


_RTF = re.compile(r"\\([a-z]+)(-?\d+)? ?|\\'([0-9a-f]{2})|\\([^a-z'])|([{}])|[\r\n]+|([^\\{}\r\n]+)", re.I)


def _rtf_text(raw: bytes) -> str:
    out, silent, skip, fallback, page = [], [False], 0, [1], "cp1252"
    for word, number, code, symbol, brace, text in _RTF.findall(_inflated(raw).decode("latin-1")):
        if brace == "{":
            silent.append(silent[-1])
            fallback.append(fallback[-1])
        elif brace == "}":
            if len(silent) > 1:
                silent.pop()
                fallback.pop()
        elif word in RTF_SILENT or symbol == "*":
            silent[-1] = True
        elif word == "ansicpg" and number:
            page = f"cp{number}"
        elif word == "uc" and number:
            fallback[-1] = int(number)
        elif silent[-1]:
            continue
        elif word == "u" and number:
            out.append(chr(int(number) % 65536))
            skip = fallback[-1]
        elif code:
            if skip:
                skip -= 1
            else:
                try:
                    out.append(bytes.fromhex(code).decode(page, "replace"))
                except LookupError:
                    out.append(bytes.fromhex(code).decode("cp1252", "replace"))
        elif word in ("par", "line", "row", "sect"):
            out.append("\n")
        elif word in ("tab", "cell"):
            out.append("\t")
        elif symbol in ("\\", "{", "}", "~"):
            out.append(" " if symbol == "~" else symbol)
        elif text:
            out.append(text[skip:])
            skip = max(0, skip - len(text))
    joined = "".join(out).encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    return "\n".join(x.rstrip() for x in joined.split("\n")).strip()


@F.pandas_udf(T.StringType())
def rtf_text(raw: pd.Series) -> pd.Series:
    """Readable text of RTF bytes, compressed or not; null for null."""
    return raw.map(lambda r: None if r is None else _rtf_text(bytes(r)))


# Suffixes of the published stemming algorithm's second and third steps with what replaces them, and those of its fourth.
STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def _shape(stem: str) -> str:
    """The stem as c and v; y counts as a vowel after a consonant."""
    out = ""
    for i, ch in enumerate(stem):
        out += "v" if ch in "aeiou" or (ch == "y" and i and out[-1] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _short(stem: str) -> bool:
    return _shape(stem)[-3:] == "cvc" and stem[-1] not in "wxy"


def _longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def _stem(w: str) -> str:
    if len(w) < 3 or not (w.isascii() and w.isalpha()):
        return w
    if w.endswith("s"):
        w = w[:-2] if w.endswith(("sses", "ies")) else w if w.endswith("ss") else w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) else w
    elif (end := _longest(w, ("ed", "ing"))) and "v" in _shape(w[: -len(end)]):
        w = w[: -len(end)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c" and w[-1] not in "lsz":
            w = w[:-1]
        elif _measure(w) == 1 and _short(w):
            w += "e"
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    for table in (STEP2, STEP3):
        if (end := _longest(w, table)) and _measure(w[: -len(end)]) > 0:
            w = w[: -len(end)] + table[end]
    if (end := _longest(w, STEP4)) and _measure(w[: -len(end)]) > 1 and (end != "ion" or w[: -len(end)].endswith(("s", "t"))):
        w = w[: -len(end)]
    if w.endswith("e") and (_measure(w[:-1]) > 1 or (_measure(w[:-1]) == 1 and not _short(w[:-1]))):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and _measure(w) > 1 else w


@lru_cache(1 << 18)
def stem_of(word: str) -> str:
    """The stem of a lower-case English word, accents removed."""
    import unicodedata

    return _stem("".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c)))


@F.arrow_udf(T.StringType())
def stemmed(words: pa.Array) -> pa.Array:
    """Stems of lower-case English words, accents removed: a batch's distinct words are looked up once each."""
    coded = words.dictionary_encode()
    return pa.array([stem_of(w) for w in coded.dictionary.to_pylist()], words.type).take(coded.indices)
