"""Column functions on strings: subjects, addresses, names, safe cells, digests."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Reply and forward prefixes, titles and suffixes, domains whose dots do not count.
PREFIXES = ["re", "aw", "antw", "sv", "vs", "ref", "res", "r", "fw", "fwd", "wg", "tr", "rv", "enc", "vb", "doorst"]
TITLES = ["mr", "mrs", "ms", "miss", "dr", "prof", "sir", "jr", "sr", "ii", "iii", "phd", "md", "esq"]
DOTLESS = ["gmail.com", "googlemail.com"]

_PREFIX = rf"(?i)^(?:\s*(?:(?:{'|'.join(PREFIXES)}|\[[^\]]{{1,40}}\])(?:\s*\[\d+\])?\s*[:>]|\[[^\]]{{1,40}}\]))+\s*"


def normalized_subject(c: Column) -> Column:
    """Subject without leading reply and forward prefixes and bracket tags, blanks collapsed, lower case."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), _PREFIX, ""), r"\s+", " ")))


def address_key(c: Column) -> Column:
    """Address for dedup keys: what stands in angle brackets if any, trimmed, lower case, tags kept."""
    inner = F.regexp_extract(c, "<([^>]*)>", 1)
    return F.lower(F.trim(F.when(inner != "", inner).otherwise(c)))


def identity(c: Column) -> Column:
    """struct<address, address_type> of a raw address, for resolving people: tags cut, legacy names kept apart."""
    raw = F.regexp_replace(F.trim(F.when(F.regexp_extract(c, "<([^>]*)>", 1) != "", F.regexp_extract(c, "<([^>]*)>", 1)).otherwise(c)), "(?i)^mailto:", "")
    local, domain = F.regexp_extract(raw, "^(.*)@", 1), F.regexp_replace(F.lower(F.element_at(F.split(raw, "@"), -1)), r"\.$", "")
    local = F.lower(F.regexp_replace(local, r"\+.*$", ""))
    local = F.when(domain.isin(DOTLESS), F.replace(local, F.lit("."), F.lit(""))).otherwise(local)
    digits = F.regexp_replace(raw, r"\D", "")
    pair = lambda a, t: F.struct(a.alias("address"), F.lit(t).alias("address_type"))
    return (
        F.when(F.coalesce(raw, F.lit("")) == "", pair(F.lit(""), "none"))
        .when(raw.rlike("(?i)^/o=.*/cn="), pair(F.upper(raw), "ex"))
        .when(raw.contains("@") & (local != "") & (domain != ""), pair(F.concat(local, F.lit("@"), domain), "smtp"))
        .when(raw.contains("@"), pair(F.lower(raw), "none"))
        .when(raw.rlike(r"^[+\d\s().\-/]+$") & (F.length(digits) >= 7), pair(digits, "phone"))
        .otherwise(pair(F.lower(raw), "none"))
    )


def normalized_name(c: Column) -> Column:
    """Name without apostrophes and hyphens inside words, other punctuation as blanks, titles dropped, lower case."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(c), r"(?<=\w)['’-](?=\w)", ""), r"[^\p{L}\p{N}\s]", " ")
    return F.array_join(F.filter(F.split(F.trim(bare), r"\s+"), lambda w: ~w.isin(TITLES) & (w != "")), " ")


def surname(c: Column) -> Column:
    """The part before a comma if something follows it, else the last word, of a raw name."""
    swapped = c.rlike(r",\s*\S")
    return F.when(swapped, normalized_name(F.split(c, ",")[0])).otherwise(F.coalesce(F.element_at(F.split(normalized_name(c), " "), -1), F.lit("")))


def given_name(c: Column) -> Column:
    swapped = c.rlike(r",\s*\S")
    words = F.split(normalized_name(c), " ")
    return F.when(swapped, normalized_name(F.split(c, ",", 2)[1])).otherwise(F.array_join(F.slice(words, 1, F.size(words) - 1), " "))


def safe_cell(c: Column) -> Column:
    """Text that a spreadsheet would take for a formula, with a quote before it."""
    return F.when(c.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), c)).otherwise(c)


def key(*parts: Column) -> Column:
    """SHA-256 of parts joined by bars, bars within parts escaped, so that other parts give another key; null parts count as empty."""
    escaped = lambda p: F.replace(F.replace(F.coalesce(p.cast("string"), F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|"))
    return F.sha2(F.array_join(F.array(*map(escaped, parts)), "|"), 256)


def person_label(name: Column, address: Column) -> Column:
    none = lambda c: F.coalesce(c, F.lit("")) == ""
    return F.when(none(name), address).when(none(address) | (name == address), name).otherwise(F.concat(name, F.lit(" <"), address, F.lit(">")))


def _jaro_winkler(a: str, b: str) -> float:
    if a == b:
        return 1.0 if a else 0.0
    if not a or not b:
        return 0.0
    window = max(max(len(a), len(b)) // 2 - 1, 0)
    taken, left = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - window), min(len(b), i + window + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                left.append(c)
                break
    if not left:
        return 0.0
    right = [c for c, t in zip(b, taken, strict=True) if t]
    m, t = len(left), sum(x != y for x, y in zip(left, right, strict=True)) // 2
    base = (m / len(a) + m / len(b) + (m - t) / m) / 3
    prefix = next((i for i, (x, y) in enumerate(zip(a[:4], b[:4], strict=False)) if x != y), min(4, len(a), len(b)))
    return base + prefix * 0.1 * (1 - base) if base >= 0.7 else base


@F.pandas_udf(T.DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([_jaro_winkler(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(T.StringType())
def html_text(html: pd.Series) -> pd.Series:
    """Readable text of HTML: blocks on lines of their own, scripts and styles gone, image texts and link targets kept."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        BLOCKS = {"p", "div", "br", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "table", "ul", "ol", "blockquote", "title", "section", "article"}

        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.out, self.skip, self.links = [], 0, []

        def handle_starttag(self, tag, attrs):
            at = dict(attrs)
            if tag in ("script", "style"):
                self.skip += 1
            elif tag in self.BLOCKS:
                self.out.append("\n")
            elif tag == "img" and at.get("alt"):
                self.out.append(at["alt"])
            elif tag == "a":
                self.links.append(at.get("href") or "")

        def handle_endtag(self, tag):
            if tag in ("script", "style"):
                self.skip = max(0, self.skip - 1)
            elif tag == "a" and self.links:
                href = self.links.pop()
                if href.startswith(("http:", "https:", "mailto:")):
                    self.out.append(f" <{href}>")
            elif tag in self.BLOCKS:
                self.out.append("\n")

        def handle_data(self, data):
            if not self.skip:
                self.out.append(data)

    def one(h: str | None) -> str | None:
        if h is None:
            return None
        r = Reader()
        r.feed(h)
        r.close()
        lines = (" ".join(x.split()) for x in "".join(r.out).split("\n"))
        return "\n".join(x for x in lines if x)

    return html.map(one)


# Lines that begin a signature or a quoted message, and headers of quotes.
SIGNATURES = ["\n-- \n", "\n--\n", "\n________________________________\n", "\n-----Original Message-----"]
QUOTE_HEADER = r"(?is)\n\s*(?:On .{0,120}? wrote:|From:.{0,200}?\n\s*(?:Sent|To):)"


def without_signature(body: Column) -> Column:
    """struct<body, removed>: the text before the first signature or quoted message, and the rest; whole where nothing would be left."""
    body = F.coalesce(body, F.lit(""))
    ends = [F.nullif(F.instr(body, F.lit(m)), F.lit(0)) for m in SIGNATURES] + [F.nullif(F.regexp_instr(body, F.lit(QUOTE_HEADER)), F.lit(0))]
    cut = F.least(*ends)
    kept = F.regexp_replace(F.substring(body, F.lit(1), cut - 1), r"^\s+|\s+$", "")
    rest = F.regexp_replace(F.substring(body, cut, F.length(body)), r"^\s+|\s+$", "")
    whole = F.struct(F.regexp_replace(body, r"^\s+|\s+$", "").alias("body"), F.lit(None).cast("string").alias("removed"))
    return F.when(cut.isNull() | (kept == ""), whole).otherwise(F.struct(kept.alias("body"), rest.alias("removed")))


def human_bytes(n: Column) -> Column:
    """A size in the unit that shows it: one decimal under ten of it."""
    shown = F.when(F.coalesce(n, F.lit(0)) <= 0, "0 bytes")
    for unit, size in (("TB", 1 << 40), ("GB", 1 << 30), ("MB", 1 << 20), ("KB", 1 << 10)):
        v = n / F.lit(size)
        shown = shown.when(n >= size, F.concat(F.when(v < 10, F.format_number(v, 1)).otherwise(F.format_number(F.bround(v), 0)), F.lit(" " + unit)))
    return shown.otherwise(F.concat(F.format_number(n, 0), F.lit(" bytes")))


def id_list(text: Column) -> Column:
    """Whole numbers of a JSON list."""
    return F.from_json(text, "array<bigint>")


def card_words(card: Column) -> Column:
    """All words of the values of a JSON contact card, keys left out, in one line for searching."""
    texts = F.regexp_extract_all(card, F.lit(r'"(?:[^"\\]|\\.)*"\s*:?'), F.lit(0))
    values = F.transform(F.filter(texts, lambda t: ~t.endswith(":")), lambda t: F.trim(F.regexp_replace(F.regexp_replace(t, r'^"|"\s*$', ""), r"\\(.)", "$1")))
    return F.array_join(F.filter(values, lambda v: v != ""), " ")


def card_fields(card: Column) -> Column:
    """struct of a JSON contact card: emails and the business address as one line each, three phones."""
    text = "string"
    c = F.from_json(card, f"emails array<{text}>, phones map<{text},{text}>, addresses map<{text},struct<street:{text},city:{text},state:{text},postal_code:{text},country:{text}>>")
    phone = lambda k: F.coalesce(F.element_at(c["phones"], k), F.lit(""))
    a = F.element_at(c["addresses"], "business")
    line = F.array_join(F.filter(F.array(a["street"], a["city"], a["state"], a["postal_code"], a["country"]), lambda v: F.coalesce(v, F.lit("")) != ""), ", ")
    return F.struct(F.array_join(F.coalesce(c["emails"], F.array().cast("array<string>")), "; ").alias("emails"), *(phone(k).alias(f"phone_{k}") for k in ("business", "home", "mobile")), F.coalesce(line, F.lit("")).alias("address"))
