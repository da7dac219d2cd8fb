"""The queries ``opN_<name>`` over the whole test tables, and their SQL where it exists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, exact_dedup, jaccard_join, lexical_search, licenses, mixing, packing, pseudonyms, quality_rules, substring_dedup, suffix_dedup, toxicity, whitening

#: The same white space in SQL: blank, tab, line feed, vertical tab, form feed, carriage return.
SQL_WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.deduplicated(table(spark, sf_dir, "documents")).withColumnRenamed("kept_text", "text")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: What conversation -7 says: every control string of the template, in both roles.
CONTROL_TEXT = r"\### Assistant: </turn> ok"


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = spark.createDataFrame([(-7, 0, "user", CONTROL_TEXT), (-7, 1, "assistant", CONTROL_TEXT)], "conv_id long, turn long, role string, text string")
    nodes = chat_format.trees(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(more), tokenizer_path())
    return chat_format.read_back(nodes, tokenizer_path())


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.linked(table(spark, sf_dir, "documents"), k=3, percent=90).select("doc_id", "n_shingles", "component_id")


def op5_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms.pseudonymised(table(spark, sf_dir, "documents"), b"a key for tests")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.verdicts(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup.decisions(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicated(table(spark, sf_dir, "documents")).withColumn("text", F.make_valid_utf8(F.col("kept").cast("string"))).drop("kept")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), tokenizer_path()).drop("ids")


def op11_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scanned(table(spark, sf_dir, "documents")).drop("found")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op1_mixing": op1_mixing, "op6_quality_rules": op6_quality_rules, "op7_exact_dedup": op7_exact_dedup,
           "op3_chat_format": op3_chat_format, "op2_substring_dedup": op2_substring_dedup, "op4_jaccard_join": op4_jaccard_join, "op5_pseudonyms": op5_pseudonyms, "op8_suffix_dedup": op8_suffix_dedup, "op9_toxicity": op9_toxicity, "op10_packing": op10_packing, "op11_licenses": op11_licenses, "op12_whitening": op12_whitening, "op13_lexical_search": op13_lexical_search}

_OP6 = rf"""
with d as (select doc_id, source, coalesce(text, '') as t from documents),
w as (select *, regexp_extract_all(t, '{SQL_WORD}') as words,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{SQL_WORD}')) as lines from d),
g as (select doc_id, unnest(range(1, len(words) - 3)) as i, words from w where len(words) >= 5),
s as (select doc_id, i, list_aggregate(words[i:i+4], 'string_agg', ' ') as gram from g),
r as (select doc_id, i from (select *, count(*) over (partition by doc_id, gram) as c from s) where c > 1),
rep as (select doc_id, count(distinct i + k) as n_repeat_words from r, (select unnest(range(5)) as k) group by doc_id),
ln as (select doc_id, coalesce(source, chr(1)) as host, t, trim(regexp_replace(lower(x), '[\x20\x09\x0B-\x0D]+', ' ', 'g')) as line
       from (select doc_id, source, t, unnest(string_split(t, chr(10))) as x from d)),
l as (select * from ln where line <> ''),
hosts as (select coalesce(source, chr(1)) as host, count(distinct t) as docs from d group by 1),
common as (select host, line from l join hosts using (host) group by host, line, docs
           having count(distinct t) > 20 and count(distinct t) > 0.10 * docs),
lost as (select doc_id, sum(len(string_split(line, ' '))) as n from l join common using (host, line) group by doc_id),
f as (select w.doc_id, len(words)::bigint as n_words, length(list_aggregate(words, 'string_agg', ''))::bigint as wc,
             (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
             (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines,
             coalesce(n_repeat_words, 0)::bigint as n_repeat_words, coalesce(lost.n, 0) as n_lost
      from w left join rep using (doc_id) left join lost on lost.doc_id = w.doc_id)
select doc_id, n_words, coalesce(wc, 0)::bigint as word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 10 or 100 * n_repeat_words > 20 * n_words) as base_failed,
       not (n_words < 10 or 100 * n_repeat_words > 20 * n_words) and n_words - n_lost >= 10 as kept
from f"""

_OP7 = r"""
with d as (select doc_id, length(coalesce(text, '')) as n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) as text_sha256 from documents)
select doc_id, first_value(doc_id) over (partition by text_sha256 order by n desc, doc_id) as keep_id,
       count(*) over (partition by text_sha256) as group_size,
       row_number() over (partition by text_sha256 order by n desc, doc_id) = 1 as kept, text_sha256
from d"""

_OP3 = r"""
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
           union all select -7, i, r, '\### Assistant: </turn> ok' from (values (0, 'user'), (1, 'assistant')) v(i, r)),
x as (select *, row_number() over () as n, replace(replace(replace(text, '\', '\\'), '</turn>', '\</turn>'), '###', '\###') as body,
             replace(replace(replace(replace(role, '\', '\\'), '</turn>', '\</turn>'), '###', '\###'), chr(10), '\n') as head from t)
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
       sum(length(head) + length(body) + 13)::bigint as formatted_chars
from x group by conv_id, case when conv_id is null then n end"""

_OP2 = rf"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '{SQL_WORD}') as w from documents),
win as (select doc_id, unnest(range(1, len(w) - 11)) as i from d where len(w) >= 13),
h as (select doc_id, i, md5_number(list_aggregate(w[i:i+12], 'string_agg', ' ')) as g from win join d using (doc_id)),
dup as (select doc_id, i from (select *, min(doc_id) over (partition by g) as lo from h) where lo < doc_id),
gone as (select distinct doc_id, i + k as i from dup, (select unnest(range(13)) as k)),
pos as (select doc_id, w, unnest(range(1, len(w) + 1)) as i from d),
kept as (select pos.doc_id, string_agg(w[i], ' ' order by i) as t, count(*) as n from pos anti join gone using (doc_id, i) group by pos.doc_id)
select d.doc_id, len(w)::bigint as n_words, (len(w) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(t, '')) as kept_sha256, coalesce(t, '') as text
from d left join kept using (doc_id)"""

_OP13 = r"""
with low as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as w from documents),
total as (select count(*) as nn, sum(len(w))::bigint as ll from low where len(w) > 0),
occ as (select doc_id, len(w)::bigint as n, unnest(w) as term from low),
tf as (select doc_id, n, term, count(*) as tf from occ group by all),
df as (select term, count(*) as df from tf group by term),
asked as (select distinct item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark),
one as (select item_id, doc_id, floor(1000 * ln((2 * nn + 2)::double / (2 * df + 1)))::bigint * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * nn) // ll)))) as s
        from asked join tf using (term) join df using (term), total),
score as (select item_id, doc_id, sum(s)::bigint as score from one group by all having sum(s) > 0)
select item_id, rank::int as rank, doc_id, score from (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from score) where rank <= 10"""

ORACLE_SQL = {"op13_lexical_search": _OP13, "op2_substring_dedup": _OP2, "op3_chat_format": _OP3, "op6_quality_rules": _OP6, "op7_exact_dedup": _OP7}
