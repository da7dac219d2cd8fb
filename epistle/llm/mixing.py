"""Mixing sources to target weights by pivotal dependent rounding (built-in functions only).

Targets: sources share all words by weight, none beyond CAP times its own words. A document of a source with
ratio r = target / words gets floor(r) copies and one more with probability r - floor(r). The extra copies are
rounded dependently: two documents with fractional mass exchange mass, at random and without bias, until one
of them is wholly in or wholly out, so a pair keeps its words in total. Documents are dealt to buckets of
about FAN rows; a bucket passes its one undecided document with its mass to the next level, and the levels
form a reduction tree of depth log(rows) / log(FAN). About SPARE documents of a source, none above its mean size, wait
for the last level. There the survivors, often long, settle against them, towards the nearer side, so that in the
end one short document is left where they are enough; it is rounded to the nearer side. A source's words miss its target by half
of that document.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, if_small, staged, text_of

CAP = 3
FAN = 64
WEIGHTS = (1, 2, 3)
#: Documents of a source that wait for the last level.
SPARE = 256
#: Equal rows that one task numbers.
MANY = 20_000
#: A row's key: a hash, by which rows are dealt and ordered, and what tells rows of equal hash apart.
KEY = "struct<h:bigint,id:bigint,n:int>"


def ordered_sums(df: DataFrame, order: list[Column], **sums: Column) -> DataFrame:
    """``df`` in global order of ``order``: for each of ``sums`` the total over the rows before, and ``all_<name>`` over all rows.

    Rows are dealt by range and summed within their range; what the ranges before hold is added from a table with one row for each
    range. So no task sees more than a range, however many rows there are. ``order`` must tell rows apart.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [f"__o{k}" for k in range(len(order))]
    dealt = df.withColumns(dict(zip(keys, order, strict=True)) | {f"__{k}": v for k, v in sums.items()}).repartitionByRange(n, *keys)
    dealt = staged(dealt.withColumn("__p", F.spark_partition_id()), "ranges")
    totals = dealt.groupBy("__p").agg(*(F.sum(f"__{k}").alias(f"__t_{k}") for k in sums))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # over one row a range
    whole = Window.partitionBy()
    totals = totals.select(F.col("__p").alias("__q"), *(F.coalesce(F.sum(f"__t_{k}").over(before), F.lit(0)).alias(f"__b_{k}") for k in sums), *(F.sum(f"__t_{k}").over(whole).alias(f"all_{k}") for k in sums))
    own = Window.partitionBy("__p").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.withColumns({f"__w_{k}": F.coalesce(F.sum(f"__{k}").over(own), F.lit(0)) for k in sums}).join(F.broadcast(totals), F.col("__p") == F.col("__q"))
    return out.select(*df.columns, *((F.col(f"__w_{k}") + F.col(f"__b_{k}")).alias(k) for k in sums), *(f"all_{k}" for k in sums))


def numbered(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``df`` with rows of equal ``keys`` (null equal to null) numbered from 1, in no fixed order, as ``name``.

    A key with more than MANY rows, such as that of texts without an id, is dealt to several tasks, each of which numbers its rows
    from where the one before ends.
    """
    many = staged(df.groupBy(*keys).agg(F.count("*").alias("__c")).where(F.col("__c") > MANY), "many")
    n_many = many.count()
    if not n_many:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(1))))
    same = [F.col(f"__k{i}").eqNullSafe(F.col(k)) for i, k in enumerate(keys)]
    hot = many.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), "__c")
    on = same[0]
    for c in same[1:]:
        on = on & c
    dealt = df.withColumn("__m", F.monotonically_increasing_id()).join(if_small(hot, n_many), on, "left").withColumn("__s", F.coalesce(F.pmod(F.xxhash64("__m"), F.ceil(F.col("__c") / MANY)), F.lit(0)))
    dealt = staged(dealt.select(*df.columns, "__m", "__c", "__s"), "dealt")
    shares = dealt.where("__c is not null").groupBy(*keys, "__s").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)  # one row for each MANY
    shares = staged(shares.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), F.col("__s").alias("__t"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__b")), "shares")
    own = F.row_number().over(Window.partitionBy(*keys, "__s").orderBy("__m"))
    out = dealt.withColumn("__r", own).join(if_small(shares, shares.count()), on & (F.col("__t") == F.col("__s")), "left")
    return out.select(*df.columns, (F.col("__r") + F.coalesce("__b", F.lit(0))).cast("int").alias(name))


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size) -> with weight and target. One row per source; null sorts last.

    Sharing again until nobody is above its cap ends at one level L: targets are min(cap, weight * L). With
    sources in order of cap / weight, L follows from running sums, and the capped sources are a prefix.
    """
    w = ordered_sums(sizes, [F.col("source").isNull(), F.col("source")], at=F.lit(1).cast("long"))
    w = w.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("at") % len(WEIGHTS) + 1).cast("int")).cast("double"))
    w = w.withColumn("cap", (CAP * F.col("source_size")).cast("double")).select("source", "source_size", "weight", "cap")
    up = [(F.col("cap") / F.col("weight")), F.col("source").isNull(), F.col("source")]
    w = ordered_sums(w, up, caps=F.col("cap"), weights=F.col("weight"), sizes=F.col("source_size").cast("double"))
    w = staged(w.withColumn("level", (F.col("all_sizes") - F.col("caps")) / (F.col("all_weights") - F.col("weights"))), "shares")
    # the first source that its share does not fill names the level for all behind it
    level = w.where(F.col("level") <= F.col("cap") / F.col("weight")).agg(F.min(F.struct((F.col("cap") / F.col("weight")).alias("ratio"), "level")).alias("x")).first()["x"]  # one number
    return w.withColumn("target", F.least("cap", F.col("weight") * F.lit(level["level"])) if level else F.col("cap")).select("source", "source_size", "weight", "target")


def _uniform(*of: Column) -> Column:
    return F.pmod(F.xxhash64(*of), F.lit(1 << 53)) / F.lit(float(1 << 53))


def _settle(items: Column, seed: int, level: int) -> Column:
    """Run through ``items`` (structs r, k, w, m with 0 < m < w; r: spare): the undecided one, and (k, x) of the others."""
    none = F.struct(F.lit(None).cast(KEY).alias("k"), F.lit(0.0).alias("w"), F.lit(0.0).alias("m"))
    done = F.array().cast(f"array<struct<k:{KEY},x:int>>")

    def step(acc: Column, b: Column) -> Column:
        a = acc["c"]
        d, e = F.least(a["w"] - a["m"], b["m"]), F.least(a["m"], b["w"] - b["m"])  # mass that can go to a, or to b
        chance = _uniform(F.lit(seed), F.lit(level), a["k"], b["k"]) * (d + e) < e
        up = F.when(b["r"] & (a["w"] > b["w"]), 2 * a["m"] >= a["w"]).otherwise(chance)
        fills, drains = a["w"] - a["m"] <= b["m"], a["m"] <= b["w"] - b["m"]
        full_a, empty_b = up & fills, up & ~fills
        empty_a, full_b = ~up & drains, ~up & ~drains
        fixed = lambda k, x: F.struct(k.alias("k"), x.cast("int").alias("x"))
        a_out, b_out = fixed(a["k"], F.when(full_a, 1).otherwise(0)), fixed(b["k"], F.when(full_b, 1).otherwise(0))
        m = F.when(full_a, b["m"] - d).when(empty_b, a["m"] + d).when(empty_a, b["m"] + e).otherwise(a["m"] - e)
        keep_b = full_a | empty_a
        k, w = F.when(keep_b, b["k"]).otherwise(a["k"]), F.when(keep_b, b["w"]).otherwise(a["w"])
        out = F.when(keep_b, a_out).otherwise(b_out)
        left = (m > 0) & (m < w)  # both may become whole at once
        both = F.array(out, fixed(k, F.when(m >= w, 1).otherwise(0)))
        moved = F.struct(F.when(left, F.struct(k.alias("k"), w.alias("w"), m.alias("m"))).otherwise(none).alias("c"), F.concat(acc["done"], F.when(left, F.array(out)).otherwise(both)).alias("done"))
        return F.when(a["k"].isNull(), F.struct(F.struct(b["k"].alias("k"), b["w"].alias("w"), b["m"].alias("m")).alias("c"), acc["done"].alias("done"))).otherwise(moved)

    return F.aggregate(items, F.struct(none.alias("c"), done.alias("done")), step)


def mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 1) -> DataFrame:
    """One row per row of ``docs``: id, source, size, source_size, target, copies (0 to CAP), taken words.

    Null text has size 0; null is a source of its own, last in order. Rows without words, and sources without
    any, take nothing. Rows equal in id, source, size and hash of the text are told apart by number, so a repeated row is
    a document of its own. The result depends only on these, never on how rows are spread, so reruns agree, and
    long texts count like others. An empty table gives no rows; other columns are ignored.
    """
    sized = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.regexp_count(text_of(text_col), F.lit(WORD)).cast("long").alias("size"), F.xxhash64(text_of(text_col)).alias("h"))
    sized = staged(sized, "sized")
    sized = staged(numbered(sized, ["id", "source", "size", "h"], "n"), "numbered")
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    per = staged(per.join(targets(per.select("source", "source_size")).select(F.col("source").alias("s"), "target"), F.col("source").eqNullSafe(F.col("s"))).drop("s"), "targets")
    stats = per.agg(F.count("*"), F.max("rows")).first()
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    small = if_small(per.select(F.col("source").alias("s"), "source_size", "target", "rows", share.alias("r")), stats[0])
    rows = sized.join(small, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    rows = rows.withColumn("whole", F.least(F.floor("r"), F.lit(CAP)).cast("int")).withColumn("part", F.when(F.col("whole") >= CAP, 0.0).otherwise(F.col("r") - F.col("whole")))
    rows = staged(rows.withColumn("k", F.struct(F.xxhash64("id", "source", "size", "h", "n", F.lit(seed)).alias("h"), F.coalesce("id", F.lit(0)).cast("long").alias("id"), F.col("n").cast("int").alias("n"))), "rows")

    w = F.col("size").cast("double")
    todo = rows.where("size > 0 and part > 0").select("source", "k", w.alias("w"), (w * F.col("part")).alias("m"), "rows", "source_size")
    todo = todo.where("m > 0 and m < w").withColumn("b", F.pmod("k.h", F.ceil(F.col("rows") / FAN)))
    short = F.col("w") * F.col("rows") <= F.col("source_size")
    todo = todo.withColumn("r", short & (F.pmod(F.xxhash64("k"), F.ceil(F.col("rows") / SPARE)) == 0) & (F.col("rows") > FAN)).drop("source_size")
    spare, todo, settled = todo.where("r").withColumn("b", F.lit(0).cast("long")), todo.where("not r"), None
    levels = 1 + max(1, math.ceil(math.log(max(stats[1] or 1, 2), FAN)))
    for level in range(levels):
        if level == levels - 1:
            todo = todo.unionByName(spare)
        items = F.array_sort(F.collect_list(F.struct("r", "k", "w", "m")))
        # the last level has one bucket for each source; what it leaves is rounded to the nearer side
        done = todo.groupBy("source", "b").agg(_settle(items, seed, level).alias("s"), F.first("rows").alias("rows"))
        done = staged(done.select("source", "b", "rows", "s.c", "s.done"), f"level{level}")
        part = done.select(F.inline("done"))
        settled = part if settled is None else settled.union(part)
        todo = done.where("c.k is not null").select("source", "c.*", "rows", F.floor(F.col("b") / FAN).alias("b"), F.lit(False).alias("r"))
    settled = settled.union(todo.select("k", F.when(2 * F.col("m") >= F.col("w"), 1).otherwise(0).alias("x")))
    out = rows.join(settled, "k", "left").withColumn("copies", F.col("whole") + F.coalesce("x", F.lit(0)))
    return out.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), F.col("h").alias("text_hash"), "n")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 1) -> DataFrame:
    """``docs`` with each row repeated as often as the mix takes it; columns and whole texts as they were."""
    take = mixture(docs, id_col, text_col, source_col, seed).where("copies > 0")
    take = take.select(F.col(id_col).alias("__i"), F.col(source_col).alias("__s"), F.col("size").alias("__z"), F.col("text_hash").alias("__h"), F.col("n").alias("__n"), "copies")
    sized = docs.withColumns({"__z": F.regexp_count(text_of(text_col), F.lit(WORD)).cast("long"), "__h": F.xxhash64(text_of(text_col))})
    sized = numbered(sized, [id_col, source_col, "__z", "__h"], "__n")
    a, b = sized.alias("a"), take.alias("b")
    same = F.col(f"a.{id_col}").eqNullSafe(F.col("b.__i")) & F.col(f"a.{source_col}").eqNullSafe(F.col("b.__s")) & (F.col("a.__z") == F.col("b.__z")) & (F.col("a.__h") == F.col("b.__h")) & (F.col("a.__n") == F.col("b.__n"))
    out = a.join(b, same).select(*(F.col(f"a.`{c}`") for c in docs.columns), F.explode(F.sequence(F.lit(1), "copies")).alias("__copy"))
    return out.drop("__copy")
