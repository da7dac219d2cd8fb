"""People: statistics, correspondents, merge proposals, source overlap."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import given_name, jaro_winkler, normalized_name, surname
from ..settings import Persons
from .graph import components, shared_out, staged


def statistics(participations: DataFrame, items: DataFrame) -> DataFrame:
    """(person_id, items, first_seen, last_seen), recomputed from distinct items."""
    links = participations.select("person_id", "item_id").distinct().join(items.select("item_id", "occurred"), "item_id")
    return links.groupBy("person_id").agg(F.count("*").alias("items"), F.min("occurred").alias("first_seen"), F.max("occurred").alias("last_seen"))


def correspondents(participations: DataFrame, top: int) -> DataFrame:
    """(person_id, other_id, shared, rank): for each sender the ``top`` receivers by distinct shared items."""
    met = staged(participations.where("role in ('from', 'to')").select("item_id", "person_id", "role").distinct(), "met")
    n = met.count()
    met = shared_out(met, n, "item_id")
    sent = met.where("role = 'from'").select("item_id", "person_id")
    got = met.where("role = 'to'").select("item_id", F.col("person_id").alias("other_id"))
    return _foremost(_shared(sent.join(got, "item_id"), n), n, "person_id", top)


def _shared(met: DataFrame, rows: int) -> DataFrame:
    """(person_id, other_id, shared): how many of the ``rows`` or so meetings each pair of people has."""
    return shared_out(met.where("person_id <> other_id"), rows, "person_id", "other_id").groupBy("person_id", "other_id").agg(F.count("*").alias("shared"))


def _foremost(pairs: DataFrame, rows: int, by: str, top: int) -> DataFrame:
    """The ``top`` of the ``rows`` or so pairs of each ``by``; those of each hundredth of the others are found first, so nobody with very many pairs fills a task."""
    ranked = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("shared"), "other_id"))
    part = F.pmod(F.xxhash64("other_id"), F.lit(100))
    some = shared_out(pairs.withColumn("part", part), rows, by, "part").withColumn("rank", ranked(by, "part")).where(F.col("rank") <= top).drop("rank", "part")
    return shared_out(some, rows, by).withColumn("rank", ranked(by)).where(F.col("rank") <= top)


def partners(participations: DataFrame, top: int, crowd: int = 1000) -> DataFrame:
    """(person_id, other_id, shared, rank): for each person the ``top`` others by shared items, in whatever roles; ties by the smaller id.

    People of items with up to ``crowd`` people meet one another. Of larger items (a letter to everybody) people with the
    same set of such items form a class: classes meet, and as any two people of a pair of classes share equally many large
    items, the ``top`` + 1 smallest ids of a class stand for all its others. So no large item is expanded into its pairs,
    and the result is that of all pairs. Work on large items grows with the squares of their classes.
    """
    links = staged(participations.select("item_id", "person_id").distinct(), "links")
    large = staged(links.groupBy("item_id").agg(F.count("*").alias("n")).where(F.col("n") > crowd).select("item_id"), "crowds")
    small = links.join(large, "item_id", "left_anti") if large.take(1) else links
    met = small.groupBy("item_id").agg(F.count("*").alias("n")).agg(F.sum(F.col("n") * (F.col("n") - 1))).first()[0] or 0
    small = shared_out(small, links.count(), "item_id")
    pairs = _shared(small.join(small.withColumnRenamed("person_id", "other_id"), "item_id"), met)
    if not large.take(1):
        return _foremost(pairs, met, "person_id", top)
    sets = links.join(large, "item_id").groupBy("person_id").agg(F.array_sort(F.collect_list("item_id")).alias("large"))
    classes = sets.groupBy("large").agg(F.min("person_id").alias("class"))
    members = staged(sets.join(classes, "large").select("person_id", "class"), "members")
    within = classes.select("class", F.explode("large").alias("item_id"))
    meet = within.join(within.withColumnRenamed("class", "other_class"), "item_id").groupBy("class", "other_class").agg(F.count("*").alias("common"))
    meet = staged(meet, "classes")
    first = F.row_number().over(Window.partitionBy("class").orderBy("person_id"))
    heads = members.withColumn("k", first).where(F.col("k") <= top + 1).select(F.col("class").alias("other_class"), F.col("person_id").alias("other_id"))
    # one more than wanted, as a person may be among its own class's others
    offered = _foremost(meet.join(heads, "other_class").select("class", "other_id", F.col("common").alias("shared")), meet.count() * (top + 1), "class", top + 1).drop("rank")
    far = members.join(offered, "class").where("person_id <> other_id").select("person_id", "other_id", "shared")
    of = lambda who, c: members.select(F.col("person_id").alias(who), F.col("class").alias(c))
    near = pairs.join(of("person_id", "class"), "person_id", "left").join(of("other_id", "other_class"), "other_id", "left").join(meet, ["class", "other_class"], "left")
    near = near.select("person_id", "other_id", (F.col("shared") + F.coalesce("common", F.lit(0))).alias("shared"))
    rows = met + members.count() * (top + 1)
    return _foremost(shared_out(near.union(far), rows, "person_id", "other_id").groupBy("person_id", "other_id").agg(F.max("shared").alias("shared")), rows, "person_id", top)


def per_year(participations: DataFrame, items: DataFrame) -> DataFrame:
    """(person_id, year, items) for every year between a person's first and last, zeros kept."""
    links = participations.select("person_id", "item_id").distinct().join(items.select("item_id", F.substring("occurred", 1, 4).cast("int").alias("year")), "item_id")
    counts = links.groupBy("person_id", "year").agg(F.count("*").alias("items"))
    spine = counts.groupBy("person_id").agg(F.min("year").alias("lo"), F.max("year").alias("hi")).select("person_id", F.explode(F.sequence("lo", "hi")).alias("year"))
    return spine.join(counts, ["person_id", "year"], "left").fillna(0, ["items"])


def sender_share(participations: DataFrame, least: float) -> DataFrame:
    """(person_id, sent, share) of people who sent at least that share of all."""
    sent = participations.where("role = 'from'")
    total = sent.agg(F.count("*").alias("total"))
    return sent.groupBy("person_id").agg(F.count("*").alias("sent")).join(F.broadcast(total)).select("person_id", "sent", (F.col("sent") / F.col("total")).alias("share")).where(F.col("share") >= least)


def source_overlap(item_sources: DataFrame, least_items: int, least_share: float) -> DataFrame:
    """(a, b, shared, overlap) of sources that share that part of the smaller one's items: one self-join on items."""
    links = staged(item_sources.select("item_id", "source_id"), "sources")
    n = links.count()
    sizes = links.groupBy("source_id").agg(F.count("*").alias("n")).where(F.col("n") >= least_items)
    links = shared_out(links, n, "item_id")
    left, right = links.select("item_id", F.col("source_id").alias("a")), links.select("item_id", F.col("source_id").alias("b"))
    pairs = shared_out(left.join(right, "item_id").where("a < b"), 2 * n, "a", "b").groupBy("a", "b").agg(F.count("*").alias("shared"))
    size = lambda c: sizes.select(F.col("source_id").alias(c), F.col("n").alias(f"n_{c}"))
    out = pairs.join(size("a"), "a").join(size("b"), "b").withColumn("overlap", F.col("shared") / F.least("n_a", "n_b"))
    return out.where(F.col("overlap") >= least_share).select("a", "b", "shared", "overlap")


def same_name(people: DataFrame) -> DataFrame:
    """(a, b, confidence): people whose normalised names are equal, of two words and four characters at least.

    Each person is paired with the smallest id of the same name and organisation (0.9), and that one with the smallest
    of the name (0.75), so pairs grow with people and not with their squares; merging them merges the whole group.
    """
    n = people.where("name not like '%@%'").select("person_id", "org", normalized_name(F.col("name")).alias("norm")).where("length(norm) >= 4 and norm like '% %'")
    inner = n.groupBy("norm", "org").agg(F.min("person_id").alias("k"))
    outer = inner.groupBy("norm").agg(F.min("k").alias("k"))
    i, o = inner.alias("i"), outer.alias("o")
    within = n.alias("n").join(i, F.expr("n.norm = i.norm and n.org <=> i.org and n.person_id > i.k")).select(F.col("i.k").alias("a"), F.col("n.person_id").alias("b"), F.when(F.col("n.org").isNull(), 0.75).otherwise(0.9).alias("confidence"))
    across = i.join(o, F.expr("i.norm = o.norm and i.k > o.k")).select(F.col("o.k").alias("a"), F.col("i.k").alias("b"), F.lit(0.75).alias("confidence"))
    return within.union(across)


def same_surname(people: DataFrame) -> DataFrame:
    """(a, b, confidence): people (person_id, name, domain) with one surname and domain and given names that agree.

    Equal or missing given names count 0.8, an initial of the other 0.7. Everybody is paired with the smallest id of the
    same full name, and only these with one another, so a common name costs no more pairs than it has people.
    """
    n = people.select("person_id", "domain", surname(F.col("name")).alias("last"), given_name(F.col("name")).alias("given")).where("length(last) >= 3 and domain is not null")
    first = n.groupBy("last", "domain", "given").agg(F.min("person_id").alias("k"))
    f, g = first.alias("f"), first.alias("g")
    alike = n.join(first, ["last", "domain", "given"]).where("person_id > k").select(F.col("k").alias("a"), F.col("person_id").alias("b"), F.lit(0.8).alias("confidence"))
    pair = lambda c: (F.least("f.k", "g.k").alias("a"), F.greatest("f.k", "g.k").alias("b"), F.lit(c).alias("confidence"))
    bare = f.where("given = ''").join(g.where("given <> ''"), F.expr("f.last = g.last and f.domain = g.domain")).select(*pair(0.8))
    initial = f.where("length(given) between 1 and 2").join(
        g, F.expr("f.last = g.last and f.domain = g.domain and left(f.given, 1) = left(g.given, 1) and (length(f.given) < length(g.given) or (length(f.given) = length(g.given) and f.given < g.given))")
    )
    return alike.union(bare).union(initial.select(*pair(0.7)))


def merge_queue(proposals: DataFrame, refused: DataFrame, statistics_: DataFrame) -> DataFrame:
    """(keep, merge, confidence): the best proposal of each pair that nobody refused (a, b); the person with more items stays."""
    best = proposals.groupBy("a", "b").agg(F.max("confidence").alias("confidence")).join(refused, ["a", "b"], "left_anti")
    size = lambda c: statistics_.select(F.col("person_id").alias(c), F.col("items").alias(f"n_{c}"))
    j = best.join(size("a"), "a", "left").join(size("b"), "b", "left").fillna(0, ["n_a", "n_b"])
    larger = F.col("n_b") > F.col("n_a")
    return j.select(F.when(larger, F.col("b")).otherwise(F.col("a")).alias("keep"), F.when(larger, F.col("a")).otherwise(F.col("b")).alias("merge"), "confidence")


def merged(participations: DataFrame, merges: DataFrame) -> DataFrame:
    """Participations with every person replaced by the last of its chain of ``merges`` (loser, winner), the smallest id.

    The rows given stay as they are, so a merge is undone by leaving it out of ``merges``.
    """
    found = components(merges.select(F.col("loser").alias("a"), F.col("winner").alias("b"))).select(F.col("id").alias("person_id"), "root")
    return participations.join(found, "person_id", "left").withColumn("person_id", F.coalesce("root", "person_id")).drop("root").distinct()


def without_role_mailboxes(people: DataFrame, addresses: DataFrame, roles: list[str]) -> DataFrame:
    """People none of whose ``addresses`` (person_id, address) is an office's: one whose part before the @ is among ``roles``."""
    shared = addresses.where(F.lower(F.substring_index("address", "@", 1)).isin([r.lower() for r in roles])).select("person_id")
    return people.join(shared, "person_id", "left_anti")


def proposals(people: DataFrame, addresses: DataFrame | None, links: DataFrame | None, limits: Persons) -> DataFrame:
    """(a, b, confidence), a < b: the best proposal of each pair of ``people`` (person_id, name, org, domain) by equal names, surnames and, with ``links``, similar names.

    People with an address that several share are left out.
    """
    own = people if addresses is None else without_role_mailboxes(people, addresses, list(limits.shared_mailboxes))
    found = same_name(own).union(same_surname(own))
    if links is not None:
        found = found.union(similar_names(own, links, limits.alike, 0.85))
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "confidence").groupBy("a", "b").agg(F.max("confidence").alias("confidence"))


def similar_names(people: DataFrame, links: DataFrame, least: float, most: float = 1.0) -> DataFrame:
    """(a, b, score) of people with a shared correspondent (person_id, other_id) whose names differ and are similar; a score is ``most`` at most.

    Names meet before people do: a name counts once with each correspondent and a pair of names is scored once, after its
    lengths allow the score (a shared beginning adds two fifths of what is missing at most). People stand in a list beside
    their name and correspondent, so only those of similar names that met are paired, and they are not dealt by names.
    """
    n = people.select("person_id", normalized_name(F.col("name")).alias("norm"))
    known = links.join(n, "person_id").where("norm is not null")
    names = staged(known.groupBy("other_id", "norm").agg(F.collect_set("person_id").alias("people")).withColumn("len", F.length("norm")), "names")
    x, y = names.alias("x"), names.alias("y")
    jaro = (least - 0.4) / 0.6
    fits = F.least("x.len", "y.len") >= (3 * jaro - 2 - 1e-9) * F.greatest("x.len", "y.len")
    met = x.join(y, F.expr("x.other_id = y.other_id and x.norm < y.norm")).where(fits)
    met = met.select(F.col("x.norm").alias("na"), F.col("y.norm").alias("nb"), F.col("x.people").alias("ps"), F.col("y.people").alias("qs"))
    # staged, or the filter on the score would be moved below the distinct and score each meeting
    once = staged(met.select("na", "nb").distinct(), "met")
    alike = staged(once.withColumn("score", jaro_winkler("na", "nb")).where(F.col("score") >= least), "alike")
    pairs = met.join(alike, ["na", "nb"]).select("score", F.explode("ps").alias("p"), "qs").select("score", "p", F.explode("qs").alias("q")).where("p <> q")
    return pairs.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), F.least("score", F.lit(most)).alias("score")).distinct()


def identities(sightings: DataFrame) -> DataFrame:
    """(address, uses, names, first_name, first_seen, last_seen) of sightings (address, name, at): the name seen first is kept."""
    named = F.struct("at", "name")
    return sightings.groupBy("address").agg(
        F.count("*").alias("uses"), F.countDistinct("name").alias("names"), F.min(F.when(F.col("name").isNotNull(), named))["name"].alias("first_name"), F.min("at").alias("first_seen"), F.max("at").alias("last_seen"),
    )
