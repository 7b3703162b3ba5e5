"""Near-duplicate documents by bottom-k sketches of word shingles.

1. One pass hashes every text to its set of shingles with one hash function and keeps the k smallest values,
   the size of the set and a digest of the whole set. Documents with equal sets form a class.
2. Retained values that two or more classes share make inverted lists. Two sets that are similar enough
   share so many retained values that they must meet in the list of a rare one (a prefix of each sketch,
   rarest values first, is enough).
3. In each list every class is compared with one leader; the estimate from the union of both sketches sorts
   out most pairs, the full sets decide. This joins dense groups with few comparisons.
4. Classes of lists that still hold several components are gone through again by their full sets, joined on the rarest
   shingles under the size and place bounds that every similar pair meets: first with the most central classes of
   each list, 1, then 4, then 16, contracting what they join, so that a dense group of any size becomes one component
   with comparisons in proportion to its size; at last all pairs of components that are still apart. No link is lost,
   and no round builds all pairs of a large group.
5. Connected components of the confirmed links, with the smallest document id of each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.ranking import first_per_group
from quire.llm.common import bounded_batches, broadcast_within, discard, fixed, text_or_empty
from quire.llm.components import connected_components
from quire.llm.shingles import shingle_set

K = 64
SPREAD = 0.3  # similar sets share at least the threshold less this part of a sketch (six standard deviations)
SLACK = 0.28  # the estimate may be so much below the threshold (over five standard deviations)
LEADERS = (1, 4, 16)  # leaders of a list in the rounds of comparison before the last, which takes all that is left
FEW_MEETINGS = 8  # meetings for each row of all prefixes, at most, for all pairs to be tried before the last round
BROADCAST_KEYS = 1_000_000

_SKETCH = "n_shingles long, digest binary, sketch array<long>"


def _sketches(batches: Iterator[pa.RecordBatch], width: int, k: int) -> Iterator[pa.RecordBatch]:
    """Adds size, digest and sketch of the last column's text to the other columns."""
    for batch in batches:
        sizes, digests, sketches = [], [], []
        for text in batch.columns[-1]:
            values = shingle_set(text.as_py().encode(), width)
            sizes.append(len(values))
            digests.append(hashlib.blake2b(values.tobytes(), digest_size=16).digest())
            sketches.append(values[:k])
        offsets = np.r_[0, np.cumsum([len(s) for s in sketches])].astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sketches + [np.empty(0, np.int64)])))
        columns = [*batch.columns[:-1], pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), lists]
        names = [*batch.schema.names[:-1], "n_shingles", "digest", "sketch"]
        yield pa.RecordBatch.from_arrays(columns, names=names)


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingle_set(text.as_py().encode(), width) for text in batch.column(1)]
        offsets = np.r_[0, np.cumsum([len(s) for s in sets])].astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets + [np.empty(0, np.int64)])))
        yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["class", "shingles"])


def _at_least(percent: int, of: Column) -> Column:
    """Smallest whole number that is at least ``percent`` per cent of ``of``."""
    return _ceil_div(of * percent, 100)


def _ceil_div(value: Column, by: int) -> Column:
    return F.floor((value + (by - 1)) / by)


def _prefix_length(percent: int, k: int) -> Column:
    """How many retained values, rarest first, are enough to meet every similar class."""
    held, n = F.size("sketch"), F.col("n_shingles")
    whole = F.floor(n * 100 / percent) <= k  # partners of such a set keep their whole sets, too
    shared = F.when(whole, _at_least(percent, n)).otherwise(F.floor(held * (percent / 100 - SPREAD)))
    return held - F.greatest(shared, F.lit(1)) + 1


def _lists(classes: DataFrame, percent: int, k: int) -> DataFrame:
    """value, class, own for the rare retained values that several classes share.

    ``own``: how many values of the class's sketch no other class has; few in the text that others copy.
    """
    held = classes.where("n_shingles > 0").select("class", F.explode("sketch").alias("value"))
    shared = held.groupBy("value").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    # the values that are not shared come before all others and need only be counted
    common = held.join(shared, "value").groupBy("class").agg(F.collect_list(F.struct("df", "value")).alias("shared"))
    lengths = classes.select("class", _prefix_length(percent, k).alias("length"), F.size("sketch").alias("held"))
    common = common.join(lengths, "class")
    own = F.col("held") - F.size("shared")
    kept = F.slice(F.array_sort("shared"), F.lit(1), F.greatest(F.col("length") - own, F.lit(0)).cast("int"))
    entries = common.select("class", own.alias("own"), F.explode(kept).alias("entry"))
    return entries.select(F.col("entry.value").alias("value"), "class", "own")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int, k: int) -> DataFrame:
    """src, dst: the pairs whose full sets are similar enough; the sketches sort out the others first."""
    left = sets.select(*[F.col(c).alias(f"{c}_a") for c in sets.columns]).withColumnRenamed("class_a", "src")
    right = sets.select(*[F.col(c).alias(f"{c}_b") for c in sets.columns]).withColumnRenamed("class_b", "dst")
    both = pairs.join(right, "dst").join(left, "src")
    union = F.slice(F.array_sort(F.array_union("sketch_a", "sketch_b")), 1, k)
    agreed = F.size(F.array_intersect(union, F.array_intersect("sketch_a", "sketch_b")))
    likely = agreed >= F.size(union) * (percent / 100 - SLACK)
    shared = F.size(F.array_intersect("shingles_a", "shingles_b"))
    joined = F.col("n_shingles_a") + F.col("n_shingles_b") - F.col("shared")
    both = both.where(likely).select("src", "dst", "n_shingles_a", "n_shingles_b", F.explode(F.array(shared)).alias("shared"))
    return both.where(F.col("shared") * 100 >= joined * percent).select("src", "dst")


def _leader_pairs(lists: DataFrame) -> DataFrame:
    """src, dst: every class of a list with the list's leader."""
    leaders = lists.groupBy("value").agg(F.min(F.struct("own", "class")).alias("leader"))
    stars = lists.join(leaders, "value").where(F.col("class") != F.col("leader.class"))
    ends = F.least("leader.class", "class").alias("src"), F.greatest("leader.class", "class").alias("dst")
    return stars.select(*ends).distinct()


def _groups(group: DataFrame, links: DataFrame) -> DataFrame:
    """class, group: the groups, with those joined that ``links`` (src, dst: classes) connect."""
    for end in ("src", "dst"):
        links = links.join(group.withColumnsRenamed({"class": end, "group": f"{end}_group"}), end).drop(end)
    joined = connected_components(links.withColumnsRenamed({"src_group": "src", "dst_group": "dst"}))
    found = group.join(joined.withColumnRenamed("node", "group"), "group", "left")
    return fixed(found.select("class", F.coalesce("component", "group").alias("group")), "groups")


def _prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """value, class, n_shingles, alone, place: the rarest shingles of each full set, as many as a similar set must meet.

    alone: how many shingles of the set no other one has.

    For sets of sizes a <= b with enough in common: a is at least ``percent`` of b, they share at least
    percent * (a + b) / (100 + percent) shingles, and so the first shared one, in any fixed order of shingles,
    stands within the first a - that + 1 of one and b - that + 1 of the other. A place too late even for the smallest
    set that holds the shingle is left out: in a large group, that is most places of the copies changed most.
    """
    n = F.col("n_shingles")
    each = sets.select("class", "n_shingles", F.explode("shingles").alias("value"))
    shared = each.groupBy("value").agg(F.count(F.lit(1)).alias("df"), F.min("n_shingles").alias("least")).where("df > 1")
    entry = F.struct("df", "value", "least")
    common = each.join(shared, "value").groupBy("class", "n_shingles").agg(F.collect_list(entry).alias("shared"))
    # places count the unshared shingles, which come first
    longest = n - _at_least(percent, n) + 1
    alone = (n - F.size("shared")).cast("int")
    kept = F.slice(F.array_sort("shared"), F.lit(1), F.greatest(longest - alone, F.lit(0)).cast("int"))
    entries = common.select("class", "n_shingles", alone.alias("alone"), F.posexplode(kept).alias("i", "entry"))
    entries = entries.select("entry.value", "entry.least", "class", "n_shingles", "alone", (F.col("alone") + F.col("i")).alias("place"))
    in_reach = n - F.col("place") >= _ceil_div(percent * (n + F.col("least")), 100 + percent)
    return entries.where(in_reach).drop("least")


def _apart(prefixes: DataFrame, group: DataFrame) -> DataFrame:
    """The rows of ``prefixes`` whose value several groups hold, with group and foreign: how many of them other groups have,
    on average of the value's rows."""
    entries = prefixes.join(group, "class")
    held = entries.groupBy("value", "group").agg(F.count(F.lit(1)).alias("n"))
    held = held.groupBy("value").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("own"), F.count(F.lit(1)).alias("groups"))
    foreign = (F.col("n") - F.col("own") / F.col("n")).alias("foreign")
    return fixed(entries.join(held.where("groups > 1").select("value", foreign), "value"), "apart")


def _open_pairs(entries: DataFrame, leaders: DataFrame, percent: int) -> DataFrame:
    """src, dst: classes and leaders of different components that meet in a prefix and can be similar by sizes and places."""
    a, b = (
        side.select("value", *[F.col(c).alias(f"{c}_{x}") for c in ("class", "n_shingles", "place", "group")])
        for side, x in ((entries, "a"), (entries if leaders is None else leaders, "b"))
    )
    needed = _ceil_div(percent * (F.col("n_shingles_a") + F.col("n_shingles_b")), 100 + percent)
    rest = F.least(F.col("n_shingles_a") - F.col("place_a"), F.col("n_shingles_b") - F.col("place_b"))
    small, large = F.least("n_shingles_a", "n_shingles_b"), F.greatest("n_shingles_a", "n_shingles_b")
    fits = (small * 100 >= large * percent) & (rest >= needed) & (F.col("group_a") != F.col("group_b"))
    if leaders is None:  # each pair from one side only
        order = F.struct("n_shingles_a", "class_a") < F.struct("n_shingles_b", "class_b")
        # the smaller set's places are bounded more tightly: equal sizes are the least it can meet
        a = a.where(F.col("place_a") <= F.col("n_shingles_a") - _ceil_div(2 * percent * F.col("n_shingles_a"), 100 + percent))
        fits = fits & order
    met = a.join(b, "value").where(fits)
    ends = F.least("class_a", "class_b").alias("src"), F.greatest("class_a", "class_b").alias("dst")
    return met.select(*ends).distinct()


def similar_classes(docs: DataFrame, carry: list[str], width: int, percent: int, k: int = K) -> tuple[DataFrame, DataFrame]:
    """(rows, groups): ``carry`` columns with n_shingles and class, and the group of every class that may have links.

    ``docs`` needs ``text``; a class is a whole number that stands for one set of shingles (null: no words).
    A group is a component of all confirmed links, named after one of its classes; a class without a group is alone.
    """
    bounded_batches(docs.sparkSession)
    mark = F.xxhash64(text_or_empty())
    texts = docs.select(*carry, mark.alias("mark"), text_or_empty().alias("text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema.fields[:-1])
    rows = fixed(texts.mapInArrow(lambda b: _sketches(b, width, k), f"{schema}, {_SKETCH}"), "sketches")

    # one row per set; equal sets have equal sketches, and any of their texts will do
    classes = rows.where("n_shingles > 0").groupBy("digest", "n_shingles")
    classes = classes.agg(F.min("mark").alias("mark"), F.first("sketch").alias("sketch"))
    classes = fixed(classes.withColumn("class", F.monotonically_increasing_id()), "classes")
    lists = fixed(_lists(classes, percent, k), "lists")

    # full sets of the classes that share a list with another
    wanted = fixed(lists.select("class").distinct().join(classes, "class"), "wanted")
    marks = broadcast_within(wanted.select("mark").distinct(), BROADCAST_KEYS)
    found = docs.select(F.xxhash64(text_or_empty()).alias("mark"), text_or_empty().alias("text")).join(marks, "mark", "left_semi")
    found = found.groupBy("mark").agg(F.first("text").alias("text")).join(wanted.select("mark", "class"), "mark")
    sets = found.select("class", "text").mapInArrow(lambda b: _sets(b, width), "class long, shingles array<long>")
    sets = fixed(sets.join(wanted.select("class", "n_shingles", "sketch"), "class"), "sets")
    discard(wanted)

    # every class of a list with the list's leader, the class that adds least of its own
    tried = fixed(_leader_pairs(lists), "leader-pairs")
    links = fixed(_confirmed(tried, sets, percent, k), "links")
    group = _groups(sets.select("class", F.col("class").alias("group")), links)

    # what is left between components, by prefixes of the full sets: first every class with the most central ones of its
    # lists, those that have fewest shingles alone; what they join needs no further pairs. Then all pairs of components
    # that are still apart.
    open_lists = lists.join(group, "class").groupBy("value").agg(F.min("group").alias("low"), F.max("group").alias("high"))
    members = lists.join(open_lists.where("low <> high"), "value").select("class").distinct()
    prefixes = fixed(_prefixes(sets.join(members, "class", "left_semi"), percent), "all-prefixes")
    few = FEW_MEETINGS * prefixes.count()
    central = None
    tests = [tried]
    for low, high in zip((0, *LEADERS), (*LEADERS, None)):
        apart = _apart(prefixes, group)
        tests.append(apart)
        n, met = apart.agg(F.count(F.lit(1)), F.sum("foreign") / 2).first()
        if not n:
            break
        # all pairs at once where they are about as few as those that leaders would make
        last = high is None
        if last or met <= few:
            pairs = fixed(_open_pairs(apart, None, percent).join(tried, ["src", "dst"], "left_anti"), "open-pairs")
            tests.append(pairs)
            last = last or pairs.count() <= tests[0].count()
        if not last:
            if central is None:
                order = [F.col("alone"), F.col("class")]
                central = fixed(first_per_group(prefixes, ["value"], order, LEADERS[-1], spread_by="class", rank="rank"), "central")
                tests.append(central)
            leaders = central.where(F.col("rank").between(low + 1, high)).join(group, "class")
            pairs = fixed(_open_pairs(apart, leaders, percent).join(tried, ["src", "dst"], "left_anti"), "open-pairs")
            tests.append(pairs)
        found = fixed(_confirmed(pairs, sets, percent, k), "more-links")
        tests.append(found)
        if found.head(1):
            group = _groups(group, found)
        if last:
            break
        tried = tried.unionByName(pairs)

    named = rows.select(*carry, "n_shingles", "digest")
    keys = classes.select("digest", "n_shingles", "class")
    named = fixed(named.join(keys, ["digest", "n_shingles"], "left").select(*carry, "n_shingles", "class"), "classed")
    discard(rows, classes, lists, sets, links, prefixes, *tests)
    return named, group


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, k: int = K) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    A document's set holds its distinct runs of ``width`` words. Documents are linked when
    100 * common >= percent * all shingles of both; component_id is the smallest doc_id that links reach.
    Texts without words (null, empty, white space) are linked with nothing, each kept. Null ids come last: a
    component without any other id has a null component_id. Of rows that repeat the smallest id, one is kept.
    Other columns are not looked at. An empty table gives an empty result.
    """
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows, groups = similar_classes(named.withColumn("row", F.monotonically_increasing_id()), ["doc_id", "row"], width, percent, k)
    return _judged(rows, groups).select("doc_id", "n_shingles", "component_id", "kept")


def _judged(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Adds component_id and kept to rows (doc_id, row, n_shingles, class)."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    firsts = rows.where("class is not null").groupBy("class").agg(first.alias("first"))
    firsts = firsts.join(groups, "class", "left").withColumn("component", F.coalesce("group", "class"))
    least = firsts.groupBy("component").agg(F.min("first").alias("least"))
    least = broadcast_within(least, BROADCAST_KEYS)
    known = firsts.select("class", "component").join(least, "component").select(
        "class", F.col("least.doc_id").alias("least_id"), F.col("least.row").alias("least_row")
    )
    rows = rows.join(known, "class", "left")
    wordless = F.col("class").isNull()
    return rows.withColumn("component_id", F.when(wordless, F.col("doc_id")).otherwise(F.col("least_id"))).withColumn(
        "kept", wordless | (F.col("row") == F.col("least_row"))
    )


def without_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, k: int = K) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and any other columns) that are kept: one per group, unchanged."""
    whole = fixed(docs.select(F.struct("*").alias("record"), F.monotonically_increasing_id().alias("row")), "numbered")
    texts = whole.select(F.col("record.doc_id").cast("long").alias("doc_id"), "row", "record.text")
    rows, groups = similar_classes(texts, ["doc_id", "row"], width, percent, k)
    dropped = fixed(_judged(rows, groups).where(~F.col("kept")).select("row"), "dropped")
    return whole.join(broadcast_within(dropped, BROADCAST_KEYS), "row", "left_anti").select("record.*")
