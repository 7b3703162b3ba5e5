"""Prefix trie of conversations, by ROLLUP over positional columns of turn ids.

1. A turn's id is the digest of its role and text, so texts are read once and never shuffled. One range-partitioned
   sort numbers all turns; a conversation that holds most rows is spread over many tasks.
2. Conversations are laid out in blocks of eight turn columns. A block is keyed by the trie node that the blocks
   before it end in: the exclusive-or of the hashes of (position, turn id) of all turns so far, 128 bits, summed up
   over blocks, then over runs of 512 blocks.
3. ROLLUP over the eight columns, within each key, makes one group per node of that depth; grouping_id tells the
   depth. Every node knows its members' count and its smallest member.
4. The smallest member of a node owns it. A conversation owns the nodes below the place where it leaves all smaller
   ones, so what is summed over a subtree (leaves, texts) becomes a sum over the conversations that run through its
   top: a second ROLLUP, and no walk over the depth of the trie.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.common import broadcast_within, fixed

BLOCK = 8  # turn columns of a block
RUN = 512  # blocks whose keys one task sums up
BROADCAST_CONVERSATIONS = 1_000_000
SHARED_GROUP, MOST_SHARED = 100, 6
PIECE_IDS = 4096  # conversation ids joined to one string at a time

_COLUMNS = [f"t{i}" for i in range(BLOCK)]
_KEY = ["depth", "hi", "lo"]


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, position (from 0 over all rows), tid, chars: the turns of all conversations, each one's in a row.

    A conversation's turns go by ``turn``, null first; equal ones by the digest of role and text.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("tid"), F.length(text).cast("long").alias("chars")
    )
    placed = turns.sort("conv_id", F.asc_nulls_first("turn"), "tid").withColumn("place", F.monotonically_increasing_id())
    placed = fixed(placed.select("conv_id", "place", "tid", "chars"), "turns")
    # the place holds the task's number and the row within it; one row per task tells where each begins
    task, row = F.shiftright("place", 33), F.col("place").bitwiseAND((1 << 33) - 1)
    begins, total = [], 0
    for number, n in sorted(map(tuple, placed.groupBy(task.alias("task")).count().collect())):
        begins.append((number, total))
        total += n
    begins = conversations.sparkSession.createDataFrame(begins, "task long, begin long")
    numbered = placed.withColumn("task", task).join(F.broadcast(begins), "task")
    return numbered.select("conv_id", (F.col("begin") + row).alias("position"), "tid", "chars")


def rebuilt_turns(ordered: DataFrame, group: int = SHARED_GROUP, most: int = MOST_SHARED) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations): conv_id, place from 1, tid, chars; and conv_id, length of every conversation.

    Conversation c takes the first h turns of conversation c - c % group (all if it has fewer, none if it is
    absent), then its own after its first h; h = crc32(decimal c) % most. The remainder has the sign of c.
    """
    c = F.col("conv_id")
    convs = ordered.groupBy(c).agg(F.min("position").alias("begin"), F.count(F.lit(1)).alias("n"))
    convs = convs.withColumns({"h": F.crc32(c.cast("string").cast("binary")) % most, "base": c - c % group})
    convs = fixed(convs, "conversations")
    bases = convs.select(c.alias("base"), F.col("n").alias("base_n"))
    taken = F.least("h", F.coalesce("base_n", F.lit(0).cast("long")))
    convs = convs.join(bases, "base", "left").withColumn("taken", taken)
    convs = fixed(convs.withColumn("length", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))), "rebuilt")

    known = broadcast_within(convs.select("conv_id", "begin", "h", "taken"), BROADCAST_CONVERSATIONS)
    turns = ordered.join(known, "conv_id").withColumn("place", F.col("position") - F.col("begin") + 1)
    own = turns.where(F.col("place") > F.col("h"))
    own = own.select("conv_id", (F.col("place") - F.col("h") + F.col("taken")).alias("place"), "tid", "chars")
    heads = turns.where((c % group == 0) & (F.col("place") < most)).select(c.alias("base"), "place", "tid", "chars")
    given = convs.select("conv_id", "base", "taken").join(heads, "base").where("place <= taken")
    return own.unionByName(given.select("conv_id", "place", "tid", "chars")), convs.select("conv_id", "length")


def _xor(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a.bitwiseXOR(b), columns)


def _hashes(place: Column, tid: Column) -> tuple[Column, Column]:
    return F.xxhash64(place, tid), F.xxhash64(tid, F.lit("low"), place)


def _paths(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """A row per conversation and block: its key (hi, lo), characters before it, t0 to t7, and the whole's length and total.

    A conversation without turns has one empty block.
    """
    block, slot = F.expr(f"(place - 1) div {BLOCK}"), (F.col("place") - 1) % BLOCK
    hi, lo = _hashes(F.col("place"), F.col("tid"))
    blocks = turns.groupBy("conv_id", block.alias("block")).agg(
        F.array_sort(F.collect_list(F.struct(slot.alias("slot"), "tid", "chars"))).alias("turns"),
        F.bit_xor(hi).alias("hi"),
        F.bit_xor(lo).alias("lo"),
        F.sum("chars").alias("chars"),
    )
    blocks = fixed(blocks.withColumn("run", F.expr(f"block div {RUN}")), "blocks")
    sums = [F.bit_xor("hi").alias("run_hi"), F.bit_xor("lo").alias("run_lo"), F.sum("chars").alias("run_chars")]
    runs = blocks.groupBy("conv_id", "run").agg(*sums, F.sum(F.size("turns")).alias("run_turns"))
    zero = F.lit(0).cast("long")

    def so_far(agg, name: str, window) -> Column:
        return F.coalesce(agg(name).over(window.rowsBetween(Window.unboundedPreceding, -1)), zero)

    whole = Window.partitionBy("conv_id")
    runs = runs.select(
        "conv_id",
        "run",
        *[so_far(agg, f"run_{c}", whole.orderBy("run")).alias(f"past_{c}") for agg, c in ((F.bit_xor, "hi"), (F.bit_xor, "lo"), (F.sum, "chars"))],
        F.sum("run_chars").over(whole).alias("total"),
        F.sum("run_turns").over(whole).alias("length"),
    )
    within = Window.partitionBy("conv_id", "run").orderBy("block")
    located = blocks.join(runs, ["conv_id", "run"]).select(
        "conv_id",
        "block",
        F.col("past_hi").bitwiseXOR(so_far(F.bit_xor, "hi", within)).alias("hi"),
        F.col("past_lo").bitwiseXOR(so_far(F.bit_xor, "lo", within)).alias("lo"),
        (F.col("past_chars") + so_far(F.sum, "chars", within)).alias("before"),
        "length",
        "total",
        *[_turn(F.get("turns", F.lit(i))).alias(t) for i, t in enumerate(_COLUMNS)],
    )
    none = {n: zero.alias(n) for n in ("block", "hi", "lo", "before", "length", "total")}
    absent = [F.lit(None).cast(located.schema[t].dataType).alias(t) for t in _COLUMNS]
    empty = convs.where("length = 0").select("conv_id", *none.values(), *absent)
    return fixed(located.unionByName(empty), "paths")


def _turn(entry: Column) -> Column:
    return F.when(entry.isNotNull(), F.struct(entry["tid"].alias("tid"), entry["chars"].alias("chars")))


def _node_key(hi: str, lo: str) -> list[Column]:
    """Key of the node that a row's block key and turn columns lead to."""
    each = [(F.col(t).isNotNull(), _hashes(F.col("block") * BLOCK + i + 1, F.col(t)["tid"])) for i, t in enumerate(_COLUMNS)]
    zero = F.lit(0).cast("long")
    return [_xor([F.col(base), *[F.when(there, both[side]).otherwise(zero) for there, both in each]]) for side, base in enumerate((hi, lo))]


def _rolled_up(spark: SparkSession, paths: DataFrame, *aggregates: str) -> DataFrame:
    """One row per node: depth, its key, its parent's key, characters before its last turn, and the aggregates."""
    columns = ", ".join(_COLUMNS)
    grouped = spark.sql(
        f"select block, hi as key_hi, lo as key_lo, before, {columns}, "
        f"{BLOCK} - bit_count(grouping_id()) as level, {', '.join(aggregates)} "
        f"from {{paths}} group by block, hi, lo, before, rollup({columns})",
        paths=paths,
    )
    turns = F.array(*_COLUMNS)
    last = F.get(turns, F.col("level") - 1)
    depth = F.col("block") * BLOCK + F.col("level")
    # columns of deeper levels and of ended conversations are null; the latter make no node
    grouped = grouped.where(((F.col("level") == 0) & (F.col("block") == 0)) | last.isNotNull())
    zero = F.lit(0).cast("long")
    hi, lo = _node_key("key_hi", "key_lo")
    last_hash = _hashes(depth, last["tid"])
    held = reduce(lambda a, b: a + b, [F.coalesce(F.col(t)["chars"], zero) for t in _COLUMNS])
    names = [a.rsplit(" as ", 1)[1] for a in aggregates]
    return grouped.select(
        depth.alias("depth"),
        "level",
        hi.alias("hi"),
        lo.alias("lo"),
        F.when(last.isNotNull(), last_hash[0]).otherwise(zero).alias("last_hi"),
        F.when(last.isNotNull(), last_hash[1]).otherwise(zero).alias("last_lo"),
        (F.col("before") + held - F.coalesce(last["chars"], zero)).alias("before"),
        *names,
    )


def _owners(nodes: DataFrame) -> DataFrame:
    """Per conversation that owns nodes: leaves (depth where it leaves all smaller ones, -1 for the smallest), at
    (owner of the node there), length, before (characters up to there), leaf (1 if it ends in a childless node)."""
    top = F.min_by(F.struct(F.col("hi").bitwiseXOR(F.col("last_hi")).alias("hi"), F.col("lo").bitwiseXOR(F.col("last_lo")).alias("lo"), "before"), "depth")
    owners = nodes.groupBy("conv_id").agg(
        (F.min("depth") - 1).alias("leaves"),
        F.max("depth").alias("length"),
        F.max((F.col("longest") == F.col("depth")).cast("int")).cast("long").alias("leaf"),
        top.alias("top"),
    )
    owners = fixed(owners.select("conv_id", "leaves", "length", "leaf", "top.hi", "top.lo", "top.before"), "owners")
    # most conversations leave at the root, whose owner is the smallest of all
    root = nodes.where("depth = 0").first()
    others = owners.where("leaves > 0").withColumnRenamed("leaves", "depth")
    found = others.join(nodes.select(*_KEY, F.col("conv_id").alias("at")), _KEY).withColumnRenamed("depth", "leaves")
    columns = ["conv_id", "leaves", "length", "leaf", "before", "at"]
    at_root = owners.where("leaves <= 0").withColumn("at", F.lit(root and root["conv_id"]).cast("long"))
    return fixed(found.select(columns).unionByName(at_root.select(columns)), "attached")


def _ids_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of rows with one key as one row: the key, the first id, and the ids joined by commas."""
    key, first, ids = None, None, []
    out: list[tuple] = []

    def close() -> None:
        if ids:
            out.append((*key, first, ",".join(map(str, ids))))
            ids.clear()

    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=[*_KEY, "first", "ids"])

    for batch in batches:
        for *here, conv in zip(*(c.to_pylist() for c in batch.columns)):
            if here != key or len(ids) >= PIECE_IDS:
                close()
                key, first = here, conv
            ids.append(conv)
        if len(out) >= PIECE_IDS:
            yield rows()
            out.clear()
    close()
    if out:
        yield rows()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each key's pieces joined by commas; the rows come sorted by key and first id."""
    key, digest = None, None
    for batch in batches:
        done: list[tuple] = []
        for *here, _, ids in zip(*(c.to_pylist() for c in batch.columns)):
            if here != key:
                if key:
                    done.append((*key, digest.hexdigest()))
                key, digest = here, hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names=[*_KEY, "ends_sha256"])
    if key:
        yield pa.RecordBatch.from_arrays([pa.array([c]) for c in (*key, digest.hexdigest())], names=[*_KEY, "ends_sha256"])


def _ends(paths: DataFrame) -> DataFrame:
    """depth, hi, lo, ends_sha256 of the nodes in which conversations end."""
    hi, lo = _node_key("hi", "lo")
    last = paths.where(F.col("length") <= (F.col("block") + 1) * BLOCK)
    ends = last.select(F.col("length").alias("depth"), hi.alias("hi"), lo.alias("lo"), "conv_id")
    pieces = ends.sort(*_KEY, "conv_id").mapInArrow(_ids_joined, "depth long, hi long, lo long, first long, ids string")
    pieces = pieces.repartition(*_KEY).sortWithinPartitions(*_KEY, "first")
    return pieces.mapInArrow(_digests, "depth long, hi long, lo long, ends_sha256 string")


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """The trie of ``turns`` (conv_id, place from 1, tid, chars) of ``convs`` (conv_id, length): a row per node.

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    A node is a distinct sequence of first turns; its members are the conversations that start with it. Without
    conversations there is no node, not even the root.
    """
    spark = turns.sparkSession
    paths = _paths(turns, convs)
    nodes = fixed(_rolled_up(spark, paths, "min(conv_id) as conv_id", "max(length) as longest"), "nodes")
    owners = _owners(nodes)

    # what a conversation adds below the place where it leaves; conversations that own no node add nothing
    added = owners.select("conv_id", "leaf", F.col("before").alias("shared"), "leaves")
    level = F.when(F.col("leaves").isNotNull(), F.col("leaves") - F.col("block") * BLOCK)
    through = paths.join(broadcast_within(added, BROADCAST_CONVERSATIONS), "conv_id", "left").withColumns(
        {
            "leaf": F.coalesce("leaf", F.lit(0).cast("long")),
            "new_chars": F.coalesce(F.col("total") - F.col("shared"), F.lit(0).cast("long")),
            "leaves_level": level,
        }
    )
    branches = [f"count_if(leaves_level = {i}) as b{i}" for i in range(BLOCK + 1)]
    sums = ["sum(total) as total", "sum(new_chars) as new_chars", "sum(leaf) as n_leaves", "count(1) as n_convs", "min(conv_id) as conv_id"]
    rolled = fixed(_rolled_up(spark, through, *sums, *branches), "rolled-up")

    owner = owners.select("conv_id", "leaves", "length", "at", F.col("before").alias("shared"))
    full = rolled.join(owner, "conv_id").join(_ends(paths), _KEY, "left")
    goes_on = (F.col("length") > F.col("depth")).cast("long")
    branched = F.get(F.array(*[f"b{i}" for i in range(BLOCK + 1)]), F.col("level"))
    # all texts of the members from here on, less each distinct node's text once
    saved = F.col("total") - F.col("new_chars") - (F.col("n_convs") - 1) * F.col("before") - F.col("shared")
    parent = F.when(F.col("leaves") < F.col("depth") - 1, F.col("conv_id")).otherwise(F.col("at"))
    nothing = hashlib.sha256(b"").hexdigest()
    return full.select(
        "conv_id",
        "depth",
        F.when(F.col("depth") > 0, parent).alias("parent_conv_id"),
        "n_convs",
        (goes_on + branched).alias("n_children"),
        "n_leaves",
        saved.alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"),
    )


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The prefix trie of the rebuilt conversations (conv_id, turn, role, text; other columns are not looked at).

    See ``rebuilt_turns`` for how each is rebuilt, ``prefix_trie`` for the result. Turns go by ``turn``, null first,
    equal ones by the MD5 of "<length of role>:<role><text>"; repeated rows are turns like any other. Null role and
    text count as empty, texts have any length; rows without conv_id belong to no conversation. An empty table
    gives an empty result.
    """
    return prefix_trie(*rebuilt_turns(ordered_turns(conversations)))
