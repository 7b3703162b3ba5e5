"""Exact de-duplication by an exchange of Golomb-coded fingerprints.

1. Every document gets a 64-bit fingerprint of its normalised text. Each part of the corpus sorts its distinct
   fingerprints, cuts them by owner (ranges of the fingerprint space) and sends each owner the differences
   in Golomb-Rice code: about as many bits as the spacing of the fingerprints needs, instead of 64.
2. Each owner merges what it gets and returns to each part a bitmap: which of its fingerprints are not
   unique in the corpus.
3. Only documents behind a set bit are suspects. Their texts alone are shuffled, and Spark groups them by
   all bytes, so that a collision of fingerprints cannot merge two texts.

A text that very many documents share is sent once per part and combined before the shuffle of texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import broadcast_within, fixed, text_or_empty

SPACE_RUN = r"[\x20\x09-\x0D]+"
PART_ROWS = 2_000_000  # rows of a part and fingerprints of an owner, about
LEAST_PARTS = 16
BROADCAST_FINGERPRINTS = 2_000_000  # 8 bytes each
_MESSAGE = "part long, owner long, n long, bits int, first long, code binary"
_REPLY = "part long, owner long, flags binary"


def normalised(text: str = "text") -> Column:
    return F.regexp_replace(text_or_empty(text), SPACE_RUN, " ")


def golomb_encode(values: np.ndarray) -> tuple[int, int, bytes]:
    """Rice parameter, first value and coded differences of ascending distinct uint64 values.

    Each difference d is floor(d / 2**bits) ones, a zero, and the low ``bits`` bits of d.
    """
    steps = np.diff(values)
    if len(steps) == 0:
        return 0, int(values[0]), b""
    mean = float(values[-1] - values[0]) / len(steps)
    bits = max(0, int(np.floor(np.log2(max(mean * 0.69, 1.0)))))
    ones = (steps >> np.uint64(bits)).astype(np.int64)
    ends = np.cumsum(ones + 1 + bits)
    starts = ends - (ones + 1 + bits)
    stream = np.zeros(int(ends[-1]), np.uint8)
    total = int(ones.sum())
    in_run = np.arange(total) - np.repeat(np.cumsum(ones) - ones, ones)
    stream[np.repeat(starts, ones) + in_run] = 1
    for bit in range(bits):
        stream[starts + ones + 1 + bit] = (steps >> np.uint64(bits - 1 - bit)).astype(np.uint8) & 1
    return bits, int(values[0]), np.packbits(stream).tobytes()


def golomb_decode(n: int, bits: int, first: int, code: bytes) -> np.ndarray:
    """The n values behind ``golomb_encode``."""
    if n <= 1:
        return np.full(n, first, np.uint64)
    stream = np.unpackbits(np.frombuffer(code, np.uint8))
    zeros = np.flatnonzero(stream == 0)
    # the zero that ends each run of ones: the next one at or after the end of the code before
    ends = np.empty(n - 1, np.int64)
    at = 0
    follow = np.searchsorted(zeros, zeros + 1 + bits) if len(zeros) else zeros  # index of the next run's zero
    for i in range(n - 1):
        ends[i] = zeros[at]
        at = follow[at]
    begins = np.r_[0, ends[:-1] + 1 + bits]
    steps = (ends - begins).astype(np.uint64) << np.uint64(bits)
    for bit in range(bits):
        steps |= stream[ends + 1 + bit].astype(np.uint64) << np.uint64(bits - 1 - bit)
    return np.uint64(first) + np.r_[np.uint64(0), np.cumsum(steps)]


def _owner_of(values: np.ndarray, owners: int) -> np.ndarray:
    return ((values >> np.uint64(32)) * np.uint64(owners)) >> np.uint64(32)


def _own_values(table: pa.Table) -> np.ndarray:
    return np.unique(table.column("fingerprint").to_numpy().view(np.uint64))


def _send(table: pa.Table, owners: int) -> pa.Table:
    """The messages of one part."""
    part = table.column("part")[0].as_py()
    values = _own_values(table)
    owner = _owner_of(values, owners)
    cuts = np.flatnonzero(np.diff(owner)) + 1
    rows = []
    for own in np.split(values, cuts):
        bits, first, code = golomb_encode(own)
        rows.append((part, int(_owner_of(own[:1], owners)[0]), len(own), bits, np.uint64(first).view(np.int64), code))
    columns = list(zip(*rows, strict=True))
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
    names = ["part", "owner", "n", "bits", "first", "code"]
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _reply(table: pa.Table) -> pa.Table:
    """The bitmaps one owner returns, in the order of each part's own fingerprints."""
    rows = table.to_pylist()
    lists = [
        golomb_decode(r["n"], r["bits"], int(np.int64(r["first"]).view(np.uint64)), r["code"]) for r in rows
    ]
    merged, parts = np.unique(np.concatenate(lists), return_counts=True)
    flags = [np.packbits(parts[np.searchsorted(merged, own)] > 1).tobytes() for own in lists]
    return pa.table(
        {
            "part": pa.array([r["part"] for r in rows], pa.int64()),
            "owner": pa.array([r["owner"] for r in rows], pa.int64()),
            "flags": pa.array(flags, pa.binary()),
        }
    )


def _receive(rows: pa.Table, replies: pa.Table, owners: int) -> pa.Table:
    """The fingerprints of one part that are not unique: by the bitmaps, or because the part repeats them."""
    if rows.num_rows == 0:
        return pa.table({"fingerprint": pa.array([], pa.int64())})
    values, counts = np.unique(rows.column("fingerprint").to_numpy().view(np.uint64), return_counts=True)
    owner = _owner_of(values, owners)
    flags = {r["owner"]: r["flags"] for r in replies.to_pylist()}
    suspect = counts > 1
    for number in np.unique(owner):
        mine = np.flatnonzero(owner == number)
        bits = np.unpackbits(np.frombuffer(flags[int(number)], np.uint8))[: len(mine)]
        suspect[mine] |= bits.astype(bool)
    return pa.table({"fingerprint": pa.array(values[suspect].view(np.int64))})


def shared_fingerprints(prints: DataFrame, parts: int) -> DataFrame:
    """Fingerprints that stand in more than one row of ``prints`` (part, fingerprint), by the exchange.

    ``part`` is below ``parts``; there are as many owners. A fingerprint may come out once per part.
    """
    sent = prints.groupBy("part").applyInArrow(lambda t: _send(t, parts), _MESSAGE)
    replies = sent.groupBy("owner").applyInArrow(_reply, _REPLY)
    both = prints.groupBy("part").cogroup(replies.groupBy("part"))
    return both.applyInArrow(lambda rows, back: _receive(rows, back, parts), "fingerprint long")


def drop_copies(docs: DataFrame, part_rows: int = PART_ROWS, broadcast_rows: int = BROADCAST_FINGERPRINTS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of white space becomes one blank; a null text is empty, and
    empty texts are copies of each other. Of equal texts the row with the smallest doc_id stays; a null id
    comes last (keep_id is null if a group has nothing else), and of repeated rows one stays. Other columns
    are not looked at. An empty table gives an empty result.
    """
    norm = normalised()
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), norm.alias("norm"))
    read = read.withColumn("fingerprint", F.xxhash64("norm"))
    slim = read.select("doc_id", "fingerprint", F.sha2("norm", 256).alias("text_sha256"), F.spark_partition_id().alias("at"))
    slim = fixed(slim.withColumn("row", F.monotonically_increasing_id()), "fingerprints")
    parts = max(LEAST_PARTS, slim.count() // part_rows + 1)
    prints = slim.select((F.col("at") % parts).cast("long").alias("part"), "fingerprint")
    suspects = fixed(shared_fingerprints(prints, parts).distinct(), "suspects")

    # the suspects' texts, grouped by all their bytes; the hint only saves a shuffle of the other texts
    near = broadcast_within(suspects, broadcast_rows)
    texts = read.join(near, "fingerprint", "left_semi").groupBy("norm")
    texts = texts.agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    texts = texts.select(F.sha2("norm", 256).alias("text_sha256"), "keep_id", "group_size")
    least = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    firsts = slim.join(near, "fingerprint", "left_semi").groupBy("text_sha256").agg(F.min(least).alias("first"))
    groups = texts.join(firsts.select("text_sha256", F.col("first.row").alias("keep_row")), "text_sha256")
    rows = slim.drop("fingerprint", "at").join(groups, "text_sha256", "left")
    alone = F.col("group_size").isNull()
    return rows.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row") == F.col("keep_row"))).alias("kept"),
        "text_sha256",
    )
