"""Mixing sources to target weights, with DataFrame functions only.

Each source is cut into blocks of equal numbers of words, in a seeded order of documents; sources with a small
target have smaller blocks.
Sainte-Laguë apportionment deals a fixed number of blocks out to the sources by highest quotients, which
gives whole quotas for every source and shard; blocks are then picked by a seeded order, again and again
where a quota is larger than its source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import WORD, fixed, free_name, text_or_empty

MAX_TIMES = 3
BLOCKS = 10_000  # dealt out over the whole corpus, more when there are many sources
BLOCKS_PER_SOURCE = 64
BLOCKS_PER_TARGET = 128  # blocks in the target of any source, at least (or one word each)
SHARDS = 40
PARTS = 1024  # parts of a source whose words are summed by separate tasks
SEED = 11
SIZE_BANDS = 4  # bands of document sizes for each doubling
ONE = 1 << 24  # a whole document, in sums of fractions


def word_count(text: str = "text") -> Column:
    return F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long")


def _of_source(left: DataFrame, right: DataFrame, *more: str, how: str = "inner") -> DataFrame:
    """Join on the source, where null is a source like any other, and on ``more``."""
    keys = ["source", *more]
    right = right.withColumnsRenamed({c: f"right_{c}" for c in keys})
    on = F.col("source").eqNullSafe(F.col("right_source"))
    for c in more:
        on = on & (F.col(c) == F.col(f"right_{c}"))
    return left.join(right, on, how).drop(*[f"right_{c}" for c in keys])


def source_targets(sources: DataFrame, max_times: int = MAX_TIMES) -> DataFrame:
    """Add ``weight`` and ``target`` to one row per source (source, source_size).

    Weights are 1, 2, 3, repeating, in code-point order with null last. Targets share all words by weight;
    a source with more than ``max_times`` its size stops there and the excess is shared again. The sources
    that stop are those with the least ``size / weight``, so one running sum finds the level. Windows here
    see one row per source.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    ranked = sources.withColumn("weight", ((place - 1) % 3 + 1).cast("long"))
    full = F.col("source_size") * max_times
    by_ratio = Window.orderBy((F.col("source_size") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    ranked = ranked.withColumn("_full", F.coalesce(F.sum(full).over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = ranked.withColumn("_weights", F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
    ranked = ranked.withColumn("_words", F.sum("source_size").over(everything))
    # words per weight if all sources before this one are at their bound; the first level that fits holds
    level = (F.col("_words") - F.col("_full")) / F.col("_weights")
    ranked = ranked.withColumn("_level", F.max(F.when(level * F.col("weight") <= full, level)).over(everything))
    target = F.least(full.cast("double"), F.col("_level") * F.col("weight"))
    return ranked.withColumn("target", target).drop("_full", "_weights", "_words", "_level")


def own_blocks(targets: DataFrame, block_words: int) -> DataFrame:
    """Add ``block``, the words in a block of each source: ``block_words``, or less where its target is small.

    The blocks of a source are as even as whole words allow.
    """
    fine = F.greatest(F.floor(F.col("target") / BLOCKS_PER_TARGET), F.lit(1))
    has = F.greatest(F.ceil(F.col("source_size") / F.least(fine, F.lit(block_words))), F.lit(1))
    return targets.withColumn("block", F.greatest(F.ceil(F.col("source_size") / has), F.lit(1)).cast("long"))


def apportion(targets: DataFrame, block_words: int, blocks: int, max_times: int = MAX_TIMES, shards: int = SHARDS) -> DataFrame:
    """Quota of each source and shard: source, shard, quota, as many as ``blocks`` hold where sources allow.

    A block has ``block_words``, or what a column ``block`` of ``targets`` says for its source. Highest
    quotients target / block / (2s - 1), s = 1, 2, ..., until ``blocks`` times ``block_words`` are dealt; equal
    quotients go to the first source by code point. A source is not dealt more than ``max_times`` the blocks it
    has. The award of rank r goes to shard (r - 1) mod ``shards``, so every shard gets its share of every
    source. Rows: about one per block.
    """
    if "block" not in targets.columns:
        targets = targets.withColumn("block", F.lit(block_words))
    has = F.ceil(F.col("source_size") / F.col("block"))
    # no more quotients than could win, with room for what capped sources leave
    most = F.least(has * max_times, F.ceil(F.col("target") / F.col("block")) * 2 + 2).cast("int")
    seats = targets.where(F.col("target") > 0).select("source", "target", "block", F.explode(F.sequence(F.lit(1), most)).alias("s"))
    quotient = F.col("target") / F.col("block") / (2 * F.col("s") - 1)
    order = Window.orderBy(quotient.desc(), F.col("source").asc_nulls_last(), F.col("s").asc())
    dealt = F.sum("block").over(order.rowsBetween(Window.unboundedPreceding, 0))
    won = seats.withColumns({"rank": F.row_number().over(order), "dealt": dealt}).where(F.col("dealt") <= blocks * block_words)
    return won.groupBy("source", ((F.col("rank") - 1) % shards).cast("int").alias("shard")).agg(
        F.count(F.lit(1)).alias("quota")
    )


def mix_sources(
    docs: DataFrame,
    carry: list[str] | None = None,
    blocks: int = BLOCKS,
    max_times: int = MAX_TIMES,
    seed: int = SEED,
    shards: int = SHARDS,
    parts: int = PARTS,
) -> DataFrame:
    """The columns ``carry`` (all by default) with ``size``, ``source_size``, ``target`` and ``taken``.

    ``docs``: doc_id, source, text and any other columns; ``taken``: words the mix takes, repeats counted.
    Null texts have no words and nothing is taken from them; a null source is a source. Rows equal in id,
    source and text are interchangeable. A carried column that bears one of the new names is kept; the new
    one gets an underscore. An empty table gives an empty result. The order of documents depends on ids and
    texts alone, so reruns agree.
    """
    carry = docs.columns if carry is None else carry
    text_mark = F.md5(text_or_empty())
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("doc_id").cast("string"), text_mark))
    sized = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in carry]).alias("doc"),
        "source",
        word_count().alias("size"),
        text_mark.alias("mark"),
        key.alias("key"),
        (F.conv(F.substring(key, 1, 6), 16, 10).cast("int") % parts).alias("part"),
    )
    sized = fixed(sized, "mix")

    # first words of each part of a source: sums of sums, one row per source and part
    by_part = sized.groupBy("source", "part").agg(F.sum("size").alias("n"))
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_part.select("source", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    sources = by_part.groupBy("source").agg(F.sum("n").alias("source_size"))
    sources = fixed(source_targets(sources, max_times), "mix-sources")
    totals = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("words"), F.count(F.lit(1)).alias("n")).first()
    block_words = max(1, -(-totals["words"] // max(blocks, BLOCKS_PER_SOURCE * totals["n"])))
    sources = own_blocks(sources, block_words)
    quotas = apportion(sources, block_words, max(1, totals["words"] // block_words), max_times, shards)
    quotas = fixed(quotas, "mix-quotas")

    # which blocks are taken once more than the rest: the first in a seeded order
    dealt = _of_source(sources.where("source_size > 0"), quotas.groupBy("source").agg(F.sum("quota").alias("quota")))
    has = F.ceil(F.col("source_size") / F.col("block")).cast("long")
    dealt = dealt.withColumn("has", has).withColumnRenamed("block", "block_words").withColumn("rounds", F.expr("quota div has"))
    each = dealt.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("has") - 1)).alias("block"))
    draw = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("source"), F.col("block").cast("string")))
    in_source = Window.partitionBy("source")
    drawn = F.row_number().over(in_source.orderBy(draw, "block")) <= F.expr("quota % has")
    each = each.withColumn("once", drawn.cast("long"))
    words = F.least(F.col("block_words"), F.col("source_size") - F.col("block") * F.col("block_words"))
    up_to = in_source.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.col("once") * words).over(up_to), F.lit(0))
    picked = fixed(each.select("source", "block", "rounds", F.struct(before.alias("before"), "once", "block").alias("at")), "mix-blocks")

    # a document covers the words from, from + 1, ... below to of its source
    in_part = Window.partitionBy("source", "part").orderBy("key", "mark", "size")
    ends = F.sum("size").over(in_part.rowsBetween(Window.unboundedPreceding, 0))
    laid = _of_source(sized.withColumn("end", ends), starts, "part")
    laid = laid.select("doc", "source", "size", (F.col("start") + F.col("end")).alias("to"))
    laid = laid.withColumn("from", F.col("to") - F.col("size"))
    laid = _of_source(laid, sources.select("source", "source_size", "target", F.col("block").alias("block_words")))
    nothing = laid.where("size = 0").withColumn("taken", F.lit(0).cast("long"))
    some = laid.where("size > 0")
    for edge, last in (("from", "`from`"), ("to", "`to` - 1")):
        at = picked.withColumnRenamed("at", f"{edge}_at")
        at = at if edge == "from" else at.drop("rounds")
        some = _of_source(some.withColumn("block", F.expr(f"({last}) div block_words")), at, "block", how="left").drop("block")
    reach = {
        edge: F.col(f"{edge}_at.before") + F.col(f"{edge}_at.once") * (F.col(edge) - F.col(f"{edge}_at.block") * F.col("block_words"))
        for edge in ("from", "to")
    }
    taken = F.col("rounds") * F.col("size") + reach["to"] - reach["from"]
    some = some.withColumn("taken", F.coalesce(taken, F.lit(0)))  # no block dealt: nothing
    result = some.unionByName(nothing, allowMissingColumns=True)
    carried = docs.select(*[F.col(f"`{c}`") for c in carry])
    new = [F.col(c).alias(free_name(carried, c)) for c in ("size", "source_size", "target", "taken")]
    return result.select("doc.*", *new)


def _sampled_times(mixed: DataFrame, seed: int, parts: int) -> DataFrame:
    """row, times: words taken as whole documents (columns row, draw, source, size, taken).

    What is left after whole rounds is a fraction of a document. The fractions are added up source by source,
    from short documents to long ones, and a document comes once more where the sum, from a seeded start,
    passes a whole number: each comes with the chance of its fraction, whatever its length, and because like
    sizes follow each other the words of a source stay within about one document of what is taken.
    """
    some = mixed.where("size > 0").withColumn("rounds", F.expr("taken div size"))
    left = F.expr(f"((taken % size) * {ONE}) div size")
    band = F.floor(F.log2("size") * SIZE_BANDS).cast("int")
    some = fixed(some.select("row", "draw", "source", "size", "rounds", left.alias("left"), band.alias("band")), "mix-taken")
    whole = some.where("left = 0").select("row", F.col("rounds").alias("times"))
    partly = some.where("left > 0").withColumn("part", F.pmod("draw", F.lit(parts)).cast("int"))

    # sums before each band of sizes and before each part of a band: sums of sums
    by_part = partly.groupBy("source", "band", "part").agg(F.sum("left").alias("n"))
    by_band = by_part.groupBy("source", "band").agg(F.sum("n").alias("n"))
    before = Window.unboundedPreceding, -1
    earlier = Window.partitionBy("source").orderBy("band").rowsBetween(*before)
    first = F.pmod(F.xxhash64(F.lit(seed), "source"), F.lit(ONE))
    bands = by_band.select("source", "band", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) + first).alias("band_start"))
    earlier = Window.partitionBy("source", "band").orderBy("part").rowsBetween(*before)
    starts = by_part.select("source", "band", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("part_start"))
    starts = _of_source(starts, bands, "band")
    in_part = Window.partitionBy("source", "band", "part").orderBy("size", "draw").rowsBetween(Window.unboundedPreceding, 0)
    partly = _of_source(partly.withColumn("to", F.sum("left").over(in_part)), starts, "band", "part")
    partly = partly.withColumn("to", F.col("to") + F.col("part_start") + F.col("band_start"))
    again = F.expr(f"`to` div {ONE} - (`to` - `left`) div {ONE}")
    return whole.unionByName(partly.select("row", (F.col("rounds") + again).alias("times")))


def mixed_documents(docs: DataFrame, **parameters) -> DataFrame:
    """Documents as the mix takes them, with the columns of ``docs``: as often as their words, in whole documents.

    A document taken in part comes with the chance of that part, drawn so that the words of each source stay
    near its target. Each document comes at most ``max_times``; documents without words do not come.
    """
    seed, parts = parameters.get("seed", SEED), parameters.get("parts", PARTS)
    draw = F.xxhash64(F.lit(seed), "doc_id", text_or_empty())
    whole = docs.select(F.struct("*").alias("record"), draw.alias("draw"), F.monotonically_increasing_id().alias("row"))
    whole = fixed(whole, "mix-documents")
    texts = whole.select("row", "draw", "record.doc_id", "record.source", "record.text")
    mixed = mix_sources(texts, carry=["row", "draw", "source"], **parameters)
    taken = _sampled_times(mixed, seed, parts).where("times > 0").withColumn("times", F.col("times").cast("int"))
    # texts move once, to meet the number of times they are taken
    both = whole.select("row", "record").join(taken, "row")
    return both.select("record", F.explode(F.array_repeat(F.lit(0), F.col("times"))).alias("time")).select("record.*")
