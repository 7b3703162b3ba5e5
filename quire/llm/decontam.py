"""Benchmark decontamination by spaced seeds, with DataFrame functions only.

A seed is a window of tokens of which a fixed mask ignores some, so that a replaced word need not hide a
passage. The seeds of the benchmark are joined with those of the documents; around every hit, the benchmark's
tokens are laid over the document's, and the best run of them that holds the seed decides. Documents never meet each
other; a benchmark passage that many items share is one seed, and its items are joined to what was found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import broadcast_within, fixed, text_or_empty

SPAN = 11
# positions compared by each mask; the others may differ
MASKS = ((0, 1, 2, 4, 5, 8, 9, 10), (0, 1, 3, 4, 6, 7, 9, 10), (0, 2, 3, 5, 6, 7, 8, 10), (0, 1, 2, 3, 7, 8, 9, 10))
REACH = 5  # tokens looked at on either side of a hit
SHARE = 80  # per cent of the tokens of a run that must be equal
LEAST = 13  # tokens of a run, at least; a shorter item must be there whole
PIECE = 256  # windows a row carries
BLOCK_SEEDS = 200_000  # seeds sent to every executor at a time
BROADCAST_TEXTS = 1_000_000  # 16-byte digests


def tokens(text: Column) -> Column:
    """Words in lower case: runs of letters, marks and digits."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}\p{N}]+")
    return F.array_remove(words, "")


def _hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _masked(words: Column, at: Column, mask: tuple[int, ...], number: int) -> Column:
    """Hash of the tokens under a mask laid at ``at`` (from 0)."""
    return F.xxhash64(F.lit(number), *[F.get(words, at + F.lit(i)) for i in mask])


def benchmark_seeds(benchmark: DataFrame, text: str = "text", id_col: str = "item_id") -> tuple[DataFrame, DataFrame]:
    """(seeds, members): seed, context, at, passage; and passage, item_id for every item that holds it.

    Each distinct seed with the tokens around it is one row and has a ``passage`` number; ``at``: place of the seed in its
    context. An item shorter than the span has one seed, of all its tokens (``at`` 0).
    """
    items = benchmark.select(F.col(id_col).alias("item_id"), _hashes(tokens(F.col(text))).alias("words"))
    items = items.withColumn("n", F.size("words")).where("n > 0")
    long = items.where(F.col("n") >= SPAN).select("*", F.explode(F.sequence(F.lit(0), F.col("n") - SPAN)).alias("place"))
    seeds = F.array(*[_masked(F.col("words"), F.col("place"), mask, i) for i, mask in enumerate(MASKS)])
    first = F.greatest(F.col("place") - REACH, F.lit(0))
    last = F.least(F.col("place") + SPAN + REACH, F.col("n"))
    long = long.select(
        F.explode(seeds).alias("seed"), F.slice("words", first + 1, last - first).alias("context"), (F.col("place") - first).alias("at"), "item_id"
    )
    short = items.where(F.col("n") < SPAN).select(
        _short_seed(F.col("words")).alias("seed"), F.col("words").alias("context"), F.lit(0).alias("at"), "item_id"
    )
    # the digest of 128 bits tells passages apart
    words = F.array_join(F.transform("context", lambda w: w.cast("string")), ",")
    both = long.unionByName(short).withColumn("passage", F.md5(F.concat_ws(";", F.col("seed").cast("string"), F.col("at").cast("string"), words)))
    both = fixed(both, "benchmark-seeds")
    return both.dropDuplicates(["passage"]).drop("item_id"), both.select("passage", "item_id").distinct()


def _short_seed(words: Column) -> Column:
    return F.xxhash64(F.lit(-1), F.size(words), words)


def _document_seeds(docs: DataFrame, short_lengths: list[int]) -> DataFrame:
    """place and seed for every window of ``words``, with the tokens near it in ``words`` (from ``lead``).

    Documents are first cut into pieces that overlap as far as a hit is looked at, so that a row never carries
    a whole long document.
    """
    n, start = F.size("words"), F.col("start")
    first = F.greatest(start - REACH, F.lit(0))
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(PIECE)))
    pieces = docs.select("*", n.alias("n"), F.explode(starts).alias("start"))
    near = F.slice("words", first + 1, F.lit(PIECE + SPAN + 2 * REACH))
    pieces = pieces.withColumn("words", near).withColumn("lead", start - first)
    steps = F.sequence(F.lit(0), F.least(F.lit(PIECE), F.col("n") - start) - 1)
    places = pieces.select("*", F.explode(steps).alias("step")).withColumn("place", start + F.col("step"))
    at, n = F.col("lead") + F.col("step"), F.col("n")
    long = [F.when(F.col("place") + SPAN <= n, _masked(F.col("words"), at, m, i)) for i, m in enumerate(MASKS)]
    short = [F.when(F.col("place") + k <= n, _short_seed(F.slice("words", at + 1, F.lit(k)))) for k in short_lengths]
    return places.withColumn("seed", F.explode(F.array(*long, *short))).where("seed is not null")


def _best_run(equal: Column, at: Column) -> Column:
    """struct(share, n_context, n_equal) of the best run of tokens that holds the seed at ``at``.

    ``equal``: 1 or 0 for each token of the context. Runs have LEAST tokens or more and equal ones at both ends, or are
    all of a shorter context. Null without such a run.
    """
    size = F.size(equal)
    least = F.least(F.lit(LEAST), size)
    span = F.least(F.lit(SPAN), size)

    def run(left: Column, right: Column) -> Column:
        n = span + left + right
        held = F.aggregate(F.slice(equal, at - left + 1, n), F.lit(0), lambda a, x: a + x)
        ends = (size < LEAST) | ((F.get(equal, at - left) == 1) & (F.get(equal, at - left + n - 1) == 1))
        return F.when((n >= least) & ends, F.struct((held / n).alias("share"), n.alias("n_context"), held.alias("n_equal")))

    lefts, rights = F.sequence(F.lit(0), at), F.sequence(F.lit(0), size - span - at)
    return F.array_max(F.flatten(F.transform(lefts, lambda left: F.transform(rights, lambda right: run(left, right)))))


def leaked_passages(seeds: DataFrame, docs: DataFrame, keep: list[str], block_seeds: int = BLOCK_SEEDS) -> DataFrame:
    """Verified overlaps: ``keep`` (columns of ``docs``), passage, place, n_equal, n_context.

    One row per hit; ``place`` is the token of the document where the seed lies. Around it the benchmark's tokens, up to
    REACH on either side, are laid over the document's. A hit counts when some run of them that holds the seed, with equal
    tokens at its ends, has LEAST tokens or more (or is the whole item) and SHARE per cent of it are equal; n_equal and n_context are those of the run
    with the greatest share, the longest of these. Items of fewer tokens than SPAN must stand in the document word for
    word. Null and empty texts have no tokens and match nothing. Texts of any length are cut into pieces that overlap.
    Seeds go to the executors in blocks of bounded size, each block in one pass.
    """
    # lengths below SPAN only, so at most SPAN - 1 rows
    short_rows = seeds.where(F.size("context") < SPAN).select(F.size("context").alias("n")).distinct().collect()
    short = sorted(r["n"] for r in short_rows)
    blocks = -(-max(seeds.count(), 1) // block_seeds)
    words = docs.select(*keep, _hashes(tokens(F.col("text"))).alias("words"))
    found = None
    for block in range(blocks):
        some = seeds if blocks == 1 else seeds.where(F.pmod(F.col("seed"), F.lit(blocks)) == block)
        hits = _document_seeds(words, short).join(F.broadcast(some), "seed")  # at most about block_seeds rows
        begin = F.col("lead") + F.col("step") - F.col("at")
        same = lambda w, i: F.coalesce(F.get(F.col("words"), begin + i) == w, F.lit(False)).cast("int")
        # exploded, so that the tests stay behind the join: the join itself then runs as generated code
        hits = hits.select(*keep, "passage", "place", "at", F.explode(F.array(F.transform("context", same))).alias("equal"))
        hits = hits.select(*keep, "passage", "place", F.explode(F.array(_best_run(F.col("equal"), F.col("at")))).alias("run"))
        hits = hits.select(*keep, "passage", "place", "run.n_equal", "run.n_context")
        hits = hits.where(F.col("n_equal") * 100 >= F.col("n_context") * SHARE)
        found = hits if found is None else found.unionByName(hits)
    return found


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, n_hits, n_equal, n_context, first_place: documents that hold benchmark text.

    One row per document and item, for every item that holds the passage found; a document without a row is clean.
    Rows with the same doc_id count together, so do items with the same item_id (repeated rows are one). Null and empty
    texts match nothing; other columns are not looked at. Empty tables give an empty result.
    """
    seeds, members = benchmark_seeds(benchmark)
    seeds = fixed(seeds, "seeds")
    hits = leaked_passages(seeds, docs, ["doc_id"])
    best = F.max(F.struct((F.col("n_equal") / F.col("n_context")).alias("share"), "n_context", "n_equal"))
    found = hits.groupBy("doc_id", "passage").agg(F.count(F.lit(1)).alias("n_hits"), best.alias("best"), F.min("place").alias("first_place"))
    pairs = found.join(members, "passage").groupBy("doc_id", "item_id").agg(
        F.sum("n_hits").alias("n_hits"), F.max("best").alias("best"), F.min("first_place").alias("first_place")
    )
    return pairs.select("doc_id", "item_id", "n_hits", "best.n_equal", "best.n_context", "first_place")


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` (text and any other columns) that hold no benchmark text, unchanged.

    Decided by the text, so rows with null or repeated ids are judged each for itself.
    """
    digest = F.sha2(text_or_empty(), 256)
    packed = docs.select(F.struct("*").alias("row"), "text", digest.alias("digest"))
    seeds = fixed(benchmark_seeds(benchmark)[0], "seeds")
    leaked = fixed(leaked_passages(seeds, packed, ["digest"]).select("digest").distinct(), "leaked")
    clean = packed.join(broadcast_within(leaked, BROADCAST_TEXTS), "digest", "left_anti")
    return clean.select("row.*")
