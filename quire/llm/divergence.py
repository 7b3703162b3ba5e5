"""How far the sources of each language differ in their words, audited with count-level bitmaps.

1. One pass counts every term per (lang, source); a term belongs to its language's list when enough of the
   language's documents hold it. Listed terms get ids in falling order of their counts, so that 64 neighbouring
   ids (a word) occur about equally often and have few count levels.
2. A term's smoothed share depends on its group and its count alone. Per group and count the term ids are stored
   as a bitset, one 64-bit word at a time.
3. For two groups, AND and popcount of their words give the joint cells: how many terms have count a here and
   count b there. Each cell is multiplied by the difference of the two shares. Cells with a zero on either side
   follow by complement from the sizes of the sets.
4. Tasks compare a chunk of 64 words for one pair of tiles (some 16 sources each), whatever the number of
   sources or terms; the parts are added up afterwards.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.ranking import first_per_group
from quire.llm.common import bounded_batches, fixed

MIN_DOCS = 30
TOP_TERMS = 50
SMOOTHING = 5
SCALE = 1_000_000_000
TILE = 16  # sources per tile, about
WORD_BITS, CHUNK_BITS = 6, 12  # terms of a word and of a chunk, as powers of two
HELD_TERMS = 200_000  # counters a task holds before it hands them on
PIECE = 4 << 20  # bytes of a text split at a time

# letters A-Z as a-z, other ASCII bytes as blanks, all else as it is
_FOLD = bytes(i + 32 if 65 <= i <= 90 else i if 97 <= i <= 122 or i >= 128 else 32 for i in range(256))

_COUNTS = "lang string, source string, term string, n long, docs long"
_PAIRS = "lang string, a string, b string, value long"


def _pieces(text: bytes) -> Iterator[bytes]:
    """The folded text in pieces that end between terms."""
    start = 0
    while len(text) - start > PIECE:
        end = text.find(b" ", start + PIECE)
        if end < 0:
            break
        yield text[start:end]
        start = end
    yield text[start:] if start else text


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term per group; a row without term names each group that occurs."""
    held: dict[tuple, tuple[Counter, Counter]] = {}
    size = 0

    def rows() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            terms = [None, *n]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * len(terms), pa.string()),
                    pa.array([source] * len(terms), pa.string()),
                    pa.array(terms, pa.binary()).cast(pa.string()),
                    pa.array([0, *n.values()], pa.int64()),
                    pa.array([0, *(docs[t] for t in n)], pa.int64()),
                ],
                names=["lang", "source", "term", "n", "docs"],
            )

    for batch in batches:
        for lang, source, text in zip(*(batch.column(i).to_pylist() for i in (0, 1)), batch.column(2)):
            key = lang, source
            if key not in held:
                held[key] = Counter(), Counter()
            n, docs = held[key]
            before, seen = len(n), set()
            for piece in _pieces(text.as_py().translate(_FOLD)):
                terms = piece.split()
                n.update(terms)
                seen.update(terms)
            docs.update(seen)
            size += len(n) - before
            if size >= HELD_TERMS:
                yield from rows()
                held.clear()
                size = 0
    yield from rows()


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents that hold it); and a row without term per group."""
    bounded_batches(docs.sparkSession)
    texts = docs.select(
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")],
        F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"),
    )
    counted = texts.mapInArrow(_count_terms, _COUNTS)
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, total: Column, terms: Column) -> Column:
    """The smoothed share of a term counted n times, in billionths, rounded down, plus one; exact."""
    above = F.lit(SCALE).cast("decimal(10,0)") * (n + SMOOTHING).cast("decimal(20,0)")
    below = (total + SMOOTHING * terms).cast("decimal(20,0)")
    return F.call_function("div", above, below) + 1


def _pair_sums(table: pa.Table) -> pa.Table:
    """Sum of the differences over one chunk's terms, for the pairs of sources between two tiles.

    Rows with word -1 are headers, one per source: p is the share of a count of 0, bits the number of terms.
    """
    word, p, bits = (table.column(c).to_numpy() for c in ("word", "p", "bits"))
    names, code = np.unique(np.array(table.column("source").to_pylist(), dtype=object), return_inverse=True)
    tile = np.zeros(len(names), np.int64)
    tile[code] = table.column("tile").to_numpy()
    head = word < 0
    zero, terms = np.zeros(len(names), np.int64), int(bits[head][0])
    zero[code[head]] = p[head]
    level = np.flatnonzero(~head)
    level = level[np.lexsort((word[level], code[level]))]
    code, word, p, bits = code[level], word[level], p[level], bits[level].astype(np.uint64)
    size = np.bitwise_count(bits).astype(np.int64)
    at = np.searchsorted(code, np.arange(len(names) + 1))
    within = tile.min() == tile.max()
    out: dict[str, list] = {"a": [], "b": [], "value": []}
    for a in range(len(names)):
        i = slice(at[a], at[a + 1])
        for b in range(a + 1, len(names)):
            if not within and tile[a] == tile[b]:
                continue
            j = slice(at[b], at[b + 1])
            neither = abs(zero[a] - zero[b])
            total = terms * neither
            total += (size[i] * (np.abs(p[i] - zero[b]) - neither)).sum()
            total += (size[j] * (np.abs(p[j] - zero[a]) - neither)).sum()
            # every level of a with every level of b in the same word
            low, high = np.searchsorted(word[j], word[i], "left"), np.searchsorted(word[j], word[i], "right")
            many = high - low
            x = np.repeat(np.arange(at[a], at[a + 1]), many)
            y = np.arange(len(x)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many) + at[b]
            cell = np.bitwise_count(bits[x] & bits[y]).astype(np.int64)
            change = np.abs(p[x] - p[y]) - np.abs(p[x] - zero[b]) - np.abs(p[y] - zero[a]) + neither
            total += (cell * change).sum()
            out["a"].append(names[a])
            out["b"].append(names[b])
            out["value"].append(int(total))
    lang = pa.array([table.column("lang")[0].as_py()] * len(out["a"]), pa.string())
    return pa.table({"lang": lang, "a": pa.array(out["a"], pa.string()), "b": pa.array(out["b"], pa.string()), "value": pa.array(out["value"], pa.int64())})


def _pairs(kept: DataFrame, groups: DataFrame, chunks: DataFrame) -> DataFrame:
    """lang, a, b, value: each pair of sources of a language once."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("id") % (1 << WORD_BITS)).cast("int"))
    word = F.shiftright("id", WORD_BITS)
    levels = kept.groupBy("lang", "source", word.alias("word"), "n").agg(F.bit_or(bit).alias("bits"))
    chunk = F.shiftright("word", CHUNK_BITS - WORD_BITS).alias("chunk")
    tile = F.pmod(F.xxhash64("source"), F.ceil(F.col("sources") / TILE)).alias("tile")
    placed = groups.select("lang", "source", "total", "terms", tile, F.ceil(F.col("sources") / TILE).alias("tiles"))
    levels = levels.join(placed, ["lang", "source"]).select(
        "lang", chunk, "source", "tile", "tiles", "word", share(F.col("n"), F.col("total"), F.col("terms")).alias("p"), "bits"
    )
    # a chunk without terms makes sure that every pair comes out
    chunks = chunks.unionByName(groups.select("lang", F.lit(-1).cast("long").alias("chunk"), F.lit(0).cast("long").alias("held")).distinct())
    zero = F.when(F.col("terms") > 0, share(F.lit(0), F.col("total"), F.greatest("terms", F.lit(1)))).otherwise(F.lit(0))
    heads = placed.join(chunks, "lang").select(
        "lang", "chunk", "source", "tile", "tiles", F.lit(-1).cast("long").alias("word"), zero.alias("p"), F.col("held").alias("bits")
    )
    partner = F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).alias("partner")
    dealt = levels.unionByName(heads).select("*", partner)
    dealt = dealt.select(
        "lang", "source", "tile", "word", "p", "bits", "chunk", F.least("tile", "partner").alias("t1"), F.greatest("tile", "partner").alias("t2")
    )
    parts = dealt.groupBy("lang", "chunk", "t1", "t2").applyInArrow(_pair_sums, _PAIRS)
    return parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def audit_sources(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: distances of each (lang, source) group of ``docs`` (text, lang, source).

    Terms are runs of ASCII letters and characters beyond ASCII, only A-Z lower-cased; a language keeps those in at
    least ``min_docs`` of its documents. A group's share of a kept term is 1 + floor(10^9 (count + 5) / (N + 5 V))
    with N all its counts and V the number of kept terms; the whole language has shares by the same rule.
    Part ``pair``: every other source of the language, the sum of the differences of all shares. Part ``term``: the
    ``top`` terms that the group holds and uses most above its language. Ranked by falling value, then by item.

    Null text, lang and source count as empty. A group without terms has the shares of zero counts; a language
    without kept terms gives pairs with value 0. Repeated rows count as often as they occur. Ties of value go by
    the item's bytes. Other columns are not looked at, texts have any length, an empty table gives an empty result.
    """
    counts = fixed(term_counts(docs), "term-counts")
    listed = counts.where("term is not null").groupBy("lang", "term")
    listed = listed.agg(F.sum("docs").alias("docs"), F.sum("n").alias("overall")).where(F.col("docs") >= min_docs)
    listed = listed.sort("lang", F.desc("overall"), "term").withColumn("id", F.monotonically_increasing_id())
    listed = fixed(listed.select("lang", "term", "overall", "id"), "terms")
    langs = listed.groupBy("lang").agg(F.sum("overall").alias("lang_total"), F.count(F.lit(1)).alias("terms"))
    kept = fixed(counts.join(listed, ["lang", "term"]).select("lang", "source", "term", "id", "n", "overall"), "kept-counts")

    groups = counts.where("term is null").select("lang", "source")
    groups = groups.join(kept.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left")
    sources = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("sources"))
    groups = groups.join(langs, "lang", "left").join(sources, "lang").na.fill(0, ["total", "terms", "lang_total"])
    groups = fixed(groups, "groups")

    chunks = listed.groupBy("lang", F.shiftright("id", CHUNK_BITS).alias("chunk")).agg(F.count(F.lit(1)).alias("held"))
    pairs = fixed(_pairs(kept, groups, chunks), "pairs")
    pairs = pairs.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").unionByName(
        pairs.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "value")
    )
    order = [F.desc("value"), F.asc("item")]
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order)))

    above = kept.join(groups, ["lang", "source"]).select(
        "lang",
        "source",
        F.col("term").alias("item"),
        (share(F.col("n"), F.col("total"), F.col("terms")) - share(F.col("overall"), F.col("lang_total"), F.col("terms"))).alias("value"),
    )
    best = first_per_group(above.where("value > 0"), ["lang", "source"], order, top, spread_by="item", rank="rank")
    out = ["lang", "source", "part", "item", "value", "rank"]
    return ranked.withColumn("part", F.lit("pair")).select(out).unionByName(best.withColumn("part", F.lit("term")).select(out))
