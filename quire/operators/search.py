"""Similarity search over embedded documents: exact, and through an index of cells.

Both ways score a grid of slots: a slot holds a bounded block of queries and streams one part of the documents past
them. Queries are a table from beginning to end; only counts come to the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.fixed_values import PREVIEW_CHARS, SEARCH_K, SEARCH_K_RANGE
from quire.functions.paths import work_dir
from quire.functions.ranking import first_per_group
from quire.functions.sizing import hinted, is_small
from quire.functions.vectors import centres_of, euclidean, matrix_of, rows_at_a_time, top_k_slots, unit_rows

QUERY_BLOCK = 16_384  # queries of a slot, about
SLOT_ROWS = 1_000_000  # documents of a slot, about; they are streamed
SAMPLE_ROWS = 65_536  # rows that cells are fitted on, at most
SAMPLE_PER_CELL = 8
CALIBRATION_QUERIES = 200
TARGET_RECALL = 0.95


def _check_k(k: int) -> None:
    low, high = SEARCH_K_RANGE
    if not low <= k <= high:
        raise ValueError(f"k must be between {low} and {high}")


def preview(text: Column) -> Column:
    """Head of a text; always ends in three dots."""
    return F.concat(F.substring(F.coalesce(text, F.lit("")), 1, PREVIEW_CHARS), F.lit("..."))


def _is_fit(vector: str, width: int) -> Column:
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x))
    return F.coalesce((F.size(vector) == width) & ~odd, F.lit(False))


def unfit_documents(docs: DataFrame, width: int) -> DataFrame:
    """id, n_values of the documents that cannot be compared: another length, no vector, or a value that is no number."""
    return docs.where(~_is_fit("embedding", width)).select("id", F.when(F.col("embedding").isNotNull(), F.size("embedding")).alias("n_values"))


def _comparable(docs: DataFrame, width: int, unfit: str) -> DataFrame:
    if unfit == "skip":
        return docs.where(_is_fit("embedding", width))
    if unfit != "error":
        raise ValueError("unfit must be 'error' or 'skip'")
    said = F.concat(F.lit("document "), F.coalesce(F.col("id").cast("string"), F.lit("null")), F.lit(f" has no vector of {width} numbers"))
    return docs.where(F.when(_is_fit("embedding", width), F.lit(True)).otherwise(F.raise_error(said).cast("boolean")))


def query_width(queries: DataFrame) -> tuple[int, int]:
    """(number of queries, their common length); raises where they differ, whatever the number."""
    size = F.coalesce(F.size("embedding"), F.lit(-1))
    odd = F.count_if(F.exists("embedding", lambda x: x.isNull() | F.isnan(x)))
    n, low, high, bad = queries.agg(F.count(F.lit(1)), F.min(size), F.max(size), odd).first()
    if n and (low != high or low < 1 or bad):
        raise ValueError(f"query vectors differ in length or hold no numbers: {low} to {high} values, {bad} with odd ones")
    return n, high or 0


def _digest() -> Column:
    """Tells apart rows that share an id."""
    return F.xxhash64("text", "embedding")


def _slots(spark: SparkSession, docs: DataFrame, queries: DataFrame, sizes: list[tuple[int, int, int]], width: int, k: int, block: int) -> DataFrame:
    """query_id, distance and the columns of ``docs`` beside cell and embedding: the k best of every slot.

    docs: cell, id, embedding, and more; queries: cell, query_id, embedding; sizes: cell, documents, queries (counts).
    A cell of many documents or queries becomes a grid of slots.
    """
    at, grid = 0, []
    want = 2 * spark.sparkContext.defaultParallelism
    for cell, n_docs, n_queries in sizes:
        blocks = -(-n_queries // block)
        parts = max(-(-n_docs // SLOT_ROWS), -(-want // (blocks * len(sizes))) if n_docs > 1000 else 1)
        grid.append((cell, at, blocks, parts))
        at += blocks * parts
    tasks = max(1, min(at, max(want, sum(s[1] for s in sizes) // SLOT_ROWS)))
    def in_grid(rows: DataFrame) -> DataFrame:
        if len(grid) == 1:
            return rows.withColumns({n: F.lit(v).cast("long") for n, v in zip(("first", "blocks", "parts"), grid[0][1:])})
        return rows.join(F.broadcast(spark.createDataFrame(grid, "cell long, first long, blocks long, parts long")), "cell")

    carried = [c for c in docs.columns if c not in ("cell", "embedding")]
    asked = in_grid(queries.select("cell", "query_id", F.col("embedding").alias("asked")))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("query_id", "asked"), "blocks"))
    asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    rows = in_grid(docs).withColumn("part", F.pmod(F.xxhash64("id", "embedding"), "parts"))
    rows = rows.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    slot = (F.col("first") + F.col("block") * F.col("parts") + F.col("part")).alias("slot")
    both = asked.select(slot, "asked", "query_id").unionByName(rows.select(slot, "embedding", *carried), allowMissingColumns=True)
    placed = both.repartitionById(tasks, F.pmod(F.col("slot"), F.lit(tasks)).cast("int"))
    placed = placed.sortWithinPartitions("slot", F.col("asked").isNull())
    fields = [docs.schema[c] for c in carried] + [T.StructField("distance", T.DoubleType()), queries.schema["query_id"]]
    return placed.mapInArrow(top_k_slots(width, k), T.StructType(fields))


def _nearest(hits: DataFrame, k: int) -> DataFrame:
    return first_per_group(hits, ["query_id"], [F.col("distance"), F.col("id")], k, spread_by="id", rank="rank")


def _stored(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written to the shared work folder and read again: computed once, whatever reads it."""
    folder = work_dir(df.sparkSession, purpose)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def _with_payload(best: DataFrame, docs: DataFrame) -> DataFrame:
    """Text and metadata of the rows found; they are read for these alone."""
    best = _stored(best, "hits")
    found = best.select("id", "digest").distinct()
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest"))
    found = found.select(F.col("id").alias("_id"), F.col("digest").alias("_digest"))
    rows = docs.select("id", _digest().alias("digest"), preview(F.col("text")).alias("text_preview"), "metadata")
    rows = rows.join(hinted(found, is_small(found)), same, "left_semi").dropDuplicates(["id", "digest"])
    rows = rows.withColumnsRenamed({"id": "_id", "digest": "_digest"})
    return best.join(rows, same).select("query_id", "rank", "id", "text_preview", "metadata", "distance")


def _of_type(docs: DataFrame, document_type: str | None) -> DataFrame:
    return docs if document_type is None else docs.where(F.col("metadata")["document_type"] == document_type)


def _empty(docs: DataFrame, queries: DataFrame) -> DataFrame:
    fields = [queries.schema["query_id"], T.StructField("rank", T.IntegerType()), docs.schema["id"]]
    fields += [T.StructField("text_preview", T.StringType()), docs.schema["metadata"], T.StructField("distance", T.DoubleType())]
    return docs.sparkSession.createDataFrame([], T.StructType(fields))


def search_similar(
    docs: DataFrame,
    queries: DataFrame,
    k: int = SEARCH_K,
    document_type: str | None = None,
    unfit: str = "error",
    block: int = QUERY_BLOCK,
) -> DataFrame:
    """The k nearest documents of every query by cosine distance, exact: a distributed top-k join.

    ``docs``: id, text, embedding, metadata; ``queries``: query_id, embedding. The type filter applies before ranking.
    Blocks of queries and parts of documents meet in slots; a slot sends on its k best per query, and these are merged
    in two steps. Documents are read once, and once more for the text of what was found. A document whose vector has
    another length, is null or holds a null or NaN raises an error (``unfit="skip"`` leaves it out, and
    ``unfit_documents`` lists it); queries of unlike lengths raise one at any number.
    """
    _check_k(k)
    n, width = query_width(queries)
    if not n:
        return _empty(docs, queries)
    chosen = _comparable(_of_type(docs, document_type), width, unfit)
    zero = F.lit(0).cast("long").alias("cell")
    rows = chosen.select(zero, "id", "embedding", _digest().alias("digest"))
    asked = queries.select(zero, "query_id", "embedding")
    hits = _slots(docs.sparkSession, rows, asked, [(0, _of_type(docs, document_type).count(), n)], width, k, block)
    return _with_payload(_nearest(hits, k), chosen)


# --- the index of cells ---


def _pieces(batches, width: int):
    """The batches in pieces whose matrices of distances to ``width`` centres are bounded."""
    step = rows_at_a_time(width)
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def _nearest_cell(centres: np.ndarray):
    def run(batches):
        for batch in _pieces(batches, len(centres)):
            gaps = euclidean(unit_rows(matrix_of(batch.column("embedding"), centres.shape[1])), centres)
            cell = gaps.argmin(axis=1) if len(gaps) else np.empty(0, np.int64)
            gap = gaps[np.arange(len(gaps)), cell]
            yield batch.append_column("cell", pa.array(cell, pa.int64())).append_column("gap", pa.array(gap, pa.float64()))

    return run


def write_search_index(
    docs: DataFrame,
    path: str,
    cells: int | None = None,
    sample_rows: int = SAMPLE_ROWS,
    target_recall: float = TARGET_RECALL,
    unfit: str = "error",
    seed: int = 7,
) -> None:
    """Store documents (id, text, embedding, metadata, ...) by cell, for ``search_index``.

    ``cells``: about the square root of the number of rows by default, and at most an eighth of the sample. Centres are
    fitted on at most ``sample_rows`` rows, drawn by a hash; every row is stored in the cell of its nearest centre, in a
    folder of its own ({path}/rows/cell=...). {path}/cells holds each cell's centre, size and radius (distance of its
    farthest row), {path}/about the number of cells to probe: as many as bring ``target_recall`` of the 20 nearest
    of 200 rows, measured against the exact search.
    """
    spark = docs.sparkSession
    n, width = docs.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    if not n or width is None or width < 1:
        raise ValueError("no vectors to index")
    chosen = _comparable(docs, width, unfit)
    order = F.xxhash64(F.lit(seed), "id", "embedding")
    # a share that brings the sample in expectation, by the hash alone, then cut to the bound
    share = min(1.0, 1.1 * sample_rows / n)
    drawn = chosen.where(F.pmod(order, F.lit(1 << 30)) < int(share * (1 << 30)) + 1).select(order.alias("order"), "embedding")
    sample = drawn.orderBy("order").limit(sample_rows).select("embedding").toArrow()
    vectors = unit_rows(matrix_of(sample.column("embedding").combine_chunks(), width))
    cells = cells or max(1, round(n**0.5))
    centres = centres_of(vectors, max(1, min(cells, len(vectors) // SAMPLE_PER_CELL or 1)), seed=seed)

    fields = docs.schema.fields + [T.StructField("cell", T.LongType()), T.StructField("gap", T.DoubleType())]
    placed = chosen.mapInArrow(_nearest_cell(centres), T.StructType(fields))
    # rebalancing keeps files few and splits the folder of a cell that holds very many rows
    placed.hint("rebalance", F.col("cell")).write.partitionBy("cell").parquet(f"{path}/rows")
    rows = _index_rows(spark, path)
    held = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n_rows"), F.max("gap").alias("radius")).orderBy("cell").collect()
    known = [(r["cell"], centres[r["cell"]].tolist(), r["radius"], r["n_rows"]) for r in held]
    spark.createDataFrame(known, "cell long, centre array<double>, radius double, n_rows long").coalesce(1).write.parquet(f"{path}/cells")

    # how far down the list of cells the true neighbours of some rows lie
    k = SEARCH_K_RANGE[1]
    some = rows.select("embedding").orderBy(order).limit(CALIBRATION_QUERIES).collect()
    vectors = {i: [float(x) for x in r["embedding"]] for i, r in enumerate(some)}
    asked = spark.createDataFrame(list(vectors.items()), "query_id long, embedding array<double>")
    zero = F.lit(0).cast("long").alias("cell")
    base = rows.select(zero, "id", "embedding", F.col("cell").alias("home"))
    hits = _slots(spark, base, asked.select(zero, "query_id", "embedding"), [(0, n, len(vectors))], width, k, QUERY_BLOCK)
    hits = _nearest(hits, k).select("query_id", "home").collect()
    centres = np.array([c[1] for c in known])
    number = {c[0]: i for i, c in enumerate(known)}
    places = {q: np.argsort(np.argsort(euclidean(unit_rows(np.array([v])), centres)[0])) for q, v in vectors.items()}
    ranks = np.sort([places[r["query_id"]][number[r["home"]]] for r in hits])
    probes = int(ranks[min(len(ranks) - 1, int(np.ceil(target_recall * len(ranks))) - 1)]) + 1
    about = [(width, probes, float(target_recall), len(known))]
    spark.createDataFrame(about, "width int, probes int, target_recall double, cells long").coalesce(1).write.parquet(f"{path}/about")


def _index_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/rows").withColumn("cell", F.col("cell").cast("bigint"))


def _probed(cells: np.ndarray, centres: np.ndarray, radii: np.ndarray, probes: int, beyond: bool):
    """query_id, embedding, cell: the ``probes`` nearest cells of each query, or the others that its limit cannot rule out."""

    def run(batches):
        for batch in _pieces(batches, len(centres)):
            gaps = euclidean(unit_rows(matrix_of(batch.column("embedding"), centres.shape[1])), centres)
            order = np.argsort(gaps, axis=1, kind="stable")
            chosen = np.zeros(gaps.shape, bool)
            np.put_along_axis(chosen, order[:, :probes], True, axis=1)
            if beyond:
                # cosine distance is half the square of the distance between unit vectors; no row of a cell is nearer
                # than its centre less its radius
                least = np.maximum(gaps - radii[None, :] - 1e-7, 0) ** 2 / 2
                chosen = ~chosen & (least <= batch.column("farthest").to_numpy()[:, None] + 1e-7)
            query, cell = np.nonzero(chosen)
            rows = batch.select(["query_id", "embedding"]).take(pa.array(query))
            yield rows.append_column("cell", pa.array(cells[cell], pa.int64()))

    return run


def search_index(
    spark: SparkSession,
    path: str,
    queries: DataFrame,
    k: int = SEARCH_K,
    document_type: str | None = None,
    probes: int | None = None,
    exact: bool | None = None,
    block: int = QUERY_BLOCK,
) -> DataFrame:
    """As ``search_similar``, over an index: each query looks into the cells whose centres are nearest.

    ``probes``: how many; the index's own measured number by default. ``exact``: look also into every other cell that
    may hold a nearer row than the k-th found, by centre and radius; the result is that of the exact search. The default
    is exact where a type is asked for (the number of cells was measured without), and not exact otherwise.
    """
    _check_k(k)
    rows = _index_rows(spark, path)
    n, width = query_width(queries)
    if not n:
        return _empty(rows, queries)
    about = spark.read.parquet(f"{path}/about").first()
    if width != about["width"]:
        raise ValueError(f"query vectors have {width} values, the index {about['width']}")
    exact = document_type is not None and probes is None if exact is None else exact
    known = spark.read.parquet(f"{path}/cells").orderBy("cell").collect()  # as many as the index was given
    cells, radii = np.array([r["cell"] for r in known]), np.array([r["radius"] for r in known])
    centres = np.array([r["centre"] for r in known])
    sizes = {r["cell"]: r["n_rows"] for r in known}
    chosen = _of_type(rows, document_type)
    schema = T.StructType([queries.schema["query_id"], queries.schema["embedding"], T.StructField("cell", T.LongType())])

    def looked_into(asked: DataFrame) -> DataFrame | None:
        asked = _stored(asked, "probes")
        counts = asked.groupBy("cell").count().collect()
        if not counts:
            return None
        grid = [(r["cell"], sizes[r["cell"]], r["count"]) for r in sorted(counts)]
        near = chosen if len(grid) == len(known) else chosen.where(F.col("cell").isin([c for c, _, _ in grid]))
        near = near.select("cell", "id", "embedding", _digest().alias("digest"))
        return _nearest(_slots(spark, near, asked, grid, width, k, block), k)

    asked = queries.select("query_id", "embedding")
    first = asked.mapInArrow(_probed(cells, centres, radii, probes or about["probes"], False), schema)
    hits = looked_into(first)
    if exact:
        hits = _stored(hits, "hits")
        farthest = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("farthest"))
        farthest = farthest.select(F.col("query_id").alias("_query"), F.when(F.col("n") >= k, F.col("farthest")).alias("farthest"))
        same = F.col("query_id").eqNullSafe(F.col("_query"))
        limits = asked.join(farthest, same, "left").select("query_id", "embedding", F.coalesce("farthest", F.lit(9.0)).alias("farthest"))
        more = looked_into(limits.mapInArrow(_probed(cells, centres, radii, probes or about["probes"], True), schema))
        hits = hits if more is None else _nearest(hits.drop("rank").unionByName(more.drop("rank")), k)
    return _with_payload(hits, chosen)
