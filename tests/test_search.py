"""Similarity search against brute force."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quire.functions import vectors
from quire.operators import search
from quire.sources import derived

WIDTH = 16


@pytest.fixture(scope="module")
def store(spark):
    """900 documents, a third of them copies of one vector; three types; one vector of zeros."""
    rng = np.random.default_rng(3)
    vectors = rng.standard_normal((900, WIDTH)).astype(np.float32)
    vectors[::3] = vectors[0]
    vectors[5] = 0
    rows = [
        (i, f"text {i}", [float(x) for x in vectors[i]], {"document_type": ("invoice", "contract", "report")[i % 7 % 3]})
        for i in range(900)
    ]
    kind = "id long, text string, embedding array<float>, metadata map<string,string>"
    return vectors, rows, spark.createDataFrame(rows, kind).repartition(6).cache()


def queries_of(spark, vectors):
    return spark.createDataFrame(
        [(f"q{i}", [float(x) for x in v]) for i, v in enumerate(vectors)], "query_id string, embedding array<float>"
    )


def brute(vectors, rows, wanted, k, keep=lambda row: True):
    docs = vectors.astype(np.float64)
    norms = np.linalg.norm(docs, axis=1)
    result = {}
    for i, q in enumerate(wanted.astype(np.float64)):
        length = norms * np.linalg.norm(q)
        cos = np.divide(docs @ q, length, out=np.zeros(len(docs)), where=length > 0)
        found = sorted((round(1 - c, 9), r[0]) for c, r in zip(cos, rows) if keep(r))[:k]
        result[f"q{i}"] = [(d, n) for d, n in found]
    return result


def listed(hits):
    result = {}
    for r in sorted(hits.collect(), key=lambda r: (r["query_id"], r["rank"])):
        result.setdefault(r["query_id"], []).append((r["distance"], r["id"]))
    return result


def same(got, want):
    assert got.keys() == want.keys()
    for key in want:
        assert [n for _, n in got[key]] == [n for _, n in want[key]]
        assert [d for d, _ in got[key]] == pytest.approx([d for d, _ in want[key]], abs=2e-9)


@pytest.mark.parametrize("k", [1, 5, 20])
def test_exact_search_with_many_copies(spark, store, k):
    vectors, rows, docs = store
    wanted = np.vstack([vectors[[0, 1, 2, 7]], -vectors[:1]])
    same(listed(search.search_similar(docs, queries_of(spark, wanted), k)), brute(vectors, rows, wanted, k))


def test_type_filter_applies_before_ranking(spark, store):
    vectors, rows, docs = store
    wanted = vectors[[0, 4]]
    got = listed(search.search_similar(docs, queries_of(spark, wanted), 7, "report"))
    same(got, brute(vectors, rows, wanted, 7, lambda r: r[3]["document_type"] == "report"))
    assert search.search_similar(docs, queries_of(spark, wanted), 7, "memo").count() == 0


@pytest.mark.parametrize("block, slot_rows", [(8, 100), (1, 10_000), (1000, 7)])
def test_blocks_of_queries_and_parts_of_documents(spark, store, monkeypatch, block, slot_rows):
    vectors, rows, docs = store
    monkeypatch.setattr(search, "SLOT_ROWS", slot_rows)
    wanted = vectors[1:30]
    same(listed(search.search_similar(docs, queries_of(spark, wanted), 3, block=block)), brute(vectors, rows, wanted, 3))


def test_no_queries_and_no_documents(spark, store):
    nothing = search.search_similar(store[2], queries_of(spark, store[0][:0]))
    assert nothing.count() == 0 and nothing.columns == search.search_similar(store[2], queries_of(spark, store[0][:1])).columns
    assert search.search_similar(store[2].limit(0), queries_of(spark, store[0][:2])).count() == 0


def test_small_arrow_batches_change_nothing(spark, store):
    vectors, rows, docs = store
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        same(listed(search.search_similar(docs, queries_of(spark, vectors[:3]), 6)), brute(vectors, rows, vectors[:3], 6))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def with_unfit(spark, docs):
    rows = [(9001, "short", [1.0], {}), (9002, "none", None, {}), (9003, "nan", [float("nan")] * WIDTH, {}), (9004, "null", [None] * WIDTH, {})]
    return docs.unionByName(spark.createDataFrame(rows, docs.schema))


@pytest.mark.parametrize("copies", [1, 700])
def test_unfit_vectors_are_reported_at_every_size(spark, store, copies):
    vectors, rows, docs = store
    wanted = vectors[:4]
    odd = with_unfit(spark, docs)
    many = queries_of(spark, np.repeat(wanted, copies, axis=0))
    with pytest.raises(Exception, match="has no vector of 16 numbers"):
        search.search_similar(odd, many).collect()
    got = listed(search.search_similar(odd, queries_of(spark, wanted), unfit="skip"))
    same(got, brute(vectors, rows, wanted, 5))
    assert sorted(map(tuple, search.unfit_documents(odd, WIDTH).collect()), key=str) == [(9001, 1), (9002, None), (9003, 16), (9004, 16)]
    for bad in ([1.0], None, [float("nan")] * WIDTH):
        last = spark.createDataFrame([("bad", bad)], many.schema)
        with pytest.raises(ValueError, match="differ in length or hold no numbers"):
            search.search_similar(docs, many.unionByName(last))


def test_rows_that_share_an_id(spark):
    rows = [(1, "a", [1.0, 0.0], {"document_type": "x"}), (1, "b", [0.0, 1.0], {"document_type": "y"}), (None, "c", [1.0, 1.0], {})]
    docs = spark.createDataFrame(rows, "id long, text string, embedding array<float>, metadata map<string,string>")
    hits = search.search_similar(docs, queries_of(spark, np.array([[1.0, 0.1]])), 3).orderBy("rank").collect()
    assert [(r["id"], r["text_preview"]) for r in hits] == [(1, "a..."), (None, "c..."), (1, "b...")]


@pytest.fixture(scope="module")
def index(spark, store, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index")) + "/index"
    search.write_search_index(store[2], path, cells=20)
    return path


def test_index_holds_every_row_and_its_cells(spark, store, index):
    assert spark.read.parquet(f"{index}/rows").count() == 900
    cells = spark.read.parquet(f"{index}/cells").collect()
    assert sum(r["n_rows"] for r in cells) == 900 and 10 < len(cells) <= 20
    centres = {r["cell"]: (np.array(r["centre"]), r["radius"]) for r in cells}
    for r in spark.read.parquet(f"{index}/rows").collect():
        vector = np.array(r["embedding"], float)
        vector /= np.linalg.norm(vector) or 1
        assert np.linalg.norm(vector - centres[r["cell"]][0]) <= centres[r["cell"]][1] + 1e-6


@pytest.mark.parametrize("kind, probes", [(None, 1), (None, 3), ("report", None), ("memo", None)])
def test_exact_index_search(spark, store, index, kind, probes):
    vectors, rows, _ = store
    wanted = np.vstack([vectors[[0, 1, 2, 5, 7]], -vectors[:1], vectors[:1] * 0])
    got = listed(search.search_index(spark, index, queries_of(spark, wanted), 10, kind, probes=probes, exact=True))
    want = brute(vectors, rows, wanted, 10, lambda r: kind is None or r[3]["document_type"] == kind)
    same(got, {q: hits for q, hits in want.items() if hits})


def test_index_reads_only_probed_folders(spark, store, index):
    hits = search.search_index(spark, index, queries_of(spark, store[0][1:2]), 3, probes=1)
    assert "PartitionFilters: [" in hits._jdf.queryExecution().executedPlan().toString()
    assert search.search_index(spark, index, queries_of(spark, store[0][:0])).count() == 0
    with pytest.raises(ValueError, match="the index 16"):
        search.search_index(spark, index, queries_of(spark, np.ones((1, 3))))


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.1"])
def test_approximate_search_recalls_nine_of_ten(spark, folder, scale):
    """The registered settings: queries are the rows with ids divisible by 50, against all rows."""
    sf_dir = f"/root/testdata/{scale}"
    docs = derived.index_documents(spark, sf_dir)
    queries = docs.where("id % 50 = 0").select(F.col("id").alias("query_id"), "embedding")
    search.write_search_index(docs, folder + "/index")
    cells, probes = spark.read.parquet(folder + "/index/about").select("cells", "probes").first()
    near = listed(search.search_index(spark, folder + "/index", queries))
    exact = listed(search.search_similar(docs, queries))
    found = [len({n for _, n in near[q]} & {n for _, n in exact[q]}) / len(exact[q]) for q in exact]
    print(scale, "cells", cells, "probes", probes, "recall", np.mean(found))
    assert np.mean(found) >= 0.9 and cells > 10


def test_matrices_of_distances_are_bounded():
    for width in (1, 500, 8192, 16_384, 10_000_000):
        step = vectors.rows_at_a_time(width)
        assert step >= 1 and (step == 1 or step * width <= vectors._MATRIX_VALUES)
    batch = pa.RecordBatch.from_pydict({"id": list(range(10_000))})
    pieces = list(search._pieces([batch], 8192))
    assert max(len(p) for p in pieces) == vectors.rows_at_a_time(8192)
    assert [i for p in pieces for i in p.column("id").to_pylist()] == list(range(10_000))
    rng = np.random.default_rng(3)
    docs, queries = rng.integers(-3, 4, (700, 5)).astype(float), rng.integers(-3, 4, (9000, 5)).astype(float)
    top = vectors.TopK(queries, 4)
    top.add(docs, pa.table({"id": np.arange(700)}))
    got = top.best()
    want = np.round(1.0 - vectors.unit_rows(docs) @ vectors.unit_rows(queries).T, vectors.DISTANCE_DIGITS)
    want = [i for q in range(9000) for i in np.lexsort((np.arange(700), want[:, q]))[:4]]
    assert got.column("id").to_pylist() == want
