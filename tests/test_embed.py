"""Embeddings by a versioned model, and the store that embeds what it is given."""

import hashlib
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.operators import embed
from quire.streaming import snapshots, streams

TEXTS = ["alpha beta gamma", "beta delta", "alpha beta gamma", "Über große Straßen 12", "", None, "epsilon zeta eta theta alpha alpha"]
KIND = "id long, seq long, text string, metadata map<string,string>"


def stored(spark, texts, seq=0):
    return spark.createDataFrame([(i, seq, t, {"document_type": "report"}) for i, t in enumerate(texts)], KIND)


def plain_vectors(fitted, texts, size=embed.SIZE):
    def places(text):
        return [int(hashlib.md5(t.encode()).hexdigest()[:7], 16) % size for t in re.findall(r"[^\W_]+", (text or "").lower())]

    held = [sum(i in set(places(t)) for t in fitted) for i in range(size)]
    weights = [math.log((len(fitted) + 1) / (n + 1)) + 1 for n in held]
    vectors = []
    for text in texts:
        v = np.zeros(size)
        for i in places(text):
            v[i] += weights[i]
        vectors.append(v / (np.linalg.norm(v) or 1))
    return weights, vectors


def test_vectors_equal_a_plain_count(spark):
    docs = stored(spark, TEXTS)
    model = embed.fit_model(docs)
    weights, vectors = plain_vectors(TEXTS, TEXTS)
    assert np.allclose(model.weights, weights)
    for r in embed.embed_text(docs, model).collect():
        assert np.allclose(r["embedding"], vectors[r["id"]], atol=1e-6) and r["model_version"] == 1
    assert embed.fit_model(docs.limit(0)).weights == (1.0,) * embed.SIZE


def test_models_are_kept_by_version(spark, folder):
    first, second = embed.EmbeddingModel(1, (1.0, 2.5)), embed.EmbeddingModel(2, (0.5, 0.1 + 0.2))
    for model in (first, second):
        model.save(spark, folder)
    assert embed.load_model(spark, folder) == second and embed.load_model(spark, folder, 1) == first
    with pytest.raises(Exception, match="already exists"):
        first.save(spark, folder)
    with pytest.raises(ValueError, match="no model of version 7"):
        embed.load_model(spark, folder, 7)


def test_text_in_text_query_out(spark):
    model = embed.fit_model(stored(spark, TEXTS))
    store = embed.embed_text(stored(spark, TEXTS), model)
    store = embed.store_texts(store, spark.createDataFrame([(1, 1, "gamma ray burst", {"document_type": "memo"}), (9, 0, "burst", {})], KIND), model)
    assert store.columns == ["id", "seq", "text", "metadata", "embedding", "model_version"]
    asked = spark.createDataFrame([("a", "GAMMA alpha, beta"), ("b", "bursts burst"), ("c", None)], "query_id string, text string")
    hits = {}
    for r in embed.search_texts(store, asked, model, 2).orderBy("rank").collect():
        hits.setdefault(r["query_id"], []).append((r["id"], r["distance"]))
    assert [n for n, _ in hits["a"]] == [0, 2] and hits["a"][0][1] == pytest.approx(0, abs=1e-6)
    assert hits["b"][0][0] == 9 and [d for _, d in hits["c"]] == [1.0, 1.0]
    typed = embed.search_texts(store, asked.where("query_id = 'b'"), model, 5, "memo").collect()
    assert [r["id"] for r in typed] == [1]


def test_rows_of_an_older_model_are_embedded_anew(spark):
    docs = stored(spark, TEXTS)
    model = embed.fit_model(docs, version=2)
    old = embed.EmbeddingModel(1, tuple(float(1 + i % 3) for i in range(embed.SIZE)))
    mixed = embed.embed_text(docs.where("id < 3"), old).unionByName(embed.embed_text(docs.where("id >= 3"), model))
    fresh = {r["id"]: (r["model_version"], r["embedding"]) for r in embed.refresh_embeddings(mixed, model).collect()}
    assert fresh == {r["id"]: (2, r["embedding"]) for r in embed.embed_text(docs, model).collect()}
    asked = spark.createDataFrame([("a", "beta delta")], "query_id string, text string")
    assert embed.search_texts(mixed, asked, model, 1).first()["id"] == 1


def test_streams_embed_what_they_store(spark, folder):
    model = embed.fit_model(stored(spark, TEXTS))
    stored(spark, TEXTS).coalesce(1).write.parquet(folder + "/in")
    stored(spark, ["new words", "beta"], seq=1).coalesce(1).write.mode("append").parquet(folder + "/in")
    arriving = spark.readStream.schema(stored(spark, []).schema).option("maxFilesPerTrigger", 1).parquet(folder + "/in")
    streams.stream_upsert(arriving, folder + "/table", folder + "/checkpoint", model).awaitTermination()
    got = {r["id"]: (r["text"], r["embedding"]) for r in streams.read_documents(spark, folder + "/table").collect()}
    want = embed.embed_text(stored(spark, ["new words", "beta", *TEXTS[2:]]), model)
    assert got == {r["id"]: (r["text"], r["embedding"]) for r in want.collect()}
    assert len(snapshots.read_snapshot(spark, folder + "/table").folders) == 2


def test_places_are_the_digest_modulo_the_size(spark):
    for size in (16, 100, 256):
        names = embed._place_names(size)
        text = "a bc Déjà 12 a"
        got = spark.createDataFrame([(text,)], "text string").select(embed._places(F.col("text"), size)).first()[0]
        assert [names.index(n) for n in got] == [int(hashlib.md5(t.encode()).hexdigest()[:7], 16) % size for t in text.lower().split()]


def test_rows_of_older_models_are_embedded_once_for_a_search(spark, monkeypatch):
    docs = spark.createDataFrame([(i, 0, f"word{i} other", {}) for i in range(8)], "id long, seq long, text string, metadata map<string,string>")
    model = embed.fit_model(docs)
    old = embed.EmbeddingModel(0, tuple(1.0 for _ in model.weights))
    mixed = embed.embed_text(docs.where("id < 5"), model).unionByName(embed.embed_text(docs.where("id >= 5"), old))
    kept, plain = [], embed._stored
    monkeypatch.setattr(embed, "_stored", lambda df, purpose: kept.append(plain(df, purpose)) or kept[-1])
    asked = docs.selectExpr("id AS query_id", "text")
    found = embed.search_texts(mixed, asked, model, k=1)
    assert {r["query_id"]: r["id"] for r in found.collect()} == {i: i for i in range(8)}
    assert [sorted(r["id"] for r in k.collect()) for k in kept] == [[5, 6, 7]]
