"""The corpus pipeline from end to end: the given tables with planted and hostile rows, and empty tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quire.llm.common import table

COPIED, LEAKED, EMPTY = 10_000_001, 10_000_101, 10_000_201


@pytest.fixture(scope="module")
def planted(spark, sf_dir, tmp_path_factory):
    """The given documents, with near copies, benchmark passages, null, empty, repeated and very long rows."""
    folder = str(tmp_path_factory.mktemp("planted"))
    docs = table(spark, sf_dir, "documents")
    for name in ("labels", "benchmark"):
        table(spark, sf_dir, name).write.parquet(f"{folder}/{name}.parquet")
    kinds = docs.schema
    text = " ".join(f"word{i * 7919 % 1009} stands{i}" for i in range(150))
    passage = table(spark, sf_dir, "benchmark").orderBy(F.length("text").desc(), "item_id").first()["text"]
    good = docs.join(table(spark, sf_dir, "labels").where("quality = 1"), "doc_id").orderBy(F.length("text").desc(), "doc_id")
    likely = [r["text"].split() for r in good.limit(3).collect()]  # half of one is no copy of it
    like = docs.orderBy("doc_id").first().asDict()

    def row(doc_id, **changes):
        return tuple((like | {"doc_id": doc_id} | changes)[f.name] for f in kinds.fields)

    rows = [row(COPIED + i, text=f"{text} end{i}") for i in range(40)]
    rows += [row(LEAKED + i, text=f"{' '.join(words[: len(words) // 2])} {passage}") for i, words in enumerate(likely)]
    rows += [row(EMPTY, text=None), row(EMPTY + 1, text=""), row(EMPTY + 2, text=" \t\n")]
    rows += [row(EMPTY + 3, text=None, source=None, lang=None), row(None, text="a row without an id")]
    rows += [row(EMPTY + 4, text="twice the same row"), row(EMPTY + 4, text="twice the same row")]
    rows += [row(EMPTY + 5, text=" ".join(f"long{i}" for i in range(60_000)))]
    more = spark.createDataFrame(rows, kinds)
    wide = docs.unionByName(more).withColumns({"shard": F.lit("s"), "component": F.lit(1), "size": F.lit("x"), "kept": F.lit(None)})
    wide.withColumn("kept", F.col("kept").cast("string")).write.parquet(f"{folder}/documents.parquet")
    return folder


def test_stages_keep_their_contracts(spark, planted):
    docs = table(spark, planted, "documents")
    columns, sizes = docs.columns, [docs.count()]
    ids = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = corpus_pipeline.fixed(stage(spark, docs, planted), f"test-{name}")
        sizes.append(docs.count())
        ids[name] = [r["doc_id"] for r in docs.select("doc_id").collect()]
        if name != "sharding":
            assert docs.columns == columns
            # rows go as they came; only the mix repeats some
            assert (docs.subtract(before) if name == "mixing" else docs.exceptAll(before)).isEmpty()
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "mixing", "sharding"]
    assert sizes[0] >= sizes[1] > sizes[2] > sizes[3] > 0
    copies = range(COPIED, COPIED + 40)
    assert sum(i in copies for i in ids["near_duplicates"] if i) == min(1, sum(i in copies for i in ids["quality"] if i))
    leaks = set(range(LEAKED, LEAKED + 3))
    assert leaks & set(ids["near_duplicates"])
    assert not leaks & set(ids["decontamination"])
    assert set(ids["mixing"]) <= set(ids["decontamination"])
    assert max(map(ids["mixing"].count, set(ids["mixing"]))) <= 3 * max(map(ids["decontamination"].count, set(ids["decontamination"])))
    # the last stage deals every row out, shards by counts
    new = [c for c in docs.columns if c not in columns]
    shard, slot = (next(c for c in new if c.startswith(w)) for w in ("shard", "slot"))
    found = docs.groupBy(shard).agg(F.count(F.lit(1)).alias("n"), F.max(slot).alias("top"), F.countDistinct(slot).alias("slots")).collect()
    assert sorted(ids["mixing"], key=str) == sorted(ids["sharding"], key=str)
    assert all(r["n"] == r["slots"] == r["top"] + 1 for r in found)
    assert max(r["n"] for r in found) - min(r["n"] for r in found) <= 1


def test_empty_tables(spark, sf_dir, folder):
    for name in ("documents", "labels", "benchmark"):
        table(spark, sf_dir, name).limit(0).write.parquet(f"{folder}/{name}.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0
