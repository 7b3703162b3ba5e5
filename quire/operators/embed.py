"""Text embeddings by a versioned model, and the store that embeds what it is given.

A token's place in the vector is its MD5 modulo the size, so that other engines and later versions find the same place;
a place weighs more the fewer documents have it. All of it runs as native expressions and JVM transformers.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.fixed_values import SEARCH_K
from quire.operators.search import _stored, search_similar
from quire.operators.store import upsert_documents

SIZE = 256
TOKEN = r"[\p{L}\p{N}]+"
_HEX_DIGITS = 7  # of the digest; below 2**28


@dataclass(frozen=True)
class EmbeddingModel:
    """A version number and the weight of every place of the vector."""

    version: int
    weights: tuple[float, ...]

    def save(self, spark: SparkSession, path: str) -> None:
        """Beside an index, one folder a version; a version is written once."""
        rows = spark.createDataFrame(list(enumerate(self.weights)), "place int, weight double")
        rows.coalesce(1).write.parquet(f"{path}/models/version={self.version}")


def load_model(spark: SparkSession, path: str, version: int | None = None) -> EmbeddingModel:
    """The model of a store: the newest version, or the one asked for."""
    rows = spark.read.parquet(f"{path}/models")
    version = rows.agg(F.max("version")).first()[0] if version is None else version
    weights = rows.where(F.col("version") == version).orderBy("place").collect()
    if not weights:
        raise ValueError(f"no model of version {version} in {path}")
    return EmbeddingModel(int(version), tuple(r["weight"] for r in weights))


def _place_names(size: int) -> list[str]:
    """How the places are written: in hexadecimal where ``size`` is a power of 16, so that they are digits of the digest."""
    digits = _digits(size)
    return [f"{i:0{digits}x}" if digits else str(i) for i in range(size)]


def _digits(size: int) -> int:
    return next((d for d in range(1, _HEX_DIGITS + 1) if 16**d == size), 0)


def _places(text: Column, size: int) -> Column:
    """The place of each token, by name."""
    tokens = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))
    digits = _digits(size)
    if digits:
        return F.transform(tokens, lambda t: F.substring(F.md5(t), _HEX_DIGITS - digits + 1, digits))
    place = lambda t: F.conv(F.substring(F.md5(t), 1, _HEX_DIGITS), 16, 10).cast("int") % size
    return F.transform(tokens, lambda t: place(t).cast("string"))


def fit_model(docs: DataFrame, version: int = 1, size: int = SIZE, text_col: str = "text") -> EmbeddingModel:
    """Weights from the number of documents that have each place; one pass, partial sums before the shuffle."""
    places = docs.select(F.explode(F.array_distinct(_places(F.col(text_col), size))).alias("place"))
    held = {r["place"]: r["n"] for r in places.groupBy("place").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most size rows
    n = docs.count()
    rows = docs.sparkSession.createDataFrame([(i, n, held.get(name, 0)) for i, name in enumerate(_place_names(size))], "place int, n long, d long")
    weight = rows.select("place", (F.ln((F.col("n") + 1) / (F.col("d") + 1)) + 1).alias("weight")).orderBy("place").collect()
    return EmbeddingModel(version, tuple(r["weight"] for r in weight))


def _stages(model: EmbeddingModel) -> PipelineModel:
    counted = CountVectorizerModel.from_vocabulary(_place_names(len(model.weights)), inputCol="_places", outputCol="_counts")
    weighed = ElementwiseProduct(scalingVec=Vectors.dense(model.weights), inputCol="_counts", outputCol="_weighed")
    return PipelineModel([counted, weighed, Normalizer(inputCol="_weighed", outputCol="_unit")])


def embed_text(df: DataFrame, model: EmbeddingModel, text_col: str = "text", out: str = "embedding") -> DataFrame:
    """Add a unit-length vector of the whole text's weighted words, and the ``model_version``; all zeros without words."""
    placed = df.withColumn("_places", _places(F.col(text_col), len(model.weights)))
    done = _stages(model).transform(placed).withColumn(out, vector_to_array("_unit", "float32"))
    return done.drop("_places", "_counts", "_weighed", "_unit").withColumn("model_version", F.lit(model.version))


def store_texts(current: DataFrame, updates: DataFrame, model: EmbeddingModel) -> DataFrame:
    """Upsert documents (id, seq, text, metadata) given as texts: their embeddings are computed here.

    ``current`` has the columns of the result: id, seq, text, metadata, embedding, model_version. Only updates are
    embedded; rows of older model versions stay until ``refresh_embeddings``.
    """
    return upsert_documents(current, embed_text(updates.select("id", "seq", "text", "metadata"), model).select(current.columns))


def refresh_embeddings(docs: DataFrame, model: EmbeddingModel) -> DataFrame:
    """``docs`` with every row embedded by ``model``; rows that already are pass through as they are."""
    known = F.col("model_version") == model.version
    fresh = embed_text(docs.where(~F.coalesce(known, F.lit(False))).drop("embedding", "model_version"), model)
    return docs.where(known).unionByName(fresh.select(docs.columns))


def search_texts(
    docs: DataFrame, questions: DataFrame, model: EmbeddingModel, k: int = SEARCH_K, document_type: str | None = None
) -> DataFrame:
    """The k stored documents nearest to each question (query_id, text), as ``search_similar``.

    Rows of other model versions are embedded anew for the search, once, so that only vectors of one version meet.
    """
    known = F.coalesce(F.col("model_version") == model.version, F.lit(False))
    fresh = _stored(refresh_embeddings(docs.where(~known), model), "refreshed")
    current = docs.where(known).unionByName(fresh)
    asked = embed_text(questions.select("query_id", "text"), model).select("query_id", "embedding")
    return search_similar(current, asked, k, document_type)
