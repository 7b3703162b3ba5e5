"""Prompt selection, rendering, and applying a model in batches."""

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.fixed_values import CLASSIFY_PROMPT, FALLBACK_PROMPT, PROMPTS, TEXT_PLACEHOLDER
from quire.functions.sizing import hinted, is_small


def prompt_registry(spark: SparkSession) -> DataFrame:
    """The built-in prompts as a table."""
    names = ["key", "version", "system", "template"]
    slots = [[f":{name}{i}" for name in names] for i in range(len(PROMPTS))]
    values = {f"{name}{i}": text for i, row in enumerate(PROMPTS) for name, text in zip(names, row)}
    rows = ", ".join(f"({', '.join(slot)})" for slot in slots)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS prompts({', '.join(names)})", args=values)


def latest_by_prefix(prompts: DataFrame) -> DataFrame:
    """For every prefix of every key, the last key in text order that starts with it.

    Turns the prefix lookup into an equality join on a table of keys x key length rows.
    """
    lengths = F.sequence(F.lit(1), F.length("key"))
    prefixes = prompts.select("key", F.explode(lengths).alias("n")).select(
        F.expr("substring(key, 1, n)").alias("prefix"), "key"
    )
    return prefixes.groupBy("prefix").agg(F.max("key").alias("latest_key"))


def _select(df: DataFrame, prompts: DataFrame, version_col: str, small: bool) -> DataFrame:
    keys = prompts.select("key")
    exact = keys.select(F.col("key").alias("_exact"))
    latest = latest_by_prefix(keys).withColumnsRenamed({"prefix": "_prefix", "latest_key": "_latest"})
    wanted = F.when(
        F.coalesce(version_col, F.lit("")) != "", F.concat_ws("_", F.col("document_type"), F.col(version_col))
    )
    return (
        df.withColumn("_wanted", wanted)
        .join(hinted(exact, small), F.col("_wanted") == F.col("_exact"), "left")
        .join(hinted(latest, small), F.col("document_type") == F.col("_prefix"), "left")
        .withColumn("prompt_key", F.coalesce("_exact", "_latest", F.lit(FALLBACK_PROMPT)))
        .drop("_wanted", "_exact", "_prefix", "_latest")
    )


def _look_up(df: DataFrame, prompts: DataFrame, columns: dict[str, str], small: bool) -> DataFrame:
    """Add the named prompt columns of ``prompt_key`` under new names."""
    side = prompts.select(F.col("key").alias("_key"), *[F.col(c).alias(n) for c, n in columns.items()])
    return df.join(hinted(side, small), F.col("prompt_key") == F.col("_key"), "left").drop("_key")


def select_prompt(df: DataFrame, prompts: DataFrame, version_col: str = "prompt_version") -> DataFrame:
    """Add ``prompt_key`` and its logged ``version_used``.

    The key is ``{type}_{version}`` if it exists, else the type's last key, else the fallback. The two
    lookup tables hold at most one row per key and per key character, so one size check covers both.
    """
    small = is_small(prompts)
    return _look_up(_select(df, prompts, version_col, small), prompts, {"version": "version_used"}, small)


def render_prompts(
    df: DataFrame, prompts: DataFrame, text_col: str = "raw_text", version_col: str = "prompt_version"
) -> DataFrame:
    """Select a prompt and add ``system``, ``prompt`` (whole text filled in) and ``version_used``."""
    small = is_small(prompts)
    columns = {"system": "system", "template": "_template", "version": "version_used"}
    chosen = _look_up(_select(df, prompts, version_col, small), prompts, columns, small)
    filled = F.replace(F.col("_template"), F.lit(TEXT_PLACEHOLDER), F.coalesce(text_col, F.lit("")))
    return chosen.withColumn("prompt", filled).drop("_template")


def render_classification(
    df: DataFrame, prompts: DataFrame, text_col: str = "raw_text", chars: int | None = None
) -> DataFrame:
    """Add ``system`` and ``prompt`` that ask for the type.

    The question shows the whole text, or its first ``chars`` characters (CLASSIFY_CHARS is the usual bound
    of a model request).
    """
    row = prompts.where(F.col("key") == CLASSIFY_PROMPT).first()  # one prompt for all rows: no join needed
    if row is None:
        raise ValueError(f"no prompt {CLASSIFY_PROMPT}")
    text = F.coalesce(text_col, F.lit(""))
    shown = text if chars is None else F.substring(text, 1, chars)
    prompt = F.replace(F.lit(row["template"]), F.lit(TEXT_PLACEHOLDER), shown)
    return df.withColumns({"prompt_key": F.lit(CLASSIFY_PROMPT), "system": F.lit(row["system"]), "prompt": prompt})


def apply_model(
    df: DataFrame, fn: Callable[[pd.DataFrame], list], id_col: str = "doc_id", out: str = "raw"
) -> DataFrame:
    """Call ``fn`` once per Arrow batch of (id, system, prompt); it returns one answer per row.

    If a batch fails its rows are tried one by one, so a failing request gives null only for itself, and ``error`` says
    what was raised: the class and its message.
    """
    id_field = df.schema[id_col]
    schema = T.StructType([id_field, T.StructField(out, T.StringType()), T.StructField("error", T.StringType())])

    def one(row: pd.DataFrame) -> tuple[str | None, str | None]:
        try:
            (answer,) = fn(row)
            return answer, None
        except Exception as error:
            return None, f"{type(error).__name__}: {error}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            try:
                answers = list(fn(batch))
                if len(answers) != len(batch):
                    raise ValueError("one answer per request expected")
                both = [(answer, None) for answer in answers]
            except Exception:  # told apart row by row
                both = [one(batch.iloc[i : i + 1]) for i in range(len(batch))]
            columns = {name: pd.array([b[i] for b in both], dtype=object) for i, name in enumerate((out, "error"))}
            yield pd.DataFrame({id_col: batch[id_col].to_numpy(), **columns})

    return df.select(id_col, "system", "prompt").mapInPandas(run, schema)
