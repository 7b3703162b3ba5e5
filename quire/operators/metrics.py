"""Counters, cumulative histograms, running totals and documents in flight."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.fixed_values import (
    CONFIDENCE_BOUNDS,
    DURATION_SECONDS_BOUNDS,
    FIELD_COUNT_BOUNDS,
    OCR_MILLISECONDS_BOUNDS,
)

SPAN_BUCKETS = 1440  # buckets of the grid that one task fills

# name -> (value, bounds, labels) of the histograms kept over the run log
HISTOGRAMS: dict[str, tuple[Column | str, list[float], list[str]]] = {
    "request_duration_seconds": ("processing_time_ms / 1000", DURATION_SECONDS_BOUNDS, ["document_type"]),
    "ocr_confidence": ("ocr_confidence", CONFIDENCE_BOUNDS, ["ocr_engine"]),
    "ocr_duration_ms": ("ocr_time_ms", OCR_MILLISECONDS_BOUNDS, ["ocr_engine"]),
    "extraction_confidence": ("extraction_confidence", CONFIDENCE_BOUNDS, ["document_type", "prompt_version"]),
    "fields_extracted": ("fields_extracted", FIELD_COUNT_BOUNDS, ["document_type"]),
}


def count_by(df: DataFrame, *labels: str) -> DataFrame:
    """Rows per combination of labels."""
    return df.groupBy(*labels).agg(F.count(F.lit(1)).alias("total"))


def bucket_counts(value: Column, bounds: list[float]) -> list[Column]:
    """Aggregates of a cumulative histogram: values up to each bound, then their number and sum; NaN as null."""
    value = F.when(~F.isnan(value), value)
    counts = [F.count_if(value <= F.lit(b)).alias(f"_le_{i}") for i, b in enumerate(bounds)]
    return [*counts, F.count(value).alias("_count"), F.coalesce(F.sum(value), F.lit(0.0)).alias("_sum")]


def bucket_rows(df: DataFrame, bounds: list[float], labels: list) -> DataFrame:
    """One row per bound (and ``+Inf``) from the columns of ``bucket_counts``."""
    pairs = [v for i, b in enumerate(bounds) for v in (F.lit(str(b)), F.col(f"_le_{i}"))]
    pairs += [F.lit("+Inf"), F.col("_count")]
    rows = F.stack(F.lit(len(bounds) + 1), *pairs).alias("le", "cumulative_count")
    return df.select(
        *labels, F.col("_count").alias("total_count"), F.col("_sum").alias("total_sum"), rows
    )


def histogram(df: DataFrame, value: str, bounds: list[float], labels: list[str]) -> DataFrame:
    """Cumulative histogram of an expression per label set: one row per bound, plus ``+Inf``.

    All bounds are counted in the same pass, and counts combine before the shuffle. Nulls are no values.
    """
    counted = df.groupBy(*labels).agg(*bucket_counts(F.expr(value).cast("double"), bounds))
    return bucket_rows(counted, bounds, labels)


def running_total(runs: DataFrame, time_col: str = "start_time") -> DataFrame:
    """Documents per day and in total up to the day. The running sum sees one row per day."""
    daily = runs.groupBy(F.to_date(time_col).alias("day")).agg(F.count(F.lit(1)).alias("documents"))
    up_to = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return daily.withColumn("total_documents", F.sum("documents").over(up_to))


def _net_changes(runs: DataFrame) -> DataFrame:
    """Net change per instant (microseconds): +1 at each start, -1 at each end.

    The instants are marked as never null, so that the three uses of this table need no null filters of
    their own and share one scan and one shuffle.
    """
    start = F.coalesce(F.unix_micros("start_time"), F.lit(0))
    length = F.floor(F.coalesce("processing_time_ms", F.lit(0.0)) * 1000.0)
    changes = F.array(
        F.struct(start.alias("at"), F.lit(1).alias("change")),
        F.struct((start + length).alias("at"), F.lit(-1).alias("change")),
    )
    return (
        runs.where(F.col("start_time").isNotNull())
        .select(F.explode(changes).alias("e"))
        .groupBy(F.col("e.at").alias("at"))
        .agg(F.sum("e.change").alias("net"))
        .withColumn("second", F.coalesce(F.expr("at div 1000000"), F.lit(0)))
        .withColumn("day", F.coalesce(F.expr("second div 86400"), F.lit(0)))
    )


def in_flight(runs: DataFrame) -> DataFrame:
    """Documents being processed after each instant at which the number changes.

    A running sum in three levels: instants within a second (at most a million), seconds within a day,
    and days. Only the one-row-per-day table is summed by a single task.
    """
    up_to = (Window.unboundedPreceding, 0)
    net = _net_changes(runs)
    days = net.groupBy("day").agg(F.sum("net").alias("day_net"))
    days = days.withColumn(
        "before_day", F.sum("day_net").over(Window.orderBy("day").rowsBetween(*up_to)) - F.col("day_net")
    ).select("day", "before_day")
    seconds = net.groupBy("day", "second").agg(F.sum("net").alias("second_net"))
    in_day = Window.partitionBy("day").orderBy("second").rowsBetween(*up_to)
    seconds = (
        seconds.withColumn("before_second", F.sum("second_net").over(in_day) - F.col("second_net"))
        .join(days, "day")
        .select("second", (F.col("before_second") + F.col("before_day")).alias("before"))
    )
    in_second = Window.partitionBy("second").orderBy("at").rowsBetween(*up_to)
    return net.join(seconds, "second").select(
        F.timestamp_micros("at").alias("at"),
        "net",
        (F.col("before") + F.sum("net").over(in_second)).alias("in_flight"),
    )


def peak_in_flight(runs: DataFrame, bucket: str = "1 minute") -> DataFrame:
    """Highest number in flight in every time bucket from the first change to the last, with those running at its start.

    A bucket without a change has the number that the bucket before it left. The grid of buckets is made in spans of
    1,440, each by its own task; what a span leaves to the next is carried over one row per span.
    """
    spark = runs.sparkSession
    begin, end = spark.range(1).select(F.window(F.timestamp_micros(F.lit(0)), bucket).alias("w")).select("w.start", "w.end").first()
    width = round((end - begin).total_seconds() * 1_000_000)
    grouped = in_flight(runs).groupBy(F.window("at", bucket).alias("w"))
    peaks = grouped.agg(
        F.max("in_flight").alias("highest"),
        F.min_by(F.col("in_flight") - F.col("net"), F.col("at")).alias("opening"),
        F.max_by("in_flight", "at").alias("left"),
    )
    number = F.expr(f"unix_micros(w.start) div {width}L")
    offset = F.expr(f"pmod(unix_micros(w.start), {width}L)")
    peaks = peaks.select(number.alias("number"), offset.alias("offset"), "highest", "opening", "left")
    peaks = peaks.withColumn("span", F.floor(F.col("number") / SPAN_BUCKETS))

    ends = peaks.agg(F.min("number").alias("low"), F.max("number").alias("high"), F.max("offset").alias("offset"))
    spans = ends.where("low IS NOT NULL").select(
        "low", "high", "offset", F.explode(F.sequence(F.floor(F.col("low") / SPAN_BUCKETS), F.floor(F.col("high") / SPAN_BUCKETS))).alias("span")
    )
    first = F.greatest("low", F.col("span") * SPAN_BUCKETS)
    last = F.least("high", (F.col("span") + 1) * SPAN_BUCKETS - 1)
    # what the spans before leave: of the last one with a change
    before = Window.orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    leaves = peaks.groupBy("span").agg(F.max_by("left", "number").alias("span_left"))
    spans = spans.join(leaves, "span", "left").withColumn("carried", F.last("span_left", ignorenulls=True).over(before))
    grid = spans.select("span", "carried", F.col("offset").alias("grid_offset"), F.explode(F.sequence(first, last)).alias("number"))
    filled = grid.join(peaks.drop("span", "offset"), "number", "left")
    in_span = Window.partitionBy("span").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    quiet = F.coalesce(F.last("left", ignorenulls=True).over(in_span), F.col("carried"))
    filled = filled.withColumn("opening", F.coalesce("opening", quiet))
    return filled.select(
        F.timestamp_micros(F.col("number") * width + F.col("grid_offset")).alias("bucket_start"),
        "opening",
        F.greatest("highest", "opening").alias("peak"),
    )
