"""Session settings the operators rely on."""

from pyspark.sql import SparkSession

# Runtime SQL settings; safe to apply to a session somebody else created.
SETTINGS = {
    # all timestamps in the model are naive UTC
    "spark.sql.session.timeZone": "UTC",
    # a repeated key in model output keeps its last value instead of failing the parse
    "spark.sql.variant.allowDuplicateKeys": "true",
    # re-plan joins and split skewed partitions at run time
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply ``SETTINGS`` to an existing session and return it."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def build_session(master: str | None = None, app_name: str = "quire", **conf) -> SparkSession:
    """Create (or reuse) a session; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    builder = builder.config("spark.ui.enabled", "false")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return configure(builder.getOrCreate())
