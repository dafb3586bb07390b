"""A few keys holding most records: exact per-key results by value-frequency compression."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from loomdex.common import written
from loomdex.functions.paths import is_tag, normal_path

#: Bits of a value that one step of a rank search decides: a step orders at most 2 ** STEP ranges of a key.
STEP = 11


def records(gtp: DataFrame, *cols: str) -> DataFrame:
    """gtp_id and ``cols`` of each record once; a repeated id is the same record delivered again."""
    return gtp.select("gtp_id", *cols).distinct()


def compress(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, w): one row per distinct pair with its number of rows; null keys are dropped, null values kept.

    The first grouping key is the pair, so the rows of a key that holds most of the table are combined on the map
    side and spread over all tasks by value; no later step sees more than the distinct pairs."""
    return df.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("key"), F.col(value).alias("value")).agg(F.count("*").alias("w"))


def key_stats(pairs: DataFrame) -> DataFrame:
    """key, n (rows), n_values (distinct, without null), mode (the most frequent value, smallest of ties; null if none).

    All by partial aggregation over weighted values."""
    best = F.when(F.col("value").isNotNull(), F.struct((-F.col("w")).alias("w"), F.col("value")))
    return pairs.groupBy("key").agg(F.sum("w").alias("n"), F.count("value").alias("n_values"), F.min(best)["value"].alias("mode"))


def key_percentiles(pairs: DataFrame, ps: tuple[float, ...]) -> DataFrame:
    """key and p50, p90, ...: for each p the smallest value at or below which at least the share p of the key's
    non-null values lies. Values are integers. Keys whose values are all null don't come out.

    The rank is sought among the values' leading bits, then among the next STEP bits below those found, and so on to the
    values themselves, so no task orders more than 2 ** STEP ranges or values of a key, however many it has."""
    rows = pairs.filter(F.col("value").isNotNull())
    bits = 64 if isinstance(rows.schema["value"].dataType, LongType) else 32
    levels = [rows.select("key", F.col("value").alias("at"), "w")]
    for _ in range(STEP, bits - 1, STEP):
        levels.append(levels[-1].groupBy("key", F.shiftright("at", STEP).alias("at")).agg(F.sum("w").alias("w")))
    here = levels.pop().withColumn("n", F.sum("w").over(Window.partitionBy("key")))
    here = here.withColumn("asks", F.array(*[F.struct(F.lit(p).alias("p"), F.ceil(F.col("n") * p).cast("long").alias("rank")) for p in ps]))
    group = ["key"]
    while True:
        upto = F.sum("w").over(Window.partitionBy(*group).orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
        inside = F.filter("asks", lambda a: (a["rank"] <= F.col("upto")) & (a["rank"] > F.col("upto") - F.col("w")))
        asks = F.transform(inside, lambda a: F.struct(a["p"].alias("p"), (a["rank"] - F.col("upto") + F.col("w")).alias("rank")))
        here = here.withColumn("upto", upto).select("key", "at", asks.alias("asks")).filter(F.size("asks") > 0)
        if not levels:
            here = here.select("key", "at", F.explode("asks.p").alias("p"))
            return here.groupBy("key").agg(*[F.min(F.when(F.col("p") == p, F.col("at"))).alias(f"p{round(100 * p)}") for p in ps])
        group = ["key", "above"]  # as the join deals its rows
        here = levels.pop().withColumn("above", F.shiftright("at", STEP)).join(here.withColumnRenamed("at", "above"), group)


def hot_keys(gtp: DataFrame, share: float = 0.01) -> DataFrame:
    """key_field, key_value, n: tags and line numbers that hold more than ``share`` of all records.

    Records count once per gtp_id, those with nulls are in the total; values that are no tags are no keys. One
    compression by (tag, lineno) serves both keys. An empty table gives no rows."""
    pairs = records(gtp, "tag", "lineno").groupBy("tag", "lineno").agg(F.count("*").alias("w"))
    both = F.array(
        F.struct(F.lit("tag").alias("key_field"), F.when(is_tag(F.col("tag")), F.col("tag")).alias("key_value")),
        F.struct(F.lit("lineno").alias("key_field"), F.col("lineno").cast("string").alias("key_value")),
        F.struct(F.lit("all").alias("key_field"), F.lit("").alias("key_value")),
    )
    n = pairs.select("w", F.inline(both)).filter(F.col("key_value").isNotNull()).groupBy("key_field", "key_value").agg(F.sum("w").alias("n"))
    total = n.filter("key_field = 'all'").select("n").scalar()
    return n.filter((F.col("key_field") != "all") & (F.col("n") > total * F.lit(share)))


def tag_profile(gtp: DataFrame) -> DataFrame:
    """Per tag: records, distinct paths, the path with most records, distinct lines, median and 90th percentile of the line."""
    tags = lambda col: records(gtp, "tag", col).filter(is_tag(F.col("tag")))
    paths = compress(tags("path").withColumn("path", normal_path(F.col("path"))), "tag", "path")
    by_path = key_stats(paths).select(F.col("key").alias("tag"), F.col("n").alias("n_records"), F.col("n_values").alias("n_paths"), F.col("mode").alias("top_path"))
    lines = written(compress(tags("lineno"), "tag", "lineno"), "lines")  # read three times below
    by_line = key_stats(lines).select(F.col("key").alias("tag"), F.col("n_values").alias("n_lines"), F.col("mode").alias("top_line"))
    ranks = key_percentiles(lines, (0.5, 0.9)).select(F.col("key").alias("tag"), F.col("p50").alias("line_p50"), F.col("p90").alias("line_p90"))
    return by_path.join(by_line, "tag").join(ranks, "tag", "left")


def line_profile(gtp: DataFrame) -> DataFrame:
    """Per line number: records, distinct tags and the tag with most records."""
    rows = records(gtp, "lineno", "tag").withColumn("tag", F.when(is_tag(F.col("tag")), F.col("tag")))
    return key_stats(compress(rows, "lineno", "tag")).select(F.col("key").alias("lineno"), F.col("n").alias("n_records"), F.col("n_values").alias("n_tags"), F.col("mode").alias("top_tag"))
