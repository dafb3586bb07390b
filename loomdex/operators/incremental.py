"""Incremental maintenance: what changed, new ids, and the new state of the path table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdex.common import numbered


def change_set(known: DataFrame, listing: DataFrame, as_of: str) -> DataFrame:
    """(path, action): add for listed paths that aren't known, modify for known ones changed after ``as_of``, delete
    for known ones not listed; unchanged paths are left out. known (path, kind), listing (path, mtime, kind); files
    that are no source are added and deleted but never modified."""
    k = known.select("path", F.lit(True).alias("old")).distinct()
    n = listing.groupBy("path").agg(F.max("mtime").alias("mtime"), F.max("kind").alias("kind"))
    both = k.join(n, "path", "full")
    changed = (F.col("mtime") > F.lit(as_of).cast("timestamp_ntz")) & (F.coalesce("kind", F.lit("source")) == "source")
    action = F.when(F.col("old").isNull(), "add").when(F.col("mtime").isNull(), "delete").when(changed, "modify")
    return both.select("path", action.alias("action")).filter("action IS NOT NULL")


def allocate(new: DataFrame, last: int | None) -> DataFrame:
    """(path, fid): ids after the last one ever given, in the order of paths, which are numbered by ranges."""
    return numbered(new.select("path"), "path").select("path", (F.col("number") + 1 + (last or 0)).alias("fid"))


def apply_changes(known: DataFrame, changes: DataFrame, last: int | None) -> DataFrame:
    """The new path table (path, fid): deleted paths are gone, modified ones keep their id, added ones get a new one."""
    gone = changes.filter("action = 'delete'").select("path")
    added = allocate(changes.filter("action = 'add'").select("path"), last)
    return known.select("path", "fid").join(gone, "path", "left_anti").unionByName(added)


def replace_rows(rel: DataFrame, fresh: DataFrame, touched: DataFrame) -> DataFrame:
    """A relation after an update: rows of the touched fids are dropped and the fresh ones added."""
    return rel.join(touched.select("fid").distinct(), "fid", "left_anti").unionByName(fresh)


def upsert(rel: DataFrame, fresh: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of the rows with one key the one with the greatest ``order``; of a tie the fresh one."""
    both = rel.withColumn("_new", F.lit(0)).unionByName(fresh.withColumn("_new", F.lit(1)))
    top = F.max_by(F.struct(*[c for c in rel.columns if c not in keys]), F.struct(order, "_new"))
    return both.groupBy(*keys).agg(top.alias("_row")).select(*keys, "_row.*").select(*rel.columns)
