"""The relations of the index as DataFrames: files, definitions, references, lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdex.common import table
from loomdex.functions.paths import is_tag, normal_path
from loomdex.functions.text import method_key


def files(spark: SparkSession, d: str) -> DataFrame:
    """fid, path, kind, lang, repo, mtime, size: each life of a path once."""
    return table(spark, d, "files").select("fid", "path", "kind", "lang", "repo", "mtime", "size").distinct()


def definitions(spark: SparkSession, d: str) -> DataFrame:
    """key, tag, fid, path, repo, lineno, image: the bag of definitions with their files' paths (a join on fid; Spark
    broadcasts the files only where their measured size is below its limit)."""
    f = table(spark, d, "files").select("fid", "path", "repo").distinct()
    return table(spark, d, "defs").select("key", "tag", "fid", "lineno", "image").join(f, "fid").select("key", "tag", "fid", "path", "repo", "lineno", "image")


def references(spark: SparkSession, d: str) -> DataFrame:
    """key, tag, path, lineno: the set of references and other symbols; paths as ``./`` and the normal form."""
    g = table(spark, d, "gtp").filter(F.col("db").isin(2, 3) & is_tag(F.col("tag")) & F.col("path").isNotNull() & F.col("lineno").isNotNull())
    return g.select(method_key(F.col("tag")).alias("key"), "tag", F.concat(F.lit("./"), normal_path(F.col("path"))).alias("path"), "lineno").distinct()


def split_lines(content: Column) -> Column:
    """The lines of a text: one carriage return before a line end goes with it, a last line without a line end keeps its
    own, and a final line end begins no new line."""
    return F.split(F.regexp_replace(F.replace(content, F.lit("\r\n"), F.lit("\n")), "\n\\z", ""), "\n", -1)


def lines(spark: SparkSession, d: str) -> DataFrame:
    """param_id, path, lineno (from 1), image of every line of the texts handed to the parser; each record once. Repeated
    records go last, line by line, so that filters on lines come first."""
    p = table(spark, d, "parser_param").filter((F.length("content") > 0) & F.col("file").isNotNull())
    rows = p.select("param_id", F.concat(F.lit("./"), normal_path(F.col("file"))).alias("path"), F.posexplode(split_lines(F.col("content"))).alias("pos", "image"))
    return rows.select("param_id", "path", (F.col("pos") + 1).cast("long").alias("lineno"), "image").distinct()
