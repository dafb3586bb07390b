"""Symbol lookup over the relations of the index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomdex.common import numbered
from loomdex.functions.text import let
from loomdex.operators.patterns import access


def search(rel: DataFrame, pattern: str | None, literal: bool = False, icase: bool = False, scope: str | None = None) -> DataFrame:
    """Rows whose key fits the pattern, and whose path lies under the scope."""
    out = rel.filter(access(pattern, literal, icase).on(F.col("key")))
    return out.filter(F.col("path").startswith(scope)) if scope else out


def resolved(refs: DataFrame, defs: DataFrame) -> DataFrame:
    """References whose key is defined."""
    return refs.join(defs.select("key").distinct(), "key", "left_semi")


def unresolved(refs: DataFrame, defs: DataFrame) -> DataFrame:
    """Other symbols: those whose key isn't defined."""
    return refs.join(defs.select("key").distinct(), "key", "left_anti")


def everything(defs: DataFrame, refs: DataFrame, pattern: str | None, **kw: object) -> DataFrame:
    """Definitions, references and other symbols that fit the pattern."""
    cols = ["key", "tag", "path", "lineno"]
    return search(defs, pattern, **kw).select(*cols).unionByName(search(refs, pattern, **kw).select(*cols))


def complete(rel: DataFrame, prefix: str, icase: bool = False, libraries: list[str] | None = None, through: bool = False) -> DataFrame:
    """Distinct keys that begin with the prefix; with ``libraries`` those of the first project that has any (or of all)."""
    key = F.lower("key") if icase else F.col("key")
    hits = rel.filter(key.startswith(prefix.lower() if icase else prefix))
    return (_first(hits, libraries, through) if libraries else hits).select("key").distinct()


def _first(hits: DataFrame, libraries: list[str], through: bool) -> DataFrame:
    hits = hits.filter(F.col("repo").isin(libraries)).withColumn("lib_rank", F.array_position(F.lit(libraries), F.col("repo")))
    return hits if through else hits.filter(F.col("lib_rank") == hits.agg(F.min("lib_rank")).scalar())


def first_library(rel: DataFrame, libraries: list[str], pattern: str | None, through: bool = False) -> DataFrame:
    """Hits in the projects (column repo), the own one first and then the libraries in their order: all hits of the first
    project that has any, or with ``through`` of all. The whole search ends at that project, whatever keys it has."""
    return _first(search(rel, pattern), libraries, through)


def resolve_context(contexts: DataFrame, defs: DataFrame, libraries: DataFrame | None = None) -> DataFrame:
    """What each context (key, path, lineno) asks for: references if it is a definition of its key, definitions if
    the key is defined elsewhere or in one of the libraries (their definitions), else other symbols."""
    at = defs.select("key", "path", F.col("lineno")).distinct().withColumn("here", F.lit(True))
    keys = defs.select("key") if libraries is None else defs.select("key").unionByName(libraries.select("key"))
    known = keys.distinct().withColumn("known", F.lit(True))
    out = contexts.join(at, ["key", "path", "lineno"], "left").join(known, "key", "left")
    return out.select("key", "path", "lineno", F.when(F.col("here"), "references").when(F.col("known"), "definitions").otherwise("symbols").alias("target"))


def nearness(path: Column, base: str) -> Column:
    """How many leading components a path shares with the base, one more if it is the same file."""
    b = F.lit(base.split("/"))

    def same(p: Column) -> Column:
        return F.size(F.filter(F.sequence(F.lit(0), F.least(F.size(p), F.size(b)) - 1), lambda i: (i > 0) & (F.slice(p, F.lit(1), i) == F.slice(b, F.lit(1), i))))

    return (let(F.split(path, "/"), same) + F.when((path == base) & ~path.endswith("/"), 1).otherwise(0)).cast("long")


def near(rel: DataFrame, base: str) -> DataFrame:
    """The rows with their score and rank by score, path and line, in that order."""
    scored = rel.withColumn("score", nearness(F.col("path"), base))
    return scored.orderBy(F.desc("score"), "path", "lineno")


def file_tags(defs: DataFrame, path: str) -> DataFrame:
    """The definitions of one file."""
    return defs.filter(F.col("path") == path).select("tag", "lineno", "image")


def number_groups(rel: DataFrame) -> DataFrame:
    """Each distinct tag with its number in sorted order, from 1."""
    return numbered(rel.select("tag").distinct(), "tag").select("tag", (F.col("number") + 1).alias("number"))
