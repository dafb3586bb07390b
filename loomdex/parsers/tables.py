"""The parsers as table functions: by Arrow batches for DataFrames, as a UDTF for SQL."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomdex.functions.text import method_key
from loomdex.parsers.symbols import parse

EVENT = "kind int, tag string, lineno int, image string"


def _run(batches: Iterator[pa.RecordBatch], notfunctions: frozenset[str] = frozenset()) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, rows = [], []
        for i, (lang, text, flags) in enumerate(zip(*(b.column(k).to_pylist() for k in (1, 2, 3)), strict=True)):
            events = parse(lang, text or "", flags, notfunctions)
            ids += [i] * len(events)
            rows += events
        cols = list(zip(*rows, strict=True)) or [[], [], [], []]
        kinds = [pa.int32(), pa.string(), pa.int32(), pa.string()]
        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(ids, pa.int32())), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=["path", "kind", "tag", "lineno", "image"])


def parse_files(df: DataFrame, notfunctions: frozenset[str] = frozenset()) -> DataFrame:
    """(path, kind, tag, lineno, image) of every symbol in rows of (path, lang, content) and, if there, flags; a file
    stays in one task. Null texts and languages without a parser give no rows; null flags are none."""
    flags = F.col("flags") if "flags" in df.columns else F.lit(0).alias("flags")
    return df.select("path", "lang", "content", flags).mapInArrow(partial(_run, notfunctions=notfunctions), f"path string, {EVENT}")


def definitions_of(events: DataFrame) -> DataFrame:
    """The bag of definitions among the events."""
    return events.filter(F.col("kind") == 1).select("tag", "path", "lineno", "image")


def references_of(events: DataFrame) -> DataFrame:
    """The set of references, those dropped that stand where a definition of the tag stands."""
    refs = events.filter(F.col("kind") == 2).select("tag", "path", "lineno").distinct()
    return refs.join(definitions_of(events).select("tag", "path", "lineno"), ["tag", "path", "lineno"], "left_anti")


def symbols_of(events: DataFrame, defs: DataFrame, target: str) -> DataFrame:
    """What a parse of files is asked for: its ``definitions``, or of its references those whose key ``defs`` (key) has, the
    ``references``, or has not, the ``symbols``."""
    if target == "definitions":
        return definitions_of(events)
    refs = events.filter(F.col("kind") == 2).select(method_key(F.col("tag")).alias("key"), "tag", "path", "lineno", "image")
    return refs.join(defs.select("key").distinct(), "key", {"references": "left_semi", "symbols": "left_anti"}[target]).select("tag", "path", "lineno", "image")


class ParseSymbols:
    """SQL: ``SELECT * FROM files, LATERAL parse_symbols(lang, content)``, with the flags as a third argument."""

    def eval(self, lang: str, content: str, flags: int = 0):
        yield from parse(lang, content or "", flags)


def register_udtf(spark: SparkSession, name: str = "parse_symbols") -> None:
    spark.udtf.register(name, F.udtf(ParseSymbols, returnType=StructType.fromDDL(EVENT)))
