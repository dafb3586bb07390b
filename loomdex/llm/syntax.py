"""Source files that do not parse: each text against the grammars of its language."""

from __future__ import annotations

import math
from collections import OrderedDict
from collections.abc import Iterator
from functools import cache
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdex.functions.paths import normal_path
from loomdex.llm.gll import END, Grammar
from loomdex.llm.grammars import GRAMMARS
from loomdex.llm.lexers import LEXERS
from loomdex.sources.languages import language_in

#: Records in one task; with the usual sources they take some seconds.
TASK_ROWS = 800
#: Texts whose verdict a worker remembers.
REMEMBERED = 4096


@cache
def grammar(lang: str) -> tuple[Grammar, tuple[str, ...]]:
    text, item, groups, pair, dialects = GRAMMARS[lang]
    return Grammar(text, groups, pair, dialects, lang in ("cpp", "java")), (item,)


def well_formed(lang: str, text: str) -> bool:
    """Whether some dialect of the language accepts the whole text; of conditional sections each branch has to stand in a reading that is
    accepted. Line ends of any kind count alike; a byte order mark is skipped. Unknown languages have no grammar, so
    nothing is wrong with their texts."""
    if lang not in GRAMMARS:
        return True
    g, items = grammar(lang)
    return LEXERS[lang](text.removeprefix("﻿").replace("\r\n", "\n").replace("\r", "\n"), g, lambda tokens: g.accepts(items, [*tokens, END]) > 0)


def _check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: OrderedDict[tuple[str, bytes], bool] = OrderedDict()

    def good(lang: str, text: str) -> bool:
        key = lang, blake2b(text.encode(), digest_size=20).digest()
        if key not in known:
            if len(known) >= REMEMBERED:
                known.popitem(last=False)
            known[key] = well_formed(lang, text)
        return known[key]

    for b in batches:
        bad = [not good(lang, text) for lang, text in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), pa.array(bad)], names=["param_id", "lang", "file", "bad"])


def checked(params: DataFrame, languages: DataFrame) -> DataFrame:
    """(param_id, lang, file, bad) for each record with a text and a language of ``languages``.

    Null and empty texts and files without a language are left out. A repeated record comes out as often; its copies are
    parsed in one task, which knows its texts again. Records are dealt by param_id to tasks of about TASK_ROWS, so no
    repository or language makes a task larger. Texts are parsed whole."""
    names = F.broadcast(languages.select(F.col("lang_name").alias("lang")).distinct())  # the languages a map may name
    rows = params.filter(F.length("content") > 0).select("param_id", language_in(F.col("file"), F.col("langmap")).alias("lang"), "content", "file").join(names, "lang", "left_semi")
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, math.ceil(params.count() / TASK_ROWS))
    kind = rows.schema["param_id"].dataType.simpleString()
    return rows.select("param_id", "lang", "content", "file").repartition(tasks, "param_id").mapInArrow(_check, f"param_id {kind}, lang string, file string, bad boolean")


def malformed(params: DataFrame, languages: DataFrame) -> DataFrame:
    """(param_id) of each record whose text no dialect of its language accepts, once."""
    return checked(params, languages).filter("bad").select("param_id").distinct()


def malformed_rates(params: DataFrame, languages: DataFrame, files: DataFrame) -> DataFrame:
    """repo, lang, records, malformed and rate, by the repository of the file's path (null where the path is unknown).

    A path's repository is the least of its lives; a record counts once."""
    one = checked(params, languages).groupBy("param_id", "lang", normal_path(F.col("file")).alias("path")).agg(F.max("bad").alias("bad"))
    repos = files.groupBy(normal_path(F.col("path")).alias("path")).agg(F.min("repo").alias("repo"))
    out = one.join(repos, "path", "left").groupBy("repo", "lang").agg(F.count("*").alias("records"), F.count_if("bad").alias("malformed"))
    return out.withColumn("rate", F.col("malformed") / F.col("records"))
