"""Where files come from: a directory, a distributed listing, a list of names; and configuration."""

from __future__ import annotations

import os
import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdex.functions.paths import normal_path
from loomdex.sources.languages import DEFAULT, language_of, skipped, source_pattern

LISTING = "path string, size long, mtime timestamp, unreadable boolean"


def walk(spark: SparkSession, root: str, links: str = "follow", strict: bool = False) -> DataFrame:
    """(path, size, mtime, unreadable) of every file below a local directory, paths as ``./...``.

    links: ``follow``, ``skip-files``, ``skip-dirs`` or ``skip``. A directory that links to one of its own parents is not
    entered again. Unreadable files are listed as such, or with ``strict`` end the walk. For trees on shared storage use ``scan``."""
    rows, top = [], os.path.realpath(root)
    todo = [(top, (top,))]
    while todo:
        at, above = todo.pop()
        for e in os.scandir(at):
            linked = e.is_symlink()
            if linked and not os.path.exists(e.path):
                continue
            if e.is_dir():
                real = os.path.realpath(e.path)
                if not (linked and links in ("skip", "skip-dirs")) and real not in above:
                    todo.append((e.path, (*above, real)))
            elif e.is_file() and not (linked and links in ("skip", "skip-files")):
                closed = not os.access(e.path, os.R_OK)
                if closed and strict:
                    raise PermissionError(e.path)
                s = e.stat()
                rows.append(("./" + os.path.relpath(e.path, top), s.st_size, int(s.st_mtime), closed))
    return spark.createDataFrame(rows, "path string, size long, seconds long, unreadable boolean").select("path", "size", F.timestamp_seconds("seconds").alias("mtime"), "unreadable")


def scan(spark: SparkSession, root: str, content: bool = False) -> DataFrame:
    """The same for any storage Spark reads, by its own parallel listing; with ``content`` also the bytes of each file."""
    b = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rel = F.concat(F.lit("./"), F.regexp_extract(F.url_decode("path"), re.escape(root.rstrip("/").split(":", 1)[-1].lstrip("/")).replace("\\/", "/") + r"/(.*)$", 1))
    return b.select(rel.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), *(["content"] if content else []))


def from_names(spark: SparkSession, names: str, root: str) -> DataFrame:
    """(path) of a list of names, one a line: blank lines and comments (a dot and a blank first) are left out, names
    outside the root too; the rest in normal form, each once."""
    lines = spark.read.text(names).select(F.trim("value").alias("name")).filter("name <> '' AND NOT startswith(name, '. ')")
    return _below(lines, root)


def _below(lines: DataFrame, root: str) -> DataFrame:
    below = F.when(F.col("name").startswith("/"), F.when(F.col("name").startswith(root.rstrip("/") + "/"), F.substring("name", len(root.rstrip("/")) + 2, 1 << 30))).otherwise(F.col("name"))
    p = normal_path(below)
    return lines.select(p.alias("p")).filter(F.col("p").isNotNull() & ~F.col("p").startswith("../") & (F.col("p") != "..")).select(F.concat(F.lit("./"), "p").alias("path")).distinct()


def sources(spark: SparkSession, root: str, arguments: Iterable[str] = (), names: str | None = None, files: DataFrame | None = None, kinds: tuple[str, ...] = ("source",)) -> DataFrame:
    """(path) of what a command works on: the arguments and the list ``names`` if any is given, else the files of the path table of the
    given kinds; in normal form, each once."""
    arguments = list(arguments)
    if not arguments and names is None:
        none = spark.createDataFrame([], "path string")
        return none if files is None else files.filter(F.col("kind").isin(list(kinds))).select("path").distinct()
    given = _below(spark.createDataFrame([(x,) for x in arguments], "name string"), root)
    return (given if names is None else given.unionByName(from_names(spark, names, root))).distinct()


def explained(listing: DataFrame, langmap: str = DEFAULT, skip: Iterable[str] = ()) -> DataFrame:
    """Each listed path with kind (source or other), lang, and why it is left out, if it is."""
    lang = language_of(F.col("path"), langmap)
    reason = F.when(skipped(F.col("path"), list(skip)), "on the skip list").when(~F.col("path").rlike(source_pattern(langmap)), "no language for the suffix")
    return listing.withColumns({"lang": lang, "kind": F.when(lang.isNull(), "other").otherwise("source"), "reason": reason})


def is_binary(content: Column) -> Column:
    """Whether the first 512 bytes are an archive's, a PDF's or hold a control byte. For a text or a binary column."""
    head = F.decode(F.substring(content.cast("binary"), 1, 512), "ISO-8859-1")
    return head.startswith("!<arch>") | head.startswith("%PDF") | head.rlike(r"[\x00-\x08\x0E-\x1A\x1C-\x1F]")


def read_config(text: str, label: str = "default", env: dict[str, str] | None = None) -> dict[str, list[str] | str | int | bool]:
    """The settings of one label of a configuration in colon-separated fields: ``name=text``, ``name#number``, ``name``.

    Lines are continued by a backslash; ``tc=other`` includes another label, whose settings do not replace those already
    seen; ``$name`` stands for a variable; ``skip``, ``langmap`` and ``parser`` add up to lists in their order."""
    many, env = ("skip", "langmap", "parser"), env or {}
    records = {}
    for line in re.sub(r"\\\n\s*", "", text).split("\n"):
        if line.strip() and not line.startswith("#"):
            names, *fields = re.split(r"(?<!\\):", line.strip())
            for n in names.split("|"):
                records[n] = [f.replace("\\:", ":") for f in fields if f]
    out: dict = {}

    def take(name: str, seen: tuple[str, ...]) -> None:
        if name not in records:
            raise KeyError(name)
        if name in seen:
            raise ValueError(f"{name} includes itself")
        for f in records[name]:
            k, mark, v = re.match(r"([^=#]+)(?:([=#])(.*))?$", f, re.S).groups()
            if k == "tc":
                take(v, (*seen, name))
                continue
            v = re.sub(r"\$(\w+)", lambda m: env.get(m[1], ""), v) if v is not None else None
            value = True if mark is None else int(v) if mark == "#" else v
            if k in many:
                out.setdefault(k, []).append(value)
            else:
                out.setdefault(k, value)

    take(label, ())
    return out
