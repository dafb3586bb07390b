"""Output formats of result rows (tag, path, lineno, image, fid)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def formatted(kind: str) -> Column:
    """One line of output: path, ctags, ctags-x, ctags-xid, ctags-mod, grep or cscope."""
    c, line = F.col, F.col("lineno").cast("string")
    x = F.format_string("%-16s %4d %-16s %s", c("tag"), c("lineno"), c("path"), F.coalesce("image", F.lit("")))
    image = F.coalesce("image", F.lit(""))
    left = F.regexp_replace(image, r"^[ \t]+", "")
    return {
        "path": c("path"),
        "ctags": F.concat_ws("\t", "tag", "path", line),
        "ctags-x": x,
        "ctags-xid": F.concat(F.col("fid").cast("string"), F.lit(" "), x) if kind == "ctags-xid" else None,
        "ctags-mod": F.concat_ws("\t", c("path"), line, image),
        "grep": F.concat_ws(":", c("path"), line, image),
        "cscope": F.concat_ws(" ", c("path"), c("tag"), line, F.when(left == "", "<unknown>").otherwise(left)),
    }[kind]


def render(df: DataFrame, kind: str) -> DataFrame:
    return df.select(formatted(kind).alias("line"))


def parse_x(line: Column) -> Column:
    """The fields of a ctags-x line: tag, lineno, path, image."""
    part = lambda i: F.regexp_extract(line, r"^(\S+)\s+(\d+)\s(\S+)\s*(.*)$", i)
    return F.struct(part(1).alias("tag"), F.try_to_number(part(2), F.lit("9999999999")).cast("long").alias("lineno"), part(3).alias("path"), part(4).alias("image"))
