"""Path and tag functions as column expressions; nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Limit of the tag's length in UTF-8 bytes (fixed value of the data model).
TAG_BYTES = 512
BLANK = r"[ \t\n\x0B\f\r]"


def is_tag(tag: Column) -> Column:
    """True for a usable tag: not null, not empty, no white space, under 512 bytes. Never null."""
    return F.coalesce((F.octet_length(tag) > 0) & (F.octet_length(tag) < TAG_BYTES) & ~tag.rlike(BLANK), F.lit(False))


def _fold(path: Column) -> Column:
    rooted = path.startswith("/")

    def step(acc: Column, part: Column) -> Column:
        up = F.when(F.size(acc) == 0, F.when(rooted, acc).otherwise(F.array(F.lit("..")))).when(F.element_at(acc, -1) == "..", F.concat(acc, F.array(part))).otherwise(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        return F.when((part == "") | (part == "."), acc).when(part == "..", up).otherwise(F.concat(acc, F.array(part)))

    body = F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")
    return F.concat(F.when(rooted, F.lit("/")).otherwise(F.lit("")), body)


def normal_path(path: Column) -> Column:
    """Normal form: no empty or ``.`` parts, ``x/..`` resolved, leading ``../`` kept. Null stays null.

    Only paths that hold such a part are folded; for most, dropping a leading ``./`` is enough."""
    cut = F.when(path.startswith("./"), F.substring(path, 3, 1 << 30)).otherwise(path)
    return F.when(F.concat(F.lit("/"), cut, F.lit("/")).rlike(r"/\.{0,2}/"), _fold(path)).otherwise(cut)


def fid_number(text: Column) -> Column:
    """A file id given as text, in plain decimal: blanks around it and leading zeros dropped; null if it is no number."""
    digits = F.regexp_extract(text, r"^\s*0*([0-9]+)\s*$", 1)
    return F.when(digits != "", digits)
