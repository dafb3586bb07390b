"""Visually identical text with different characters: one form for texts that look the same.

The form of a text is, for every character: canonical decomposition; wide and narrow variants replaced by the plain
character; look-alike letters of other scripts by the Latin letter they can't be told from; spaces other than the ordinary one
by a space; invisible characters dropped; then marks put in canonical order and composed. Case, accents, raised
digits, ordinary spaces, tabs and line ends are kept.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Letters of other scripts whose glyphs are those of a Latin letter, each pair "other Latin".
LOOKALIKES = """
А A  В B  Е E  Ѕ S  І I  Ј J  К K  М M  Н H  О O  Р P  С C  Т T  Х X  Ү Y  Ԍ G  Ԛ Q  Ԝ W
а a  с c  ԁ d  е e  һ h  і i  ј j  о o  р p  ԛ q  ѕ s  ԝ w  х x  у y  ӏ l
Α A  Β B  Ε E  Ζ Z  Η H  Ι I  Ϳ J  Κ K  Μ M  Ν N  Ο O  Ρ P  Τ T  Υ Y  Χ X  Ϲ C
ο o  ν v  ϲ c  ϳ j  օ o  Օ O  ս u  հ h  ց g  զ q  ѵ v  Ѵ V  ү y  ɡ g
Ꭰ D  Ꭱ R  Ꭲ T  Ꭵ i  Ꭺ A  Ꭻ J  Ꭼ E  Ꮃ W  Ꮇ M  Ꮋ H  Ꮍ Y  Ꮐ G  Ꮒ h  Ꮓ Z  Ꮟ b  Ꮢ R  Ꮥ S  Ꮩ V  Ꮪ S  Ꮮ L  Ꮯ C  Ꮲ P  Ꮶ K  Ᏼ B
ꓐ B  ꓑ P  ꓒ d  ꓓ D  ꓔ T  ꓖ G  ꓗ K  ꓙ J  ꓚ C  ꓜ Z  ꓝ F  ꓟ M  ꓠ N  ꓡ L  ꓢ S  ꓣ R  ꓦ V  ꓧ H  ꓪ W  ꓫ X  ꓬ Y  ꓮ A  ꓰ E  ꓲ I  ꓳ O  ꓴ U
Ⲃ B  Ⲏ H  Ⲓ I  Ⲕ K  Ⲙ M  Ⲛ N  Ⲟ O  ⲟ o  Ⲣ P  ⲣ p  Ⲥ C  ⲥ c  Ⲧ T  Ⲭ X
Ⅰ I  Ⅴ V  Ⅹ X  Ⅼ L  Ⅽ C  Ⅾ D  Ⅿ M  ⅰ i  ⅴ v  ⅹ x  ⅼ l  ⅽ c  ⅾ d  ⅿ m
‐ -  ‑ -
"""
# Invisible characters (first and last code point of each range). Direction overrides and variation
# selectors stay: they change what is seen. Joiners are dropped unless what stands beside them joins.
INVISIBLE = [(0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180E), (0xFFA0, 0xFFA0), (0x200B, 0x200B), (0x200E, 0x200F), (0x202A, 0x202C), (0x2060, 0x2064), (0x2066, 0x206F), (0xFE00, 0xFE0D), (0xFEFF, 0xFEFF), (0xE0000, 0xE007F)]
JOINERS = (0x200C, 0x200D)
# Blank characters that are no space by their class.
BLANK = (0x2800, 0x3164)
# Where a joiner between two characters is seen: cursive and Indic scripts, pictures.
JOINING = [(0x600, 0x8FF), (0x900, 0xDFF), (0xF00, 0x109F), (0x1780, 0x18AF)]
PICTURES = [(0x2190, 0x2BFF), (0xFE0F, 0xFE0F), (0x1F000, 0x1FAFF)]
#: Code points from here on have no decomposition, but for the last planes.
TOP = 0x110000


class Tables(NamedTuple):
    """LEN and START: by code point, number and place in POOL of what replaces it; CCC: combining class;
    PAIRS and PAIRED: sorted (first << 21 | second) and the composed character; SECOND: starters that end a pair."""

    LEN: np.ndarray
    START: np.ndarray
    POOL: np.ndarray
    CCC: np.ndarray
    PAIRS: np.ndarray
    PAIRED: np.ndarray
    SECOND: np.ndarray


@cache
def tables() -> Tables:
    """The lookup tables, built by rule from Python's character database; once per worker."""
    alike = dict(zip(map(ord, (x := LOOKALIKES.split())[::2]), map(ord, x[1::2]), strict=True))
    length, start, pool = np.ones(TOP, np.uint8), np.arange(TOP, dtype=np.int32), [np.arange(TOP, dtype=np.uint32)]
    ccc, second = np.zeros(TOP, np.uint8), np.zeros(TOP, bool)
    at, pairs = TOP, {}

    def replace(cp: int, to: list[int]) -> None:
        nonlocal at
        length[cp], start[cp] = len(to), at
        pool.append(np.array(to, np.uint32))
        at += len(to)

    for cp in (*range(0xA0, 0x30000), *range(0xE0000, 0xE0200)):
        ch = chr(cp)
        ccc[cp] = unicodedata.combining(ch)
        kind, _, rest = unicodedata.decomposition(ch).rpartition("> ")
        if kind in ("", "<wide", "<narrow") and rest and not 0xAC00 <= cp <= 0xD7A3:
            flat = unicodedata.normalize("NFD", "".join(chr(int(x, 16)) for x in rest.split()))
            replace(cp, [alike.get(ord(c), 0x20 if unicodedata.category(c) == "Zs" else ord(c)) for c in flat])
            if not kind and " " in rest:
                a, b = (int(x, 16) for x in rest.split())
                if unicodedata.normalize("NFC", chr(a) + chr(b)) == ch:
                    pairs[a << 21 | b] = cp
        elif cp in alike:
            replace(cp, [alike[cp]])
        elif unicodedata.category(ch) == "Zs" and cp != 0x1680 or cp in BLANK:
            replace(cp, [0x20])
    for lead in range(19):
        for vowel in range(21):
            lv = 0xAC00 + (lead * 21 + vowel) * 28
            pairs[(0x1100 + lead) << 21 | 0x1161 + vowel] = lv
            pairs |= {lv << 21 | 0x11A7 + tail: lv + tail for tail in range(1, 28)}
            for tail in range(28):
                replace(lv + tail, [0x1100 + lead, 0x1161 + vowel, *[0x11A7 + tail] * (tail > 0)])
    for a, b in INVISIBLE:
        length[a : b + 1] = 0
    # look-alikes replace bases inside pairs too: what was composed from one is composed from the Latin letter
    keys = np.array(sorted(pairs), np.int64)
    ends = keys & (1 << 21) - 1
    second[ends[ccc[ends] == 0]] = True
    return Tables(length, start, np.concatenate(pool), ccc, keys, np.array([pairs[k] for k in keys.tolist()], np.uint32), second)


def _pair(t: Tables, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether a and b compose, and to what."""
    key = a.astype(np.int64) << 21 | b.astype(np.int64)
    at = np.minimum(np.searchsorted(t.PAIRS, key), len(t.PAIRS) - 1)
    return t.PAIRS[at] == key, t.PAIRED[at]


def _within(cps: np.ndarray, ranges: list[tuple[int, int]]) -> np.ndarray:
    return np.logical_or.reduce([(cps >= a) & (cps <= b) for a, b in ranges])


def _cut(cps: np.ndarray, ends: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """cps where keep, with the rows' ends moved accordingly."""
    return cps[keep], np.r_[0, np.cumsum(keep)][ends]


def visual_forms(cps: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The forms of texts given as code points, row after row; ends: where each row ends. Same shape returned.

    Array operations over the whole batch only: a gather for the expansion lengths, running sums for the offsets,
    and one round for each mark on the most marked character."""
    t = tables()
    n = t.LEN[cps]
    at = np.flatnonzero((cps == JOINERS[0]) | (cps == JOINERS[1]))
    if len(at):
        first = np.r_[0, ends[:-1]]
        row = np.searchsorted(ends, at, "right")
        inner = (at > first[row]) & (at + 1 < ends[row])
        before, after = cps[np.maximum(at - 1, 0)], cps[np.minimum(at + 1, len(cps) - 1)]
        n[at] = inner & (_within(before, JOINING) | _within(before, PICTURES) & _within(after, PICTURES) & (cps[at] == JOINERS[1]))
    # expand: each output place takes the entry of its source character, so many places after the entry's start
    begin = np.r_[0, np.cumsum(n, dtype=np.int64)]
    if (n == 1).all():
        out = t.POOL[t.START[cps]]
    else:
        source = np.repeat(t.START[cps] - begin[:-1], n)
        out = t.POOL[source + np.arange(begin[-1])]
    ends = begin[ends]
    for _ in range(2):  # a syllable takes a vowel, then a tail
        b = np.flatnonzero(t.SECOND[out])
        b = b[b > 0]
        if not len(b):
            break
        b = b[b > np.r_[0, ends[:-1]][np.searchsorted(ends, b, "right")]]
        found, to = _pair(t, out[b - 1], out[b])
        b, to = b[found], to[found]
        if not len(b):
            break
        out[b - 1] = to
        keep = np.ones(len(out), bool)
        keep[b] = False
        out, ends = _cut(out, ends, keep)
    ccc = t.CCC[out]
    marks = np.flatnonzero(ccc)
    if len(marks):
        row = np.searchsorted(ends, marks, "right")
        fresh = np.r_[True, (np.diff(marks) > 1) | (np.diff(row) > 0)]
        run = np.cumsum(fresh) - 1
        order = np.lexsort((ccc[marks], run))  # stable: canonical order inside each run
        out[marks], ccc[marks] = out[marks][order], ccc[marks][order]
        start = marks[fresh]
        size = np.diff(np.r_[np.flatnonzero(fresh), len(marks)])
        base = start - 1
        based = (start > 0) & (base >= np.r_[0, ends[:-1]][row[fresh]])
        start, size, base = start[based], size[based], base[based]
        keep, last = np.ones(len(out), bool), np.zeros(len(start), np.uint8)
        live, k = np.arange(len(start)), 0
        while len(live):
            m = start[live] + k
            found, to = _pair(t, out[base[live]], out[m])
            found &= last[live] < ccc[m]
            out[base[live][found]] = to[found]
            keep[m[found]] = False
            last[live[~found]] = ccc[m[~found]]
            k += 1
            live = live[size[live] > k]
        out, ends = _cut(out, ends, keep)
    return out, ends


def form_array(texts: pa.Array) -> pa.Array:
    """The forms of an Arrow string array; null stays null, empty stays empty."""
    texts = texts.cast(pa.large_string())
    if not len(texts):
        return texts
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    cps = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32)
    ends = np.r_[0, np.cumsum((raw & 0xC0) != 0x80)][offsets[1:] - offsets[0]]
    out, ends = visual_forms(cps, ends)
    width = (1 + (out >= 0x80) + (out >= 0x800) + (out >= 0x10000)).astype(np.uint8)
    data = out.astype("<u4").tobytes().decode("utf-32-le").encode()
    to = np.r_[0, np.r_[0, np.cumsum(width, dtype=np.int64)][ends]]
    made = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(to.astype(np.int64).tobytes()), pa.py_buffer(data))
    return pa.compute.if_else(texts.is_null(), pa.scalar(None, pa.large_string()), made) if texts.null_count else made


def _forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import pyarrow.compute  # noqa: F401

    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), form_array(b.column(1)).cast(pa.string())], names=["id", "form"])


def visual_form(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, form) for each row. ASCII texts are their own form and stay in the JVM; null and empty texts stay so.

    Repeated rows come out as often; other columns, whatever their names, are left out. No shuffle."""
    rows = df.select(F.col(key).alias("id"), F.col(text).alias("form"))
    plain = F.col("form").isNull() | (F.octet_length("form") == F.char_length("form"))
    kind = rows.schema["id"].dataType.simpleString()
    other = rows.filter(~plain).mapInArrow(_forms, f"id {kind}, form string")
    return rows.filter(plain).unionByName(other).select(F.col("id").alias(key), "form")


def alike_pairs(df: DataFrame, key: str, text: str) -> DataFrame:
    """(doc_a, doc_b), doc_a < doc_b: all pairs of rows whose texts differ as strings but have the same form.

    Null and empty texts, and pairs of equal strings, are no case; texts of invisible characters alone look the same. Only 128-bit digests of text and form are shuffled.
    Forms with a single text are dropped by a mergeable aggregate before any join, so copies of a text, however
    many, never meet; pairs of different texts are made first and their ids put in after, so no more rows arise than the result has."""
    rows = df.filter(F.length(text) > 0).select(F.col(key).alias("id"), F.col(text).alias("text"))
    ascii = F.octet_length("text") == F.char_length("text")
    digest = lambda c: F.unhex(F.md5(F.encode(c, "utf-8")))
    kind = rows.schema["id"].dataType.simpleString()

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), form_array(b.column(1)).cast(pa.string()), b.column(2)], names=["id", "form", "t"])

    same = rows.filter(ascii).select("id", digest(F.col("text")).alias("f"), digest(F.col("text")).alias("t"))
    other = rows.filter(~ascii).select("id", "text", digest(F.col("text")).alias("t")).mapInArrow(made, f"id {kind}, form string, t binary")
    both = same.unionByName(other.select("id", digest(F.col("form")).alias("f"), "t"))
    hit = both.groupBy("f").agg(F.min("t").alias("lo"), F.max("t").alias("hi")).filter("lo <> hi").select("f")
    members = both.join(hit, "f", "left_semi").distinct()
    texts = members.select("f", "t").distinct()
    pairs = texts.withColumnRenamed("t", "ta").join(texts.withColumnRenamed("t", "tb"), "f").filter("ta < tb")
    a, b = members.select("f", F.col("id").alias("a"), F.col("t").alias("ta")), members.select("f", F.col("id").alias("b"), F.col("t").alias("tb"))
    return pairs.join(a, ["f", "ta"]).join(b, ["f", "tb"]).filter("a <> b").select(F.least("a", "b").alias("doc_a"), F.greatest("a", "b").alias("doc_b"))
