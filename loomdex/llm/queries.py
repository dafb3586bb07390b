"""The queries of the text problems and the SQL of those SQL can express."""

from __future__ import annotations

import unicodedata

from loomdex.common import table
from loomdex.llm import frequency, handwritten, mixing, syntax, tokens, visual
from loomdex.plans.general import sql_norm, sql_tag


def _mix(s, d):
    return mixing.Mix(table(s, d, "documents"), table(s, d, "mix_targets"))


QUERIES = {
    "p1_found": lambda s, d: handwritten.not_handwritten(table(s, d, "files"), table(s, d, "parser_param")).select("path").distinct(),
    "p1_kinds": lambda s, d: handwritten.not_handwritten(table(s, d, "files"), table(s, d, "parser_param")),
    "p3_found": lambda s, d: syntax.malformed(table(s, d, "parser_param"), table(s, d, "lang_entry")),
    "p3_rates": lambda s, d: syntax.malformed_rates(table(s, d, "parser_param"), table(s, d, "lang_entry"), table(s, d, "files")),
    "p4_found": lambda s, d: frequency.marked_tags(table(s, d, "gtp")).filter("mark IS NOT NULL").select("tag", "mark"),
    "p4_frequency": lambda s, d: frequency.tag_frequency(table(s, d, "gtp")),
    "p6_ids": lambda s, d: tokens.encode(table(s, d, "documents"), "doc_id", "text"),
    "p6_decode": lambda s, d: tokens.decode(tokens.encode(table(s, d, "documents"), "doc_id", "text"), "doc_id", "ids"),
    "p7_mix": lambda s, d: _mix(s, d).report(),
    "p7_selection": lambda s, d: _mix(s, d).selection(),
    "p8_found": lambda s, d: visual.alike_pairs(table(s, d, "documents"), "doc_id", "text"),
    "p8_forms": lambda s, d: visual.visual_form(table(s, d, "documents"), "doc_id", "text"),
}
_TAGS = f"""
WITH r AS (SELECT DISTINCT gtp_id, CASE WHEN {sql_tag('tag')} THEN tag END AS tag, {sql_norm('path')} AS path FROM gtp),
f AS (SELECT count(DISTINCT path) AS all_files FROM r),
t AS (SELECT tag, count(*) AS records, count(DISTINCT path) AS files FROM r WHERE tag IS NOT NULL GROUP BY tag)
"""


def sql_form(text: str) -> str:
    """SQL for the visual form: joiners that are seen set aside, every character by its own form, then composed."""
    ranges = lambda rs: "".join(f"{chr(a)}-{chr(b)}" for a, b in rs)
    for _ in range(2):  # neighbours share a character
        for joiner, mark in (("\u200c", "\ue000"), ("\u200d", "\ue001")):
            text = f"regexp_replace({text}, '([{ranges(visual.JOINING)}]){joiner}(.)', '\\1{mark}\\2', 'gs')"
        text = f"regexp_replace({text}, '([{ranges(visual.PICTURES)}])\u200d([{ranges(visual.PICTURES)}])', '\\1\ue001\\2', 'g')"
    alike = dict(zip((x := visual.LOOKALIKES.split())[::2], x[1::2], strict=True))
    maps, gone = {"\ue000": "\u200c", "\ue001": "\u200d"}, "\u200c\u200d" + "".join(chr(c) for a, b in visual.INVISIBLE for c in range(a, b + 1))
    for c in map(chr, (*range(0xA0, 0xD800), *range(0xF900, 0x11000))):
        kind, _, rest = unicodedata.decomposition(c).rpartition("> ")
        parts = unicodedata.normalize("NFD", "".join(chr(int(x, 16)) for x in rest.split()) if kind in ("", "<wide", "<narrow") and rest else c)
        form = unicodedata.normalize("NFC", "".join(alike.get(p, " " if unicodedata.category(p) == "Zs" and p != "\u1680" or ord(p) in visual.BLANK else p) for p in parts))
        if len(form) == 1 and form != c and c not in gone:
            maps[c] = form
    return f"nfc_normalize(translate({text}, '{''.join(maps)}{gone}', '{''.join(maps.values()).replace(chr(39), chr(39) * 2)}'))"


_FORMS = f"SELECT doc_id, text, {sql_form('text')} AS form FROM documents"
ORACLE: dict[str, str] = {
    "p8_forms": f"SELECT doc_id, form FROM ({_FORMS})",
    "p8_found": f"WITH f AS ({_FORMS} WHERE text <> '') SELECT a.doc_id AS doc_a, b.doc_id AS doc_b FROM f a JOIN f b ON a.form = b.form AND a.doc_id < b.doc_id AND a.text <> b.text",
    "p4_found": _TAGS + "SELECT tag, 'rare' AS mark FROM t WHERE records < 3 UNION ALL SELECT tag, 'common' FROM t, f WHERE files > 0.05 * all_files",
    "p4_frequency": _TAGS + "SELECT tag, records, files, all_files FROM t, f",
    # decoding the ids must give the texts back
    "p6_decode": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}
