"""Generated, minified or vendored source files and data saved as code, so that only hand-written source remains.

Three steps: copies between repositories by an inverted index of rare lines; then, for every text, what its leading and trailing
comments and its path say about it; then the composition of its tokens.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from hashlib import blake2b, md5

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomdex.common import written
from loomdex.functions.paths import normal_path
from loomdex.functions.text import base_name
from loomdex.sources.languages import language_in

#: A line is rare in at most this many texts or this share of all texts, if that is more; or if the names of its texts fill at most so
#: many of the BUCKETS a name may fall into, which is what RARE_TEXTS names do on average.
RARE_TEXTS, RARE_SHARE = 64, 1e-4
BUCKETS, RARE_BUCKETS = 256, 57
#: Repositories of a line that are asked first.
EARLIEST = 64
#: The share of a text's rare lines another repository must hold; of fewer than FEW rare lines it must hold all, and of
#: fewer than FEWEST the whole text.
CONTAINED, FEW, FEWEST = 0.8, 8, 3

# File names that tools give to what they generate or shrink.
GENERATED_NAME = re.compile(
    r"(?:\.(?:pb|pb-c|pb\.\w+|gen|g|generated|autogen|designer|tab|min|bundle)\.[^./]+|_(?:pb2|pb2_grpc|autogen|generated|moc)\.[^./]+|-min\.[^./]+|[a-z]Generated\.[^./]+)$|(?:^|/)(?:Auto_\w+\.java|lex\.\w+\.[^./]+|moc_[^/]+|y\.tab\.[^/]+)$"
)
# Directories that hold other people's code, or the output of generators.
VENDOR_DIR = re.compile(r"(?:^|/)(?:vendor|vendored|third_party|third-party|thirdparty|3rdparty|3rd_party|node_modules|bower_components|external|externals|extern|deps|bundled|contrib/imported|site-packages)/", re.I)
GENERATED_DIR = re.compile(r"(?:^|/)(?:generated|autogen|gen-src|__generated__|generated-sources)/", re.I)
# How a comment says that its own file was generated (English, German, French, Spanish). A sentence
# that speaks of other files, or of a part of this one, is none of these.
GENERATED_NOTE = re.compile(
    r"\bauto(?:matically)?[- ]?generated\s+(?:file|code|source|by|from|with|using|on|[-–:])|^\W*auto(?:matically)?[- ]?generated\b"
    r"|\bthis (?:file|code|source|module|class) (?:is|was|has been) (?:\w+ )?(?:auto-?|machine[- ])?(?:matically )?(?:generated|created|produced|built)\b(?! by hand)"
    r"|\b(?:code|file|source) (?:is |was )?generated (?:from|by|with|using)\b|(?:^|\s)@generated\b"
    r"|^\W*(?:created|generated|produced|built|emitted) (?:by|with|using) \S+(?: v?\d[\w.]*)? from \S|^\W*(?:generated|emitted) (?:by|with|from) "
    r"|^\W*output of \W?\w.*(?:overwritten|lost|regenerat)|\bmachine[- ](?:made|generated) (?:by|with|from)\b"
    r"|\bautomatisch (?:erzeugt|erstellt|generiert)|\b(?:produit|généré|créé)e? (?:automatiquement|par)\b|\b(?:generado|creado|producido) (?:con|por|automáticamente)\b",
    re.I | re.M,
)
# How a comment says that its own file is a copy.
VENDOR_NOTE = re.compile(
    r"\bcopied (?:verbatim|unchanged|unmodified)\b|\b(?:this is|is) an? (?:unmodified|verbatim|vendored|local) copy\b|^\W*(?:imported|vendored|taken verbatim|synced) from \S+,? (?:release|version|tag|commit|v?\d)"
    r"|^\W*origin: \S+-\d[\w.]*/|\blocal (?:edits|changes|modifications) (?:are|will be) (?:lost|overwritten)",
    re.I | re.M,
)
#: Directives by which scanner and parser generators point to their input.
LINE_NOTE = re.compile(r'(?m)^[ \t]*#[ \t]*(?:line[ \t]+)?\d+[ \t]+"[^"\n]*\.(?:y|yy|ypp|y\+\+|l|ll|lpp|l\+\+|re|rl|rex|g|g4|jj|jflex|peg)"')
_SLASHES = r"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)"
_STRINGS = r'"(?:\\[\s\S]|[^"\\\n])*"|\'(?:\\[\s\S]|[^\'\\\n])*\''
_TRIPLE = r'"""[\s\S]*?(?:"""|\Z)|\'\'\'[\s\S]*?(?:\'\'\'|\Z)|'
_HASH = r"(?<![^\s;])#[^\n]*"
SCAN = {
    "slash": re.compile(rf"(?P<comment>{_SLASHES})|(?P<string>{_STRINGS}|`(?:\\[\s\S]|[^`\\])*`)"),
    "hash": re.compile(rf"(?P<comment>{_HASH})|(?P<string>{_TRIPLE}{_STRINGS})"),
    "both": re.compile(rf"(?P<comment>{_SLASHES}|{_HASH})|(?P<string>{_STRINGS})"),
}
STYLE = {"python": "hash", "asm": "both", "php": "both"}
#: Lines that may stand before the comment that speaks of the file.
PREAMBLE = re.compile(r"""\s*(?:<\?php|#!.*|['"]use strict['"];?|%\{|#\s*(?:include|pragma|ifndef|define)\b.*|(?:package|import|from|require|require_once|namespace|using)\b.*)?\s*""")
_TOKEN = re.compile(r"(?<![\w$])\.?\d[\w.]*|[^\W\d]\w*")
#: Above this share of the text's literals among its literals and names it is data; of its characters in long strings, too.
DATA_LITERALS, DATA_CHARS = 0.6, 0.5
LITERALS = 24
LONG_STRING = 48
#: A text is minified if this share of its code stands in lines that long, and less than that share of them is blank.
LONG_LINE, LONG_SHARE, BLANKS = 200, 0.8, 0.08


def notes(text: str, style: str) -> tuple[str, str, list[str]]:
    """The comments before and after the code, the code without comments, and its strings."""
    pieces, strings, head, tail, last, began = [], [], [], [], 0, False
    for m in SCAN[style].finditer(text):
        if m["comment"] is None:
            strings.append(m[0])
            continue
        between = text[last : m.start()]
        pieces.append(between)
        if between.strip():
            tail = []
            began = began or not all(PREAMBLE.fullmatch(x) for x in between.split("\n"))
        (tail if began else head).append(m[0])
        last = m.end()
    pieces.append(text[last:])
    if text[last:].strip() not in ("", "?>"):
        tail = []
    return "\n".join(head + tail), " ".join(pieces), strings


def kind_of_path(path: Column) -> Column:
    """vendored or generated, or null where the path says nothing."""
    return F.when(path.rlike("(?i)" + VENDOR_DIR.pattern), "vendored").when(path.rlike(GENERATED_NAME.pattern) | path.rlike("(?i)" + GENERATED_DIR.pattern), "generated")


def kind_of_text(text: str | None, style: str) -> str | None:
    """generated, vendored, minified or data, or null for what looks written by hand, as a null or empty text does. style: how
    the language writes comments. Whole texts are read; only comments outside the code speak of the file."""
    if not text:
        return None
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    said, code, strings = notes(text, style)
    if VENDOR_NOTE.search(said):
        return "vendored"
    if GENERATED_NOTE.search(said) or LINE_NOTE.search(text):
        return "generated"
    size = len(code.strip())
    if not size:
        return None
    if sum(len(s) for s in strings if len(s) >= LONG_STRING) > DATA_CHARS * size:
        return "data"
    bare = re.sub(_STRINGS, " ", code)
    tokens = _TOKEN.findall(bare)
    words = sum(x[0] == "_" or x[0].isalpha() for x in tokens)
    literals = len(tokens) - words + len(strings)
    if literals >= LITERALS and literals > DATA_LITERALS * (literals + words):
        return "data"
    long = [x for x in code.split("\n") if len(x) >= LONG_LINE]
    chars = sum(map(len, long))
    if chars > LONG_SHARE * size and words and sum(len(re.findall(r"\s", x)) for x in long) < BLANKS * chars:
        return "minified"
    return None


def _digest(x: bytes) -> bytes:
    return md5(x, usedforsecurity=False).digest()


def _hash(x: str) -> int:
    return int.from_bytes(blake2b(x.encode(), digest_size=8).digest(), "little", signed=True)


#: What is known of a text: its kind by each style of comments, digests of its lines and of the whole, line hashes.
TEXT = "norm string, of string, slash string, hash string, both string, lines binary, whole binary, h array<long>"


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, int | None] = {}  # hash by line as it stands, none of an empty one
    for b in batches:
        out: list[tuple] = []
        for norm, of, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            styles = [STYLE.get(of, "slash")] if of is not None else SCAN
            kinds = [kind_of_text(text, x) if x in styles else None for x in SCAN]
            plain = (text or "").replace("\r\n", "\n").replace("\r", "\n")
            if len(known) > 100_000:
                known.clear()
            lines = plain.split("\n")
            for x in lines:
                if x not in known:
                    known[x] = _hash(y) if (y := " ".join(x.split())) else None
            all_ = [y for x in lines if (y := known[x]) is not None]
            h = list(dict.fromkeys(all_))
            out.append((norm, of, *kinds, _digest(array("q", all_).tobytes()) if h else None, _digest(plain.encode()) if h else None, h))
        cols = list(zip(*out, strict=True)) or [()] * 8
        types = [pa.string()] * 5 + [pa.binary()] * 2 + [pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[x.split()[0] for x in TEXT.split(", ")])


def read_texts(params: DataFrame) -> DataFrame:
    """TEXT of each record (file, langmap, content), where the records are: texts are neither shuffled nor broadcast."""
    rows = params.select(normal_path(F.col("file")).alias("norm"), language_in(F.col("file"), F.col("langmap")).alias("of"), "content").filter("norm IS NOT NULL")
    return rows.mapInArrow(_texts, TEXT)


def copies(members: DataFrame, texts: DataFrame) -> DataFrame:
    """(path, kind 'copy') of members (path, repo, born, lines, whole): texts that another repository held before, in whole or by
    their rare lines. texts: (lines, h), the line hashes of each text, repeats allowed.

    Lines are trimmed, their blanks made single; empty ones are left out. Texts with the same lines in the same order count as
    one, so a file copied a thousand times is as rare as its one text. A line is rare if few texts hold it or if its texts have few base
    names (of one text the least), so copies with an edit each, however many, leave their lines rare, while what stands in files of all
    names does not. Of a rare line the index has the repositories, each
    with the earliest text there that holds it. A text is a copy if one text of another repository holds at least
    CONTAINED of its FEW or more rare lines, or all of its FEWEST or more, and was born earlier (of those born at the same time the
    lesser repository's is the first), or holds the whole text, line ends aside. The containment is exact: all rare
    lines are counted. Of a line's repositories the EARLIEST are asked first, and all of them only for the texts not found so; of a
    repository's texts that hold a line the earliest is asked first, and all of them only where the repository holds
    enough lines but its earliest texts don't.
    No two files meet: a line joins its texts with its repositories, and a line in most files is counted by a mergeable aggregate
    before that. Only lines of several repositories, and the common ones, are joined back; the others need no index.
    Texts without a birth count as born last, those without a repository are no copies and make none."""
    name = F.xxhash64(F.lower(base_name(F.col("path"))))
    of = members.filter("lines IS NOT NULL").withColumn("born", F.coalesce("born", F.lit("9999-12-31").cast("timestamp_ntz")))
    one = of.groupBy("lines").agg(F.min(F.xxhash64("repo")).alias("a"), F.max(F.xxhash64("repo")).alias("b"), F.min(name).alias("name"))
    text = texts.filter(F.size("h") > 0).groupBy("lines").agg(F.any_value("h").alias("h")).join(one, "lines")
    text = written(text.select(F.xxhash64("lines").alias("text"), "a", "b", F.pmod("name", F.lit(BUCKETS)).cast("int").alias("name"), "h"), "lines")
    held = of.groupBy(F.xxhash64("lines").alias("text"), "repo").agg(F.min("born").alias("born")).filter("repo IS NOT NULL")
    n = text.agg(F.count("*").alias("n")).select(F.greatest(F.lit(RARE_TEXTS), F.col("n") * RARE_SHARE)).scalar()
    bits = [F.bit_or(F.when(F.floor(F.col("name") / 64) == i, F.expr("shiftleft(1L, name % 64)"))) for i in range(BUCKETS // 64)]
    names = sum((F.bit_count(F.coalesce(x, F.lit(0).cast("long"))) for x in bits[1:]), F.bit_count(F.coalesce(bits[0], F.lit(0).cast("long"))))
    stats = text.select("a", "b", "name", F.explode("h").alias("h")).groupBy("h").agg(F.count("*").alias("df"), names.alias("names"), F.min("a").alias("a"), F.max("b").alias("b"))
    stats = stats.select("h", ((F.col("df") > n) & (F.col("names") > RARE_BUCKETS)).alias("common"), (F.col("a") != F.col("b")).alias("several")).filter("common OR several")
    notable = written(text.select("text", F.explode("h").alias("h")).join(stats, "h"), "notable")
    total = text.select("text", F.size("h").alias("n")).join(notable.groupBy("text").agg(F.count_if("common").alias("common")), "text").select("text", (F.col("n") - F.col("common")).alias("rare"))
    need = F.when(F.col("rare") >= FEW, F.col("rare") * CONTAINED).when(F.col("rare") >= FEWEST, F.col("rare"))
    shared = written(notable.filter("several AND NOT common").select("text", "h").join(held, "text"), "shared")
    other = shared.groupBy("h", F.col("repo").alias("other")).agg(F.min(F.struct("born", "text")).alias("first"))
    other = other.select("h", "other", F.col("first.born").alias("first"), F.col("first.text").alias("source"))
    other = written(other.withColumn("rank", F.row_number().over(Window.partitionBy("h").orderBy("first", "other"))), "other")
    earlier = (F.col("repo") != F.col("other")) & (F.struct("first", "other") < F.struct("born", "repo"))

    def found(lines: DataFrame, repos: DataFrame) -> DataFrame:
        hits = lines.join(repos.drop("rank"), "h").filter(earlier)
        got = hits.groupBy("text", "repo", "other", "source").agg(F.count("*").alias("got"))
        got = got.groupBy("text", "repo", "other").agg(F.max("got").alias("most"), F.sum("got").alias("got")).join(total, "text")
        got = got.filter(F.col("got") >= need).select("text", "repo", "other", (F.col("most") >= need).alias("sure"), need.alias("need"))
        sure = got.filter("sure").select("text", "repo").distinct()
        doubt = got.filter("NOT sure").join(sure, ["text", "repo"], "left_anti")
        holders = shared.select("h", F.col("repo").alias("other"), F.col("born").alias("first"), F.col("text").alias("source"))
        rest = lines.join(doubt, ["text", "repo"]).join(holders, ["h", "other"]).filter(earlier).groupBy("text", "repo", "source").agg(F.count("*").alias("got"), F.max("need").alias("need"))
        return sure.unionByName(rest.filter("got >= need").select("text", "repo").distinct())

    best = found(shared, other.filter(F.col("rank") <= EARLIEST))
    if not other.filter(F.col("rank") > EARLIEST).isEmpty():  # else all repositories were asked
        best = written(best, "best")
        late = shared.join(other.filter(F.col("rank") == EARLIEST + 1).select("h"), "h", "left_semi").select("text", "repo").distinct().join(best, ["text", "repo"], "left_anti")
        best = best.unionByName(found(shared.join(late, ["text", "repo"], "left_semi"), other))
    same = of.filter("repo IS NOT NULL").select("path", "repo", "born", "whole")
    first = same.groupBy("whole").agg(F.min("repo").alias("a"), F.max("repo").alias("b"), F.min(F.struct("born", "repo")).alias("first")).filter("a <> b")
    same = same.join(first, "whole").filter(F.col("first.repo") != F.col("repo")).select("path")
    return of.select("path", "repo", F.xxhash64("lines").alias("text")).join(best, ["text", "repo"], "left_semi").select("path").unionByName(same).select("path", F.lit("copy").alias("kind")).distinct()


def not_handwritten(files: DataFrame, params: DataFrame) -> DataFrame:
    """(path, kind) for each source path of ``files`` that nobody wrote by hand for its tree; a path comes out once for each kind.

    A file is source if its kind says so, or if that is null and it has a language, by its own column or its request's map.
    Texts meet paths by the normal form; a path of several requests is judged by each text, one without a text by its name.
    Repeated rows count once; null paths are left out. Each text is read whole, once, where it lies; what is shuffled are its
    digests, kinds and line hashes."""
    paths = files.filter(F.col("path").isNotNull()).groupBy("path").agg(F.max(F.when(F.col("kind").isNotNull(), F.col("kind") == "source")).alias("source"), F.max("lang").alias("lang"), F.min("repo").alias("repo"), F.min("mtime").alias("born"))
    texts = written(read_texts(params), "texts")
    rows = paths.withColumn("norm", normal_path(F.col("path"))).join(texts.drop("h").distinct(), "norm", "left").filter(F.coalesce("source", F.coalesce("lang", "of").isNotNull()))
    style = F.coalesce("of", "lang")
    said = F.when(style.isin([k for k, v in STYLE.items() if v == "hash"]), F.col("hash")).when(style.isin([k for k, v in STYLE.items() if v == "both"]), F.col("both")).otherwise(F.col("slash"))
    rows = written(rows.select("path", "repo", "born", "lines", "whole", F.coalesce(kind_of_path(F.col("path")), said).alias("kind")), "paths")
    return rows.filter("kind IS NOT NULL").select("path", "kind").unionByName(copies(rows.drop("kind"), texts.select("lines", "h"))).distinct()
