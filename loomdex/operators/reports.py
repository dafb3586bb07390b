"""Batch reports over the index: duplicates, alphabet, directories, includes, navigation inside files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomdex.common import numbered
from loomdex.functions.paths import normal_path
from loomdex.functions.text import anchor_kind, base_name, encode_lines, include_name


def duplicates(defs: DataFrame) -> DataFrame:
    """Per tag: number of entries, and path and line of the first by (path, lineno)."""
    first = F.min(F.struct("path", "lineno"))
    return defs.groupBy("tag").agg(F.count("*").alias("entries"), first["path"].alias("first_path"), first["lineno"].alias("first_lineno"))


def tooltip(dup: DataFrame) -> DataFrame:
    """The text that a link to each tag shows."""
    text = F.when(F.col("entries") == 1, F.format_string("Defined at %d in %s.", "first_lineno", "first_path")).otherwise(F.format_string("Multiple defined in %d places.", "entries"))
    return dup.select("tag", text.alias("title"))


def alphabet(defs: DataFrame) -> DataFrame:
    """Distinct tags per first letter; characters that are no letter and no underscore by their code."""
    first = F.substring("tag", 1, 1)
    bucket = F.when(first.rlike(r"^[A-Za-z_]$") | (F.ascii(first) > 127), first).otherwise(F.ascii(first).cast("string"))
    return defs.select("tag").distinct().groupBy(bucket.alias("bucket")).agg(F.count("*").alias("tags"))


def directories(files: DataFrame) -> DataFrame:
    """Distinct files below each directory, at any depth."""
    parts = F.split(F.col("path"), "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    return files.select("path").distinct().select(F.explode(above).alias("directory")).groupBy("directory").agg(F.count("*").alias("files"))


def directory_ids(files: DataFrame) -> DataFrame:
    """Directories with ids after the files' greatest, in the order of their names."""
    top = files.agg(F.max("fid").alias("top"))
    return numbered(directories(files).select("directory"), "directory").select("directory", (F.col("number") + 1 + top.scalar()).alias("fid"))


def duplicate_entries(defs: DataFrame) -> DataFrame:
    """The pages of tags with several entries: every entry (tag, path, lineno, image)."""
    many = defs.groupBy("tag").agg(F.count("*").alias("n")).filter("n > 1").select("tag")
    return defs.join(many, "tag", "left_semi").select("tag", "path", "lineno", "image")


#: Suffixes of files that others include (fixed values).
INCLUDED = [".h", ".hh", ".hxx", ".hpp", ".H", ".inc.php"]


def _candidates(files: DataFrame) -> DataFrame:
    names = files.select("path").distinct().filter(F.col("path").rlike("(" + "|".join(x.replace(".", r"\.") for x in INCLUDED) + ")$"))
    return names.select(base_name(F.col("path")).alias("name"), F.col("path").alias("target"))


def includes(lines: DataFrame, files: DataFrame) -> DataFrame:
    """(path, lineno, name, candidates, target): each include line with how many files of that name may be included, and that file
    where it is one; where there are several, ``include_targets`` lists them once. So a name of many files that many
    lines include takes as many rows as it has lines."""
    edges = lines.withColumn("name", include_name(F.col("image"))).filter("name IS NOT NULL").select("path", "lineno", "name").distinct()
    what = _candidates(files).groupBy("name").agg(F.count("*").alias("candidates"), F.min("target").alias("target"))
    return edges.join(what, "name", "left").select("path", "lineno", "name", F.coalesce("candidates", F.lit(0)).cast("long").alias("candidates"), F.when(F.col("candidates") == 1, F.col("target")).alias("target"))


def include_targets(files: DataFrame) -> DataFrame:
    """(name, target): the files that a name of several may mean."""
    c = _candidates(files)
    return c.join(c.groupBy("name").agg(F.count("*").alias("n")).filter("n > 1").select("name"), "name", "left_semi")


def include_counts(lines: DataFrame, files: DataFrame) -> DataFrame:
    """Per name: files it may mean and lines that include it. Both sides are counted before they meet."""
    who = lines.withColumn("name", include_name(F.col("image"))).filter("name IS NOT NULL").select("path", "lineno", "name").distinct().groupBy("name").agg(F.count("*").alias("includers"))
    what = files.select("path").distinct().filter(F.col("path").rlike("(" + "|".join(x.replace(".", r"\.") for x in INCLUDED) + ")$")).groupBy(base_name(F.col("path")).alias("name")).agg(F.count("*").alias("candidates"))
    return who.join(what, "name", "left").select("name", F.coalesce("candidates", F.lit(0)).cast("long").alias("candidates"), "includers")


def navigation(defs: DataFrame) -> DataFrame:
    """For each line that defines a function: the line of the function before and after, and of the first and last of the file
    where that is another line. Macros and types are no stops."""
    d = defs.filter(anchor_kind(F.lit(1), F.col("tag"), F.col("image")) == "D").select("path", "lineno").distinct()
    w = Window.partitionBy("path").orderBy("lineno")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    other = lambda c: F.when(c != F.col("lineno"), c)
    return d.select("path", "lineno", F.lag("lineno").over(w).alias("previous"), F.lead("lineno").over(w).alias("next"), other(F.first("lineno").over(whole)).alias("first"), other(F.last("lineno").over(whole)).alias("last"))


def anchors(defs: DataFrame, refs: DataFrame, syms: DataFrame) -> DataFrame:
    """(path, lineno, tag, kind) of every definition (D a function, M a macro, T a type), reference (R) and other symbol (Y)."""
    of = lambda d, kind: d.select("path", "lineno", "tag", kind.alias("kind"))
    return of(defs, anchor_kind(F.lit(1), F.col("tag"), F.col("image"))).unionByName(of(refs, F.lit("R"))).unionByName(of(syms, F.lit("Y")))


def enclosing(refs: DataFrame, defs: DataFrame) -> DataFrame:
    """For each reference the last definition at or above its line in the same file (an as-of join): definitions and
    references of a file are put in one order and the last definition seen is carried on. Several on a line: the
    greatest tag."""
    d = defs.select(F.concat(F.lit("./"), normal_path(F.col("path"))).alias("path"), "lineno", "tag").groupBy("path", "lineno").agg(F.max("tag").alias("enclosing"))
    both = d.select("path", "lineno", F.lit(0).alias("is_ref"), F.struct("enclosing", F.col("lineno").alias("at")).alias("d"), F.lit(None).cast("string").alias("tag"))
    both = both.unionByName(refs.select("path", "lineno", F.lit(1).alias("is_ref"), F.lit(None).cast(both.schema["d"].dataType).alias("d"), "tag"))
    w = Window.partitionBy("path").orderBy("lineno", "is_ref").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("d", F.last("d", True).over(w)).filter("is_ref = 1").select("path", "tag", "lineno", F.col("d.enclosing").alias("enclosing"), F.col("d.at").alias("def_lineno"))


def line_lists(refs: DataFrame) -> DataFrame:
    """Per file and tag: its distinct lines in order, and their short form. Lists are as long as a file has lines."""
    return refs.groupBy("path", "tag").agg(F.sort_array(F.collect_set("lineno")).alias("linenos")).select("path", "tag", F.size("linenos").cast("long").alias("n"), encode_lines(F.col("linenos")).alias("coded"))


def linked(anchors: DataFrame, defs: DataFrame, refs: DataFrame, syms: DataFrame) -> DataFrame:
    """Each anchor (tag, path, lineno, kind) with where its link goes: from references to definitions, from definitions to
    references, from other symbols to symbols. One entry is linked itself, several by their list; a symbol's only entry
    is the anchor itself, so that has no link, nor has an anchor without entries."""
    dup = lambda d, name: duplicates(d).withColumn("list", F.lit(name))
    entries = dup(defs, "definitions").unionByName(dup(refs, "references")).unionByName(dup(syms, "symbols"))
    to = F.when(F.col("entries") > 1, F.concat_ws("/", "list", "tag")).when((F.col("entries") == 1) & (F.col("list") != "symbols"), F.concat_ws("#L", "first_path", F.col("first_lineno").cast("string")))
    asks = F.when(F.col("kind") == "R", "definitions").when(F.col("kind") == "Y", "symbols").otherwise("references")
    return anchors.withColumn("list", asks).join(entries, ["list", "tag"], "left").select("tag", "path", "lineno", "kind", to.alias("link"))


#: What a line of a printed call tree may be: indented name, then its place or a line or nothing between angle brackets.
CALL = r"^([ \t]*)([A-Za-z_]\w*)\(?\)?:?.*?<([^<>\s]*)(?:\s+(\d+))?>"


def call_tree(text: DataFrame, files: DataFrame) -> DataFrame:
    """(seq, depth, name, path, lineno, fid) of each line of a call tree; fid is null where the file isn't known."""
    part = lambda i: F.regexp_extract("line", CALL, i)
    rows = text.select("seq", F.length(part(1)).alias("depth"), part(2).alias("name"), F.nullif(part(3), F.lit("")).alias("path"), F.nullif(part(4), F.lit("")).cast("long").alias("lineno")).filter("name <> ''")
    f = files.select(F.concat(F.lit("./"), normal_path(F.col("path"))).alias("norm"), "fid").groupBy("norm").agg(F.max("fid").alias("fid"))
    return rows.join(f, F.concat(F.lit("./"), normal_path(F.col("path"))) == F.col("norm"), "left").drop("norm")


def line_clusters(anchors: DataFrame) -> DataFrame:
    """Per line with anchors (path, lineno, tag, kind): how many there are, and whether one defines a function."""
    return anchors.groupBy("path", "lineno").agg(F.count("*").alias("anchors"), F.max(F.col("kind") == "D").alias("defines"))
