"""The index on storage: sorted tables in numbered versions, a table of settings, and text outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdex.functions.formats import render
from loomdex.operators import incremental

#: Version of the layout; another one is refused (fixed value of this library).
FORMAT = 1
#: Rows in one file of a sorted table, about.
FILE_ROWS = 4_000_000


def write_sorted(df: DataFrame, path: str, *keys: str, files: int | None = None, mode: str = "errorifexists") -> None:
    """Range-partitioned and sorted by the keys, so that each file's statistics bound its keys and a lookup reads few."""
    (df.repartitionByRange(files, *keys) if files else df.repartitionByRange(*keys)).sortWithinPartitions(*keys).write.mode(mode).parquet(path)


class Catalog:
    """An index in a folder: ``meta`` names the version in use, ``v<N>`` holds its tables. A new version is complete
    before ``meta`` names it, so readers never see half of one and a failed update leaves the old."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def meta(self) -> dict[str, str]:
        """The settings; of several rows with a name the one of the greatest version."""
        rows = self.spark.read.parquet(f"{self.root}/meta").groupBy("name").agg(F.max_by("value", "version").alias("value")).collect()  # one row for each setting
        out = {x.name: x.value for x in rows}
        if out.get("format") != str(FORMAT):
            raise ValueError(f"the index has format {out.get('format')}, this library reads {FORMAT}")
        return out

    def put_meta(self, version: int, **values: object) -> None:
        rows = [(k, str(v), version) for k, v in values.items()]
        self.spark.createDataFrame(rows, "name string, value string, version long").coalesce(1).write.mode("append").parquet(f"{self.root}/meta")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/v{self.meta()['current']}/{name}")

    def create(self, files: DataFrame, defs: DataFrame, refs: DataFrame, as_of: str) -> None:
        """Writes the first version: files (fid, path, ...), defs and refs with key and fid."""
        self._write(1, files, defs, refs)
        last = files.agg(F.max("fid")).first()[0] or 0
        self.put_meta(1, format=FORMAT, current=1, next_fid=last + 1, as_of=as_of)

    def _write(self, version: int, files: DataFrame, defs: DataFrame, refs: DataFrame) -> None:
        at = f"{self.root}/v{version}"
        write_sorted(files, f"{at}/files", "path", mode="overwrite")
        write_sorted(defs, f"{at}/defs", "key", "path", "lineno", mode="overwrite")
        write_sorted(refs, f"{at}/refs", "key", "path", "lineno", mode="overwrite")

    def update(self, listing: DataFrame, parse, as_of: str) -> dict[str, int]:
        """Brings the index up to the listing (path, mtime, kind, ...): rows of deleted and modified files are dropped,
        ``parse(paths with fid) -> (defs, refs)`` gives those of added and modified ones. Ids are never used again. Without
        a change nothing is written but the time. Returns the numbers of added, modified and deleted paths."""
        meta = self.meta()
        known = self.read("files")
        changes = incremental.change_set(known, listing, meta["as_of"]).persist()
        try:
            n = {x.action: x["count"] for x in changes.groupBy("action").count().collect()}  # three rows at most
            version, next_fid = int(meta["current"]), int(meta["next_fid"])
            if not n:
                self.put_meta(version, as_of=as_of)
                return {}
            files = incremental.apply_changes(known, changes, next_fid - 1)
            touched = known.select("path", "fid").join(changes.filter("action <> 'add'").select("path"), "path", "left_semi")
            fresh = files.join(changes.filter("action <> 'delete'").select("path"), "path", "left_semi")
            defs, refs = parse(fresh)
            new = version + 1
            kinds = listing.groupBy("path").agg(F.max("kind").alias("kind"))
            self._write(new, files.join(kinds, "path", "left"), incremental.replace_rows(self.read("defs"), defs, touched), incremental.replace_rows(self.read("refs"), refs, touched))
            self.put_meta(new, current=new, next_fid=next_fid + n.get("add", 0), as_of=as_of)
            return n
        finally:
            changes.unpersist()


def write_lines(df: DataFrame, kind: str, path: str, mode: str = "errorifexists", compression: str = "none", separator: str = "\n") -> None:
    """Result rows in one of the output formats as text files; ``append`` adds to a saved result."""
    render(df, kind).write.mode(mode).option("compression", compression).option("lineSep", separator).text(path)


def write_map(df: DataFrame, name: str, target: str, path: str) -> None:
    """Two columns as tab-separated text, by name: a map of symbols or of files."""
    df.select(F.concat_ws("\t", name, target).alias("value")).write.mode("overwrite").text(path)


def read_map(spark: SparkSession, path: str) -> DataFrame:
    """(name, target) of such a map."""
    return spark.read.option("sep", "\t").option("quote", "").schema("name string, target string").csv(path)


def first_target(pairs: DataFrame, name: str) -> DataFrame:
    """What a map has for a name, the least of several."""
    return pairs.filter(F.col("name") == name).orderBy("target").limit(1)


def read_result(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a saved result."""
    return spark.read.text(path).select(F.col("value").alias("line"))
