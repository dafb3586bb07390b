"""References to records that do not exist: temporal anti-join by range partitions and binary search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomdex.common import wide_hash, written
from loomdex.functions.paths import fid_number, is_tag, normal_path

#: Rows (references and parents) that one group should hold; a task takes its groups one after the other.
TARGET_ROWS = 250_000
FOREVER = np.iinfo(np.int64).max


def merged_lifetimes(parents: DataFrame) -> DataFrame:
    """Joins the overlapping lifetimes [loaded_at, removed_at) of each (kind, key); null removed_at is without end.

    Rows are reduced twice: first among lifetimes that begin on the same day, then over days, so a key that holds
    a large share of all rows is cut down by many tasks before one task sees what is left of it. Lifetimes that end
    before they begin, or begin at null, are empty and dropped."""
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    rows = parents.select("kind", "h1", "h2", micros("loaded_at").alias("start"), F.coalesce(micros("removed_at"), F.lit(FOREVER)).alias("end"))
    rows = rows.filter("start < end").groupBy("kind", "h1", "h2", "start").agg(F.max("end").alias("end"))
    for keys in (["kind", "h1", "h2", "day"], ["kind", "h1", "h2"]):
        w = Window.partitionBy(*keys).orderBy("start")
        rows = rows.withColumn("day", F.floor(F.col("start") / F.lit(86_400_000_000)))
        rows = rows.withColumn("fresh", F.coalesce(F.col("start") > F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True)).cast("int"))
        rows = rows.withColumn("island", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        rows = rows.groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island", "day")
    return rows


def _alive(ref: tuple[np.ndarray, ...], par: tuple[np.ndarray, ...]) -> np.ndarray:
    """Whether each reference (h1, h2, at) falls into a lifetime of its key; par: (h1, h2, start, end), disjoint per key."""
    h1, h2, at = ref
    p1, p2, start, end = par
    alive = np.zeros(len(h1), bool)
    if not len(p1):
        return alive
    order = np.lexsort((start, p2, p1))
    p1, p2, start, end = (x[order] for x in (p1, p2, start, end))
    new_pair = np.r_[True, (p1[1:] != p1[:-1]) | (p2[1:] != p2[:-1])]
    new_h1 = np.r_[True, p1[1:] != p1[:-1]]
    pair = np.cumsum(new_pair) - 1  # number of each row's key
    first_of_h1 = pair[np.flatnonzero(new_h1)]
    keys1, keys2 = p1[new_pair], p2[new_pair]
    uniq1 = p1[new_h1]
    layers = int(np.diff(np.r_[first_of_h1, len(keys1)]).max())  # above 1 only where two keys share a 64-bit hash
    starts = np.unique(start)
    comp = pair * np.int64(len(starts) + 1) + np.searchsorted(starts, start) + 1
    rank = np.searchsorted(starts, at, "right")
    slot = np.minimum(np.searchsorted(uniq1, h1), len(uniq1) - 1)
    known = uniq1[slot] == h1
    for layer in range(layers):
        k = np.minimum(first_of_h1[slot] + layer, len(keys1) - 1)
        hit = known & (keys1[k] == h1) & (keys2[k] == h2)
        at_row = np.searchsorted(comp, k * np.int64(len(starts) + 1) + rank, "right") - 1
        at_row = np.maximum(at_row, 0)
        alive |= hit & (pair[at_row] == k) & (start[at_row] <= at) & (at < end[at_row])
    return alive


def _column(t: pa.Table, name: str) -> np.ndarray:
    return t.column(name).to_numpy()


def _probe(refs: pa.Table, parents: pa.Table) -> pa.Table:
    out = np.ones(refs.num_rows, bool)
    kinds, of = _column(refs, "kind"), _column(parents, "kind")
    for kind in np.unique(kinds):
        r, p = kinds == kind, of == kind
        out[r] = ~_alive(tuple(_column(refs, c)[r] for c in ("h1", "h2", "at")), tuple(_column(parents, c)[p] for c in ("h1", "h2", "start", "end")))
    return refs.select(["kind", "ref_id", "at"]).filter(pa.array(out))


def orphans(refs: DataFrame, parents: DataFrame, target_rows: int = TARGET_ROWS) -> DataFrame:
    """References without a living parent at their own time.

    refs (kind INT, key STRING, ref_id BIGINT, at TIMESTAMP), parents (kind INT, key STRING, loaded_at, removed_at):
    a reference is an orphan if no parent with its kind and key has loaded_at <= at and (removed_at null or at < removed_at).
    Returns kind, ref_id, at of each orphan, once for each (kind, ref_id).

    Keys are range-partitioned by their 64-bit hash into ranges of half of target_rows on average, references and
    parents together; both are hashed once and written. Only a range above target_rows, as of a key that a third of all rows name,
    is looked at by itself (such ranges, at most one for each target_rows rows, reach the driver): its time is cut so
    that a slice starts no more than target_rows lifetimes, and its references are dealt over salts, each with
    the lifetimes of its slice. Lifetimes of a key are disjoint, so of each key one at most is repeated for a cut. A group keeps the
    parents as sorted arrays and probes all its references by binary search. Keys travel as 96 bits of
    hash, so the shuffle's size doesn't depend on their length.

    Null keys are no references; a null time is in no lifetime, so its reference is an orphan. Empty tables on either
    side are fine. Repeated rows count once. Extra columns are ignored."""
    spark = refs.sparkSession
    hashed = lambda d: d.filter(F.col("key").isNotNull()).withColumns(dict(zip(("h1", "h2"), wide_hash("key"), strict=True)))
    r = hashed(refs).select("kind", "h1", "h2", F.col("ref_id").cast("long").alias("ref_id"), F.coalesce(F.unix_micros(F.col("at").cast("timestamp")), F.lit(-FOREVER)).alias("at"))
    r, p = written(r, "references"), written(merged_lifetimes(hashed(parents)), "parents")
    total = r.count() + p.count()
    bits = max(1, (2 * total // target_rows).bit_length(), (spark.sparkContext.defaultParallelism - 1).bit_length())
    part = F.shiftrightunsigned("h1", 64 - bits)
    both = r.select(part.alias("part"), F.lit(1).alias("r"), F.lit(None).cast("long").alias("start")).unionByName(p.select(part.alias("part"), F.lit(0).alias("r"), "start"))
    sizes = both.groupBy("part").agg(F.sum("r").alias("r"), F.count("start").alias("p")).filter(F.col("r") + F.col("p") > target_rows).collect()
    large = {x.part: (-(-x.r // target_rows) or 1, -(-x.p // target_rows) or 1) for x in sizes}
    cuts = dict.fromkeys(large, ())
    for slices in sorted({k for _, k in large.values() if k > 1}):
        parts = [x for x, (_, k) in large.items() if k == slices]
        found = p.withColumn("part", part).filter(F.col("part").isin(parts)).groupBy("part").agg(F.percentile_approx("start", [i / slices for i in range(1, slices)], 100 * slices).alias("cuts"))
        cuts |= {x.part: tuple(sorted(set(x.cuts))) for x in found.collect()}
    r, p = r.withColumn("part", part), p.withColumn("part", part)
    if large:
        plan = F.broadcast(spark.createDataFrame([(x, salts, list(cuts[x])) for x, (salts, _) in large.items()], "part long, salts int, cuts array<long>"))  # large ranges only
        r, p = (d.join(plan, "part", "left").fillna(1, ["salts"]).withColumn("cuts", F.coalesce("cuts", F.array().cast("array<long>"))) for d in (r, p))
        slice_of = lambda at: F.size(F.filter("cuts", lambda c: c <= at))
        r = r.withColumn("slice", slice_of(F.col("at"))).withColumn("salt", F.pmod(F.xxhash64("ref_id", "at"), F.col("salts")).cast("int"))
        p = p.withColumn("slice", F.explode(F.sequence(slice_of(F.col("start")), slice_of(F.col("end") - 1)))).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    else:
        r, p = (d.withColumns({"slice": F.lit(0), "salt": F.lit(0)}) for d in (r, p))
    group = ["part", "slice", "salt"]
    r, p = r.select(*group, "kind", "h1", "h2", "ref_id", "at"), p.select(*group, "kind", "h1", "h2", "start", "end")
    miss = r.groupBy(*group).cogroup(p.groupBy(*group)).applyInArrow(_probe, "kind int, ref_id long, at long")
    return miss.groupBy("kind", "ref_id").agg(F.min("at").alias("at")).withColumn("at", F.when(F.col("at") > -FOREVER, F.timestamp_micros("at")))


#: The references of the index: number, table and field.
KINDS = {1: ("gtp", "tag"), 2: ("gtp", "path"), 3: ("parsefile_data", "fid")}


def index_references(gtp: DataFrame, parsed: DataFrame) -> DataFrame:
    """All references of the index: tags of definitions and references, paths of any record, file ids of parses."""
    path = normal_path(F.col("path"))
    pairs = F.array(
        F.struct(F.lit(1).alias("kind"), F.when(F.col("db").isin(1, 2) & is_tag(F.col("tag")), F.col("tag")).alias("key")),
        F.struct(F.lit(2).alias("kind"), path.alias("key")),
    )
    a = gtp.select(F.col("gtp_id").alias("ref_id"), F.col("read_at").alias("at"), F.inline(pairs))
    b = parsed.select(F.col("run_id").alias("ref_id"), F.col("parsed_at").alias("at"), F.lit(3).alias("kind"), fid_number(F.col("fid")).alias("key"))
    return a.unionByName(b)


def index_parents(defs: DataFrame, files: DataFrame) -> DataFrame:
    """What those references may name, with lifetimes."""
    of = lambda d, kind, key: d.select(F.lit(kind).alias("kind"), key.alias("key"), "loaded_at", "removed_at")
    return of(defs, 1, F.col("tag")).unionByName(of(files, 2, normal_path(F.col("path")))).unionByName(of(files, 3, F.col("fid").cast("string")))


def _name(i: int) -> Column:
    return F.create_map(*[F.lit(x) for k, v in KINDS.items() for x in (k, v[i])])[F.col("kind")]


def index_orphans(gtp: DataFrame, parsed: DataFrame, defs: DataFrame, files: DataFrame, target_rows: int = TARGET_ROWS) -> DataFrame:
    """ref_table, field, ref_id and time of every orphan reference of the index."""
    o = orphans(index_references(gtp, parsed), index_parents(defs, files), target_rows)
    return o.select(_name(0).alias("ref_table"), _name(1).alias("field"), "ref_id", "at")


def orphan_counts(found: DataFrame) -> DataFrame:
    """Orphans per table, field and month (``yyyy-MM``, null for references without a time)."""
    return found.groupBy("ref_table", "field", F.date_format("at", "yyyy-MM").alias("month")).agg(F.count("*").alias("orphans"))
