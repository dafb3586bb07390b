"""Frequency of every distinct term: one dictionary of integers for all terms and count arrays by blocks of its identifiers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdex.common import wide_hash, written
from loomdex.functions.paths import is_tag, normal_path

#: Identifiers in one block of count arrays.
BLOCK = 1 << 16
#: Identifiers with counts that a task keeps before it sends them on.
HELD = 1 << 21


def dictionary(terms: DataFrame) -> DataFrame:
    """(term, id): each distinct term of the column ``term`` with its identifier, dense from 0.

    The distinct terms are written to the shared folder with the number of their part and their place in it, so a term has one
    identifier however often and by whatever splits the table is read: its place plus the number of terms in the parts
    before. One row for each part, never a term, reaches the driver."""
    spark = terms.sparkSession
    mono = F.monotonically_increasing_id()
    kept = written(terms.select("term").distinct().select("term", F.shiftright(mono, 33).cast("int").alias("part"), mono.bitwiseAND((1 << 33) - 1).alias("at")), "terms")
    sizes = sorted((x.part, x.n) for x in kept.groupBy("part").agg(F.count("*").alias("n")).collect())
    begin = np.r_[0, np.cumsum([n for _, n in sizes])].tolist()
    ahead = F.broadcast(spark.createDataFrame([(p, b) for (p, _), b in zip(sizes, begin, strict=False)], "part int, ahead long"))  # one row for each part
    return kept.join(ahead, "part").select("term", (F.col("ahead") + F.col("at")).alias("id"))


def _counted(ids: np.ndarray, *sums: np.ndarray) -> tuple[np.ndarray, ...]:
    """The distinct ids in order, and their sums."""
    order = np.argsort(ids, kind="stable")
    ids = ids[order]
    first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]]) if len(ids) else np.zeros(0, np.int64)
    return ids[first], *(np.add.reduceat(x[order], first) if len(first) else x for x in sums)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up (id, n): the counts of a task's identifiers, in arrays by block, sent once they are HELD or all are read."""

    def send(ids: np.ndarray, occ: np.ndarray, pres: np.ndarray) -> pa.RecordBatch:
        block = ids // BLOCK
        first = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
        offsets = pa.array(np.r_[first, len(ids)], pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x, kind)) for x, kind in ((ids % BLOCK, pa.int32()), (occ, pa.int64()), (pres, pa.int64()))]
        return pa.RecordBatch.from_arrays([pa.array(block[first], pa.int64()), *lists], names=["block", "at", "occurrences", "presence"])

    held = (np.zeros(0, np.int64),) * 3
    fresh: list[tuple[np.ndarray, ...]] = []
    size = 0
    for b in batches:
        ids, n = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        fresh.append(_counted(ids, n, np.ones(len(ids), np.int64)))
        size += len(fresh[-1][0])
        if size > max(len(held[0]), HELD // 4):
            held = _counted(*(np.concatenate(x) for x in zip(held, *fresh, strict=True)))
            fresh, size = [], 0
            if len(held[0]) >= HELD:
                yield send(*held)
                held = (np.zeros(0, np.int64),) * 3
    held = _counted(*(np.concatenate(x) for x in zip(held, *fresh, strict=True)))
    if len(held[0]):
        yield send(*held)


def _sum(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums the arrays of one block; one pair of arrays is held, whatever number comes."""
    total = np.zeros((2, BLOCK), np.int64)
    for b in batches:
        at = b.column("at").flatten().to_numpy()
        for i, name in enumerate(("occurrences", "presence")):
            np.add.at(total[i], at, b.column(name).flatten().to_numpy())
    at = np.flatnonzero(total[1])
    yield pa.RecordBatch.from_arrays([pa.array(at + key[0].as_py() * BLOCK), pa.array(total[0][at]), pa.array(total[1][at])], names=["id", "occurrences", "presence"])


def term_frequency(pairs: DataFrame) -> DataFrame:
    """(term, occurrences, presence) of pairs (term, n), one row for each record that holds the term, n times in it.

    Terms are encoded by the dictionary, the counts are taken in arrays by block of identifiers where the encoded rows
    are, and the arrays are summed by block: what is shuffled for the counts has the size of the dictionary, not of the
    rows. Null terms are dropped. A hot term's rows are split over tasks by adaptive execution; its counts add up."""
    rows = pairs.filter(F.col("term").isNotNull())
    ids = dictionary(rows)
    coded = rows.join(ids, "term").select("id", "n")
    arrays = coded.mapInArrow(_blocks, "block long, at array<int>, occurrences array<long>, presence array<long>")
    sums = arrays.groupBy("block").applyInArrow(_sum, "id long, occurrences long, presence long")
    return sums.join(ids, "id").select("term", "occurrences", "presence")


def tag_frequency(gtp: DataFrame) -> DataFrame:
    """tag, records (distinct gtp_id), files (distinct normal paths) and all_files (of the whole table) for each distinct tag.

    Values that are no tags don't count, but the paths of their records do; a null path is no file. Repeated rows count
    once. Records without a path count as records only. Paths take part as 96-bit hashes."""
    path = normal_path(F.col("path"))
    p1, p2 = wide_hash(path)
    rows = gtp.select("gtp_id", F.when(is_tag(F.col("tag")), F.col("tag")).alias("term"), F.when(path.isNotNull(), p1).alias("p1"), F.when(path.isNotNull(), p2).alias("p2")).distinct()
    pairs = rows.groupBy("term", "p1", "p2").agg(F.count("*").alias("n"))
    files = gtp.select(p1.alias("p1"), p2.alias("p2")).filter(path.isNotNull()).distinct().agg(F.count("*").alias("all_files"))
    counts = term_frequency(pairs)
    unnamed = pairs.filter("term IS NOT NULL AND p1 IS NULL").select("term", F.lit(1).alias("less"))
    out = counts.join(unnamed, "term", "left").select(F.col("term").alias("tag"), F.col("occurrences").alias("records"), (F.col("presence") - F.coalesce("less", F.lit(0))).alias("files"))
    return out.withColumn("all_files", files.scalar())


def marked_tags(gtp: DataFrame, rare: int = 3, common: float = 0.05) -> DataFrame:
    """tag_frequency with mark: ``rare`` below ``rare`` records, ``common`` in more than the share ``common`` of all
    files, null for useful tags; a tag that is both comes out once for each mark."""
    marks = F.array_compact(F.array(F.when(F.col("records") < rare, "rare"), F.when(F.col("files") > F.col("all_files") * F.lit(common), "common")))
    return tag_frequency(gtp).withColumn("mark", F.explode_outer(marks))
