"""Encoding of a corpus with a byte-level BPE vocabulary through a table of its distinct words.

Texts are split into words by array operations on their code points; each distinct word is encoded once; its ids come
back to every place where it stands. Words travel as (128-bit hash, block of documents), so what is shuffled is the
texts once and each block's distinct words, never one row for each word of the corpus.
"""

from __future__ import annotations

import base64
import hashlib
import math
import os
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The vocabulary's file: base64 of each token's bytes and its rank, which is its id.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Bytes of text that are handled at once; a block holds more only where a single text does.
BLOCK_BYTES = 2 << 20
#: Blocks whose words one task encodes: of a word that stands in every block no task gets more rows.
SPREAD = 4096
#: Words of more characters are hashed one by one.
LONG = 256
SEEDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)  # odd, any
# White space of the word pattern.
SPACES = [*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
SPACE, LETTER, NUMBER, OTHER = range(4)


@cache
def _classes() -> np.ndarray:
    """Class of each code point."""
    import unicodedata

    out = np.full(0x110000, OTHER, np.uint8)
    for cp in (*range(0x34000), *range(0xE0000, 0xE0200)):
        kind = unicodedata.category(chr(cp))[0]
        if kind == "L":
            out[cp] = LETTER
        elif kind == "N":
            out[cp] = NUMBER
    out[SPACES] = SPACE
    return out


@cache
def _values(i: int) -> np.ndarray:
    """A scattered 64-bit value for each code point."""
    with np.errstate(over="ignore"):
        x = (np.arange(0x110000, dtype=np.uint64) + np.uint64(1)) * np.uint64(SEEDS[i])
        for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
        return x ^ (x >> np.uint64(31))


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(i: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash's base and of its inverse modulo 2**64."""
    if i not in _POWERS or len(_POWERS[i][0]) < n:
        base = SEEDS[1 - i]
        up, down = np.full(n, base, np.uint64), np.full(n, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _POWERS[i] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _POWERS[i][0][:n], _POWERS[i][1][:n]


def word_starts(cps: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where words start, in texts given as code points row after row; ends: where each row ends.

    The words are those of the pattern: 's 't 're 've 'm 'll 'd, then a run of letters, of numbers or of others with at
    most one ordinary space before it, then white space, of which the last character stays apart if a word follows."""
    n = len(cps)
    if not n:
        return np.zeros(0, np.int64)
    kind = _classes()[cps]
    first = np.zeros(n + 1, bool)  # rows' first characters, and the end
    first[0] = True
    first[ends] = True
    first = first[:n]
    change = np.r_[True, kind[1:] != kind[:-1]] | first
    space = kind == SPACE
    # the last of a space run, if a word follows in the same row
    last = np.zeros(n, bool)
    last[:-1] = space[:-1] & ~space[1:] & ~first[1:]
    joins = last & (cps == 0x20)
    start = change.copy()
    start |= last  # splits from the run before it
    start[1:] &= ~joins[:-1]  # the word goes with the space
    # contractions: an apostrophe alone, not after a joined space, before fitting letters
    q = np.flatnonzero((cps == 0x27) & start)
    q = q[q + 1 < n]
    q = q[(kind[q + 1] == LETTER) & ~first[q + 1]]
    if len(q):
        a = cps[q + 1]
        two = q[np.isin(a, [ord(c) for c in "stmd"])] + 2
        q3 = q[q + 2 < n]
        q3 = q3[~first[q3 + 2]]
        a, b = cps[q3 + 1], cps[q3 + 2]
        three = q3[((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))] + 3
        for tail, back in ((two, 2), (three, 3)):
            start[tail - back + 1] = False
            start[tail[tail < n]] = True
    return np.flatnonzero(start)


def word_hashes(cps: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each word, by prefix sums."""
    n = len(cps)
    stops = np.r_[starts[1:], n]
    long = np.flatnonzero(stops - starts > LONG)
    out = []
    with np.errstate(over="ignore"):
        for i in (0, 1):
            up, down = _powers(i, n + 1)
            sums = np.r_[np.uint64(0), np.cumsum(_values(i)[cps] * up[:n], dtype=np.uint64)]
            h = (sums[stops] - sums[starts]) * down[starts]
            out.append(h ^ (h >> np.uint64(29)))
    for k in long:
        d = hashlib.blake2b(cps[starts[k] : stops[k]].tobytes(), digest_size=16).digest()
        for i in (0, 1):
            out[i][k] = int.from_bytes(d[8 * i : 8 * i + 8], "little")
    return out[0], out[1]


def code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all rows and where each row ends; null as empty."""
    texts = texts.cast(pa.large_string())
    if not len(texts):
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    cps = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32)
    return cps, np.r_[0, np.cumsum((raw & 0xC0) != 0x80)][offsets[1:] - offsets[0]]


def _pieces(texts: pa.Array, most: int) -> Iterator[pa.Array]:
    """Slices of at most ``most`` bytes, or of one row."""
    size = pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.r_[0, np.cumsum(size)[:-1]] // most
    cuts = np.r_[0, np.flatnonzero(np.diff(part)) + 1, len(texts)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield texts.slice(a, b - a)


def _strings(cps: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """The words at starts as an Array of binary UTF-8."""
    upto = np.cumsum(sizes)
    flat = cps[np.repeat(starts - np.r_[0, upto[:-1]], sizes) + np.arange(upto[-1] if len(upto) else 0)]
    width = 1 + (flat >= 0x80).astype(np.int64) + (flat >= 0x800) + (flat >= 0x10000)
    at = np.r_[0, np.cumsum(width)][np.r_[0, upto]].astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(flat.astype("<u4").tobytes().decode("utf-32-le").encode())])


def _distinct(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Index of one word of each distinct pair of hashes."""
    _, at, to = np.unique(h1, return_index=True, return_inverse=True)
    if (h2[at][to] == h2).all():
        return at
    order = np.lexsort((h2, h1))  # two words share the first hash
    return order[np.r_[True, (np.diff(h1[order]) != 0) | (np.diff(h2[order]) != 0)]]


def _block_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, h1, h2, word): each block's distinct words, repeated only over batches."""
    import pyarrow.compute  # noqa: F401

    for b in batches:
        block = b.column(0).to_numpy(zero_copy_only=False)
        order = np.argsort(block, kind="stable")
        of, texts = block[order], b.column(1).take(pa.array(order))
        cuts = np.r_[0, np.flatnonzero(np.diff(of)) + 1, len(of)]
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            for part in _pieces(texts.slice(i, j - i), BLOCK_BYTES):
                cps, ends = code_points(part)
                starts = word_starts(cps, ends)
                if not len(starts):
                    continue
                h1, h2 = word_hashes(cps, starts)
                at = _distinct(h1, h2)
                sizes = np.diff(np.r_[starts, len(cps)])[at]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), of[i], np.int32)), pa.array(h1[at].view(np.int64)), pa.array(h2[at].view(np.int64)), _strings(cps, starts[at], sizes)], names=["block", "h1", "h2", "word"]
                )


def shipped(spark, path: str) -> str:
    """The vocabulary's path, after its file was sent to all executors where the driver has it."""
    if os.path.exists(path):
        spark.sparkContext.addFile(path)
    return path


def _here(path: str) -> str:
    """Where this worker has the file: among those sent with the job, else at its own path."""
    from pyspark import SparkFiles

    try:
        sent = SparkFiles.get(os.path.basename(path))
    except Exception:  # no job here
        return path
    return sent if os.path.exists(sent) else path


@cache
def ranks(path: str) -> dict[bytes, int]:
    """Bytes of each token and its id."""
    with open(_here(path), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@cache
def _encoder(path: str):
    import tiktoken

    return tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks(path), special_tokens={})._core_bpe.encode_single_piece


def _encode_words(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(path)
        last, ids = None, []
        for b in batches:  # sorted by hash: equal words stand together
            h1, h2 = b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_numpy(zero_copy_only=False)
            new = np.r_[(h1[0], h2[0]) != last, (np.diff(h1) != 0) | (np.diff(h2) != 0)] if len(h1) else np.zeros(0, bool)
            words, made = b.column(3), []
            fresh = np.flatnonzero(new)
            if len(h1) and not new[0]:
                made.append(ids)
            made += [encode(w) for w in words.take(pa.array(fresh)).to_pylist()]
            which = np.cumsum(new) - (1 if len(h1) and new[0] else 0)
            if made:
                last, ids = (h1[-1], h2[-1]), made[-1]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(made, pa.list_(pa.int32())).take(pa.array(which))], names=["block", "h1", "h2", "ids"])

    return run


def _find(k1: np.ndarray, k2: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Place of each (h1, h2) among the pairs (k1, k2)."""
    order = np.argsort(k1, kind="stable")
    at = order[np.minimum(np.searchsorted(k1, h1, sorter=order), len(k1) - 1)]
    bad = np.flatnonzero((k1[at] != h1) | (k2[at] != h2))
    if len(bad):  # another word has the same first hash
        place = {p: i for i, p in enumerate(zip(k1.tolist(), k2.tolist(), strict=True))}
        at[bad] = [place[p] for p in zip(h1[bad].tolist(), h2[bad].tolist(), strict=True)]
    return at


def _join(counts: bool):
    def run(docs: pa.Table, words: pa.Table) -> pa.Table:
        import pyarrow.compute  # noqa: F401

        keys, texts = docs.column("id").combine_chunks(), docs.column("text").combine_chunks()
        cps, ends = code_points(texts)
        starts = word_starts(cps, ends)
        firsts = np.searchsorted(starts, np.r_[0, ends])  # number of the first word of each row
        if len(starts):
            ids = words.column("ids").combine_chunks()
            size = np.diff(ids.offsets.to_numpy())
            begin = ids.offsets.to_numpy()[:-1] - ids.offsets[0].as_py()
            flat = ids.flatten().to_numpy(zero_copy_only=False)
            at = _find(words.column("h1").to_numpy().view(np.uint64), words.column("h2").to_numpy().view(np.uint64), *word_hashes(cps, starts))
            upto = np.r_[0, np.cumsum(size[at], dtype=np.int64)]
        else:
            upto = np.zeros(1, np.int64)
        bounds = upto[firsts]
        if counts:
            return pa.table({"id": keys, "tokens": pa.array(np.diff(bounds))})
        out = flat[np.repeat(begin[at] - upto[:-1], size[at]) + np.arange(upto[-1])] if len(starts) else np.zeros(0, np.int32)
        return pa.table({"id": keys, "ids": pa.LargeListArray.from_arrays(pa.array(bounds), pa.array(out.astype(np.int32))).cast(pa.list_(pa.int32()))})

    return run


def encode(df: DataFrame, key: str, text: str, vocabulary: str = VOCABULARY, counts: bool = False) -> DataFrame:
    """(key, ids ARRAY<INT>) for each row, or (key, tokens BIGINT) with ``counts``; empty and null texts have no ids: [] and 0.

    One pass sums the bytes of the texts for the number of blocks. Rows are dealt to blocks by a hash of key and
    text, each block's distinct words are sent by hash to where each word is encoded once, and back to the block,
    which meets its texts there and puts the ids at the words' places. Both shuffles spread evenly, whatever text
    or word is frequent: a word comes at most once from each block and batch, and the words of each SPREAD blocks are encoded
    apart, so no task gets more rows of one word than that. A task of the last step has two blocks, whatever
    number of partitions the session sets. The vocabulary's file is sent to the executors. Whole texts are encoded, however long. Repeated
    rows and keys come out as often as they are in; extra columns are ignored."""
    spark = df.sparkSession
    rows = df.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    blocks = max(1, math.ceil(total / BLOCK_BYTES))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks)).cast("int"))
    words = rows.select("block", "text").mapInArrow(_block_words, "block int, h1 long, h2 long, word binary")
    words = words.repartition("h1", F.floor(F.col("block") / SPREAD)).sortWithinPartitions("h1", "h2").mapInArrow(_encode_words(shipped(spark, vocabulary)), "block int, h1 long, h2 long, ids array<int>")
    kind = rows.schema["id"].dataType.simpleString()
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(blocks / 2))
    rows, words = rows.repartition(tasks, "block"), words.repartition(tasks, "block")
    out = rows.groupBy("block").cogroup(words.groupBy("block")).applyInArrow(_join(counts), f"id {kind}, " + ("tokens long" if counts else "ids array<int>"))
    return out.withColumnRenamed("id", key)


@cache
def pieces(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The table of pieces by id: size and place of each id's bytes, and all bytes; size 0 for ids without a piece."""
    known = {i: x for x, i in ranks(path).items()}
    size = np.zeros(max(known) + 1, np.int64)
    for i, x in known.items():
        size[i] = len(x)
    return size, np.r_[0, np.cumsum(size)[:-1]], np.frombuffer(b"".join(known.get(i, b"") for i in range(len(size))), np.uint8)


def _decode_batch(lists: pa.Array, path: str) -> pa.Array:
    size, place, flat = pieces(path)
    offsets = lists.offsets.to_numpy()
    ids = pa.compute.fill_null(lists.flatten(), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = np.r_[0, np.cumsum(pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy(zero_copy_only=False))] if lists.null_count else offsets - offsets[0]
    known = (ids >= 0) & (ids < len(size))
    ids = np.where(known, ids, 0)
    n = np.where(known, size[ids], 0)
    upto = np.r_[0, np.cumsum(n)]
    out = flat[np.repeat(place[ids] - upto[:-1], n) + np.arange(upto[-1])]
    made = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(upto[offsets].astype(np.int64).tobytes()), pa.py_buffer(out.tobytes())])
    try:
        made = made.cast(pa.large_string())
    except pa.ArrowInvalid:  # some row is no UTF-8
        made = pa.array([x.decode(errors="replace") for x in made.to_pylist()], pa.large_string())
    return pa.compute.if_else(lists.is_null(), pa.scalar(None, pa.large_string()), made) if lists.null_count else made


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        for b in batches:
            lists = b.column(1)
            count = pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            part = np.r_[0, np.cumsum(count)[:-1]] // (BLOCK_BYTES // 4)
            cuts = np.r_[0, np.flatnonzero(np.diff(part)) + 1, len(lists)] if len(lists) else []
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), _decode_batch(lists.slice(i, j - i), path).cast(pa.string())], names=["id", "text"])

    return run


def decode(df: DataFrame, key: str, ids: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, text): the text of each row's ids, by a join of the ids with the table of pieces where the rows are: a gather
    by id for a whole batch, so nothing is shuffled. Ids without a piece have none; bytes that are no UTF-8 become
    U+FFFD; a null list stays null, an empty one is the empty text. Repeated rows come out as often."""
    rows = df.select(F.col(key).alias("id"), F.col(ids).cast("array<int>").alias("ids"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_decode(shipped(df.sparkSession, vocabulary)), f"id {kind}, text string").withColumnRenamed("id", key)
