"""What the training-data operators share: byte-level text kernels that run inside Arrow batches, the shared folder, and row plumbing.

The kernels work on the concatenated UTF-8 bytes of many documents at a time. Documents never run into each other:
every function takes the offsets of the documents and breaks words and windows there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_dir

#: Bytes of text that one kernel call works on; a single longer document makes a chunk of its own.
CHUNK_BYTES = 1 << 20

#: Bases of two independent polynomial hashes, and their inverses.
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
_INVERSES = tuple(np.uint64(pow(int(b), -1, 1 << 64)) for b in _BASES)
#: Words of more bytes are hashed by BLAKE2: polynomials modulo a power of two collide on long patterns of two letters.
LONG_WORD = 64
_BYTE_CODE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_OTHER_CODE = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

#: A-Z to a-z; every other byte stays.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words after lower-casing: 0-9, a-z and everything from 0x80.
WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[48:58] = WORD_BYTE[65:91] = WORD_BYTE[97:123] = True
WORD_BYTE[128:] = True
#: The same words for JVM regular expressions, applied after translate(text, A-Z, a-z).
WORD_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER_ASCII, LOWER_ASCII = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers[name] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser: spreads the low entropy of polynomial hashes over all 64 bits."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def prefix_hash(codes: np.ndarray, other: bool = False) -> np.ndarray:
    """Prefix sums of codes[i] * base**i modulo 2**64; span_hash() reads the hash of any span from them. other: by the second base."""
    out = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * _power(f"up{other}", _BASES[other], len(codes)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, other: bool = False) -> np.ndarray:
    """Hash of codes[start:end], the same wherever the span stands; the length is part of it. other: as in prefix_hash()."""
    inverse = _power(f"down{other}", _INVERSES[other], len(prefix))
    return mix((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(np.uint64) * np.uint64(0x632BE59BD9B4E019))


def span_order(prefix: np.ndarray, size: int) -> np.ndarray:
    """For each start, a number by which spans of one size are put in order, the same wherever the span stands; its high bits are spread."""
    return (prefix[size:] - prefix[:-size]) * _power("downFalse", _INVERSES[0], len(prefix))[: len(prefix) - size]


def byte_codes(data: np.ndarray) -> np.ndarray:
    return _BYTE_CODE[data]


def text_chunks(batch: pa.RecordBatch, column: str, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yields (first row, row after the last, bytes, offsets of the rows in them) over a string or binary column; null is empty."""
    array = batch.column(column)
    if array.null_count:
        array = pa.array([b"" if x is None else x for x in array.cast(pa.large_binary()).to_pylist()], pa.large_binary())
    elif not pa.types.is_large_binary(array.type):
        array = array.cast(pa.large_binary())
    n = len(array)
    if not n:
        return
    offsets = np.frombuffer(array.buffers()[1], np.int64, n + 1, array.offset * 8)
    data = np.frombuffer(array.buffers()[2], np.uint8) if array.buffers()[2] is not None and offsets[-1] else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word starts, word ends and, for each document, the index of its first word (one entry more than documents)."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = WORD_BYTE[data]
    first, last = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    if len(data):
        cuts = offsets[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(data))]
        cuts = cuts[inside[cuts + 1] & inside[cuts]]
        first[cuts], last[cuts - 1] = True, True
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(start, offsets)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, other: bool = False) -> np.ndarray:
    """A hash of each word, lower-cased. other: a second, independent one, of another base and other codes."""
    low = LOWER[data]
    out = span_hash(prefix_hash((_OTHER_CODE if other else _BYTE_CODE)[low], other), start, end, other)
    for i in np.flatnonzero(end - start > LONG_WORD).tolist():
        out[i] = np.frombuffer(hashlib.blake2b(low[start[i] : end[i]].tobytes(), digest_size=16).digest(), np.uint64)[int(other)]
    return out


def gram_hashes(hashes: np.ndarray, first: np.ndarray, n: int, other: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every n consecutive words by its first word, and whether they are of one document. other: by the second base."""
    total = len(hashes)
    if total < n:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    at = np.arange(total - n + 1)
    whole = np.ones(total - n + 1, bool)
    for j in range(1, n):  # a window that a document's start cuts
        cut = first[1:-1] - j
        whole[cut[(cut >= 0) & (cut < len(whole))]] = False
    return span_hash(prefix_hash(hashes, other), at, at + n, other), whole


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """min(values[i:i + width]) for each i that has so many."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def sliding_max(values: np.ndarray, width: int) -> np.ndarray:
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.maximum(out[: len(out) - step], out[step:])
        have += step
    return out


def through_disk(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it again: later steps reread it instead of computing it twice, and lost executors cost nothing."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    before = spark.conf.get(_CLEAN, None)
    try:
        spark.conf.set(_CLEAN, "true")  # the shuffles of this write are of no use after it
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN, before) if before is not None else spark.conf.unset(_CLEAN)
    return spark.read.schema(df.schema).parquet(path)


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(column):
    return F.translate(column, UPPER_ASCII, LOWER_ASCII)


def fresh(df: DataFrame, name: str) -> str:
    """name, with underscores after it until no column of df is called so in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def annotate(df: DataFrame, function, name: str, kind: str, rows: int = 1024) -> DataFrame:
    """df with a column appended by function(batch) -> pa.Array, one value per row, in one pass over Arrow batches without a shuffle. Batches are worked on in slices of `rows`, which bounds a worker's memory."""
    name = fresh(df, name)
    out = df.withColumn(name, F.lit(None).cast(kind))
    schema = out.schema

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        want = to_arrow_type(schema[name].dataType)
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                batch = whole.slice(at, rows)
                made = function(batch)
                yield pa.RecordBatch.from_arrays([*batch.columns, made.cast(want) if made.type != want else made], [*batch.schema.names, name])

    return df.mapInArrow(run, schema)


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys out of sorted batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy() for k in keys]
        turn = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        for a, z in zip(np.r_[0, turn], np.r_[turn, batch.num_rows], strict=True):
            key = tuple(c[a] for c in columns)
            if last is not None and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, z - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)
