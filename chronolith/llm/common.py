"""Registry of the queries of this subpackage and what its operators share.

Texts reach Python as Arrow batches.  Words and their hashes are then found with array
operations over the bytes of many texts at once; no step works word by word.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from chronolith.sources.tables import work_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: A word: a run of code points that are neither space nor tab, line feed, VT, FF or CR.
WORD = r"[^\x20\x09-\x0D]+"


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return register


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage and survives lost executors."""
    path = f"{work_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex[:8]}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def crc_fold(doc_id: Column | str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % n


def crc_fold_sql(doc_id: str, n: int) -> str:
    return f"crc32({doc_id}) % {n}"


def most_frequent(counts: DataFrame, rows: int) -> DataFrame:
    """The `rows` rows of (h, n, ...) with the largest n, smallest h among equals; h is unique.

    The cut is found in the histogram of n.  Rows above it are taken; of those at it, as many as are still missing,
    after a cut of the same kind over ranges of the hash, so that no task sorts more than about `rows` rows.
    """
    if rows <= 0:
        return counts.limit(0)
    n = counts.groupBy("n").agg(F.count("*").alias("size"))
    by_n = Window.orderBy(F.desc("n"))
    cut = n.withColumn("upto", F.sum("size").over(by_n)).where(F.col("upto") >= rows).orderBy(F.desc("n")).first()
    if cut is None:
        return counts
    missing = rows - (cut["upto"] - cut["size"])
    above, at = counts.where(F.col("n") > cut["n"]), counts.where(F.col("n") == cut["n"])
    if missing == cut["size"]:
        return above.unionByName(at)
    piece = F.shiftright("h", 48)  # ranges of the hash in ascending order, 65,536 at most
    by_piece = Window.orderBy("piece")
    last = (at.groupBy(piece.alias("piece")).agg(F.count("*").alias("size"))
            .withColumn("upto", F.sum("size").over(by_piece)).where(F.col("upto") >= missing).orderBy("piece").first())
    rest = at.where(piece == last["piece"]).orderBy("h").limit(missing - (last["upto"] - last["size"]))
    return above.unionByName(at.where(piece < last["piece"])).unionByName(rest)


# --- words of many texts at once ---------------------------------------------------

_RNG = np.random.Generator(np.random.PCG64(20260101))
_TABLE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLDED = _TABLE.copy()
_FOLDED[65:91] = _TABLE[97:123]
_P = np.uint64(0x9E3779B97F4A7C15 | 3)
_P_INV = np.uint64(pow(int(_P), -1, 2**64))
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(n, 1 << 20)
        for k, base in ((0, _P), (1, _P_INV)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS[0][:n], _POWERS[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words in which every bit depends on every other."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Slice:
    """Some consecutive texts of a batch: rows [first, last), their bytes and where each starts."""

    def __init__(self, first: int, last: int, data: np.ndarray, offsets: np.ndarray):
        self.first, self.last, self.data, self.offsets = first, last, data, offsets

    def spans(self, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return start[:-1], start[1:]


def slices(column: pa.ChunkedArray | pa.Array, limit: int = 1 << 20) -> Iterator[Slice]:
    """Consecutive texts, about `limit` bytes at a time (a longer text comes alone); null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_large_string(column.type):
        kind, column = np.int64, column
    elif pa.types.is_string(column.type):
        kind = np.int32
    else:
        kind, column = np.int32, column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if n == 0:
        return
    width = np.dtype(kind).itemsize
    offsets = np.frombuffer(column.buffers()[1], kind, n + 1, column.offset * width).astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield Slice(first, last, data[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first])
        first = last


def words(s: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and where the words of each text begin (one more entry than texts)."""
    inside = ~IS_SPACE[s.data]
    n = len(inside)
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    edges = s.offsets[(s.offsets > 0) & (s.offsets < n)]
    before[edges] = False
    after[edges - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, s.offsets)


def running_hash(data: np.ndarray, fold: bool = True) -> np.ndarray:
    """Running sums out of which span_hashes takes the hash of any span of the bytes."""
    power, _ = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_FOLDED if fold else _TABLE)[data] * power[:len(data)], out=total[1:])
    return total


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True,
                total: np.ndarray | None = None) -> np.ndarray:
    """64-bit hash of the bytes of each span; with fold, A-Z count as a-z."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    total = running_hash(data, fold) if total is None else total
    inverse = _powers(len(data) + 1)[1]
    raw = (total[ends] - total[starts]) * inverse[starts]
    return mix(raw + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_hash(word: str, fold: bool = True) -> int:
    """The hash that span_hashes gives the word."""
    data = np.frombuffer(word.encode(), np.uint8)
    return int(span_hashes(data, np.array([0]), np.array([len(data)]), fold)[0])


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def list_array(values: np.ndarray, starts: np.ndarray) -> pa.ListArray:
    """Rows of a list column out of one flat array; starts has one more entry than rows."""
    return pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(values))


def append_columns(docs: DataFrame, keep: list[str], inputs: dict[str, Column], run: Callable, added: str) -> DataFrame:
    """Columns `keep` of the documents and, after them, the columns `added`.

    `run` is called once in each task and returns a function that takes the inputs of a batch and yields
    (first row, last row, the new columns of these rows).
    """
    # Columns travel under names by position: no name of the input can clash, and none is parsed.
    names = [f"in{k}" for k in range(len(inputs))]
    kept = docs.select(*[F.col(f"`{c}`") for c in keep])
    new = [x.split()[0].strip("`") for x in added.split(", ")]
    out = [f"keep{k}" for k in range(len(keep))] + [f"new{k}" for k in range(len(new))]
    schema = ", ".join([f"keep{k} {f.dataType.simpleString()}" for k, f in enumerate(kept.schema)]
                       + [f"new{k} {x.split(' ', 1)[1]}" for k, x in enumerate(added.split(", "))])
    frame = docs.select(*[F.col(f"`{c}`").alias(f"keep{k}") for k, c in enumerate(keep)],
                        *[c.alias(n) for n, c in zip(names, inputs.values())])

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = run()
        for batch in batches:
            for first, last, arrays in make(*[batch.column(len(keep) + k) for k in range(len(names))]):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(k).slice(first, last - first) for k in range(len(keep))] + arrays, out)

    return frame.mapInArrow(over, schema).toDF(*keep, *new)
