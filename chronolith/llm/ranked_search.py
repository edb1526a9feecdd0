"""Ranked lexical search over bit-sliced Bloom signatures.

The index holds blocks of documents of similar size: one row of bits for each place of the signature, one column for
each document.  A term sets its places once for each level of its frequency (at least 1, 2, 4, 16), so a term that
shows at some level is overestimated and never missed.  Weighted sums of the terms' rows bound every score from above.
Documents that reach the 50th best exact score of an item are scored exactly, all others are provably behind.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from chronolith.llm.common import mix, slices, span_hashes, stored

#: Least frequencies of the levels; a document's bound for a level uses the greatest frequency below the next one.
LEVELS = (1, 2, 4, 16)
#: Places of a term and bits of a signature for each entry (2.4 false places in a thousand).
PLACES, BITS = 4, 16
#: Documents of a block, and bits of a block at most (a single document may need more): rows of 128 KB.
BLOCK, BLOCK_BITS = 512, 1 << 20
#: Items that are answered together, and their distinct terms at most (one longer item comes alone).
ITEMS, ITEM_TERMS = 512, 1 << 15
_SALTS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)

# A term: a run of characters but the ASCII ones that are neither letters nor digits.
IS_TERM = np.ones(256, bool)
IS_TERM[:128] = [chr(c).isalnum() for c in range(128)]
#: Bytes of a long text that are hashed at once (plus the rest of a term).
PIECE = 1 << 20


def term_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all terms; none crosses an offset."""
    inside = IS_TERM[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    before[edges] = False
    after[edges - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """span_hashes in pieces of PIECE bytes, so that memory does not follow a long text."""
    if len(data) <= 2 * PIECE:
        return span_hashes(data, starts, ends)
    out = np.zeros(len(starts), np.uint64)
    k = 0
    while k < len(starts):
        upto = max(int(np.searchsorted(ends, starts[k] + PIECE, "right")), k + 1)
        low, high = int(starts[k]), int(ends[upto - 1])
        out[k:upto] = span_hashes(data[low:high], starts[k:upto] - low, ends[k:upto] - low)
        k = upto
    return out


def frequencies(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, last row, terms of each text with repeats, text, hash and frequency of each distinct term)."""
    for s in slices(column):
        starts, ends = term_spans(s.data, s.offsets)
        h = hash_spans(s.data, starts, ends)
        doc = np.searchsorted(s.offsets, starts, "right") - 1
        m = s.last - s.first
        order = np.lexsort((h, doc))
        doc, h = doc[order], h[order]
        new = np.ones(len(h), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
        at = np.flatnonzero(new)
        yield s.first, s.last, np.bincount(doc, minlength=m), doc[at], h[at], np.diff(np.append(at, len(h)))


def places(h: np.ndarray, level: int, width: np.ndarray | int) -> np.ndarray:
    """The PLACES places of each term in a signature of `width` bits."""
    salted = h[:, None] ^ (_SALTS[None, :] * np.uint64(2 * level + 1))
    return (mix(salted) % np.asarray(width, np.uint64)).astype(np.int64)


def build_blocks(n: np.ndarray, doc: np.ndarray, h: np.ndarray, tf: np.ndarray) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
    """(texts of a block, width, bits by place and text) for the texts with at least one term."""
    entries = np.zeros(len(n), np.int64)
    for least in LEVELS:
        entries += np.bincount(doc[tf >= least], minlength=len(n))
    border = np.searchsorted(doc, np.arange(len(n) + 1))
    order = np.argsort(entries, kind="stable")
    order = order[n[order] > 0][::-1]
    at = 0
    while at < len(order):
        width = int(-(-BITS * entries[order[at]] // 64)) * 64
        many = max(8, min(BLOCK, BLOCK_BITS // width))
        group = order[at:at + many]
        at += many
        bits = np.zeros((width, len(group)), bool)
        for k, text in enumerate(group.tolist()):
            own, own_tf = h[border[text]:border[text + 1]], tf[border[text]:border[text + 1]]
            for level, least in enumerate(LEVELS):
                chosen = own[own_tf >= least]
                if len(chosen):
                    bits[places(chosen, level, width).reshape(-1), k] = True
        yield group, width, np.packbits(bits, axis=1)


def index_documents(docs: DataFrame, terms: np.ndarray, doc_id: str, text: str) -> DataFrame:
    """The index: (ids, n, width, bits) by block; and rows (df_at, df_n, total, texts) with the document frequencies of the
    sorted hashes `terms` in each slice."""
    kind = docs.schema[doc_id].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value
        names = ["ids", "n", "width", "bits", "df_at", "df_n", "total", "texts"]
        df, total, texts = np.zeros(len(wanted), np.int64), 0, 0
        id_type = None
        for batch in batches:
            id_type = batch.schema.field(0).type
            for first, last, n, doc, h, tf in frequencies(batch.column(1)):
                at = np.minimum(np.searchsorted(wanted, h), max(len(wanted) - 1, 0))
                if len(wanted):
                    df += np.bincount(at[wanted[at] == h], minlength=len(wanted))
                total, texts = total + int(n.sum()), texts + int((n > 0).sum())
                own = batch.column(0).slice(first, last - first)
                for group, width, bits in build_blocks(n, doc, h, tf):
                    ids = own.take(pa.array(group))
                    yield pa.RecordBatch.from_arrays(
                        [pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([n[group].tolist()], pa.list_(pa.int64())),
                         pa.array([width], pa.int64()), pa.array([bits.tobytes()], pa.binary()), pa.array([None], pa.list_(pa.int64())),
                         pa.array([None], pa.list_(pa.int64())), pa.array([0], pa.int64()), pa.array([0], pa.int64())], names)
        if id_type is not None:
            at = np.flatnonzero(df)
            yield pa.RecordBatch.from_arrays(
                [pa.array([None], pa.list_(id_type)), pa.array([None], pa.list_(pa.int64())), pa.array([0], pa.int64()),
                 pa.array([None], pa.binary()), pa.array([at.tolist()], pa.list_(pa.int64())),
                 pa.array([df[at].tolist()], pa.list_(pa.int64())), pa.array([total], pa.int64()), pa.array([texts], pa.int64())], names)

    read = docs.select(F.col(f"`{doc_id}`"), F.col(f"`{text}`").cast("string").alias("t"))
    return read.mapInArrow(run, f"ids array<{kind}>, n array<long>, width long, bits binary, df_at array<long>, "
                                "df_n array<long>, total long, texts long")


def weight(df: int, texts: int) -> int:
    return math.floor(1000 * math.log((2 * texts + 2) / (2 * df + 1)))


def share(tf, m):
    """What a term's weight is multiplied by, in whole numbers."""
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def measure(n, texts: int, total: int):
    """The length term of a document with n terms."""
    return 100 - 50 + (50 * n * texts) // max(total, 1)


class Queries:
    """Items of a step: their terms (sorted hashes), and each item's terms and weights."""

    def __init__(self, items: list[np.ndarray], terms: np.ndarray, weights: np.ndarray, texts: int, total: int):
        self.terms, self.weights, self.texts, self.total = terms, weights, texts, total
        self.at = [np.searchsorted(terms, x) for x in items]
        # Sums of weights stay whole numbers in the narrow type while they are below its exact range.
        self.kind = np.float32 if max((int(np.abs(weights[x]).sum()) for x in self.at), default=0) < 1 << 24 else np.float64

    def bounds(self, n: np.ndarray, width: int, bits: bytes) -> np.ndarray:
        """Upper bounds of the scores, items by documents of a block.  Terms of negative weight cannot raise a score."""
        rows = np.frombuffer(bits, np.uint8).reshape(width, -1)
        m = measure(n, self.texts, self.total)
        top = [share(np.minimum(np.int64(LEVELS[k + 1] - 1), n), m) for k in range(len(LEVELS) - 1)] + [share(n, m)]
        out = np.zeros((len(self.at), len(n)), np.int64)
        positive = np.maximum(self.weights, 0)
        for level in range(len(LEVELS)):
            where = places(self.terms, level, width)
            present = rows[where[:, 0]]
            for k in range(1, PLACES):
                present = present & rows[where[:, k]]
            used = present.any(1)
            gain = top[level] - (top[level - 1] if level else 0)
            sums = np.zeros((len(self.at), len(n)), self.kind)
            for i, own in enumerate(self.at):
                own = own[used[own]]
                if len(own):
                    sums[i] = positive[own].astype(self.kind) @ np.unpackbits(present[own], axis=1, count=len(n)).astype(self.kind)
            out += sums.astype(np.int64) * gain
        return out


def bound_rows(index: DataFrame, shared, best: int, threshold=None) -> DataFrame:
    """(item, doc_id): without a threshold, the `best` highest bounds of each task and item with their bound; with one
    (a broadcast array by item), every document whose bound reaches it."""
    kind = index.schema["ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = shared.value
        least = None if threshold is None else threshold.value
        held = None
        for batch in batches:
            for k in range(batch.num_rows):
                ids, n = batch.column(0)[k].values, batch.column(1)[k].values.to_numpy()
                bound = queries.bounds(n, batch.column(2)[k].as_py(), batch.column(3)[k].as_buffer())
                if least is not None:
                    item, at = np.nonzero((bound >= least[:, None]) & (bound > 0))
                    if len(item):
                        yield pa.RecordBatch.from_arrays([pa.array(item), ids.take(pa.array(at)), pa.array(bound[item, at])], ["item", "doc_id", "bound"])
                    continue
                if bound.shape[1] > best:
                    at = np.argpartition(-bound, best - 1, axis=1)[:, :best]
                else:
                    at = np.broadcast_to(np.arange(bound.shape[1]), bound.shape)
                item = np.repeat(np.arange(len(bound)), at.shape[1])
                value = np.take_along_axis(bound, at, 1).reshape(-1)
                more = pa.table({"item": item, "doc_id": ids.take(pa.array(at.reshape(-1))), "bound": value})
                more = more.filter(pa.array(value > 0))
                held = more if held is None else pa.concat_tables([held, more])
                if held.num_rows > 8 * best * len(bound):
                    held = _best(held, best)
        if held is not None:
            yield from _best(held, best).combine_chunks().to_batches()

    return index.where("ids IS NOT NULL").select("ids", "n", "width", "bits").mapInArrow(run, f"item long, doc_id {kind}, bound long")


def _best(table: pa.Table, best: int) -> pa.Table:
    table = table.sort_by([("item", "ascending"), ("bound", "descending")])
    item = table.column("item").to_numpy()
    return table.filter(pa.array(np.arange(len(item)) - np.searchsorted(item, item) < best))


def exact_scores(docs: DataFrame, wanted: DataFrame, shared, doc_id: str, text: str) -> DataFrame:
    """(item, doc_id, score, row number inside the batch) for every row of a document that is wanted by some item."""
    kind = docs.schema[doc_id].dataType.simpleString()
    # Written first: the planner knows its size, and broadcasts a small list instead of moving the texts.
    lists = stored(wanted.groupBy("doc_id").agg(F.collect_set("item").alias("items")), "wanted")
    named = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").cast("string").alias("t"))
    read = named.join(lists, F.col("id").eqNullSafe(F.col("doc_id"))).select("id", "t", "items")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = shared.value
        for batch in batches:
            for first, last, n, doc, h, tf in frequencies(batch.column(1)):
                m = measure(n, queries.texts, queries.total)
                at = np.minimum(np.searchsorted(queries.terms, h), max(len(queries.terms) - 1, 0))
                hit = queries.terms[at] == h if len(queries.terms) else np.zeros(len(h), bool)
                doc, at, tf = doc[hit], at[hit], tf[hit]
                part = queries.weights[at] * share(tf, m[doc])
                border = np.searchsorted(doc, np.arange(last - first + 1))
                items, rows, scores = [], [], []
                for k in range(last - first):
                    own, value = at[border[k]:border[k + 1]], part[border[k]:border[k + 1]]
                    gain = np.zeros(len(queries.terms), np.int64)
                    gain[own] = value
                    for item in batch.column(2)[first + k].as_py():
                        items.append(item)
                        rows.append(first + k)
                        scores.append(int(gain[queries.at[item]].sum()))
                yield pa.RecordBatch.from_arrays([pa.array(items, pa.int64()), batch.column(0).take(pa.array(rows, pa.int64())),
                                                  pa.array(scores, pa.int64())], ["item", "doc_id", "score"])

    return read.mapInArrow(run, f"item long, doc_id {kind}, score long").where("score > 0")


def top_rows(scored: DataFrame, best: int, value: str) -> DataFrame:
    """The `best` rows of every item with their rank, in two steps, so that no task holds all rows of an item."""
    order = [F.desc(value), F.col("doc_id").asc_nulls_last()]
    dealt = scored.withColumn("part", F.pmod(F.xxhash64("doc_id", value), F.lit(64)))
    first = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("item", "part").orderBy(*order))).where(F.col("rank") <= best)
    return first.drop("part").withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= best)


def item_terms(items: DataFrame, item_id: str, text: str) -> tuple[list, list[np.ndarray]]:
    """Ids of the items and the sorted hashes of their terms."""
    table = items.select(F.col(f"`{item_id}`").alias("i"), F.col(f"`{text}`").cast("string").alias("t")).toArrow()
    ids, found = table.column(0).to_pylist(), []
    for first, last, _, doc, h, _ in frequencies(table.column(1).combine_chunks()):
        border = np.searchsorted(doc, np.arange(last - first + 1))
        found += [h[border[k]:border[k + 1]] for k in range(last - first)]
    return ids, found


def steps(found: list[np.ndarray]) -> Iterator[range]:
    """Consecutive items, ITEMS at most, with ITEM_TERMS terms at most (or one item)."""
    begin = 0
    while begin < len(found):
        end, size = begin + 1, len(found[begin])
        while end < len(found) and end - begin < ITEMS and size + len(found[end]) <= ITEM_TERMS:
            size += len(found[end])
            end += 1
        yield range(begin, end)
        begin = end


def ranked_search(docs: DataFrame, items: DataFrame, best: int = 50, doc_id: str = "doc_id", text: str = "text",
                  item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): each item's `best` documents with a score above 0, highest first, ties by doc_id.

    The items are the query set: their texts are read to the driver and answered in steps of bounded size; the index of
    the documents is written once for all steps.  Null and empty texts have no terms: such a document is never found,
    such an item gives no rows.  Rows that repeat a document are ranked each for themselves, rows that repeat an item are
    answered each; a null doc_id ranks last among equals; other columns are ignored, whatever their names; an empty table gives
    no rows.  Long texts are hashed in pieces, and a document larger than a block has a block of its own.
    """
    spark = docs.sparkSession
    ids, found = item_terms(items, item_id, item_text)
    terms = np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)
    index = stored(index_documents(docs, terms, doc_id, text), "index")
    sizes = index.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("texts"), F.lit(0))).first()
    total, texts = int(sizes[0]), int(sizes[1])
    df = np.zeros(len(terms), np.int64)
    counted = (index.where("df_at IS NOT NULL").select(F.explode(F.arrays_zip("df_at", "df_n")).alias("x"))
               .groupBy(F.col("x.df_at").alias("at")).agg(F.sum("x.df_n").alias("df"))).toArrow()
    df[counted.column(0).to_numpy()] = counted.column(1).to_numpy()
    weights = np.array([weight(int(d), texts) for d in df], np.int64)
    answers = None
    for step in steps(found):
        own = np.unique(np.concatenate([found[k] for k in step]))
        queries = Queries([found[k] for k in step], own, weights[np.searchsorted(terms, own)], texts, total)
        shared = spark.sparkContext.broadcast(queries)
        # Exact scores of the documents of highest bound give the score that the best ones reach at least.
        seeds = top_rows(bound_rows(index, shared, best), best, "bound").select("item", "doc_id")
        first = top_rows(exact_scores(docs, seeds, shared, doc_id, text), best, "score").where(F.col("rank") == best)
        least = np.ones(len(step), np.int64)
        for row in first.select("item", "score").collect():
            least[row["item"]] = row["score"]
        threshold = spark.sparkContext.broadcast(least)
        wanted = bound_rows(index, shared, best, threshold).select("item", "doc_id")
        ranked = top_rows(exact_scores(docs, wanted, shared, doc_id, text), best, "score")
        numbered = ranked.select((F.col("item") + step.start).alias("item"), F.col("rank").cast("int").alias("rank"), "doc_id", "score")
        answers = numbered if answers is None else answers.unionByName(numbered)
    kind = items.schema[item_id].dataType
    if answers is None:
        return spark.createDataFrame([], f"item_id {kind.simpleString()}, rank int, doc_id {docs.schema[doc_id].dataType.simpleString()}, score long")
    names = spark.createDataFrame([(k, i) for k, i in enumerate(ids)], f"item long, item_id {kind.simpleString()}")
    return answers.join(names, "item").select("item_id", "rank", "doc_id", "score")
