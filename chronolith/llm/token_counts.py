"""Token counts without ids: pieces are counted once per distinct pre-token and summed over the
pre-token frequencies of each document."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from chronolith.llm.common import list_array, most_frequent, signed, slices, span_hashes, stored

TOKENIZER = "piece_bpe_32k.model"
#: So many of the most frequent pre-tokens are sent to every task (16 bytes each); all others are joined.
FREQUENT = 1 << 18
SPACE, NEWLINE = 0x20, 0x0A


def pretokens(column: pa.Array | pa.ChunkedArray):
    """For each slice of texts: its bytes, starts, ends and text number of all pre-tokens.

    A pre-token is a run of spaces with what follows it up to the next space or line feed; a line feed
    stands alone.  No piece of the vocabulary has a space after another character, and none holds a line
    feed, so no merge crosses these borders.  Each text gets the space in front that the tokenizer adds.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "")
    if pc.any(pc.match_substring(column, "▁")).as_py():
        column = pc.replace_substring(column, "▁", " ")
    column = pc.if_else(pc.equal(pc.binary_length(column), 0), "", pc.binary_join_element_wise(" ", column, ""))
    for s in slices(column):
        n = len(s.data)
        space, line = s.data == SPACE, s.data == NEWLINE
        begins = np.zeros(n + 1, bool)
        begins[1:n] = (space[1:] & ~space[:-1]) | line[1:] | (line[:-1] & ~space[1:])
        begins[s.offsets] = True
        begins[n] = False
        starts = np.flatnonzero(begins)
        ends = np.append(starts[1:], n) if n else starts
        yield s, starts, ends, np.searchsorted(s.offsets, starts, "right") - 1


def count_pieces(model, pretoken: str) -> int:
    """Pieces of one pre-token inside a text."""
    if pretoken in (" ", "\n"):
        return 1
    if pretoken[0] == " ":
        return len(model.encode(pretoken[1:], num_threads=1))
    return len(model.encode("\n" + pretoken, num_threads=1)) - 2  # without the space in front and the line feed


def _per_slice_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for s, starts, ends, _ in pretokens(batch.column(0)):
            if not len(starts):
                continue
            h, first, n = np.unique(span_hashes(s.data, starts, ends, fold=False), return_index=True, return_counts=True)
            a, b, raw = starts[first].tolist(), ends[first].tolist(), s.data.tobytes()
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(h)), pa.array([raw[i:j] for i, j in zip(a, b)], pa.binary()).cast(pa.string()),
                 pa.array(n.astype(np.int64))], ["h", "pretoken", "n"])


def pretoken_pieces(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """(h, n, pieces): every distinct pre-token of the corpus by its hash, how often it stands there, its pieces."""
    distinct = (docs.select(F.col(text).cast("string")).mapInArrow(_per_slice_counts, "h long, pretoken string, n long")
                .groupBy("h").agg(F.min("pretoken").alias("pretoken"), F.sum("n").alias("n")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array([count_pieces(model, p) for p in b.column(1).to_pylist()], pa.int64())],
                ["h", "n", "pieces"])

    return stored(distinct.mapInArrow(count, "h long, n long, pieces long"), "pretokens")


def token_counts(docs: DataFrame, path: str | None = None, limit: int = 4096, doc_id: str = "doc_id",
                 text: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit), one row per document row.

    A null or empty text has 0 bytes and 0 tokens; repeated rows give repeated results; other columns are
    ignored.  Counts of the most frequent pre-tokens (`frequent` of them, a fixed size) are looked up where
    the text is read; the rest goes through a join on the pre-token, which no longer has a hot key, and is
    summed by row.
    """
    path = path or public_tokenizers.path(TOKENIZER)
    spark = docs.sparkSession
    pieces = pretoken_pieces(docs, path, text)
    top = most_frequent(pieces, frequent).select("h", "pieces").toArrow()
    keys, values = (top.column(c).to_numpy() for c in (0, 1))
    order = np.argsort(keys)
    shared = spark.sparkContext.broadcast((keys[order], values[order].astype(np.int64)))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = shared.value
        row = TaskContext.get().partitionId() << 40
        for b in batches:
            for s, starts, ends, doc in pretokens(b.column(1)):
                m = s.last - s.first
                h = signed(span_hashes(s.data, starts, ends, fold=False))
                at = np.minimum(np.searchsorted(known, h), max(len(known) - 1, 0))
                hit = known[at] == h if len(known) else np.zeros(len(h), bool)
                base = np.bincount(doc[hit], counts[at[hit]], m).astype(np.int64) if hit.any() else np.zeros(m, np.int64)
                rest = ~hit
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row + np.arange(m)), b.column(0).slice(s.first, m), b.column(2).slice(s.first, m),
                     pa.array(base), list_array(h[rest], np.searchsorted(doc[rest], np.arange(m + 1)))],
                    ["row", "doc_id", "n_bytes", "base", "rest"])
                row += m

    kind = docs.schema[doc_id].dataType.simpleString()
    read = docs.select(F.col(doc_id), F.col(text).cast("string").alias("t"),
                       F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    rows = stored(read.mapInArrow(look_up, f"row long, doc_id {kind}, n_bytes long, base long, rest array<long>"), "counted")
    rest = rows.select("row", F.explode("rest").alias("h")).groupBy("row", "h").agg(F.count("*").alias("n"))
    extra = (rest.join(pieces.select("h", "pieces"), "h").groupBy("row")
             .agg(F.sum(F.col("n") * F.col("pieces")).alias("extra")))
    total = F.col("base") + F.coalesce("extra", F.lit(0))
    return (rows.join(extra, "row", "left")
            .select("doc_id", "n_bytes", total.alias("n_tokens"), (total > limit).alias("over_limit")))
