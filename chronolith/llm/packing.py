"""Best-fit packing planned on the histogram of lengths.

Pieces are never sorted or gathered.  Their lengths, at most `limit` different ones, are counted; the
driver fits counts of equal pieces into counts of equal sequences; each piece then takes its planned
slot by its rank among the pieces of its length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from chronolith.llm.bpe_codec import IdMemory
from chronolith.llm.common import stored

TOKENIZER = "word_bpe_49k.json"
LIMIT = 2048
END_ID = 0
#: Words that are encoded together, and what stands between them.
TOGETHER, MARK = 64, "\x1d"


class LibraryWords:
    """Ids of words by the tokenizers library.

    The tokenizer drops white space and splits at it before anything else, so the ids of a text are those of its words in
    turn; words are encoded together with a mark between them, and alone where a word holds the mark.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        probe = self._ids(f"a {MARK} a")
        if len(probe) != 3 or probe[0] != probe[2] or not np.array_equal(self._ids("a  a\n\ta"), probe[[0, 0, 0]]):
            raise ValueError(f"{path}: the tokenizer does not split at white space before everything else")
        self.mark = probe[1]

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int64)

    def encode(self, spans: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after the other, and how many each word has."""
        words = [w.decode("utf-8", "replace") for w in spans]
        alone = {k for k, w in enumerate(words) if MARK in w}
        count = np.zeros(len(words), np.int64)
        parts = []
        begin = 0
        while begin < len(words):
            if begin in alone:
                ids = self._ids(words[begin])
                count[begin] = len(ids)
                parts.append(ids)
                begin += 1
                continue
            end = begin + 1
            while end < len(words) and end - begin < TOGETHER and end not in alone:
                end += 1
            ids = self._ids(f" {MARK} ".join(words[begin:end]))
            marks = np.flatnonzero(ids == self.mark)
            count[begin:end] = np.diff(np.concatenate([[-1], marks, [len(ids)]])) - 1
            parts.append(ids[ids != self.mark])
            begin = end
        return (np.concatenate(parts) if parts else np.zeros(0, np.int64)), count


def cut_pieces(docs: DataFrame, path: str, limit: int, doc_id: str, text: str) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, and (task, nth): the piece is the nth of
    its length among those its task made."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        memory, task, seen = IdMemory(LibraryWords(path).encode), TaskContext.get().partitionId(), np.zeros(limit + 1, np.int64)
        for batch in batches:
            for first, last, ids, border in memory.texts(batch.column(1)):
                raw = np.insert(ids, border[1:], END_ID).astype("<u4").tobytes()
                size = np.diff(border) + 1
                begin = np.cumsum(size) - size
                pieces = -(-size // limit)
                doc = np.repeat(np.arange(last - first), pieces)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * limit
                length = np.minimum(size[doc] - start, limit)
                at = (begin[doc] + start) * 4
                crc = [zlib.crc32(raw[a:b]) for a, b in zip(at.tolist(), (at + length * 4).tolist())]
                # Rank within the length: pieces of the task before this slice, then those before it here.
                order = np.argsort(length, kind="stable")
                sorted_length = length[order]
                nth = np.empty(len(length), np.int64)
                nth[order] = np.arange(len(length)) - np.searchsorted(sorted_length, sorted_length) + seen[sorted_length]
                seen += np.bincount(length, minlength=limit + 1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, last - first).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start),
                     pa.array(length), pa.array(crc, pa.int64()), pa.array(np.full(len(doc), task, np.int32)), pa.array(nth)],
                    ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(
        run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, task int, nth long")


def plan_best_fit(counts: dict[int, int], limit: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts.

    Returns runs (length, first rank, pieces, per sequence, first sequence, first offset): the piece with
    rank r of the run goes to sequence first + (r - rank) // per sequence.  Sequences that are equally
    full are one entry (how many, first id), so the work depends on the number of lengths, not of pieces.
    """
    open_runs: dict[int, list[tuple[int, int]]] = {}
    free = np.zeros(limit + 1, bool)
    runs, made = [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            fits = np.flatnonzero(free[length:])
            if len(fits):
                room = length + int(fits[0])
                many, first = open_runs[room].pop()
                if not open_runs[room]:
                    free[room] = False
            else:
                room, first = limit, made
                many = -(-left // (limit // length))
                made += many
            per = room // length
            full = min(many, left // per)
            if full:
                runs.append((length, rank, full * per, per, first, limit - room))
                _open(open_runs, free, room - per * length, full, first)
                rank, left = rank + full * per, left - full * per
            if full < many and left and left < per:
                runs.append((length, rank, left, left, first + full, limit - room))
                _open(open_runs, free, room - left * length, 1, first + full)
                rank, left, full = rank + left, 0, full + 1
            if full < many:
                _open(open_runs, free, room, many - full, first + full)
    return runs


def _open(open_runs, free, room: int, many: int, first: int) -> None:
    if room > 0:
        open_runs.setdefault(room, []).append((many, first))
        free[room] = True


def best_fit_packing(docs: DataFrame, path: str | None = None, limit: int = LIMIT, doc_id: str = "doc_id",
                     text: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and a final id 0; only documents longer than `limit` are cut.  Null texts are
    empty (one id), repeated rows are packed each for themselves, other columns are ignored, an empty
    table gives no rows.  The pieces are written before they are ranked, so a lost executor cannot change
    ranks.  Read back to the driver: the histogram, at most `limit` rows; sent out: the plan, whose size is
    bounded by the number of lengths.
    """
    path = path or public_tokenizers.path(TOKENIZER)
    pieces = stored(cut_pieces(docs, path, limit, doc_id, text), "pieces")
    by_task = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = by_task.select("length", "task", (F.sum("n").over(
        Window.partitionBy("length").orderBy("task")) - F.col("n")).alias("before"))
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}
    runs = np.array(plan_best_fit(counts, limit), np.int64).reshape(-1, 6)
    runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
    shared = docs.sparkSession.sparkContext.broadcast(runs)
    width = max(counts.values(), default=0) + 1

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared.value
        keys = plan[:, 0] * width + plan[:, 1]
        for b in batches:
            length, rank = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            row = plan[np.searchsorted(keys, length * width + rank, "right") - 1]
            nth = rank - row[:, 1]
            columns = {n: b.column(n) for n in ("doc_id", "piece", "start", "length", "ids_crc32")}
            columns["sequence_id"] = pa.array(row[:, 4] + nth // row[:, 3])
            columns["offset"] = pa.array(row[:, 5] + nth % row[:, 3] * length)
            yield pa.RecordBatch.from_pydict(columns)

    ranked = pieces.join(before, ["length", "task"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"))
    kind = pieces.schema["doc_id"].dataType.simpleString()
    return ranked.mapInArrow(place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, "
                                    "sequence_id long, offset long")
