"""Alignment of two tokenizers over a corpus, and how often their tokens end together.

The first pass aligns the texts and gives pair counts of each task.  The distinct pairs get a minimal perfect hash
(by shards), the counts become dense vectors over its numbers, which are summed as a tree; the key kept at each
number is compared, so that no count goes to a wrong pair.  The second pass aligns the texts again and looks the
counts up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from chronolith.llm.bpe_codec import LETTERS
from chronolith.llm.common import list_array, most_frequent, stored
from chronolith.llm.perfect_hash import PerfectHash
from chronolith.llm.spans import Memory, Pool, chunks, gather

FIRST, SECOND = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Distinct pairs of a shard (about), leaves that are summed at once, and pairs whose counts are sent to every task
#: (25 bytes each); the counts of all others are joined.
SHARD, FAN, FREQUENT = 1 << 14, 32, 1 << 20
#: Bits of a pair's key that hold the second id.
SHIFT = 20
SPACE, NEWLINE = 0x20, 0x0A
_GROUP = 2000


def segment_starts(data: np.ndarray) -> np.ndarray:
    """Where a space or line feed follows a character that is no white space.

    The first tokenizer splits there before it merges, and no piece of the second has a space or line feed behind
    another character, so no token of either crosses these borders.
    """
    n = len(data)
    before = np.zeros((3, n), np.uint8)
    for k in range(3):
        before[k, k + 1:] = data[:n - k - 1]
    one, two, three = before
    ascii_space = (one == 0x20) | ((one >= 9) & (one <= 13))
    # Characters of two and three bytes that are white space, U+0085 to U+3000.
    wide = ((two == 0xC2) & ((one == 0x85) | (one == 0xA0))) | (
        (one >= 0x80) & ((two == 0x80) | (two == 0x81) | (two == 0x9A)) & (three >= 0xE1) & (three <= 0xE3))
    start = ((data == SPACE) | (data == NEWLINE)) & ~ascii_space & ~wide
    if n:
        start[0] = True
    return start


def next_segment(data: np.ndarray, at: int) -> int:
    while at < len(data):
        low = max(at - 3, 0)
        found = np.flatnonzero(segment_starts(data[low:at + 4096])[at - low:])
        if low == 0 and at == 0:
            found = found[found > 0]
        if len(found):
            return at + int(found[0])
        at += 4096
    return len(data)


class Pair:
    """The two tokenizers; the bytes of every token."""

    def __init__(self, first: str, second: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.first = Tokenizer.from_file(first)
        self.first.encode_special_tokens = True
        self.second = sentencepiece.SentencePieceProcessor(model_file=second)
        back = {c: b for b, c in enumerate(LETTERS)}
        vocab = self.first.get_vocab(with_added_tokens=False)
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for token, k in vocab.items():
            self.a_bytes[k] = bytes(back[c] for c in token)
        self.b_bytes = []
        for k in range(self.second.get_piece_size()):
            piece = self.second.id_to_piece(k)
            if self.second.is_byte(k):
                self.b_bytes.append(bytes([int(piece[1:-1], 16)]))
            elif self.second.is_control(k) or self.second.is_unknown(k):
                self.b_bytes.append(b"")
            else:
                if "▁" in piece.lstrip("▁") or "\n" in piece or " " in piece:
                    raise ValueError(f"{second}: the piece {piece!r} crosses a space")
                self.b_bytes.append(piece.replace("▁", " ").encode())
        self.a_size = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_size = np.array([len(x) for x in self.b_bytes], np.int64)
        if max(len(self.a_bytes), len(self.b_bytes)) >= 1 << SHIFT:
            raise ValueError("a vocabulary is too large for the keys of pairs")

    def encode(self, text: str) -> tuple[list[int], list[int]]:
        """Ids of a stretch of segments; it begins with a space or a line feed."""
        a = self.first.encode_batch_fast([text], add_special_tokens=False)[0].ids
        # The second adds a space: that of the text, or one that stands alone before a line feed.  It adds none to
        # an empty text, so a single space goes behind a line feed.
        if text[0] != " ":
            b = self.second.encode(text, num_threads=1)[1:]
        else:
            b = self.second.encode(text[1:], num_threads=1) if text != " " else self.second.encode("\n ", num_threads=1)[2:]
        return a, b

    def same(self, raw: bytes, a: list[int], b: list[int]) -> bool:
        return b"".join(map(self.a_bytes.__getitem__, a)) == raw and b"".join(map(self.b_bytes.__getitem__, b)) == raw


class Aligner:
    """Aligned segments, each distinct one worked out once: sizes, pair keys and (if asked for) the groups as text."""

    def __init__(self, pair: Pair, groups: bool, known=None):
        self.pair, self.groups, self.known = pair, groups, known
        self.memory = Memory(self._learn, self._forget)
        self.weights = None
        self._forget()
        if groups:
            a, b = ([str(k).encode() for k in range(n)] for n in (len(pair.a_bytes), len(pair.b_bytes)))
            self.a_text = [[x + b"," for x in a], [x + b"|" for x in a]]
            self.b_text = [[x + b"," for x in b], [x + b";" for x in b], [x + b"\n" for x in b]]

    def _forget(self) -> None:
        self.flush()
        self.bad = Pool(bool)
        self.n_a, self.n_b, self.n_links = Pool(np.int64), Pool(np.int64), Pool(np.int64)
        self.keys, self.start = Pool(np.int64), Pool(np.int64)
        self.total, self.best = Pool(np.int64), Pool(np.int64)
        self.rest, self.rest_start, self.rest_size = Pool(np.int64), Pool(np.int64), Pool(np.int64)
        self.text: list[bytes] = []
        self.seen = np.zeros(0, np.int64)

    def flush(self) -> None:
        """Hands the pair counts of the segments seen so far to `weights`."""
        if self.weights is not None and self.seen.any():
            rows = np.flatnonzero(self.seen)
            at = gather(self.start.values[rows], self.n_links.values[rows])
            self.weights(self.keys.values[at], np.repeat(self.seen[rows], self.n_links.values[rows]))
            self.seen[:] = 0

    def count(self, number: np.ndarray) -> None:
        more = np.bincount(number, minlength=self.memory.made)
        more[:len(self.seen)] += self.seen
        self.seen = more

    def _learn(self, spans: list[bytes]) -> None:
        # A segment that ends with white space ends its text; nothing may follow it.
        texts = [x.decode() for x in spans]
        apart = [k for k, x in enumerate(texts) if x[-1].isspace()]
        borders = sorted({*range(0, len(spans), _GROUP), *apart, *(k + 1 for k in apart), len(spans)})
        for low, high in zip(borders[:-1], borders[1:]):
            group = spans[low:high]
            raw = b"".join(group)
            a, b = self.pair.encode("".join(texts[low:high]))
            if self.pair.same(raw, a, b):
                self._add([len(x) for x in group], a, b)
                continue
            for one, text in zip(group, texts[low:high]):
                a, b = self.pair.encode(text)
                if self.pair.same(one, a, b):
                    self._add([len(one)], a, b)
                else:
                    self._add([0], [], [])
                    self.bad.values[self.bad.size - 1] = True

    def _add(self, sizes: list[int], a_ids: list[int], b_ids: list[int]) -> None:
        a, b = np.array(a_ids, np.int64), np.array(b_ids, np.int64)
        a_end, b_end, end = np.cumsum(self.pair.a_size[a]), np.cumsum(self.pair.b_size[b]), np.cumsum(sizes)
        both = np.intersect1d(a_end, b_end, assume_unique=True)
        a_last, b_last = np.searchsorted(a_end, both), np.searchsorted(b_end, both)
        keys = (a[a_last] << SHIFT) | b[b_last]
        n_a, n_b, links = (np.diff(np.searchsorted(x, end, "right"), prepend=0) for x in (a_end, b_end, both))
        m = len(sizes)
        self.bad.extend(np.zeros(m, bool))
        self.n_a.extend(n_a)
        self.n_b.extend(n_b)
        self.start.extend(self.keys.size + np.cumsum(links) - links)
        self.n_links.extend(links)
        self.keys.extend(keys)
        if self.known is not None:
            n, best, found = self.known(keys)
            upto = np.cumsum(links)
            for pool, value in ((self.total, n), (self.best, best)):
                run = np.concatenate([[0], np.cumsum(value)])
                pool.extend(run[upto] - run[upto - links])
            run = np.concatenate([[0], np.cumsum(~found)])
            rest = run[upto] - run[upto - links]
            self.rest_start.extend(self.rest.size + np.cumsum(rest) - rest)
            self.rest_size.extend(rest)
            self.rest.extend(keys[~found])
        if self.groups:
            if not len(both):
                self.text += [b""] * m
                return
            a_group, b_group = np.searchsorted(both, a_end), np.searchsorted(both, b_end)
            a_kind, b_kind = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
            a_kind[a_last], b_kind[b_last] = 1, 1
            b_kind[b_last[np.isin(both, end)]] = 2
            order = np.argsort(np.concatenate([2 * a_group, 2 * b_group + 1]), kind="stable").tolist()
            text = [self.a_text[k][i] for k, i in zip(a_kind.tolist(), a_ids)] + [self.b_text[k][i] for k, i in zip(b_kind.tolist(), b_ids)]
            self.text += b"".join([text[i] for i in order])[:-1].split(b"\n")

    def texts(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, bool]]:
        """(first row, last row, numbers of the segments, text of each, which texts have a bad segment, more to come)."""
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        column = pc.fill_null(column, "")
        # The second tokenizer takes U+2581 for a space, so such a text has no tokens; nor has an empty one.
        none = pc.or_(pc.equal(pc.binary_length(column), 0), pc.match_substring(column, "▁"))
        column = pc.if_else(none, "", pc.binary_join_element_wise(" ", column, ""))
        for s, more in chunks(column, next_segment):
            begin = segment_starts(s.data)
            begin[s.offsets[s.offsets < len(s.data)]] = True
            starts = np.flatnonzero(begin)
            ends = np.append(starts[1:], len(s.data)) if len(starts) else starts
            number = self.memory.number(s.data, starts, ends)
            text = np.searchsorted(s.offsets, starts, "right") - 1
            m = s.last - s.first
            yield s.first, s.last, number, text, np.bincount(text, self.bad.values[number], m) > 0, more


class _Sums:
    """Pair counts of a task, folded whenever they grow long."""

    def __init__(self):
        self.held, self.size, self.ready = [], 0, []

    def add(self, keys: np.ndarray, n: np.ndarray) -> None:
        unique, inverse = np.unique(keys, return_inverse=True)
        self.held.append((unique, np.bincount(inverse, n).astype(np.int64)))
        self.size += len(unique)
        if self.size > 4_000_000:
            self.fold()

    def fold(self) -> None:
        if self.held:
            keys, n = (np.concatenate(x) for x in zip(*self.held))
            unique, inverse = np.unique(keys, return_inverse=True)
            self.held = [(unique, np.bincount(inverse, n).astype(np.int64))]
            self.size = len(unique)
            if self.size > 2_000_000:
                self.ready += self.held
                self.held, self.size = [], 0


def task_counts(docs: DataFrame, first: str, second: str, text: str) -> DataFrame:
    """(key, n): how often each task links each pair; a key may come from several tasks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, sums = Aligner(Pair(first, second), groups=False), _Sums()
        aligner.weights = sums.add
        long, spoilt = [], False  # links of a text that comes in several chunks
        for batch in batches:
            for _first, _last, number, doc, bad, more in aligner.texts(batch.column(0)):
                if more or long:
                    at = gather(aligner.start.values[number], aligner.n_links.values[number])
                    keys, n = np.unique(aligner.keys.values[at], return_counts=True)
                    long.append((keys, n))
                    spoilt |= bool(bad.any())
                    if not more:
                        if not spoilt:
                            for keys, n in long:
                                sums.add(keys, n)
                        long, spoilt = [], False
                    continue
                aligner.count(number[~bad[doc]])
            yield from _emit(sums.ready)
            sums.ready = []
        aligner.flush()
        sums.fold()
        yield from _emit(sums.ready + sums.held)

    return docs.select(F.col(f"`{text}`").cast("string").alias("t")).mapInArrow(run, "key long, n long")


def _emit(parts, rows: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    for keys, n in parts:
        for k in range(0, len(keys), rows):
            yield pa.RecordBatch.from_arrays([pa.array(keys[k:k + rows]), pa.array(n[k:k + rows])], ["key", "n"])


def shard_hashes(keys: DataFrame, shards: int) -> DataFrame:
    """(shard, sizes, bits, keys): a minimal perfect hash of each shard's keys and the keys by number."""
    def build(key, table):
        own = table.column("key").to_numpy().astype(np.uint64)
        sizes, bits = PerfectHash.build(own)
        by_slot = np.zeros(len(own), np.int64)
        by_slot[PerfectHash(sizes, bits).slots(own)] = own.view(np.int64)
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int64()), "sizes": pa.array([sizes], pa.list_(pa.int64())),
                         "bits": pa.array([bits], pa.binary()), "keys": pa.array([by_slot.tobytes()], pa.binary())})

    return (keys.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)))
            .groupBy("shard").applyInArrow(build, "shard long, sizes array<long>, bits binary, keys binary"))


def dense_sums(counts: DataFrame, hashes: DataFrame, shards: int, leaves: int) -> DataFrame:
    """(shard, vector): counts by hash number, summed as a tree over `leaves` parts of the rows."""
    def leaf(key, rows, table):
        if not table.num_rows or not rows.num_rows:
            return pa.table({"shard": pa.array([], pa.int64()), "leaf": pa.array([], pa.int64()), "vector": pa.array([], pa.binary())})
        hashed = PerfectHash(table.column("sizes")[0].as_py(), table.column("bits")[0].as_py())
        by_slot = np.frombuffer(table.column("keys")[0].as_py(), np.int64)
        own = rows.column("key").to_numpy()
        slot = hashed.slots(own.view(np.uint64))
        if (slot < 0).any() or (by_slot[slot] != own).any():
            raise ValueError("a pair is not in the hash of its shard")
        vector = np.zeros(len(by_slot), np.int64)
        np.add.at(vector, slot, rows.column("n").to_numpy())
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int64()), "leaf": pa.array([key[1].as_py()], pa.int64()),
                         "vector": pa.array([vector.tobytes()], pa.binary())})

    def add(key, table):
        total = np.frombuffer(table.column("vector")[0].as_py(), np.int64).copy()
        for other in table.column("vector")[1:]:
            total += np.frombuffer(other.as_py(), np.int64)
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int64()), "leaf": pa.array([key[1].as_py()], pa.int64()),
                         "vector": pa.array([total.tobytes()], pa.binary())})

    schema = "shard long, leaf long, vector binary"
    dealt = counts.select(F.pmod(F.xxhash64("key"), F.lit(shards)).alias("shard"),
                          F.pmod(F.xxhash64("n", F.spark_partition_id()), F.lit(leaves)).cast("long").alias("leaf"), "key", "n")
    copies = hashes.withColumn("leaf", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(leaves - 1).cast("long"))))
    vectors = dealt.groupBy("shard", "leaf").cogroup(copies.groupBy("shard", "leaf")).applyInArrow(leaf, schema)
    while leaves > 1:
        leaves = -(-leaves // FAN)
        vectors = vectors.withColumn("leaf", F.pmod("leaf", F.lit(leaves)).cast("long")).groupBy("shard", "leaf").applyInArrow(add, schema)
    return vectors.select("shard", "vector")


def pair_counts(docs: DataFrame, first: str, second: str, text: str = "text", shard: int = SHARD) -> DataFrame:
    """(key, n, best): links of every pair over the corpus; best is 1 where no pair of its second id has more."""
    counts = stored(task_counts(docs, first, second, text), "task_counts")
    keys = stored(counts.select("key").distinct(), "keys")
    shards = max(1, -(-keys.count() // shard))
    leaves = max(1, -(-counts.count() // (shards * 8 * shard)))
    hashes = stored(shard_hashes(keys, shards), "hashes")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(batch.column(c)[k].as_py(), np.int64)) for c in (0, 1)], ["key", "n"])

    table = stored(hashes.select("shard", "keys").join(dense_sums(counts, hashes, shards, leaves), "shard")
                   .select("keys", "vector").mapInArrow(rows, "key long, n long"), "sums")
    second_id = F.col("key").bitwiseAND((1 << SHIFT) - 1)
    # One row for each id of a vocabulary: at most 2^SHIFT, and the planner sees the size.
    most = table.groupBy(second_id.alias("b")).agg(F.max("n").alias("most"))
    return stored(table.withColumn("b", second_id).join(most, "b")
                  .select("key", "n", (F.col("n") == F.col("most")).cast("long").alias("best")), "pairs")


def align_tokens(docs: DataFrame, first: str | None = None, second: str | None = None, doc_id: str = "doc_id",
                 text: str = "text", groups: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups), one row per document row.

    The first tokenizer encodes the text with a space in front, the second adds it itself.  Byte offsets where tokens of
    both end cut the text into groups; the two tokens that end at such an offset are a link, and a pair's count is the
    number of its links in all documents.  `groups` is "text" (a1,a2|b1;a3|b2,b3) or "sha256" for its digest in hex
    ('' without tokens).  A text that is null or empty, or whose tokens do not join to its bytes, has no tokens.
    Repeated rows count each for themselves and get equal rows; other columns are ignored, whatever their names; an
    empty table gives no rows; pairs of equal count are all best.  Long texts are aligned in chunks.
    """
    first, second = first or public_tokenizers.path(FIRST), second or public_tokenizers.path(SECOND)
    pairs = pair_counts(docs, first, second, text)
    top = most_frequent(pairs.select(F.xxhash64("key").alias("h"), "n", "key", "best"), frequent).select("key", "n", "best").toArrow()
    keys = top.column("key").to_numpy()
    sizes, bits = PerfectHash.build(keys.astype(np.uint64))
    table = np.zeros((3, len(keys)), np.int64)
    table[:, PerfectHash(sizes, bits).slots(keys.astype(np.uint64))] = [keys, top.column("n").to_numpy(), top.column("best").to_numpy()]
    shared = docs.sparkSession.sparkContext.broadcast((sizes, bits, table))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, bits, (own, n, best) = shared.value
        hashed = PerfectHash(sizes, bits)

        def known(keys: np.ndarray):
            slot = hashed.slots(keys.astype(np.uint64))
            found = slot >= 0
            found[found] = own[slot[found]] == keys[found]
            slot = np.where(found, slot, 0)
            if not len(own):
                return np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64), found
            return np.where(found, n[slot], 0), np.where(found, best[slot], 0), found

        aligner = Aligner(Pair(first, second), groups=True, known=known)
        row = TaskContext.get().partitionId() << 40
        long = None
        for batch in batches:
            for begin, end, number, doc, bad, more in aligner.texts(batch.column(1)):
                m = end - begin
                border = np.searchsorted(doc, np.arange(m + 1))
                values = []
                for pool in (aligner.n_a, aligner.n_b, aligner.n_links, aligner.best, aligner.total):
                    upto = np.concatenate([[0], np.cumsum(pool.values[number])])[border]
                    values.append(np.where(bad, 0, np.diff(upto)))
                good = ~bad[doc]
                kept = number[good]
                size = aligner.rest_size.values[kept]
                rest = aligner.rest.values[gather(aligner.rest_start.values[kept], size)]
                rest_border = np.concatenate([[0], np.cumsum(size)])[np.searchsorted(doc[good], np.arange(m + 1))]
                strings = list(map(aligner.text.__getitem__, number.tolist()))
                shown = [b"" if spoilt else b";".join(strings[a:b]) for a, b, spoilt in
                         zip(border[:-1].tolist(), border[1:].tolist(), bad.tolist())]
                if more or long:
                    long = long or ([], [], [], [])
                    for held, new in zip(long, (np.array(values)[:, 0], rest, shown[0], bool(bad[0]))):
                        held.append(new)
                    if more:
                        continue
                    spoilt = any(long[3])
                    values = [np.array([0 if spoilt else x]) for x in np.sum(long[0], axis=0)]
                    rest = np.concatenate(long[1])[:0 if spoilt else None]
                    rest_border = np.array([0, len(rest)])
                    shown, long = [b"" if spoilt else b";".join(long[2])], None
                n_a, n_b, links, best_sum, total = (pa.array(v.astype(np.int64)) for v in values)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row + np.arange(m)), batch.column(0).slice(begin, m), n_a, n_b, links, best_sum, total,
                     pa.array(shown, pa.binary()).cast(pa.string()), list_array(rest, rest_border)],
                    ["row", "doc_id", "n_a", "n_b", "n_links", "base_best", "base", "groups", "rest"])
                row += m

    kind = docs.schema[doc_id].dataType.simpleString()
    read = docs.select(F.col(f"`{doc_id}`"), F.col(f"`{text}`").cast("string").alias("t"))
    seen = read.mapInArrow(run, f"row long, doc_id {kind}, n_a long, n_b long, n_links long, base_best long, base long, "
                                "groups string, rest array<long>")
    if groups == "sha256":
        seen = seen.withColumn("groups", F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)))
    rows = stored(seen, "aligned")
    extra = (rows.select("row", F.explode("rest").alias("key")).groupBy("row", "key").agg(F.count("*").alias("times"))
             .join(pairs, "key").groupBy("row").agg(F.sum(F.col("times") * F.col("n")).alias("more"),
                                                    F.sum(F.col("times") * F.col("best")).alias("more_best")))
    return rows.join(extra, "row", "left").select(
        "doc_id", "n_a", "n_b", F.col("n_links").alias("n_groups"), "n_links",
        (F.col("base_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"),
        (F.col("base") + F.coalesce("more", F.lit(0))).alias("count_sum"), "groups")
