"""Sampled segmentations over the piece lattice (forward filtering, backward sampling) and lossless decoding."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401 - pa.compute
import public_tokenizers
from pyspark.sql import DataFrame, functions as F

from chronolith.llm.common import list_array, mix, running_hash, slices, span_hashes
from chronolith.llm.token_counts import NEWLINE, SPACE

MODEL = "piece_bpe_32k.model"
#: Exponent on piece probabilities: 0 samples all paths alike, large values keep the likeliest path.
SHARPNESS = 1.0
SEED = 7
#: Places of the table of pieces' beginnings, some eight for each.
SLOTS = 1 << 19
#: Bytes of text that are segmented together.
SLICE = 1 << 20


class Vocabulary:
    """Pieces with their log weights.  The model ranks its pieces, so their probabilities follow Zipf's law."""

    def __init__(self, path: str, sharpness: float):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = model.get_piece_size()
        self.weight: dict[str, tuple[int, float]] = {}
        self.byte_id = np.zeros(256, np.int32)
        self.bytes: list[bytes] = [b""] * self.size
        plain = [i for i in range(self.size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i)
                                                     or model.is_unused(i))]
        total = math.log(sum(1 / r for r in range(1, len(plain) + 1)))
        for rank, i in enumerate(plain, 1):
            piece = model.id_to_piece(i).replace("▁", " ")
            self.weight[piece] = (i, -sharpness * (math.log(rank) + total))
            self.bytes[i] = piece.encode()
        for i in range(self.size):
            if model.is_byte(i):
                b = int(model.id_to_piece(i)[3:5], 16)
                self.byte_id[b], self.bytes[i] = i, bytes([b])
        self.longest = max(map(len, self.weight))
        self.rare = -sharpness * (math.log(len(plain)) + total)
        # Every beginning of a piece by its hash, with the piece it is itself (or -1).
        begins = {p[:n]: -1 for p in self.weight for n in range(1, len(p))}
        begins.update({p: i for p, (i, _) in self.weight.items()})
        raw = [p.encode() for p in begins]
        length = np.array([len(r) for r in raw])
        stop = np.cumsum(length)
        h = span_hashes(np.frombuffer(b"".join(raw), np.uint8), stop - length, stop, fold=False)
        self._fill(h, np.array(list(begins.values()), np.int32))
        self.log_weight = np.zeros(self.size)
        for i, w in self.weight.values():
            self.log_weight[i] = w

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All pieces' bytes in one array, with the start and the length of each."""
        length = np.array([len(b) for b in self.bytes], np.int64)
        return np.frombuffer(b"".join(self.bytes), np.uint8), np.cumsum(length) - length, length

    def _fill(self, h: np.ndarray, piece: np.ndarray) -> None:
        """Open addressing by the upper bits; a slot that is taken sends a hash on to the next one."""
        self.slots, self.values = np.zeros(SLOTS + 64, np.uint64), np.full(SLOTS + 64, -1, np.int32)
        for x, p in zip(h.tolist(), piece.tolist()):
            at = x // (2 ** 64 // SLOTS)
            while self.slots[at]:
                at += 1
            self.slots[at], self.values[at] = x, p

    def look_up(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether some piece begins so, and the piece itself or -1."""
        at = (h // np.uint64(2 ** 64 // SLOTS)).astype(np.int64)
        there = self.slots[at]
        begins = there == h
        todo = np.flatnonzero(~begins & (there != 0))
        while len(todo):
            at[todo] += 1
            there = self.slots[at[todo]]
            begins[todo] = there == h[todo]
            todo = todo[(there != h[todo]) & (there != 0)]
        return begins, np.where(begins, self.values[at], -1)


class Lattices:
    """Forward-filtered lattices of many distinct pre-tokens in flat arrays.

    A lattice has a start node and a node after each character; characters without a piece are spelled in
    bytes through nodes of their own.  The edges into a node lie side by side, with the running share of the
    paths through the node that come by them, so that one search in `key` finds the edge of a random
    number.  All lattices are filtered together, one character at a time, in logarithms.
    """

    def __init__(self, v: Vocabulary, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        size = ends - starts
        place = np.repeat(starts - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
        lead = (data[place] & 0xC0) != 0x80
        begin = place[lead]  # of each character
        word = np.repeat(np.arange(len(size)), size)[lead]
        stop = np.append(begin[1:], 0)
        last = np.append(word[1:] != word[:-1], True)
        stop[last] = ends[word[last]]
        chars = np.bincount(word, minlength=len(size))
        first = np.cumsum(chars) - chars
        nth = np.arange(len(begin)) - first[word]
        left = chars[word] - nth
        edges: list[tuple] = []
        active, total_hash = np.arange(len(begin)), running_hash(data, fold=False)
        for n in range(1, v.longest + 1):
            active = active[left[active] >= n]
            if not len(active):
                break
            goes_on, piece = v.look_up(span_hashes(data, begin[active], stop[active + n - 1], total=total_hash))
            hit = piece >= 0
            if n == 1:
                spelled = np.ones(len(begin), bool)
                # The file shows a space as this character; the character itself is spelled.
                spelled[active[hit]] = False
            edges.append((active[hit], active[hit] + n - 1, piece[hit]))
            active = active[goes_on]
        width = stop - begin
        nodes = np.cumsum(np.where(spelled, width, 1))
        after = word + nodes                       # the node after a character
        before = np.where(nth == 0, word + nodes - np.where(spelled, width, 1), np.append(0, after[:-1]))
        source = np.concatenate([before[e[0]] for e in edges])
        target = np.concatenate([after[e[1]] for e in edges])
        step = np.concatenate([nth[e[1]] for e in edges])
        piece = np.concatenate([e[2] for e in edges])
        weight = v.log_weight[piece]
        lone = np.flatnonzero(spelled)
        owner = np.repeat(lone, width[lone])
        q = np.arange(len(owner)) - np.repeat(np.cumsum(width[lone]) - width[lone], width[lone])
        to = after[owner] - width[owner] + 1 + q
        source = np.concatenate([source, np.where(q == 0, before[owner], to - 1)])
        target, step = np.concatenate([target, to]), np.concatenate([step, nth[owner]])
        piece = np.concatenate([piece, v.byte_id[data[begin[owner] + q]]])
        weight = np.concatenate([weight, np.full(len(owner), v.rare)])
        order = np.argsort(target, kind="stable")
        source, target, step, piece, weight = (x[order] for x in (source, target, step, piece, weight))
        total = int(target.max()) + 1 if len(target) else 1
        if len(step) and step.max() < 1 << 16:
            step = step.astype(np.uint16)  # sorted by counting
        forward, share = np.zeros(total), np.ones(len(target))
        # Nodes inside a spelled character follow from the node before it.
        inner = np.flatnonzero(q < width[owner] - 1)
        by_step = np.argsort(step, kind="stable")
        cuts = np.searchsorted(step[by_step], np.arange(int(step.max()) + 2 if len(step) else 1))
        spell_order = inner[np.argsort(nth[owner[inner]], kind="stable")]
        spell_cuts = np.searchsorted(nth[owner[spell_order]], np.arange(len(cuts)))
        ends_char = np.zeros(total, bool)
        ends_char[after] = True
        for j in range(len(cuts) - 1):
            own = spell_order[spell_cuts[j]:spell_cuts[j + 1]]
            forward[to[own]] = forward[before[owner[own]]] + (q[own] + 1) * v.rare
            e = by_step[cuts[j]:cuts[j + 1]]
            e = e[ends_char[target[e]]]
            heads = np.flatnonzero(np.append(True, target[e][1:] != target[e][:-1]))
            value = forward[source[e]] + weight[e]
            top = np.maximum.reduceat(value, heads)
            count = np.diff(np.append(heads, len(e)))
            value = np.exp(value - np.repeat(top, count))
            whole = np.add.reduceat(value, heads)
            forward[target[e[heads]]] = top + np.log(whole)
            share[e] = value / np.repeat(whole, count)
        run = np.cumsum(share)
        heads = np.flatnonzero(np.append(True, target[1:] != target[:-1])) if len(target) else np.zeros(0, int)
        count = np.diff(np.append(heads, len(target)))
        run -= np.repeat(run[heads] - share[heads], count)
        self.key = target + np.clip(run, 0, 1)
        self.key[heads + count - 1] = target[heads] + 1.0
        np.maximum.accumulate(self.key, out=self.key)
        self.previous, self.piece = source, piece.astype(np.int32)
        self.is_start = np.zeros(total, bool)
        self.is_start[before[first]] = True
        self.end = after[first + chars - 1]


def sample(lattices: Lattices, end: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of all pre-tokens in order, and how many each has.

    Every pre-token walks back from its end node; step k of a pre-token uses the k-th number of the
    generator that its seed starts.
    """
    n = len(end)
    count = np.zeros(n, np.int64)
    active, node, step, made = np.arange(n), end.copy(), 0, []
    while len(active):
        u = (mix(seed[active] + np.uint64((step * 0x9E3779B97F4A7C15) & (2**64 - 1))) >> np.uint64(11)) * 2.0**-53
        edge = np.searchsorted(lattices.key, node + u, "right")
        made.append((active, lattices.piece[edge]))
        count[active] += 1
        node = lattices.previous[edge]
        more = ~lattices.is_start[node]
        active, node, step = active[more], node[more], step + 1
    stop = np.cumsum(count)
    ids = np.zeros(int(stop[-1]) if n else 0, np.int32)
    for k, (who, piece) in enumerate(made):
        ids[stop[who] - 1 - k] = piece
    return ids, count


def _pretokens(s):
    """Starts, ends and text number of the pre-tokens of a slice whose texts begin with a space."""
    n = len(s.data)
    space, line = s.data == SPACE, s.data == NEWLINE
    begins = np.zeros(n + 1, bool)
    begins[1:n] = (space[1:] & ~space[:-1]) | line[1:] | (line[:-1] & ~space[1:])
    begins[s.offsets] = True
    begins[n] = False
    starts = np.flatnonzero(begins)
    return starts, np.append(starts[1:], n)[:len(starts)], np.searchsorted(s.offsets, starts, "right") - 1


def encode_sampled(docs: DataFrame, path: str | None = None, doc_id: str = "doc_id", text: str = "text",
                   ids: str = "ids", sharpness: float = SHARPNESS, seed: int = SEED,
                   keep: list[str] | None = None) -> DataFrame:
    """The documents' columns `keep` (default: all) with a column of sampled piece ids.

    A text is a space followed by its characters, as the tokenizer has it.  No piece crosses a border
    between another character and a space or a line feed, so the lattice of a text is a chain of
    independent lattices of pre-tokens: each distinct one is filtered forward once, and every occurrence
    samples backward with its own random numbers, drawn from (seed, document id, position).  The same row
    therefore gets the same ids on any machine and in any partition.  Characters without a piece are
    spelled in bytes, and so is the character that the vocabulary file uses to show a space; decoding
    gives back the text whatever it holds.  A null text has null ids, an empty one no ids; equal ids and
    texts give equal rows; a column that already has the name `ids` is replaced.
    """
    path = path or public_tokenizers.path(MODEL)
    keep = [c for c in keep or docs.columns if c != ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(path, sharpness)
        for batch in batches:
            texts = batch.column(len(keep))
            spaced = pa.compute.if_else(pa.compute.equal(pa.compute.fill_null(pa.compute.binary_length(texts), 0), 0), "",
                                        pa.compute.binary_join_element_wise(" ", pa.compute.fill_null(texts, ""), ""))
            keys = np.array([(x or 0) & (2**64 - 1) for x in batch.column(len(keep) + 1).to_pylist()], np.uint64)
            for s in slices(spaced, SLICE):
                m = s.last - s.first
                starts, ends, doc = _pretokens(s)
                if len(starts):
                    h = span_hashes(s.data, starts, ends, fold=False)
                    distinct, first, which = np.unique(h, return_index=True, return_inverse=True)
                    lattices = Lattices(vocabulary, s.data, starts[first], ends[first])
                    end = lattices.end[which]
                    own = mix(keys[s.first + doc] + np.uint64(seed)) + starts.astype(np.uint64) - s.offsets[doc].astype(np.uint64)
                    flat, count = sample(lattices, end, mix(own))
                    border = np.concatenate([[0], np.cumsum(count)])[np.searchsorted(doc, np.arange(m + 1))]
                else:
                    flat, border = np.zeros(0, np.int32), np.zeros(m + 1, np.int64)
                part = batch.slice(s.first, m)
                lists = list_array(flat, border)
                null = texts.slice(s.first, m).is_null()
                lists = pa.compute.if_else(null, pa.scalar(None, lists.type), lists)
                yield pa.RecordBatch.from_arrays([part.column(k) for k in range(len(keep))] + [lists], names)

    # Columns travel under names by position: no name of the input can clash, and none is parsed.
    names = [*[f"c{k}" for k in range(len(keep))], "ids"]
    kept = [F.col(f"`{c}`").alias(n) for c, n in zip(keep, names)]
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in docs.select(*kept).schema] + ["ids array<int>"])
    return docs.select(*kept, F.col(f"`{text}`").cast("string").alias("t"),
                       F.xxhash64(F.col(f"`{doc_id}`")).alias("k")).mapInArrow(run, schema).toDF(*keep, ids)


def decode(frame: DataFrame, path: str | None = None, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """The frame with the text of its piece ids; null ids give null, no ids the empty text."""
    path = path or public_tokenizers.path(MODEL)
    keep = [c for c in frame.columns if c != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool, start, length = Vocabulary(path, 1.0).tables()
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                lists = part.column(keep.index(ids))
                flat = lists.flatten().to_numpy(zero_copy_only=False)
                sizes = pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
                border = np.concatenate([[0], np.cumsum(sizes)])
                n = length[flat]
                place = np.concatenate([[0], np.cumsum(n)])
                data = pool[np.repeat(start[flat] - place[:-1], n) + np.arange(place[-1])].tobytes()
                cut = place[border]
                texts = [None if null else data[a + 1:b].decode("utf-8") for a, b, null in zip(
                    cut[:-1].tolist(), cut[1:].tolist(), lists.is_null().to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(k) for k in range(len(keep))] + [pa.array(texts, pa.string())], names)

    names = [*[f"c{k}" for k in range(len(keep))], "decoded"]
    kept = frame.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names)])
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in kept.schema] + ["decoded string"])
    return kept.mapInArrow(run, schema).toDF(*keep, out)
