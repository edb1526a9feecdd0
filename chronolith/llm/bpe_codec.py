"""Byte-pair encoding with word ends, and its decoding.

Each distinct word is merged once in a task.  A short part of a word is a row of part ids beside a row of the ranks of
adjacent pairs: the smallest rank is found by a scan, the boundary behind it is deleted, and the two neighbouring ranks
are looked up again.  Rows of equal width are worked on together, one merge of every row in each step.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, functions as F

from chronolith.llm.common import IS_SPACE, append_columns, list_array, words
from chronolith.llm.spans import Memory, Pool, chunks, gather

TOKENIZER = "word_bpe_49k.json"
END = "</w>"
#: Widest row of the scan; longer parts are merged pair by pair over the whole part.
SHORT = 32
NONE = np.int64(1 << 40)
_PIECES = 4096


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself where it prints, else the next one from U+0100 on."""
    shown = set(range(0x21, 0x7F)) | set(range(0xA1, 0xAD)) | set(range(0xAE, 0x100))
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


LETTERS = byte_letters()
_BYTE_OF = np.zeros(0x200, np.uint8)
for _b, _c in enumerate(LETTERS):
    _BYTE_OF[ord(_c)] = _b

# Classes of printing ASCII characters for the split into letters, single digits and others.
_CLASS = np.full(256, 2, np.int8)
_CLASS[[c for c in range(128) if chr(c).isalpha()]] = 0
_CLASS[[c for c in range(128) if chr(c).isdigit()]] = 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Words that the ASCII rules cover: no apostrophe (contractions), no control, no special token.
_PLAIN = re.compile(rb"[!-&(-~]+")


class MergeTable:
    """Vocabulary and merges of a tokenizer file, checked to be of the kind this module is written for."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab = model["vocab"]
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges", "fuse_unk") if model.get(k)]
        if model["type"] != "BPE" or model.get("end_of_word_suffix") != END or odd or spec.get("decoder") or spec.get("post_processor"):
            raise ValueError(f"{path}: not a byte-level BPE with word ends ({odd})")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] or not t["content"].startswith("<|") for t in spec["added_tokens"]):
            raise ValueError(f"{path}: special tokens that take their surroundings")
        self.inner = np.array([vocab[c] for c in LETTERS], np.int64)
        self.last = np.array([vocab[c + END] for c in LETTERS], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left, right = (np.array([vocab[p[k]] for p in pairs], np.int64) for k in (0, 1))
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.size = max([*vocab.values(), *self.special.values()]) + 1
        rank_of = np.full(self.size, -1)
        rank_of[made] = np.arange(len(made))
        if len(np.unique(made)) < len(made) or (np.maximum(rank_of[left], rank_of[right]) >= np.arange(len(made))).any():
            raise ValueError(f"{path}: merges are not in the order in which they were learnt")
        keys = left * self.size + right
        order = np.argsort(keys)
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made
        self.tokens = [""] * self.size
        for token, k in [*vocab.items(), *self.special.items()]:
            self.tokens[k] = token

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE where it does not merge."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)


def merge_rows(table: MergeTable, parts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merges rows of parts to the end; returns the rows and how many parts each has left."""
    result, left = parts.copy(), sizes.copy()
    rows = np.arange(len(parts))
    column = np.arange(parts.shape[1])
    ranks = np.full((len(parts), max(parts.shape[1] - 1, 1)), NONE)
    if parts.shape[1] > 1:
        ranks[:] = np.where(column[1:] < sizes[:, None], table.rank(parts[:, :-1], parts[:, 1:]), NONE)
    while len(rows):
        at = ranks.argmin(1)
        low = ranks[np.arange(len(rows)), at]
        more = low < NONE
        if not more.all():
            ended = rows[~more]
            result[ended, :parts.shape[1]], left[ended] = parts[~more], sizes[~more]
            rows, parts, sizes, ranks, at, low = rows[more], parts[more], sizes[more], ranks[more], at[more], low[more]
            if not len(rows):
                break
        each = np.arange(len(rows))
        parts[each, at] = table.made[low]
        # Every row loses one boundary, so one column goes too.
        width = parts.shape[1] - 1
        column = np.arange(width)
        parts = np.take_along_axis(parts, column + (column > at[:, None]), 1)
        sizes = sizes - 1
        if width == 1:
            result[rows, :1], left[rows] = parts, sizes
            break
        ranks = np.take_along_axis(ranks, column[:-1] + (column[:-1] >= at[:, None]), 1)
        before = np.flatnonzero(at > 0)
        ranks[before, at[before] - 1] = table.rank(parts[before, at[before] - 1], parts[before, at[before]])
        after = np.flatnonzero(at + 1 < sizes)
        ranks[after, at[after]] = table.rank(parts[after, at[after]], parts[after, at[after] + 1])
        none = np.flatnonzero((at + 1 >= sizes) & (at < width - 1))
        ranks[none, at[none]] = NONE
    return result, left


def merge_long(table: MergeTable, parts: np.ndarray) -> np.ndarray:
    """The same for one long part: all places of the pair of smallest rank merge in each step, from left to right.

    A pair that holds a merged token ranks behind the merge that made it, so no step creates a smaller rank.
    """
    while len(parts) > 1:
        ranks = table.rank(parts[:-1], parts[1:])
        low = ranks.min()
        if low == NONE:
            break
        at = np.flatnonzero(ranks == low)
        # In a run of overlapping places every second one merges.
        run = np.concatenate([[0], np.cumsum(np.diff(at) > 1)])
        first = np.searchsorted(run, run)
        at = at[(np.arange(len(at)) - first) % 2 == 0]
        parts = parts.copy()
        parts[at] = table.made[low]
        parts = np.delete(parts, at + 1)
    return parts


def merge_parts(table: MergeTable, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all parts one after the other, and how many each part has."""
    symbols = table.inner[data]
    symbols[starts + sizes - 1] = table.last[data[starts + sizes - 1]]
    counts = np.zeros(len(starts), np.int64)
    blocks = []
    low = 0
    for width in (1, 2, 4, 6, 8, 10, 12, 16, 24, SHORT):
        rows = np.flatnonzero((sizes > low) & (sizes <= width))
        low = width
        if len(rows):
            column = np.arange(width)
            inside = column < sizes[rows, None]
            parts = np.where(inside, symbols[np.minimum(starts[rows, None] + column, len(symbols) - 1)], 0)
            found, counts[rows] = merge_rows(table, parts, sizes[rows])
            blocks.append((rows, found))
    long = [(r, merge_long(table, symbols[starts[r]:starts[r] + sizes[r]])) for r in np.flatnonzero(sizes > SHORT).tolist()]
    for r, ids in long:
        counts[r] = len(ids)
    begin = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.int64)
    for rows, found in blocks:
        column = np.arange(found.shape[1])
        inside = column < counts[rows, None]
        out[(begin[rows, None] + column)[inside]] = found[inside]
    for r, ids in long:
        out[begin[r]:begin[r] + len(ids)] = ids
    return out, counts


class WordEncoder:
    """Ids of words; white space parts words before everything else, so the ids of a text are those of its words."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.table = MergeTable(path)
        rules = Tokenizer.from_file(path)
        self.normal, self.split = rules.normalizer, rules.pre_tokenizer
        self.special = re.compile("(" + "|".join(map(re.escape, self.table.special)) + ")")

    def _pieces(self, text: str) -> list[tuple[str, tuple[int, int]]]:
        return self.split.pre_tokenize_str(text)

    def _alone(self, word: str) -> np.ndarray:
        """Ids of one word, special tokens and inner Unicode spaces included."""
        found = []
        for k, part in enumerate(self.special.split(word)):
            if k % 2:
                found.append(np.array([self.table.special[part]], np.int64))
            elif part:
                pieces = [p for p, _ in self._pieces(self.normal.normalize_str(part))]
                if pieces:
                    data = _BYTE_OF[np.frombuffer("".join(pieces).encode("utf-16-le"), np.uint16)]
                    sizes = np.array([len(p) for p in pieces])
                    found.append(merge_parts(self.table, data, np.cumsum(sizes) - sizes, sizes)[0])
        return np.concatenate(found) if found else np.zeros(0, np.int64)

    def encode(self, spans: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after the other, and how many each word has."""
        plain = np.array([_PLAIN.fullmatch(w) is not None and b"<|" not in w for w in spans], bool)
        data, sizes, owner = [], [], []
        at = np.flatnonzero(plain)
        if len(at):
            raw = _LOWER[np.frombuffer(b"".join([spans[i] for i in at.tolist()]), np.uint8)]
            length = np.array([len(spans[i]) for i in at.tolist()])
            kind = _CLASS[raw]
            begins = np.ones(len(raw), bool)
            begins[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 1)
            begins[np.cumsum(length) - length] = True
            starts = np.flatnonzero(begins)
            data.append(raw)
            sizes.append(np.diff(np.append(starts, len(raw))))
            owner.append(at[np.searchsorted(np.cumsum(length), starts, "right")])
        alone = []
        rest = []
        for i in np.flatnonzero(~plain).tolist():
            w = spans[i].decode("utf-8", "replace")
            (alone if "<|" in w or len(w.split()) != 1 or len(w) > 4096 else rest).append((i, w))
        for k in range(0, len(rest), _PIECES):
            group = rest[k:k + _PIECES]
            text = self.normal.normalize_str(" ".join([w for _, w in group]))
            length = np.array([len(w) for w in text.split(" ")])
            if len(length) != len(group):
                alone += group
                continue
            pieces = self._pieces(text)
            if pieces:
                begin = np.cumsum(length + 1) - length - 1
                data.append(_BYTE_OF[np.frombuffer("".join([p for p, _ in pieces]).encode("utf-16-le"), np.uint16)])
                sizes.append(np.array([len(p) for p, _ in pieces]))
                first = np.array([a for _, (a, _) in pieces])
                owner.append(np.array([i for i, _ in group])[np.searchsorted(begin, first, "right") - 1])
        count = np.zeros(len(spans), np.int64)
        if data:
            flat, width, word = np.concatenate(data), np.concatenate(sizes), np.concatenate(owner)
            ids, many = merge_parts(self.table, flat, np.cumsum(width) - width, width)
            np.add.at(count, word, many)
        single = [(i, self._alone(w)) for i, w in alone]
        for i, own in single:
            count[i] = len(own)
        out = np.zeros(int(count.sum()), np.int64)
        begin = np.cumsum(count) - count
        if data:
            # Parts of a word stand together and in order in each of the groups above.
            before = np.cumsum(many) - many
            new = np.concatenate([[True], word[1:] != word[:-1]])
            lead = before[new][np.cumsum(new) - 1]
            out[gather(begin[word] + before - lead, many)] = ids
        for i, own in single:
            out[begin[i]:begin[i] + len(own)] = own
        return out, count


class IdMemory:
    """Ids of every word of a chunk, each distinct word encoded once; `encode` is as in WordEncoder."""

    def __init__(self, encode):
        self.encode, self.memory = encode, Memory(self._learn, self._forget)
        self._forget()

    def _forget(self) -> None:
        self.ids, self.start, self.size = Pool(np.int32), Pool(np.int64), Pool(np.int64)

    def _learn(self, spans: list[bytes]) -> None:
        ids, count = self.encode(spans)
        self.start.extend(self.ids.size + np.cumsum(count) - count)
        self.size.extend(count)
        self.ids.extend(ids)

    def texts(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, last row, ids of these texts one after the other, where each text begins and ends)."""
        held = []
        for s, more in chunks(column, next_space):
            a, b, border = words(s)
            number = self.memory.number(s.data, a, b)
            sizes = self.size.values[number]
            ids = self.ids.values[gather(self.start.values[number], sizes)]
            upto = np.concatenate([[0], np.cumsum(sizes)])[border]
            if more:
                held.append(ids)
                continue
            if held:
                ids, held = np.concatenate([*held, ids]), []
                upto = np.array([0, len(ids)])
            yield s.first, s.last, ids, upto


def next_space(data: np.ndarray, at: int) -> int:
    """The first white space at or after `at`."""
    while at < len(data):
        found = np.flatnonzero(IS_SPACE[data[at:at + 4096]])
        if len(found):
            return at + int(found[0])
        at += 4096
    return len(data)


def encode_bpe(docs: DataFrame, path: str | None = None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns `keep` (all, if not given) and `ids`, an array of int: the tokens of the whole text.

    A null or empty text has no ids.  Strings of special tokens in a text are these tokens.  Rows are independent, so
    repeated rows give equal ids; an input column named ids is replaced; an empty table gives no rows.  A long text is
    worked on in chunks; its ids are one array.  A word longer than LONGEST is not remembered.
    """
    path = path or public_tokenizers.path(TOKENIZER)
    keep = [c for c in (docs.columns if keep is None else keep) if c != "ids"]

    def run():
        memory = IdMemory(WordEncoder(path).encode)

        def make(column):
            for first, last, ids, border in memory.texts(column):
                yield first, last, [list_array(ids, border)]
        return make

    return append_columns(docs, keep, {"t": F.col(f"`{text}`").cast("string")}, run, "ids array<int>")


def decode_bpe(docs: DataFrame, path: str | None = None, ids: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """Columns `keep` (all, if not given) and `decoded`: the tokens of the ids with a space between them.

    The file names no decoder, so word ends stay visible; special tokens are not skipped, ids outside of the vocabulary
    are, and null ids give a null text.
    """
    path = path or public_tokenizers.path(TOKENIZER)
    keep = [c for c in (docs.columns if keep is None else keep) if c != "decoded"]

    def run():
        decoder = Decoder(MergeTable(path))

        def make(column):
            for k in range(len(column)):
                value = column[k].values
                shown = None if value is None else decoder(value.to_numpy(zero_copy_only=False))
                yield k, k + 1, [pa.array([shown], pa.string())]
        return lambda column: _batched(make(column))

    return append_columns(docs, keep, {"i": F.col(f"`{ids}`")}, run, "decoded string")


class Decoder:
    def __init__(self, table: MergeTable):
        self.tokens, self.size = table.tokens, table.size

    def __call__(self, ids: np.ndarray) -> str:
        if len(ids) and (ids.min() < 0 or ids.max() >= self.size):
            ids = ids[(ids >= 0) & (ids < self.size)]
        return " ".join([t for t in map(self.tokens.__getitem__, ids.tolist()) if t])


def bpe_round_trip(docs: DataFrame, path: str | None = None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """encode_bpe and decode_bpe in one pass: columns `keep`, n_tokens, ids_sha256 (hex digest of the ids as little-endian
    unsigned 32-bit numbers) and decoded.  The ids themselves never leave the task."""
    path = path or public_tokenizers.path(TOKENIZER)
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("n_tokens", "ids_sha256", "decoded")]

    def run():
        encoder = WordEncoder(path)
        memory, decoder = IdMemory(encoder.encode), Decoder(encoder.table)

        def make(column):
            for first, last, ids, border in memory.texts(column):
                parts = [ids[a:b] for a, b in zip(border[:-1].tolist(), border[1:].tolist())]
                yield first, last, [pa.array(np.diff(border)), pa.array([hashlib.sha256(p.astype("<u4").tobytes()).hexdigest() for p in parts]),
                                    pa.array([decoder(p) for p in parts], pa.string())]
        return make

    return append_columns(docs, keep, {"t": F.col(f"`{text}`").cast("string")}, run,
                          "n_tokens long, ids_sha256 string, decoded string")


def _batched(rows, size: int = 8 << 20):
    """Neighbouring rows together, up to about `size` bytes."""
    first = last = None
    held, weight = [], 0
    for a, b, (array,) in rows:
        first = a if first is None else first
        last = b
        held.append(array)
        weight += array.nbytes
        if weight > size:
            yield first, last, [pa.concat_arrays(held)]
            first, held, weight = None, [], 0
    if held:
        yield first, last, [pa.concat_arrays(held)]
