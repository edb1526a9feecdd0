"""Hidden Markov language model: Baum-Welch over the whole training corpus, exact scaled forward scores.

States emit word classes.  The most frequent words are classes of their own; every other word belongs to
a class given by its last letters and is drawn from it by its corpus frequency.  The model is thus a
probability over whole token sequences, with one unknown word in each open class.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401 - pa.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from chronolith.llm.common import crc_fold, list_array, mix, most_frequent, signed, slices, span_hashes, stored, words

STATES = 16
ROUNDS = 5
#: Words that are classes of their own, and open classes for all others.
OWN_CLASSES = 16_384
OPEN_CLASSES = 64
#: So many of the most frequent words are sent to every task with their counts; all others are joined.
FREQUENT = 1 << 18
FOLD = 10
ALPHA = 0.1
END = 0
#: Training counts a long sequence in segments of so many tokens side by side, each read with so many tokens before and
#: after it, which carry the forward and backward distributions over its borders; scores run over whole texts.
SEGMENT, MARGIN = 512, 64
BLOCK_TOKENS = 250_000
LOWER = np.arange(256, dtype=np.uint64)
LOWER[65:91] += 32


def open_class(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Open class of each word, from its last two bytes in lower case."""
    last = LOWER[data[ends - 1]]
    before = np.where(ends - starts > 1, LOWER[data[np.maximum(ends - 2, 0)]], np.uint64(0))
    return (mix(last * np.uint64(256) + before) % np.uint64(OPEN_CLASSES)).astype(np.int32)


# --- the model ---------------------------------------------------------------------

@dataclass
class Model:
    start: np.ndarray  # K
    move: np.ndarray   # K x K
    emit: np.ndarray   # classes x K


def first_model(share: np.ndarray, states: int) -> Model:
    """States that differ at random from the corpus distribution and tend to stay."""
    rng = np.random.Generator(np.random.PCG64(11))
    emit = share[:, None] * rng.gamma(0.5, 2.0, (len(share), states)).clip(0.02)
    move = np.full((states, states), 0.2 / max(states - 1, 1))
    np.fill_diagonal(move, 0.8)
    return Model(np.full(states, 1 / states), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def next_model(share: np.ndarray, start, move, emit, prior: float = 20.0) -> Model:
    """Maximisation with pseudo-counts that follow the corpus distribution."""
    k = len(start)
    start, move = start + 1.0, move + 0.5 + 5.0 * np.eye(k)
    emit = emit + prior * share[:, None]
    return Model(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def _by_length(length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequences from long to short, and how many are longer than t, for every t."""
    order = np.argsort(-length, kind="stable")
    most = int(length.max()) if len(length) else 0
    return order, len(length) - np.searchsorted(np.sort(length), np.arange(most), "right")


@dataclass
class Stretches:
    """Stretches of sequences: where each begins, its length, how many tokens come before those it counts, how many
    it counts, and whether it begins where its sequence does."""

    begin: np.ndarray
    length: np.ndarray
    lead: np.ndarray
    core: np.ndarray
    opening: np.ndarray

    def __getitem__(self, which) -> "Stretches":
        return Stretches(*(x[which] for x in (self.begin, self.length, self.lead, self.core, self.opening)))

    def blocks(self, limit: int) -> Iterator["Stretches"]:
        """Consecutive stretches, about `limit` tokens at a time."""
        stop = np.cumsum(self.length)
        a = 0
        while a < len(stop):
            b = max(a + 1, int(np.searchsorted(stop, (stop[a - 1] if a else 0) + limit, "right")))
            yield self[a:b]
            a = b


def segments(border: np.ndarray) -> Stretches:
    """Every token of the sequences is counted in one segment, and so is the move that leads to it."""
    size = np.diff(border)
    pieces = -(-size // SEGMENT)
    which = np.repeat(np.arange(len(size)), pieces)
    nth = np.arange(len(which)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    first, last = border[:-1][which], border[1:][which]
    own = first + nth * SEGMENT
    core = np.minimum(SEGMENT, last - own)
    begin, end = np.maximum(first, own - MARGIN), np.minimum(last, own + core + MARGIN)
    return Stretches(begin, end - begin, own - begin, core, begin == first)


def expected_counts(model: Model, flat: np.ndarray, parts: Stretches):
    """Expected starts, moves and emissions of what the stretches count (scaled forward and backward recursions).

    A stretch that begins inside its sequence starts from the stationary distribution of the moves; its lead makes the
    recursion forget that, and nothing of the lead is counted.
    """
    order, alive = _by_length(parts.length)
    parts = parts[order]
    begin, stop = parts.begin, parts.lead + parts.core
    start, move, emit = (x.astype(np.float32) for x in (model.start, model.move, model.emit))
    k = len(start)
    rest = np.linalg.matrix_power(model.move, 64).mean(0).astype(np.float32)
    # At steps in [low, high) every stretch that is still read counts its token.
    low, high = parts.lead.max(initial=0), stop[stop < parts.length].min(initial=len(alive))
    alphas, scales = [], []
    for t, n in enumerate(alive):
        e = emit[flat[begin[:n] + t]]
        a = e * (np.where(parts.opening[:n, None], start, rest) if t == 0 else alphas[-1][:n] @ move)
        s = a.sum(1)
        a /= s[:, None]
        alphas.append(a)
        scales.append(s)
    moves = np.zeros((k, k))
    beta = np.ones((0, k), np.float32)
    gamma = np.empty((int(alive.sum()), k), np.float32)
    seen = np.empty(len(gamma), flat.dtype)
    at = len(gamma)
    counted = None
    for t in range(len(alive) - 1, -1, -1):
        n, own = alive[t], flat[begin[:alive[t]] + t]
        full = np.ones((n, k), np.float32)
        if len(beta):
            w = emit[flat[begin[:len(beta)] + t + 1]] * beta / scales[t + 1][:, None]
            full[:len(beta)] = w @ move.T
            moves += move * (alphas[t][:len(beta)].T @ (w if counted is None else w * counted))
        beta = full
        g = alphas[t] * beta
        counted = None if low <= t < high else ((parts.lead[:n] <= t) & (t < stop[:n]))[:, None].astype(np.float32)
        if counted is not None:
            g *= counted
        gamma[at - n:at] = g
        seen[at - n:at] = own
        at -= n
    emitted = np.stack([np.bincount(seen, gamma[:, j], len(emit)) for j in range(k)], 1) if len(gamma) else np.zeros(emit.shape)
    # Only a stretch without a lead counts its first token.
    return (gamma[:alive[0]].sum(0).astype(float) if len(alive) else np.zeros(k)), moves, emitted


def log10_likelihood(model: Model, flat: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """log10 probability of each whole sequence of classes, by the scaled forward recursion."""
    order, alive = _by_length(length)
    begin = begin[order]
    total = np.zeros(len(order))
    a = np.zeros((0, 0))
    for t, n in enumerate(alive):
        a = model.emit[flat[begin[:n] + t]] * (model.start if t == 0 else a[:n] @ model.move)
        s = a.sum(1)
        a /= s[:, None]
        total[:n] += np.log10(s)
    out = np.empty(len(order))
    out[order] = total
    return out


# --- the jobs ----------------------------------------------------------------------

def _words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for s in slices(batch.column(0)):
            starts, ends, _ = words(s)
            h, first, n = np.unique(span_hashes(s.data, starts, ends), return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(h)), pa.array(open_class(s.data, starts[first], ends[first])), pa.array(n.astype(np.int64))],
                ["h", "cls", "n"])


@dataclass
class Lexicon:
    """What every task knows of the words: the frequent ones with count and class, and the open classes' totals."""

    h: np.ndarray        # sorted
    n: np.ndarray
    cls: np.ndarray      # class of emission
    tokens: int
    types: int
    open_n: np.ndarray   # tokens of each open class
    open_v: np.ndarray   # types of each open class

    @property
    def classes(self) -> int:
        return 1 + OWN_CLASSES + OPEN_CLASSES

    def base(self, n):
        return np.log10((n + ALPHA) / (self.tokens + ALPHA * (self.types + 1)))

    def inside(self, n, cls):
        return np.log10((n + ALPHA) / (self.open_n[cls] + ALPHA * (self.open_v[cls] + 1)))


def learn_words(train: DataFrame) -> tuple[DataFrame, Lexicon, np.ndarray]:
    """All training words with their counts (a stored table), the lexicon, and the corpus shares of the classes."""
    counts = stored(train.select("t").mapInArrow(_words_of, "h long, cls int, n long").groupBy("h")
                    .agg(F.min("cls").alias("cls"), F.sum("n").alias("n")), "words")
    texts = train.count()
    top = most_frequent(counts, FREQUENT).toArrow()
    h, cls, n = (top.column(c).to_numpy() for c in ("h", "cls", "n"))
    ranked = np.lexsort((h, -n))
    h, cls, n = h[ranked], cls[ranked], n[ranked]
    by_class = counts.groupBy("cls").agg(F.sum("n"), F.count("*")).collect()
    open_n, open_v = np.zeros(OPEN_CLASSES), np.zeros(OPEN_CLASSES)
    for c, tokens, types in by_class:
        open_n[c], open_v[c] = tokens, types
    tokens, types = int(open_n.sum()) + texts, int(open_v.sum()) + (texts > 0)
    rank = np.arange(len(h))
    own = rank < OWN_CLASSES
    np.subtract.at(open_n, cls[own], n[own])
    np.subtract.at(open_v, cls[own], 1)
    share = np.full(1 + OWN_CLASSES + OPEN_CLASSES, ALPHA)
    share[END] += texts
    share[1:1 + own.sum()] += n[own]
    share[1 + OWN_CLASSES:] += open_n
    emitted = np.where(own, 1 + rank, 1 + OWN_CLASSES + cls).astype(np.int32)
    order = np.argsort(h)
    return counts, Lexicon(h[order], n[order], emitted[order], tokens, types, open_n, open_v), share / share.sum()


def encode(read: DataFrame, lexicon, texts: int) -> DataFrame:
    """Stored rows of (row, doc_id, held_out, n_tokens, n_known, base, inside, seq, rest, rest_cls): the class
    sequence of each text, sums over its frequent words, and its other words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = lexicon.value
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for s in slices(batch.column("t")):
                m = s.last - s.first
                starts, ends, border = words(s)
                doc = np.repeat(np.arange(m), np.diff(border))
                h = signed(span_hashes(s.data, starts, ends))
                at = np.minimum(np.searchsorted(x.h, h), max(len(x.h) - 1, 0))
                hit = x.h[at] == h if len(x.h) else np.zeros(len(h), bool)
                at, opened = at[hit], open_class(s.data, starts, ends)
                cls = 1 + OWN_CLASSES + opened
                cls[hit] = x.cls[at]
                base = np.bincount(doc[hit], x.base(x.n[at]), m).astype(float) + x.base(texts)
                drawn = hit & (cls > OWN_CLASSES)
                inside = np.bincount(doc[drawn], x.inside(x.n[at][drawn[hit]], opened[drawn]), m).astype(float)
                known = np.bincount(doc[hit], minlength=m) + (texts > 0)
                flat = np.insert(cls, border[1:], END).astype("<u2")
                stops = border + np.arange(m + 1)
                raw = flat.tobytes()
                rest = np.searchsorted(doc[~hit], np.arange(m + 1))
                part = batch.slice(s.first, m)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row + np.arange(m)), part.column("doc_id"), part.column("held_out"),
                     pa.array(np.diff(stops)), pa.array(known.astype(np.int64)), pa.array(base, pa.float64()), pa.array(inside, pa.float64()),
                     pa.array([raw[2 * a:2 * b] for a, b in zip(stops[:-1].tolist(), stops[1:].tolist())], pa.binary()),
                     list_array(h[~hit], rest), list_array(opened[~hit], rest)],
                    ["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "inside", "seq", "rest", "rest_cls"])
                row += m

    kind = read.schema["doc_id"].dataType.simpleString()
    return stored(read.mapInArrow(run, f"row long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base double, "
                                       "inside double, seq binary, rest array<long>, rest_cls array<int>"), "sequences")


def _sequences(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[np.ndarray, np.ndarray, int, pa.RecordBatch]]:
    """Flat classes and borders of rows, about `limit` tokens at a time."""
    for batch in batches:
        size = pa.compute.binary_length(batch.column("seq")).to_numpy(zero_copy_only=False).astype(np.int64) // 2
        stop = np.cumsum(size)
        a = 0
        while a < len(size):
            b = max(a + 1, int(np.searchsorted(stop, (stop[a - 1] if a else 0) + limit, "right")))
            part = batch.slice(a, b - a)
            flat = np.frombuffer(b"".join(part.column("seq").to_pylist()), "<u2")
            yield flat, np.concatenate([[0], np.cumsum(size[a:b])]), part
            a = b


def train(rows: DataFrame, share: np.ndarray, states: int = STATES, rounds: int = ROUNDS) -> Model:
    """Baum-Welch: tasks compute expected counts, Spark adds them up by class, the driver reads one row per class."""
    model = first_model(share, states)
    names = [f"k{j}" for j in range(states)]
    for _ in range(rounds):
        shared = rows.sparkSession.sparkContext.broadcast(model)

        def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m = shared.value
            start, move, emit = np.zeros(states), np.zeros((states, states)), np.zeros((len(m.emit), states))
            for flat, border, _part in _sequences(batches, BLOCK_TOKENS):
                for parts in segments(border).blocks(2 * BLOCK_TOKENS):
                    s, t, e = expected_counts(m, flat, parts)
                    start, move = start + s, move + t
                    emit += e
            # Ids below the classes carry the moves and, last, the starts.
            table = np.concatenate([emit, move, start[None]])
            used = np.flatnonzero(table.any(1))
            yield pa.RecordBatch.from_arrays([pa.array(used)] + [pa.array(table[used, j]) for j in range(states)], ["id", *names])

        got = (rows.select("seq").mapInArrow(expect, "id long, " + ", ".join(f"{n} double" for n in names))
               .groupBy("id").agg(*[F.sum(n).alias(n) for n in names]).toArrow())
        table = np.zeros((len(share) + states + 1, states))
        table[got.column("id").to_numpy()] = np.stack([got.column(n).to_numpy() for n in names], 1)
        c = len(share)
        model = next_model(share, table[-1], table[c:c + states], table[:c])
        shared.unpersist()
    return model


def hmm_scores(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", states: int = STATES,
               rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row per document row.

    Tokens are the words of the text and one end.  A null text is empty (one token); repeated rows get equal
    rows; a null id is in the fold of the empty text; without training rows every word is unknown; an empty table
    gives no rows.  Words of equal count are ranked by their hash.  Other columns are ignored, whatever their names.
    Word counts cover all training texts; the frequent words are looked up where texts are read, the others are joined
    by word, where no key is hot any more.  Of a very long text, training holds 2 * BLOCK_TOKENS tokens at a time.
    """
    spark = docs.sparkSession
    read = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), (crc_fold(F.col(f"`{doc_id}`"), FOLD) == 0).alias("held_out"),
                       F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("t"))
    taught = read.where(~F.col("held_out"))
    counts, lexicon, share = learn_words(taught)
    rows = encode(read, spark.sparkContext.broadcast(lexicon), taught.count())
    model = train(rows.where(~F.col("held_out")), share, states, rounds)
    shared = spark.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for flat, border, part in _sequences(batches, 4_000_000):
            ll = log10_likelihood(shared.value, flat, border[:-1], np.diff(border))
            yield pa.RecordBatch.from_arrays([part.column(c) for c in ("row", "doc_id", "held_out", "n_tokens", "n_known", "base")]
                                             + [pa.array(ll + part.column("inside").to_numpy())],
                                             ["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "ll"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    scored = rows.select("row", "doc_id", "held_out", "n_tokens", "n_known", "base", "inside", "seq").mapInArrow(
        score, f"row long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base double, ll double")
    classes = F.broadcast(spark.createDataFrame(
        [(c, float(lexicon.open_n[c]), float(lexicon.open_v[c])) for c in range(OPEN_CLASSES)], "cls int, open_n double, open_v double"))
    rest = (rows.select("row", F.explode(F.arrays_zip("rest", "rest_cls")).alias("x"))
            .groupBy("row", F.col("x.rest").alias("h"), F.col("x.rest_cls").alias("cls")).agg(F.count("*").alias("k"))
            .join(counts.select("h", "n"), "h", "left").join(classes, "cls"))
    n, k = F.coalesce("n", F.lit(0)), F.col("k")
    denominator = lexicon.tokens + ALPHA * (lexicon.types + 1)
    extra = rest.groupBy("row").agg(
        F.sum(F.when(n > 0, k).otherwise(0)).alias("x_known"), F.sum(k * F.log10((n + ALPHA) / denominator)).alias("x_base"),
        F.sum(k * F.log10((n + ALPHA) / (F.col("open_n") + ALPHA * (F.col("open_v") + 1)))).alias("x_ll"))

    def plus(a, b):
        return F.col(a) + F.coalesce(F.col(b), F.lit(0))

    return scored.join(extra, "row", "left").select(
        "doc_id", "held_out", "n_tokens", plus("n_known", "x_known").cast("long").alias("n_known"),
        F.lit(lexicon.tokens).cast("long").alias("train_tokens"), plus("base", "x_base").alias("base_score"),
        plus("ll", "x_ll").alias("score"))
