"""Quality by the votes of labelled neighbours in a latent-semantic space."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from chronolith.llm.common import append_columns, crc_fold, mix, slices, span_hashes, words
from chronolith.llm.toxicity import training_sample

#: Bound on the labelled texts that vote; their vectors are what is broadcast (SAMPLE_ROWS x RANK floats).
SAMPLE_ROWS = 6_000
RANK = 48
NEIGHBOURS = 15
#: Rows of one block of cosine products.
BLOCK = 256
THRESHOLD = 0.3
#: Similarities are raised to this power before they weigh a vote.
POWER = 8
HASHED = 256


def _byte_classes() -> np.ndarray:
    """Letters apart, digits together, each mark apart, other bytes by their upper bits."""
    c = np.zeros(256, np.int64)
    for b in range(256):
        ch = chr(b)
        if b >= 128:
            c[b] = 1 + (b >> 4) % 8
        elif ch.isalpha():
            c[b] = 10 + (ord(ch.lower()) - 97) // 2
        elif ch.isdigit():
            c[b] = 9
        elif ch == "\n":
            c[b] = 23
        elif ch in " \t\r\x0b\x0c":
            c[b] = 24
        elif b > 32:
            c[b] = 25 + "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~".find(ch) if ch in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" else 0
    return c


CLASSES = 57
BYTE_CLASS = _byte_classes()
SHAPES = 40
WIDTH = CLASSES * CLASSES + HASHED + SHAPES


def features(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first, last, matrix): per text, frequencies of pairs of neighbouring byte classes, of hashed words, and of
    shapes: words that repeat the word before or one of the last eight, word lengths, lengths of the text,
    share of distinct words and lines.  Counts are taken over whole texts."""
    for s in slices(column, 1 << 19):
        m = s.last - s.first
        cls = BYTE_CLASS[s.data]
        doc_of = np.repeat(np.arange(m), np.diff(s.offsets))
        x = np.zeros((m, WIDTH), np.float32)
        if len(cls) > 1:
            same = doc_of[1:] == doc_of[:-1]
            code = doc_of[1:] * (CLASSES * CLASSES) + cls[:-1] * CLASSES + cls[1:]
            x[:, :CLASSES * CLASSES] = np.bincount(code[same], minlength=m * CLASSES * CLASSES).reshape(m, -1)
        starts, ends, border = words(s)
        h = span_hashes(s.data, starts, ends)
        doc = np.repeat(np.arange(m), np.diff(border))
        base = CLASSES * CLASSES
        x[:, base:base + HASHED] = np.bincount(doc * HASHED + (h >> np.uint64(56)).astype(np.int64),
                                               minlength=m * HASHED).reshape(m, HASHED)
        shape = x[:, base + HASHED:]
        n = np.diff(border).astype(np.float32)
        near = np.zeros(len(h), bool)
        for lag in range(1, 9):
            if len(h) > lag:
                hit = (h[lag:] == h[:-lag]) & (doc[lag:] == doc[:-lag])
                near[lag:] |= hit
                if lag == 1:
                    shape[:, 0] = np.bincount(doc[lag:][hit], minlength=m)
        shape[:, 1] = np.bincount(doc[near], minlength=m)
        length = np.minimum(ends - starts, 15)
        shape[:, 2:18] = np.bincount(doc * 16 + length, minlength=m * 16).reshape(m, 16)
        distinct = mix(h) + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        first = np.unique(distinct, return_index=True)[1]
        repeats = n - np.bincount(doc[first], minlength=m)
        # Counts become square roots of shares, so that long and short texts compare.
        for a, b in ((0, base), (base, base + HASHED)):
            part = x[:, a:b]
            part /= np.maximum(part.sum(1, keepdims=True), 1)
            np.sqrt(part, out=part)
        shape[:, :18] = np.sqrt(shape[:, :18] / np.maximum(n, 1)[:, None])
        shape[np.arange(m), 18 + np.minimum(np.log2(n + 1), 16).astype(int)] = 0.5
        shape[:, 35] = repeats / np.maximum(n, 1)
        shape[:, 36] = n == 0
        yield s.first, s.last, x


def latent(x: np.ndarray, mean: np.ndarray, scale: np.ndarray, axes: np.ndarray) -> np.ndarray:
    v = ((x - mean) * scale) @ axes
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)


def fit_space(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, column weights and leading axes of the weighted matrix.

    Columns of terms that stand in few texts are weighed up (inverse document frequency); the axes come
    from a subspace iteration with a fixed start, so equal samples give equal spaces.
    """
    n = max(len(x), 1)
    df = (x > 0).sum(0)
    scale = (np.log((n + 1) / (df + 1)) + 1).astype(np.float32)
    scale[CLASSES * CLASSES:CLASSES * CLASSES + HASHED] *= 0.5
    scale[CLASSES * CLASSES + HASHED:] = 2.0
    mean = x.mean(0) if len(x) else np.zeros(WIDTH, np.float32)
    q = np.random.Generator(np.random.PCG64(1)).standard_normal((WIDTH, RANK)).astype(np.float32)
    if len(x):
        centred = (x - mean) * scale
        for _ in range(6):
            q = np.linalg.qr(centred.T @ (centred @ q))[0]
    return mean, scale, q.astype(np.float32)


def vote(v: np.ndarray, voters: np.ndarray, votes: np.ndarray, prior: float) -> np.ndarray:
    """Share of label 1 among the nearest voters, weighed by similarity; a block of exact cosines at a time."""
    out = np.full(len(v), prior)
    k = min(NEIGHBOURS, len(voters))
    for a in range(0, len(v) if k else 0, BLOCK):
        sims = v[a:a + BLOCK] @ voters.T
        near = np.argpartition(sims, -k, axis=1)[:, -k:] if k < len(voters) else np.broadcast_to(np.arange(k), (len(sims), k))
        w = np.maximum(np.take_along_axis(sims, near, 1), 0) ** POWER + 1e-6
        out[a:a + BLOCK] = ((w * votes[near]).sum(1) + 1e-3 * prior) / (w.sum(1) + 1e-3)
    return out


def quality_classifier(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
                       label: str = "quality", sample_rows: int = SAMPLE_ROWS, keep: list[str] | None = None) -> DataFrame:
    """The documents' columns `keep` (default: all) with held_out, score and predicted, one row per document row.

    The voters are a bounded sample of the labelled training texts; every document is compared with all of
    them.  A null text counts as empty; repeated rows get equal rows; without any label the score is 0.5.
    Input columns named like the three results are replaced.
    Read back to the driver: the features of the sample (sample_rows x WIDTH half floats).
    """
    sample = training_sample(docs, labels, label, sample_rows, doc_id, text)

    def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, x in features(batch.column(0)):
                for i in range(0, len(x), 64):
                    part = x[i:i + 64].astype(np.float16)
                    yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in part], pa.binary()),
                                                      batch.column(1).slice(a + i, len(part))], ["x", "label"])

    got = sample.mapInArrow(dense, "x binary, label int").toArrow()
    x = np.frombuffer(b"".join(got.column(0).to_pylist()), np.float16).reshape(-1, WIDTH).astype(np.float32)
    votes = got.column(1).to_numpy().astype(np.float32)
    del got
    mean, scale, axes = fit_space(x)
    prior = float(votes.mean()) if len(votes) else 0.5
    shared = docs.sparkSession.sparkContext.broadcast((mean, scale, axes, latent(x, mean, scale, axes), votes, prior))
    del x

    def score():
        mean, scale, axes, voters, votes, prior = shared.value

        def make(held, texts):
            for a, b, x in features(texts):
                p = vote(latent(x, mean, scale, axes), voters, votes, prior)
                yield a, b, [held.slice(a, b - a), pa.array(np.clip(p, 0, 1).astype(np.float64))]
        return make

    results = ("held_out", "score", "predicted")
    keep = [c for c in (keep or docs.columns) if c not in results]
    out = append_columns(docs, keep, {"held": crc_fold(doc_id, 5) == 0, "text": F.col(text).cast("string")}, score,
                         "held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
