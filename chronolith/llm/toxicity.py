"""Toxicity by a learnt lexicon whose terms are also recognised misspelt, weighed by their context."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from chronolith.llm.common import append_columns, crc_fold, stored

#: Bound on the labelled rows that the model learns from (those first in the order of a hash of their id).
SAMPLE_ROWS = 20_000
#: Bound on the lexicon.
MAX_TERMS = 1_000
#: Prefixes of these lengths are candidates for stems; shorter terms than MIN_FUZZY are matched exactly only.
STEM_LENGTHS = range(4, 9)
MIN_FUZZY = 5
WINDOW = 6
MEMORY_WORDS = 200_000
TOKEN = re.compile(r"[^\W_]+|[\"“”„«»]")
QUOTES = set("\"“”„«»")
FEATURES = 6


def training_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, doc_id: str = "doc_id",
                    text: str = "text", fold: int = 5) -> DataFrame:
    """(text, label) of at most `rows` labelled ids outside the held-out fold, stored.

    An id labelled twice takes its larger label; null labels are no labels.  Only the ids of the sample, whose
    number is bounded, are broadcast; equal texts count once.
    """
    ids = (labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & (crc_fold(doc_id, fold) != 0))
           .groupBy(F.col(doc_id).alias("_id")).agg(F.max(label).cast("int").alias("label"))
           .orderBy(F.xxhash64("_id"), "_id").limit(rows))
    texts = docs.select(F.col(doc_id).alias("_doc"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    chosen = texts.join(F.broadcast(ids), F.col("_doc") == F.col("_id")).select("text", "label")
    return stored(chosen.groupBy(F.xxhash64("text").alias("_h")).agg(F.first("text").alias("text"), F.max("label").alias("label"))
                  .select("text", "label"), "sample")


class Automaton:
    """The trie of the lexicon intersected with the Levenshtein automata of all its terms for one edit.

    A state is the set of trie nodes that the letters read so far can have led to, each with the edits
    spent, and the best stem passed.  States are made when they are first needed and kept, so a word costs
    one look-up per letter and most words leave the lexicon after a few.
    """

    def __init__(self, terms: list[tuple[str, bool]], weight: np.ndarray):
        self.weight = weight  # by (term, misspelt)
        self.children: list[dict[str, int]] = [{}]
        self.depth, self.word, self.stem = [0], [-1], [-1]
        for k, (term, is_stem) in enumerate(terms):
            node = 0
            for c in term:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.depth.append(self.depth[node] + 1)
                    self.word.append(-1)
                    self.stem.append(-1)
                node = self.children[node][c]
            (self.stem if is_stem else self.word)[node] = k
        self.clear()

    def clear(self) -> None:
        self.ids: dict = {}
        self.states: list = []
        self.steps: list[dict[str, int]] = []
        self.ends: list = []
        self._id((((0, 0),), None))

    def _id(self, state) -> int:
        if state not in self.ids:
            self.ids[state] = len(self.states)
            self.states.append(state)
            self.steps.append({})
            self.ends.append(False)
        return self.ids[state]

    def _better(self, best, term: int, misspelt: int):
        w = self.weight[term][misspelt]
        return (term, misspelt) if best is None or w > self.weight[best[0]][best[1]] else best

    def _step(self, at: int, c: str) -> int:
        nodes, best = self.states[at]
        reached: dict[int, int] = {}

        def reach(node, edits):
            if reached.get(node, 2) > edits:
                reached[node] = edits

        for node, edits in nodes:
            own = self.children[node]
            if c in own:
                reach(own[c], edits)
            if not edits:
                reach(node, 1)  # a letter too many
                for child in own.values():
                    reach(child, 1)  # another letter
                    if c in self.children[child]:
                        reach(self.children[child][c], 1)  # a letter missing
        for node, edits in reached.items():
            k = self.stem[node]
            if k >= 0 and (not edits or self.depth[node] > MIN_FUZZY):
                best = self._better(best, k, edits)
        return self._id((tuple(sorted(reached.items())), best)) if reached or best else -1

    def _end(self, at: int):
        nodes, best = self.states[at]
        for node, edits in nodes:
            long = self.depth[node] >= MIN_FUZZY
            if self.word[node] >= 0 and (not edits or long):
                best = self._better(best, self.word[node], edits)
            if not edits:
                for child in self.children[node].values():  # the last letter missing
                    if self.word[child] >= 0 and self.depth[child] >= MIN_FUZZY:
                        best = self._better(best, self.word[child], 1)
        return best

    def match(self, word: str):
        """(term, misspelt) of the heaviest term that the word is or begins with, or None."""
        if len(self.states) > MEMORY_WORDS:
            self.clear()
        at = 0
        for c in word:
            to = self.steps[at].get(c)
            if to is None:
                to = self.steps[at][c] = self._step(at, c)
            if to < 0:
                return None
            at = to
        if self.ends[at] is False:
            self.ends[at] = self._end(at)
        return self.ends[at]


class Reader:
    """Hits of a text, with the class of their context: quoted or not, and other hits close by (0, 1, 2)."""

    def __init__(self, terms, weight):
        self.automaton, self.known, self.hits = Automaton(terms, weight), set(), {}

    def __call__(self, text: str):
        tokens = TOKEN.findall(text.lower())
        new = set(tokens) - self.known
        if len(self.known) + len(new) > MEMORY_WORDS:
            self.known, self.hits, new = set(), {}, set(tokens)
        for w in new:
            hit = self.automaton.match(w) if w not in QUOTES else None
            if hit is not None:
                self.hits[w] = hit
        self.known |= new
        hits = self.hits
        at = [i for i, w in enumerate(tokens) if w in hits]
        found = []
        for k, i in enumerate(at):
            near = sum(abs(j - i) <= WINDOW for j in at[max(0, k - 2):k + 3]) - 1
            quoted = (not QUOTES.isdisjoint(tokens[max(0, i - WINDOW):i])
                      and not QUOTES.isdisjoint(tokens[i + 1:i + 1 + WINDOW]))
            found.append((*hits[tokens[i]], 3 * quoted + min(near, 2)))
        return found, len(tokens)


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of either label that hold each word, or a word that goes on after the prefix."""
    for batch in batches:
        seen = (Counter(), Counter())
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ws = {w for w in TOKEN.findall(text.lower()) if 3 <= len(w) <= 40}
            seen[label > 0].update({(w, False) for w in ws} | {(w[:n], True) for w in ws for n in STEM_LENGTHS if len(w) > n})
            seen[label > 0][("", False)] += 1
        keys = list(seen[0].keys() | seen[1].keys())
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys]), pa.array([k[1] for k in keys]),
             pa.array([seen[1][k] for k in keys], pa.int64()), pa.array([seen[0][k] for k in keys], pa.int64())],
            ["term", "is_stem", "toxic", "clean"])


def without_covered(found: list[tuple[str, bool, float]]) -> list[tuple[str, bool, float]]:
    """The (term, is_stem, log odds) that no stem covers.

    A stem covers what goes on after it with log odds about as high, and its own whole word with lower ones.  A term
    that is also recognised misspelt is covered only by a stem that is so too: one of more than
    MIN_FUZZY letters matches each of its misspellings, a shorter one only those that leave the stem as it is.
    """
    stems = {term: odds for term, is_stem, odds in found if is_stem}

    def covered(term, is_stem, odds):
        fuzzy = len(term) > MIN_FUZZY if is_stem else len(term) >= MIN_FUZZY
        least = MIN_FUZZY + 1 if fuzzy else min(STEM_LENGTHS)
        return (any(stems.get(term[:n], 0) > odds - 0.3 for n in range(least, len(term)))
                or not is_stem and not fuzzy and stems.get(term, 0) > odds)

    return [x for x in found if not covered(*x)]


def learn_lexicon(sample: DataFrame) -> tuple[list[tuple[str, bool]], np.ndarray, tuple[int, int]]:
    """Terms, their log odds, and the numbers of toxic and clean texts; the driver reads MAX_TERMS rows at most."""
    counts = (sample.mapInArrow(_term_counts, "term string, is_stem boolean, toxic long, clean long")
              .groupBy("term", "is_stem").agg(F.sum("toxic").alias("a"), F.sum("clean").alias("c")))
    counts = stored(counts.where((F.col("a") >= 3) | (F.col("term") == "")), "terms")
    whole = counts.where("term = ''").agg(F.sum("a"), F.sum("c")).first()
    n_toxic, n_clean = whole[0] or 0, whole[1] or 0
    odds = F.log((F.col("a") + 0.5) / (n_toxic + 1.0)) - F.log((F.col("c") + 0.5) / (n_clean + 1.0))
    best = (counts.where("term <> ''").select("term", "is_stem", odds.alias("odds"), (odds * F.sqrt("a")).alias("z"))
            .where("odds > 1 AND z > 6").orderBy(F.desc("z"), "term", "is_stem").limit(MAX_TERMS).collect())
    kept = without_covered([(r["term"], r["is_stem"], r["odds"]) for r in best])
    return [(term, is_stem) for term, is_stem, _ in kept], np.array([x for *_, x in kept]), (n_toxic, n_clean)


def calibrate(sample: DataFrame, terms, odds: np.ndarray, totals) -> tuple[np.ndarray, np.ndarray]:
    """Weights by (term, misspelt), and by context class, from the hits in the sample."""
    weight = np.stack([odds, odds * 0.6], 1) if len(odds) else np.zeros((0, 2))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, seen = Reader(terms, weight), (Counter(), Counter())
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found, _ = read(text)
                seen[label > 0].update({f"t{t}_{m}" for t, m, _ in found})
                seen[label > 0].update(f"c{c}" for _, m, c in found if not m)
        keys = list(seen[0].keys() | seen[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([seen[1][k] for k in keys], pa.int64()),
                                          pa.array([seen[0][k] for k in keys], pa.int64())], ["key", "toxic", "clean"])

    rows = (sample.mapInArrow(count, "key string, toxic long, clean long").groupBy("key")
            .agg(F.sum("toxic"), F.sum("clean")).collect())
    got = {r[0]: (r[1], r[2]) for r in rows}
    rate = (totals[0] + 1) / (totals[1] + 1)
    for k in range(len(terms)):
        a, c = got.get(f"t{k}_1", (0, 0))
        prior = 0.6 * odds[k]
        weight[k, 1] = min(prior, max(0.0, math.log((a + 2 * rate * math.exp(prior)) / ((c + 2) * rate))))
    hits = [sum(got.get(f"c{c}", (0, 0))[i] for c in range(6)) for i in (0, 1)]
    context = np.zeros(6)
    for c in range(6):
        a, b = got.get(f"c{c}", (0, 0))
        quoted = math.exp(-1.0) if c >= 3 else 1.0  # without evidence, a quotation counts less than abuse
        context[c] = math.log((a + 5 * quoted) / (b + 5) * (hits[1] + 5) / (hits[0] + 5))
    return weight, np.exp(np.clip(context, -2, 2))


def featurize(read: Reader, weight: np.ndarray, context: np.ndarray, text: str) -> list[float]:
    found, n = read(text)
    exact = sum(weight[t][0] * context[c] for t, m, c in found if not m)
    fuzzy = sum(weight[t][1] * context[c] for t, m, c in found if m)
    total = exact + fuzzy
    return [math.log1p(exact), math.log1p(fuzzy), total / math.sqrt(n + 10), 100 * total / (n + 50),
            max((weight[t][m] * context[c] for t, m, c in found), default=0.0), math.log1p(n)]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Newton steps on standardised columns; returns coefficients of the raw columns, then the intercept."""
    if not len(y):
        return np.zeros(x.shape[1] + 1)
    mean, sd = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack([(x - mean) / sd, np.ones(len(y))])
    penalty = np.diag([ridge] * x.shape[1] + [1e-3])
    b = np.zeros(z.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        b += np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty, z.T @ (y - p) - penalty @ b)
    raw = b[:-1] / sd
    return np.append(raw, b[-1] - raw @ mean)


def toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
             label: str = "toxic", sample_rows: int = SAMPLE_ROWS, keep: list[str] | None = None) -> DataFrame:
    """The documents' columns `keep` (default: all) with held_out, score and predicted, one row per document row.

    Only texts and the labels of training ids teach the model; a score depends on the text alone.  A null
    text counts as empty and gets the score of a text without hits; repeated rows get equal rows; with no
    label of either kind the score is 0.5.  Input columns named like the three results are replaced.  Read
    back to the driver: the lexicon (MAX_TERMS rows), its counts, and FEATURES numbers for each row of the
    bounded sample.
    """
    sample = training_sample(docs, labels, label, sample_rows, doc_id, text)
    terms, odds, totals = learn_lexicon(sample)
    weight, context = calibrate(sample, terms, odds, totals)
    shared = docs.sparkSession.sparkContext.broadcast((terms, weight.tolist(), context.tolist()))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, w, c = shared.value
        read = Reader(t, w)
        for batch in batches:
            x = [featurize(read, w, c, v) for v in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(1)], ["x", "label"])

    got = sample.mapInArrow(features, "x array<double>, label int").toArrow()
    x = np.array(got.column(0).to_pylist(), float).reshape(-1, FEATURES)
    b = fit_logistic(x, got.column(1).to_numpy().astype(float))

    def score():
        t, w, c = shared.value
        read = Reader(t, w)

        def make(held, texts):
            for a in range(0, len(texts), 512):
                part = texts.slice(a, 512).to_pylist()
                z = np.array([featurize(read, w, c, v or "") for v in part]) @ b[:-1] + b[-1]
                yield a, a + len(part), [held.slice(a, len(part)), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))]
        return make

    results = ("held_out", "score", "predicted")
    keep = [c for c in (keep or docs.columns) if c not in results]
    out = append_columns(docs, keep, {"held": crc_fold(doc_id, 5) == 0, "text": F.col(text).cast("string")}, score,
                         "held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
