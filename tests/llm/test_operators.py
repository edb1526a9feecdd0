"""Operators of chronolith.llm against brute force, and on nulls, empty, long, tied, repeated and clashing input."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chronolith.llm import (common, hidden_markov as hm, line_dedup as ld, near_dedup as nd, packing, piece_sampling as ps,
                            quality_classifier as qc, quality_rules as qr, token_counts as tc, toxicity as tox, winnowing as wn)

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, score string, row int, h string, n int, "
          "t string, label int, kept string, ids string, furniture string, bucket int")
rng = random.Random(5)
VOCAB = ["alpha", "beta", "gamma", "delta", "straße", "ñandú", "x", "The", "the", "日本", "end.", "a|b", "###"]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCAB) + r.choice(["", "", ",", ".", "\n"]) for _ in range(n))


LONG = prose(30_000, 99)
TEXTS = [None, "", " \n\t ", "one", "two words", "A b C", "a B c", prose(80, 1), prose(80, 1), prose(81, 2), LONG,
         "line one here.\nline two here.\nline one here.\n", "▁ odd \x00 bytes 🎉🎉", "idiot " * 30, prose(300, 3)]


@pytest.fixture(scope="module")
def edge(spark):
    rows = [(i, t, "en", None if i % 7 == 3 else f"s{i % 2}", 0, "x", 1, "h", 2, "t", 1, "k", "i", "f", 3)
            for i, t in enumerate(TEXTS)]
    rows += [rows[7], rows[7], (None, "no id at all", "en", "s0", 0) + rows[0][5:], (None, None, None, None, None) + rows[0][5:]]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, int(i % 5 == 0), "x") for i in range(-40, 15)] + [(3, None, None, "x"), (None, 1, 1, "x")],
                                 "doc_id long, quality int, toxic int, text string")


def rows_of(df, key="doc_id"):
    return sorted((r.asDict() for r in df.collect()), key=lambda r: repr(r.get(key)))


def words_of(text):
    return WORDS.findall(text or "")


# --- shared ------------------------------------------------------------------------

def test_words_and_hashes():
    texts = [t or "" for t in TEXTS]
    got = []
    for s in common.slices(pa.array(TEXTS), 4000):
        a, b, border = common.words(s)
        raw = s.data.tobytes()
        assert [common.word_hash(raw[i:j].decode()) for i, j in list(zip(a, b))[:200]] == \
            common.span_hashes(s.data, a, b)[:200].tolist()
        got += [[raw[i:j].decode() for i, j in zip(a[x:y], b[x:y])] for x, y in zip(border[:-1], border[1:])]
    assert got == [words_of(t) for t in texts]
    assert common.word_hash("AbC") == common.word_hash("aBc") != common.word_hash("abd")
    assert common.word_hash("AbC", False) != common.word_hash("abc", False)
    many = {common.word_hash("".join(w)) for w in itertools.product("abcdef", repeat=5)}
    assert len(many) == 6 ** 5


# --- 1 -----------------------------------------------------------------------------

def shingles(text, width):
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in words_of(text)]
    n = min(width, len(w))
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if n else set()


def brute_components(rows, width, percent):
    sets = [shingles(t, width) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
            root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [(d, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))]


@pytest.mark.parametrize("width,percent", [(3, 85), (5, 80)])
def test_near_dedup_brute_force(spark, edge, width, percent):
    r = random.Random(8)
    vocabulary = [f"w{i}" for i in range(60)]
    rows = [(x.doc_id, x.text) for x in edge.select("doc_id", "text").collect()]
    for g in range(12):  # groups of near copies on both sides of the threshold, chains included
        base = [r.choice(vocabulary) for _ in range(r.choice([6, 8, 40, 120]))]
        for k in range(12):
            for _ in range(r.choice([0, 1, 1, 2])):
                base[r.randrange(len(base))] = r.choice(vocabulary)
            rows.append((1000 + 100 * g + k, " ".join(base)))
    got = nd.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), width=width, percent=percent).collect()
    want = brute_components(rows, width, percent)
    assert sorted(map(repr, ((x.doc_id, x.n_shingles, x.component_id) for x in got))) == sorted(map(repr, want))
    assert all(x.kept == (x.doc_id == x.component_id) for x in got if x.doc_id is not None)


def test_signatures_agree_with_similarity():
    r = np.random.Generator(np.random.PCG64(3))
    for size in (8, 60, 3000):
        a = np.unique(r.integers(0, 2**64, size, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: int(size * 0.85)], r.integers(0, 2**64, max(size // 20, 1), dtype=np.uint64)]))
        sig = nd.signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), 4200)
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((sig[0] == sig[1]).mean() - true) < (0.25 if size < 10 else 0.08)
    assert (nd.signatures(np.zeros(0, np.uint64), np.array([0, 0])) == nd.EMPTY).all()


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 90), (90, 95), (7, 60)]
    got = {r.c: r.root for r in nd.components(spark.createDataFrame(edges, "centre long, other long")).collect()}
    assert all(got[i] == 0 for i in range(1, 41)) and got[60] == 0 and got[95] == 90 and got[100] == 90


def test_most_frequent_sorts_no_dictionary(spark):
    r = random.Random(3)
    rows = [(r.getrandbits(64) - 2**63, int(r.paretovariate(1))) for _ in range(3000)]
    counts = spark.createDataFrame(rows, "h long, n long")
    want = sorted(rows, key=lambda x: (-x[1], x[0]))
    for k in (0, 1, 7, 400, 2999, 3000, 9000):
        got = [tuple(x) for x in common.most_frequent(counts, k).collect()]
        assert len(got) == min(k, 3000) and set(got) == set(want[:k])
    plan = common.most_frequent(counts, 7)._jdf.queryExecution().optimizedPlan().toString()
    assert "Sort [n" not in plan


# --- 2 -----------------------------------------------------------------------------

def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_brute_force():
    r = random.Random(1)
    terms = list({("".join(r.choice("abc") for _ in range(r.randint(3, 7))), r.random() < 0.4) for _ in range(25)})
    machine = tox.Automaton(terms, np.ones((len(terms), 2)))
    for _ in range(4000):
        w = "".join(r.choice("abcd") for _ in range(r.randint(1, 9)))
        hit = False
        for term, stem in terms:
            if stem:
                hit |= w.startswith(term) or len(term) > tox.MIN_FUZZY and any(
                    distance(w[:i], term) <= 1 and w[:i] != term[:-1] for i in range(1, len(w) + 1))
            else:
                hit |= w == term or len(term) >= tox.MIN_FUZZY and distance(w, term) <= 1
        assert (machine.match(w) is not None) == hit, w


def test_quotation_counts_less():
    read = tox.Reader([("moron", False)], np.ones((1, 2)))
    plain, quoted = read("you are a moron and that is all"), read('she said "moron" and that is all')
    assert plain[0] == [(0, 0, 0)] and quoted[0] == [(0, 0, 3)]
    assert read("a mroon, a morom, a morron")[0] and read("nothing here")[0] == []


def test_learnt_terms_are_recognised_misspelt(spark):
    insults = ["idiot", "moron", "stupid", "disgusting", "pathetic", "worthless"]
    r = random.Random(8)
    calm = ["".join(r.choice("bcdfghklmnprtv") + r.choice("aeou") for _ in range(3)) for _ in range(60)]
    held = [i for i in range(800) if zlib.crc32(str(i).encode()) % 5 == 0]
    wrong = {}
    for k, i in enumerate(held[:24]):  # the first letters are wrong, so no short stem is left whole
        w = insults[k % 6]
        wrong[i] = ["z" + w[1:], w[0] + w[2:], w[:2] + "q" + w[2:], w[:3] + "q" + w[4:]][k // 6]
    rows, marks = [], []
    for i in range(800):
        toxic = i in wrong or i not in held and i % 4 == 0
        ws = [r.choice(calm) for _ in range(20)]
        if toxic:
            ws[5] = ws[14] = wrong.get(i) or r.choice(insults)
            if i not in wrong and i % 16 == 0:  # some in the sample too, each spelling too rare to be learnt
                ws[5] = ws[14] = ws[5][:1] + "bcfghjklvwxyz"[i // 16 % 13] + ws[5][1:]
        rows.append((i, " ".join(ws)))
        marks.append((i, int(toxic)))
    docs, marked = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")
    terms, _, _ = tox.learn_lexicon(tox.training_sample(docs, marked, "toxic", 1000))
    machine = tox.Automaton(terms, np.array([[1, 0.6]] * len(terms)))
    assert all(machine.match(w)[1] == 0 for w in insults)
    assert not [w for w in wrong.values() if not machine.match(w)] and not [w for w in calm if machine.match(w)]
    got = {x.doc_id: x.predicted for x in tox.toxicity(docs, marked).where("held_out").collect()}
    assert all(got[i] == (i in wrong) for i in held)


def test_toxicity_edges(spark, edge, labels):
    out = tox.toxicity(edge, labels)
    assert out.columns == [c for c in edge.columns if c != "score"] + ["held_out", "score", "predicted"]
    got = out.collect()
    assert len(got) == edge.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    for r in got:
        assert r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 5 == 0)
    assert len({r.score for r in got if r.doc_id == 7}) == 1
    assert tox.toxicity(edge.limit(0), labels).count() == 0
    assert {r.score for r in tox.toxicity(edge, labels.limit(0)).collect()} == {0.5}


# --- 3 -----------------------------------------------------------------------------

def tiny_model():
    r = np.random.Generator(np.random.PCG64(2))
    make = lambda *s: (lambda x: x / x.sum(-1, keepdims=True))(r.random(s))
    return hm.Model(make(3), make(3, 3), make(3, 5).T)


def test_forward_and_expectations_brute_force():
    m, seqs = tiny_model(), [[1, 2, 0], [4], [3, 3, 1, 0, 2], [0, 0]]
    flat, length = np.array(sum(seqs, [])), np.array([len(s) for s in seqs])
    begin = np.concatenate([[0], np.cumsum(length)[:-1]])
    starts, moves, emitted, logs = np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3)), []
    for s in seqs:
        paths = {}
        for path in itertools.product(range(3), repeat=len(s)):
            p = m.start[path[0]] * m.emit[s[0], path[0]]
            for a, b, o in zip(path, path[1:], s[1:]):
                p *= m.move[a, b] * m.emit[o, b]
            paths[path] = p
        total = sum(paths.values())
        logs.append(np.log10(total))
        for path, p in paths.items():
            starts[path[0]] += p / total
            for a, b in zip(path, path[1:]):
                moves[a, b] += p / total
            for o, k in zip(s, path):
                emitted[o, k] += p / total
    assert np.allclose(hm.log10_likelihood(m, flat, begin, length), logs, atol=1e-12)
    for got, want in zip(hm.expected_counts(m, flat, hm.segments(np.append(begin, len(flat)))), (starts, moves, emitted)):
        assert np.allclose(got, want, atol=1e-4)


def counts_in_segments(model, flat, border, limit=10**9):
    total = None
    for parts in hm.segments(border).blocks(limit):
        found = hm.expected_counts(model, flat, parts)
        total = found if total is None else tuple(a + b for a, b in zip(total, found))
    return total


@pytest.mark.parametrize("segment,margin,limit,apart", [(3, 1000, 10**9, 1e-4), (3, 1000, 1, 1e-4), (512, 64, 10**9, 1e-3), (512, 64, 700, 1e-3)])
def test_segments_count_as_whole_sequences(monkeypatch, segment, margin, limit, apart):
    r = np.random.Generator(np.random.PCG64(7))
    sizes = np.array([0, 1, 3, 4, 60, 700, 1100]) if segment > 3 else np.array([0, 1, 2, 3, 4, 7, 31])
    border = np.concatenate([[0], np.cumsum(sizes)])
    flat = r.integers(0, 5, border[-1])
    m = tiny_model()
    monkeypatch.setattr(hm, "SEGMENT", 10**6)
    whole = counts_in_segments(m, flat, border)
    monkeypatch.setattr(hm, "SEGMENT", segment)
    monkeypatch.setattr(hm, "MARGIN", margin)
    parts = counts_in_segments(m, flat, border, limit)
    for got, want in zip(parts, whole):
        assert np.allclose(got, want, atol=apart, rtol=apart)
    assert abs(parts[0].sum() - (sizes > 0).sum()) < 1e-3 and abs(parts[1].sum() - np.maximum(sizes - 1, 0).sum()) < 1e-2
    assert abs(parts[2].sum() - sizes.sum()) < 1e-2


@pytest.mark.parametrize("frequent", [4, 1 << 18])
def test_hmm_score_brute_force(spark, edge, monkeypatch, frequent):
    kept = {}
    learn, train = hm.learn_words, hm.train
    monkeypatch.setattr(hm, "FREQUENT", frequent)
    monkeypatch.setattr(hm, "OWN_CLASSES", 3)
    monkeypatch.setattr(hm, "SEGMENT", 3)
    monkeypatch.setattr(hm, "learn_words", lambda d: kept.setdefault("words", learn(d)))
    monkeypatch.setattr(hm, "train", lambda *a: kept.setdefault("model", train(*a)))
    got = hm.hmm_scores(edge, states=2, rounds=2).collect()
    counts, lexicon, _ = kept["words"]
    n_of, m = {r.h: (r.n, r.cls) for r in counts.collect()}, kept["model"]
    own = {int(h): int(c) for h, c in zip(lexicon.h, lexicon.cls) if c <= hm.OWN_CLASSES}

    def score(text):
        total, classes = 0.0, []
        for w in words_of(text):
            raw = np.frombuffer(w.encode(), np.uint8)
            h = int(np.uint64(common.word_hash(w)).view(np.int64))
            opened = int(hm.open_class(raw, np.array([0]), np.array([len(raw)]))[0])
            if h in own:
                classes.append(own[h])
            else:
                classes.append(1 + hm.OWN_CLASSES + opened)
                total += np.log10((n_of.get(h, (0, 0))[0] + 0.1) / (lexicon.open_n[opened] + 0.1 * (lexicon.open_v[opened] + 1)))
        a = m.start
        for t, c in enumerate(classes + [hm.END]):
            a = (a if t == 0 else a @ m.move) * m.emit[c]
            total += np.log10(a.sum())
            a = a / a.sum()
        return total

    key = lambda x: (repr(x[0]), round(x[1], 6))
    want = sorted([(r.doc_id, score(r.text)) for r in edge.select("doc_id", "text").collect()], key=key)
    mine = sorted([(r.doc_id, r.score) for r in got], key=key)
    assert len(mine) == len(want)
    for a, b in zip(mine, want):
        assert a[0] == b[0] and abs(a[1] - b[1]) < 1e-6 * max(1, abs(b[1]))


def test_hmm_other_columns(spark):
    rows = [(i, f"tok{i % 7} b c", "x", "y", "z") for i in range(30)] + [(None, None, None, None, None)]
    plain = spark.createDataFrame(rows, "doc_id long, text string, t string, held_out string, row string")
    odd = plain.toDF("a.id", "a.text", "doc_id", "held_out", "seq")
    want = sorted(map(repr, hm.hmm_scores(plain, states=2, rounds=1).collect()))
    assert sorted(map(repr, hm.hmm_scores(odd, "a.id", "a.text", states=2, rounds=1).collect())) == want


@pytest.mark.parametrize("frequent", [4, 1 << 18])
def test_hmm_counts_brute_force(spark, edge, monkeypatch, frequent):
    monkeypatch.setattr(hm, "FREQUENT", frequent)
    monkeypatch.setattr(hm, "OWN_CLASSES", 3)
    rows = [(r.doc_id, r.text) for r in edge.select("doc_id", "text").collect()]
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0
    low = lambda t: [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in words_of(t)] + [None]
    c = {}
    for d, t in rows:
        if not held(d):
            for w in low(t):
                c[w] = c.get(w, 0) + 1
    n, v = sum(c.values()), len(c)
    got = hm.hmm_scores(edge, states=2, rounds=2).collect()
    want = []
    for d, t in rows:
        ws = low(t)
        want.append((d, held(d), len(ws), sum(w in c for w in ws), n,
                     sum(np.log10((c.get(w, 0) + 0.1) / (n + 0.1 * (v + 1))) for w in ws)))
    key = lambda x: (repr(x[0]), x[2], round(x[5], 6))
    mine = sorted([(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got], key=key)
    for a, b in zip(mine, sorted(want, key=key)):
        assert a[:5] == b[:5] and abs(a[5] - b[5]) < 1e-6 * max(1, abs(b[5]))
    assert all(r.score < 0 and np.isfinite(r.score) for r in got)
    assert hm.hmm_scores(edge.limit(0)).count() == 0


# --- 4 -----------------------------------------------------------------------------

def test_votes_are_exact_neighbours():
    r = np.random.Generator(np.random.PCG64(4))
    v, voters, votes = r.standard_normal((600, 8)), r.standard_normal((90, 8)), r.integers(0, 2, 90).astype(float)
    v /= np.linalg.norm(v, axis=1)[:, None]
    voters /= np.linalg.norm(voters, axis=1)[:, None]
    got = qc.vote(v, voters, votes, 0.5)
    for i in range(0, 600, 37):
        sims = voters @ v[i]
        near = np.argsort(-sims)[:qc.NEIGHBOURS]
        w = np.maximum(sims[near], 0) ** qc.POWER + 1e-6
        assert abs(got[i] - ((w * votes[near]).sum() + 5e-4) / (w.sum() + 1e-3)) < 1e-9
    assert (qc.vote(v, voters[:0], votes[:0], 0.5) == 0.5).all()


def test_quality_edges(spark, edge, labels):
    got = qc.quality_classifier(edge, labels).collect()
    assert len(got) == edge.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert qc.quality_classifier(edge.limit(0), labels, keep=["doc_id"]).count() == 0
    assert {r.score for r in qc.quality_classifier(edge, labels.limit(0)).collect()} == {0.5}


# --- 5, 8 --------------------------------------------------------------------------

@pytest.mark.parametrize("frequent", [3, 1 << 18])
def test_token_counts_match_the_library(spark, edge, frequent):
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(tc.TOKENIZER))
    got = tc.token_counts(edge, frequent=frequent).collect()
    want = [(r.doc_id, len((r.text or "").encode()), len(model.encode(r.text or ""))) for r in edge.collect()]
    assert sorted(map(repr, ((r.doc_id, r.n_bytes, r.n_tokens) for r in got))) == sorted(map(repr, want))
    assert all(r.over_limit == (r.n_tokens > 4096) for r in got)
    assert tc.token_counts(edge.limit(0)).count() == 0


def test_sampled_pieces_decode_to_the_text(spark, edge):
    once = ps.decode(ps.encode_sampled(edge)).collect()
    assert all(r.decoded == r.text for r in once)
    again = ps.encode_sampled(edge.repartition(5)).collect()
    assert sorted(repr((r.doc_id, r.ids)) for r in once) == sorted(repr((r.doc_id, r.ids)) for r in again)
    other = ps.encode_sampled(edge, seed=8).collect()
    assert sorted(repr((r.doc_id, r.ids)) for r in once) != sorted(repr((r.doc_id, r.ids)) for r in other)
    assert ps.encode_sampled(edge.limit(0)).count() == 0


def test_sampling_follows_the_lattice():
    import public_tokenizers

    v = ps.Vocabulary(public_tokenizers.path(ps.MODEL), 1.0)
    n, raw = 60_000, np.frombuffer(b" other hello", np.uint8)
    lattices = ps.Lattices(v, raw, np.array([0, 6]), np.array([6, 12]))
    flat, count = ps.sample(lattices, np.full(n, lattices.end[1]), common.mix(np.arange(n, dtype=np.uint64)))
    border = np.concatenate([[0], np.cumsum(count)])
    seen = {}
    for i in range(n):
        k = tuple(flat[border[i]:border[i + 1]].tolist())
        seen[k] = seen.get(k, 0) + 1

    def paths(x):
        if not x:
            yield (), 1.0
        for j in range(1, len(x) + 1):
            if x[:j] in v.weight:
                for rest, p in paths(x[j:]):
                    yield (v.weight[x[:j]][0], *rest), p * np.exp(v.weight[x[:j]][1])
    weights = dict(paths(" hello"))
    total = sum(weights.values())
    assert set(seen) <= set(weights) and all(abs(seen.get(k, 0) / n - w / total) < 0.01 for k, w in weights.items())


# --- 6 -----------------------------------------------------------------------------

def test_quality_rules_brute_force(spark, edge):
    want = []
    for r in edge.select("doc_id", "text").collect():
        t = r.text or ""
        w = words_of(t)
        at = {}
        for i in range(len(w) - 2):
            at.setdefault(tuple(w[i:i + 3]), []).append(i)
        covered = {p for v in at.values() if len(v) > 1 for i in v for p in (i, i + 1, i + 2)}
        lines = [x for x in t.split("\n") if WORDS.search(x)]
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        want.append((r.doc_id, len(w), sum(map(len, w)), sum(c in qr.SYMBOLS for c in t), len(lines) - len(set(lines)),
                     len(covered), failed))
    got = qr.quality_rules(edge).collect()
    assert sorted(map(repr, (tuple(r)[:7] for r in got))) == sorted(map(repr, want))
    assert not any(r.kept and r.base_failed for r in got)
    assert qr.quality_rules(edge.limit(0)).count() == 0


def test_quality_verdicts(spark):
    good = "\n".join(f"Sentence number {i} says that word{i} follows thing{i + 7} without any harm." for i in range(12))
    menu = "\n".join(f"Home{i} | About{i} | Contact{i} | Login{i} | More{i} | Shop{i}" for i in range(15))
    df = spark.createDataFrame([(1, good), (2, menu), (3, good + "\nHome | About | More"), (4, good + "\nAll rights reserved.")],
                               "doc_id long, text string")
    got = {r.doc_id: r for r in qr.quality_rules(df).collect()}
    assert [got[i].kept for i in (1, 2, 3, 4)] == [True, False, True, True]
    assert got[1].clean_text == got[3].clean_text == got[4].clean_text == good


# --- 7 -----------------------------------------------------------------------------

def test_plan_is_best_fit_decreasing():
    r = random.Random(1)
    for _ in range(80):
        limit = r.choice([5, 16, 64])
        counts = {n: r.randint(1, 30) for n in r.sample(range(1, limit + 1), r.randint(1, limit))}
        sequences, ranks = {}, {}
        for length, rank, n, per, first, offset in packing.plan_best_fit(counts, limit):
            for k in range(n):
                sequences.setdefault(first + k // per, []).append((offset + k % per * length, length))
                ranks.setdefault(length, []).append(rank + k)
        assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(n)) for k, n in counts.items()}
        for slots in sequences.values():
            end = 0
            for offset, length in sorted(slots):
                assert offset == end
                end += length
            assert end <= limit
        rooms = []
        for length in sorted(counts, reverse=True):
            for _ in range(counts[length]):
                fits = [i for i, room in enumerate(rooms) if room >= length]
                if fits:
                    rooms[min(fits, key=lambda i: rooms[i])] -= length
                else:
                    rooms.append(limit - length)
        assert len(sequences) == len(rooms)


def test_packing_brute_force(spark, edge):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    extra = spark.createDataFrame([(50, "x<|endoftext|>y <|startoftext|> İΣΑΣ ΣΑΣ"), (51, "it's we'll 12345 ...!!!")], "doc_id long, text string")
    docs = edge.select("doc_id", "text").union(extra)
    got = packing.best_fit_packing(docs).collect()
    want = []
    for r in docs.collect():
        ids = np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(r.doc_id, a // 2048, a, len(ids[a:a + 2048]), zlib.crc32(ids[a:a + 2048].tobytes())) for a in range(0, len(ids), 2048)]
    assert sorted(map(repr, (tuple(r)[:5] for r in got))) == sorted(map(repr, want))
    filled = {}
    for r in got:
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for slots in filled.values():
        assert [o for o, _ in sorted(slots)] == [sum(n for _, n in sorted(slots)[:i]) for i in range(len(slots))]
        assert sum(n for _, n in slots) <= 2048
    assert packing.best_fit_packing(edge.limit(0)).count() == 0


# --- 9 -----------------------------------------------------------------------------

def test_line_dedup_brute_force(spark, edge):
    rows = [(i, f"body {i} of its own.\n  Menu of the site \nshared by {i // 2}\n", "big" if i % 3 else None) for i in range(40)]
    rows += [(100 + i, "exact copy line one\nexact copy line two", "big") for i in range(30)] + [(200, None, "big"), (201, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in ld.line_dedup(docs, max_ratio=0.1).collect()}
    assert len(got) == len(rows)
    assert all(got[i].text == f"body {i} of its own.\nshared by {i // 2}\n" and got[i].n_dropped == 1 and got[i].n_lines == 3
               for i in range(40))
    assert all(got[100 + i].text == "exact copy line one\nexact copy line two" for i in range(30))
    assert got[200].text is None and got[200].n_lines == 0 and got[201].text == ""
    out = ld.line_dedup(edge)
    assert out.count() == edge.count() and out.columns == edge.columns + ["n_lines", "n_dropped"]
    assert ld.line_dedup(edge.limit(0)).count() == 0


# --- 10 ----------------------------------------------------------------------------

def winnow(text):
    import xxhash

    def chain(ws):
        h = 42
        for w in ws:
            h = xxhash.xxh64_intdigest(w.encode(), seed=h)
        return h
    w = words_of(text)
    grams = [chain(w[i:i + wn.K]) for i in range(len(w) - wn.K + 1)] if len(w) >= wn.K else [chain([" ".join(w)])] if w else []
    rank = [(g >> 31) - (1 << 33 if g >> 63 else 0) for g in grams]
    at = []
    for j in range(max(1, len(grams) - wn.W + 1)) if grams else []:
        best = min(range(j, min(j + wn.W, len(grams))), key=lambda i: (rank[i], -i))
        if best not in at[-1:]:
            at.append(best)
    return [(grams[i] >> 31, i) for i in at]


def test_fingerprints_brute_force(spark, edge):
    docs = edge.where("doc_id is not null").dropDuplicates(["doc_id"])
    rows = sorted((r.doc_id, r.text or "") for r in docs.collect())
    got = {r.doc_id: r for r in wn.fingerprints(docs).collect()}
    assert len(got) == len(rows)
    for k, (d, t) in enumerate(rows):
        after, half = rows[(k + 1) % len(rows)][1], len(t) // 2
        edited = t[:len(t) - half] + after[:half]
        prints = [winnow(x) for x in (t, edited, after)]
        sets = [{h for h, _ in p} for p in prints]
        like = [len(sets[0] & s) / len(sets[0] | s) if sets[0] | s else 1.0 for s in sets[1:]]
        r = got[d]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == " ".join(f"{h:x}:{p}" for h, p in prints[0])
        assert r.edited_fingerprint == " ".join(f"{h:x}:{p}" for h, p in prints[1])
        assert [r.near_edited, r.near_next] == like
    assert wn.fingerprints(edge).count() == edge.count()
    assert wn.fingerprints(edge.limit(0)).count() == 0


def test_winnowing_guarantee():
    run = [f"common{i}" for i in range(wn.K + wn.W - 1)]
    a = " ".join([f"a{i}" for i in range(30)] + run + [f"b{i}" for i in range(9)])
    b = " ".join([f"c{i}" for i in range(11)] + run + [f"d{i}" for i in range(40)])
    assert {h for h, _ in winnow(a)} & {h for h, _ in winnow(b)}


def test_prefix_filter_loses_no_link(spark, monkeypatch):
    """Without stars every link must come from the prefix filter."""
    monkeypatch.setattr(nd, "STARS", 0)
    r = random.Random(21)
    rows = []
    for g in range(6):  # groups around the threshold: each copy has edits of its own
        base = [f"g{g}w{k}" for k in range(r.choice([30, 90, 200]))]
        for k in range(25):
            words = list(base)
            for _ in range(r.randrange(0, max(len(base) // 20, 2))):
                at = r.randrange(len(words))
                words[at:at + r.choice([0, 1, 1])] = [f"own{g}x{k}y{r.randrange(9)}"]
            rows.append((100 * g + k, " ".join(words)))
    got = nd.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((x.doc_id, x.n_shingles, x.component_id) for x in got) == sorted(brute_components(rows, 3, 85))
    assert len({x.component_id for x in got}) > 20


def test_class_filter_knows_every_class(spark, monkeypatch):
    keys = np.random.Generator(np.random.PCG64(4)).integers(-2**63, 2**63, 3000)
    active = spark.createDataFrame([(int(k),) for k in keys], "a long")
    for bits in (1 << 13, 1 << 28):
        monkeypatch.setattr(nd, "FILTER_BITS", bits)
        known = nd.class_filter(active)
        assert len(known) * 8 == min(1 << 16, bits)
        assert all((((known[p >> 3] >> (p & 7)) & 1) == 1).all() for p in nd._filter_bits(keys.view(np.uint64), 8 * len(known)))
