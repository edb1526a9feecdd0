"""Tokenizer alignment, BPE and ranked search against the libraries and brute force."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from chronolith.llm import bpe_codec as bc, perfect_hash as ph, ranked_search as rs, spans, token_alignment as ta

CLASH = "doc_id long, text string, ids string, _text string, `a.b` int, __in0 string, decoded string, n long, row int, rank string, item long, t string, key long"
ALPHABET = [" ", "  ", "\n", "\n\n", "\t", "a", "B", "the", "ing", "'s", "'LL", "İ", "क़", ".", ",", "é", "é", "́", "ß", "ΑΣ", "1", "23", "½",
            " ", " ", "　", "\x85", "\x1c", "日本", "🎉", "<|endoftext|>", "<|startoftext|>", "<|", "<s>", "<0x41>", "aaaa", "\x00", "ﬁ", "​",
            "\r", "\r\n", ";", "_", "한국"]


def texts(seed, n=600, extra=()):
    r = random.Random(seed)
    out = ["".join(r.choice(ALPHABET) for _ in range(r.randrange(0, 40))) for _ in range(n)]
    return out + [None, "", " ", "  ", "x ", "▁ x", "a" * 3000, " ".join(r.choice(ALPHABET) + "word" for _ in range(3000))] + list(extra)


def frame(spark, values):
    rows = [(k, v, "i", "t", 1, "x", "d", 2, 3, "r", 4, "t", 5) for k, v in enumerate(values)]
    rows += [rows[3], (None, values[5]) + rows[0][2:], (None, None) + rows[0][2:]]
    return spark.createDataFrame(rows, CLASH).repartition(4)


# --- shared --------------------------------------------------------------------------

def test_memory_numbers_each_distinct_span_once(monkeypatch):
    monkeypatch.setattr(spans, "LONGEST", 5)
    learnt = []
    memory = spans.Memory(learnt.extend, learnt.clear, known=40)
    r = random.Random(1)
    for _ in range(60):
        words = ["w%d" % r.randrange(60) + "x" * r.choice([0, 0, 9]) for _ in range(12)]
        raw = " ".join(words).encode()
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        starts = ends - [len(w) for w in words]
        number = memory.number(np.frombuffer(raw, np.uint8), starts, ends)
        assert [learnt[k].decode() for k in number] == words


def test_perfect_hash_is_minimal():
    keys = np.unique(np.random.Generator(np.random.PCG64(2)).integers(0, 2**63, 30_000, dtype=np.uint64))
    for own in (keys[:0], keys[:1], keys[:7], keys):
        hashed = ph.PerfectHash(*ph.PerfectHash.build(own))
        assert sorted(hashed.slots(own).tolist()) == list(range(len(own)))


# --- 11 ------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def tokenizers():
    first = Tokenizer.from_file(public_tokenizers.path(ta.FIRST))
    first.encode_special_tokens = True
    return first, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(ta.SECOND))


def aligned(rows, tokenizers):
    pair = ta.Pair(public_tokenizers.path(ta.FIRST), public_tokenizers.path(ta.SECOND))
    counts, made = collections.Counter(), []
    for key, text in rows:
        a, b = (tokenizers[0].encode(" " + text, add_special_tokens=False).ids, tokenizers[1].encode(text)) if text else ([], [])
        raw = (" " + (text or "")).encode()
        if b"".join(pair.a_bytes[i] for i in a) != raw or b"".join(pair.b_bytes[i] for i in b) != raw:
            a = b = []
        a_end, b_end = (np.cumsum([len(by[i]) for i in x]).tolist() for by, x in ((pair.a_bytes, a), (pair.b_bytes, b)))
        groups, links, i, j = [], [], 0, 0
        for cut in sorted(set(a_end) & set(b_end)):
            x, y = a_end.index(cut, i) + 1, b_end.index(cut, j) + 1
            links.append((a[x - 1], b[y - 1]))
            groups.append(",".join(map(str, a[i:x])) + "|" + ",".join(map(str, b[j:y])))
            i, j = x, y
        counts.update(links)
        made.append((key, len(a), len(b), len(groups), links, ";".join(groups)))
    best = collections.defaultdict(int)
    for (_, second), n in counts.items():
        best[second] = max(best[second], n)
    return [(key, a, b, g, len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), text)
            for key, a, b, g, links, text in made]


@pytest.mark.parametrize("frequent", [50, 1 << 20])
def test_alignment_brute_force(spark, tokenizers, frequent, monkeypatch):
    docs = frame(spark, texts(3))
    want = aligned([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], tokenizers)
    got = [tuple(r) for r in ta.align_tokens(docs, frequent=frequent).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    if frequent == 50:
        digests = {r.doc_id: r.groups for r in ta.align_tokens(docs.where("doc_id < 40"), groups="sha256").collect()}
        assert all(digests[k] == (hashlib.sha256(g.encode()).hexdigest() if g else "") for k, *_, g in want if k is not None and k < 40)


def test_alignment_of_chunks_and_many_leaves(spark, tokenizers):
    """Long texts come in chunks; counts are summed over several leaves and shards."""
    docs = spark.createDataFrame([(1, " ".join(["one two  three\nfour é"] * 20_000)), (2, "one two"), (3, "▁" + "one two " * 200_000)], "doc_id long, text string")
    pair = (public_tokenizers.path(ta.FIRST), public_tokenizers.path(ta.SECOND))
    want = aligned([(1, " ".join(["one two  three\nfour é"] * 20)), (2, "one two")], tokenizers)
    got = {r.doc_id: r for r in ta.align_tokens(docs).collect()}
    assert got[1].n_a == (want[0][1] - 0) * 1000 and got[3].n_links == 0 and got[2].n_links == want[1][4]
    counts = spark.createDataFrame([(k % 97, 1 + k % 3) for k in range(5000)], "key long, n long").repartition(7)
    hashes = ta.shard_hashes(counts.select("key").distinct(), 3)
    sums = ta.dense_sums(counts, hashes, 3, 70).join(hashes, "shard").collect()
    found = {k: n for r in sums for k, n in zip(np.frombuffer(r["keys"], np.int64).tolist(), np.frombuffer(r.vector, np.int64).tolist())}
    want = collections.Counter()
    for k in range(5000):
        want[k % 97] += 1 + k % 3
    assert found == dict(want)
    assert ta.pair_counts(docs.limit(0), *pair).count() == 0 and ta.align_tokens(docs.limit(0)).count() == 0


# --- 12 ------------------------------------------------------------------------------

def test_bpe_is_the_library(spark):
    library = Tokenizer.from_file(public_tokenizers.path(bc.TOKENIZER))
    marks = [c + " " + c + ". x" + c + ", " + c + c for c in map(chr, [*range(1, 0x600), *range(0x900, 0xE00), 0xFB1D, 0xFB2A, 0x1E9E, 0x212A, 0x3000, 0x1F600])]
    docs = frame(spark, texts(5, extra=marks))
    coded = bc.decode_bpe(bc.encode_bpe(docs))
    assert coded.columns == [c for c in docs.columns if c not in ("ids", "decoded")] + ["ids", "decoded"]
    for r in coded.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == ids, r.text
        assert r.decoded == library.decode(ids, skip_special_tokens=False)
    assert bc.encode_bpe(docs.limit(0)).count() == 0
    want = [(r.doc_id, len(r.ids), hashlib.sha256(np.array(r.ids, "<u4").tobytes()).hexdigest(), r.decoded) for r in coded.collect()]
    got = [tuple(r) for r in bc.bpe_round_trip(docs, keep=["doc_id"]).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_decode_skips_unknown_ids(spark):
    docs = spark.createDataFrame([(1, [0, 1, -4, 10**6, 49407]), (2, []), (3, None)], "k int, ids array<int>")
    got = {r.k: r.decoded for r in bc.decode_bpe(docs).collect()}
    assert got == {1: '! " <|endoftext|>', 2: "", 3: None}


def test_merging_of_long_parts_and_chunks(monkeypatch):
    path = public_tokenizers.path(bc.TOKENIZER)
    table = bc.MergeTable(path)
    library = Tokenizer.from_file(path)
    r = random.Random(9)
    for _ in range(60):
        word = "".join(r.choice(["a", "ab", "th", "e", "ing"]) for _ in range(r.randrange(1, 60)))
        data = np.frombuffer(word.encode(), np.uint8)
        symbols = table.inner[data]
        symbols[-1] = table.last[data[-1]]
        assert bc.merge_long(table, symbols).tolist() == library.encode(word, add_special_tokens=False).ids
    monkeypatch.setattr(spans.chunks, "__defaults__", (100,))
    text = " ".join(["some", "words", "İ,"] * 400) + "x" * 300
    memory = bc.IdMemory(bc.WordEncoder(path).encode)
    rows = [ids[b[k]:b[k + 1]].tolist() for first, last, ids, b in memory.texts(pa.array(["a b", text, "", "c"])) for k in range(last - first)]
    assert rows == [library.encode(t, add_special_tokens=False).ids for t in ("a b", text, "", "c")]


# --- 13 ------------------------------------------------------------------------------

TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_search(docs, items, best):
    lists = [(key, terms(text)) for key, text in docs]
    texts_, total = sum(bool(x) for _, x in lists), sum(len(x) for _, x in lists)
    df = collections.Counter(t for _, x in lists for t in set(x))
    out = []
    for item, text in items:
        found = []
        for row, (key, x) in enumerate(lists):
            tf, m, score = collections.Counter(x), 50 + 50 * len(x) * texts_ // max(total, 1), 0
            for t in set(terms(text)):
                if tf[t]:
                    w = math.floor(1000 * math.log((2 * texts_ + 2) / (2 * df[t] + 1)))
                    score += w * (1_000_000_000 * tf[t] // (1000 * tf[t] + 20 * m))
            if score > 0:
                found.append((-score, key is None, key or 0, key))
        out += [(item, k + 1, f[3], -f[0]) for k, f in enumerate(sorted(found)[:best])]
    return sorted(out, key=repr)


def test_search_brute_force(spark, monkeypatch):
    r = random.Random(4)
    vocabulary = [f"w{k}" for k in range(300)] + ["Straße", "日本", "é", "x9", "THE"]
    made = [" ".join(r.choice(vocabulary[:r.choice([8, 60, 305])]) + r.choice(["", ",", ". ", "\n"]) for _ in range(r.choice([1, 5, 30, 200])))
            for _ in range(400)] + texts(6, 40)
    docs = frame(spark, made + made[:5])
    items = spark.createDataFrame([(k, " ".join(r.choice(vocabulary) for _ in range(r.choice([1, 4, 40])))) for k in range(12)]
                                  + [(3, "w1 w1 W2"), (50, None), (51, "..."), (None, "w5"), (52, "never seen"), (53, made[7])],
                                  "item_id long, text string")
    monkeypatch.setattr(rs, "ITEMS", 7)
    monkeypatch.setattr(rs, "BLOCK", 32)
    want = brute_search([(x.doc_id, x.text) for x in docs.collect()], [(x.item_id, x.text) for x in items.collect()], 10)
    got = sorted((tuple(x) for x in rs.ranked_search(docs, items, best=10).collect()), key=repr)
    assert [(x[0], x[1], x[3]) for x in got] == [(x[0], x[1], x[3]) for x in want]
    assert got == want
    assert rs.ranked_search(docs.limit(0), items).count() == 0 and rs.ranked_search(docs, items.limit(0)).count() == 0


def test_bounds_never_fall_below_scores():
    r = random.Random(8)
    made = [" ".join(f"t{int(r.paretovariate(0.6))}" for _ in range(r.choice([2, 20, 400]))) for _ in range(200)]
    (_, _, n, doc, h, tf), = rs.frequencies(pa.array(made))
    items = [np.unique(h[doc == k]) for k in (0, 5, 9)]
    own = np.unique(np.concatenate(items))
    weights = np.array([r.randrange(0, 9000) for _ in own])
    queries = rs.Queries(items, own, weights, len(made), int(n.sum()))
    seen = 0
    for group, width, bits in rs.build_blocks(n, doc, h, tf):
        bound = queries.bounds(n[group], width, bits.tobytes())
        for i, item in enumerate(items):
            for k, text in enumerate(group.tolist()):
                m = rs.measure(n[text], len(made), int(n.sum()))
                score = sum(weights[np.searchsorted(own, x)] * rs.share(f, m) for x, f in zip(h[doc == text], tf[doc == text]) if x in item)
                assert bound[i, k] >= score
                seen += bound[i, k] == score
    assert seen > 200


def test_long_texts_are_hashed_in_pieces(monkeypatch):
    text = pa.array(["ab cd " * 3000 + "x" * 5000 + " ab"])
    whole = next(rs.frequencies(text))
    monkeypatch.setattr(rs, "PIECE", 64)
    assert all((np.asarray(a) == np.asarray(b)).all() for a, b in zip(whole, next(rs.frequencies(text))))


# --- 7: words by the library ----------------------------------------------------------------

def test_packing_ids_of_letters_that_decompose(spark):
    from chronolith.llm import packing
    import zlib
    library = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    marks = [c + ", " + c + ". x" + c + "." for c in map(chr, [0x130, *range(0x958, 0x960), *range(0x9DC, 0x9E0), *range(0xA33, 0xA37), *range(0xB5C, 0xB5E),
                                                               0xF43, 0xF4D, *range(0xFB1D, 0xFB4F)])]
    values = texts(11, 300, ["İ, yes İ. and क़, x", "a \x1d b", "\x1d", *marks])
    docs = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "doc_id long, text string")
    for r in packing.best_fit_packing(docs).where("piece = 0").collect():
        ids = (library.encode(values[r.doc_id] or "", add_special_tokens=False).ids + [0])[:2048]
        assert r.length == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes()), values[r.doc_id]


# --- 2, 4, 8: names of the input ------------------------------------------------------------

def test_names_that_clash_or_hold_a_dot(spark):
    from chronolith.llm import piece_sampling, quality_classifier, toxicity
    docs = spark.createDataFrame([(k, f"some words of text {k} " * 5, "t", 1, 2.0, "k", "x") for k in range(30)],
                                 "doc_id long, text string, _text string, _key int, `a.b` double, c0 string, keep0 string")
    labels = spark.createDataFrame([(k, k % 2, k % 2) for k in range(30)], "doc_id long, quality int, toxic int")
    coded = piece_sampling.decode(piece_sampling.encode_sampled(docs))
    assert coded.columns == [*docs.columns, "ids", "decoded"]
    for r in coded.collect():
        assert r.decoded == r.text and (r._text, r["_key"], r["a.b"], r.c0, r.keep0) == ("t", 1, 2.0, "k", "x")
    for out in (toxicity.toxicity(docs, labels), quality_classifier.quality_classifier(docs, labels)):
        assert out.columns[:7] == docs.columns
        assert {(r["a.b"], r._text) for r in out.collect()} == {(2.0, "t")}
