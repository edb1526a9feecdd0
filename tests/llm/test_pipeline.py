"""Registered queries and the corpus pipeline over the test tables."""

import os
import random

import pytest

import corpus_pipeline as cp
from chronolith.llm import QUERIES, SQL
from chronolith.llm.common import documents, labels
from tests.compare import compare, duck
from tests.llm.test_operators import brute_components

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    message, _ = compare(spark, duck(SF), name, QUERIES[name], SQL.get(name), SF)
    assert message is None, message


def test_numbers_are_registered_once():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name,label,least", [("op2_toxicity", "toxic", 0.9), ("op4_quality_classifier", "quality", 0.95)])
def test_held_out_accuracy(spark, name, label, least):
    sf = "/root/testdata/sf0.01"
    got = QUERIES[name](spark, sf).where("held_out").join(labels(spark, sf), "doc_id").select("predicted", label).collect()
    assert sum(r.predicted == r[label] for r in got) >= least * len(got)


def test_hmm_beats_the_base(spark):
    got = QUERIES["op3_hidden_markov"](spark, "/root/testdata/sf0.01").where("held_out").groupBy().sum("base_score", "score").first()
    assert got[1] > got[0]


def test_stages(spark):
    docs = documents(spark, SF)
    frame = docs.persist()
    for name, stage in cp.STAGES:
        before = frame.collect()
        out = stage(spark, frame, SF).persist()
        after = out.collect()
        if name in ("toxicity", "quality_classifier"):
            assert out.columns == docs.columns and 0 < len(after) <= len(before)
            assert {tuple(r) for r in after} <= {tuple(r) for r in before}
        elif name == "line_dedup":
            assert out.columns == docs.columns and len(after) == len(before)
            assert all(r.n_chars == len(r.text) for r in after)
        elif name == "near_dedup":
            want = {d for d, n, c in brute_components([(r.doc_id, r.text) for r in before], 5, 80) if d == c}
            assert out.columns == docs.columns and sorted(r.doc_id for r in after) == sorted(want)
        else:
            assert {r.doc_id for r in after} == {r.doc_id for r in before}
            assert max(r.offset + r.length for r in after) <= 2048
        frame = out


def test_near_copies_keep_their_lines(spark):
    def line(seed, n=12):
        r = random.Random(seed)
        return " ".join("".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(n))

    shared = [line(f"shared {k}") for k in range(10)]
    # 40 near copies, each with one word changed, among 100 pages of their own with the same menu.
    copies = ["\n".join(shared[:k % 10] + [shared[k % 10].rsplit(" ", 1)[0] + f" word{k}"] + shared[k % 10 + 1:] + ["The menu"]) for k in range(40)]
    own = ["\n".join([line(f"own {k} {j}") for j in range(3)] + ["The menu"]) for k in range(100)]
    rows = [(i, t, "en", "host", len(t)) for i, t in enumerate(copies + own)]
    docs = spark.createDataFrame(rows, documents(spark, SF).schema)
    out = cp.drop_boilerplate(spark, docs, SF).persist()
    got = {r.doc_id: r.text for r in out.collect()}
    assert all(got[i] == t.removesuffix("\nThe menu") for i, t in enumerate(copies + own))
    kept = cp.drop_near_copies(spark, out, SF).collect()
    assert sorted(r.doc_id for r in kept) == [0, *range(40, 140)]


def test_edges(spark):
    rows = [(1, "same text of more than five words", "en", "a", 33)] * 3 + [(1, "another text", "en", "a", 12), (None, None, None, None, None),
            (2, "", "en", "a", 0), (3, "Same text of more than five words", "en", None, 33)]
    docs = spark.createDataFrame(rows, documents(spark, SF).schema)
    kept = cp.drop_near_copies(spark, docs, SF).collect()
    assert sorted(repr((r.doc_id, r.text)) for r in kept) == sorted(repr(x) for x in [
        (1, "same text of more than five words"), (1, "another text"), (None, None), (2, "")])
    for _, stage in cp.STAGES:
        stage(spark, docs, SF).count()
        assert stage(spark, docs.limit(0), SF).count() == 0
