"""Quality rules by lines first: lines are judged one by one, failures are removed, and a text that
loses too much is rejected.  DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from chronolith.llm.common import WORD

SYMBOLS = "#*$%&|<>"
#: Characters that count against a line, and the share of its visible characters above which it fails.
MARKS = SYMBOLS + "{}[]=~^_»›•·"
MAX_MARK_SHARE = 0.08
#: A line of fewer words that also lacks a stop at its end is navigation.
MIN_WORDS_WITHOUT_STOP = 4
STOPS = ".!?…:;\"”’'»)]。！？"
#: A text that keeps less than this share of the characters of its lines is rejected.
MIN_KEPT_SHARE = 0.5
# Phrases of page furniture, compared without case.
BOILERPLATE = ["all rights reserved", "cookie policy", "privacy policy", "terms of use", "terms of service",
               "enable javascript", "skip to content", "click here", "sign in", "log in", "subscribe to our",
               "share this", "read more", "lorem ipsum", "back to top", "powered by"]
LOW = (1 << 31) - 1


def _has_phrase(lowered: Column) -> Column:
    return reduce(lambda a, b: a | b, [lowered.contains(p) for p in BOILERPLATE])


def _packed(words: Column) -> Column:
    """Windows of three words in hash order, each as one long: 33 bits of its hash, then its position.

    A sort of plain numbers thus brings equal windows together; neighbours with equal cuts are few and
    are compared by the whole hash afterwards.
    """
    high = F.lit(~LOW).cast("long")
    return F.sort_array(F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(
        F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).bitwiseAND(high).bitwiseOR(i.cast("long"))))


def _cut(x: Column) -> Column:
    return F.shiftright(x, 31)


def _candidates(packed: Column) -> Column:
    """Positions of windows whose cut equals a neighbour's."""
    return F.transform(F.filter(packed, lambda x, i: (_cut(x) == _cut(F.get(packed, i - 1)))
                                | (_cut(x) == _cut(F.get(packed, i + 1)))),
                       lambda x: x.bitwiseAND(F.lit(LOW).cast("long")).cast("int"))


def _same_neighbour(entries: Column) -> Column:
    return F.transform(F.filter(entries, lambda x, i: (x["g"] == F.get(entries, i - 1)["g"])
                                | (x["g"] == F.get(entries, i + 1)["g"])), lambda x: x["p"])


def line_passes(line: Column, text_has_marks: Column, text_has_phrase: Column) -> Column:
    """Verdict on one line that has a word; the costly tests run only where the text can fail them."""
    marks = F.length(line) - F.length(F.translate(line, MARKS, ""))
    visible = F.length(F.regexp_replace(line, r"[\x20\x09-\x0D]+", ""))
    stop = F.lit(STOPS).contains(F.right(F.btrim(line, F.lit(" \t\x0b\x0c\r")), F.lit(1)))
    wordy = line.rlike(r"(?:[^\x20\x09-\x0D]+[\x20\x09-\x0D]+){%d}[^\x20\x09-\x0D]" % (MIN_WORDS_WITHOUT_STOP - 1))
    return ((stop | wordy) & line.rlike(r"\p{L}") & ~(text_has_phrase & F.lower(line).rlike("|".join(BOILERPLATE)))
            & ~(text_has_marks & (marks > MAX_MARK_SHARE * visible)))


def quality_rules(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Counts, verdict and the text without failed lines, one row per document row.

    Columns: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, clean_text.
    Other columns of the input are left out, whatever their names.  A null text counts as empty: all
    counts 0, base_failed true, clean_text empty.  Repeated rows each get their own result row.
    """
    none = F.array().cast("array<int>")
    t = F.col("t")
    d = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    d = d.select("*", F.lower("t").alias("lowered"))
    # Each array that a lambda indexes is a column of its own below: an expression in its place would be
    # computed again for every element.
    d = d.select("doc_id", "t", F.regexp_extract_all("t", F.lit(WORD), F.lit(0)).alias("w"),
                 F.filter(F.split("t", "\n", -1), lambda x: x.rlike(WORD)).alias("lines"),
                 t.rlike(r"[#*$%&|<>{}\[\]=~^_»›•·]").alias("marked"), _has_phrase(F.col("lowered")).alias("phrased"))
    d = d.select("*", F.size("w").cast("long").alias("n_words"),
                 F.when(F.size("w") >= 3, _packed(F.col("w"))).otherwise(F.array().cast("array<bigint>")).alias("packed"))
    packed = F.col("packed")
    d = d.select("*", (F.size(F.filter(packed, lambda x, i: _cut(x) == _cut(F.get(packed, i - 1)))) > 0).alias("any"))
    d = d.select("*", F.when(F.col("any"), _candidates(packed)).otherwise(none).alias("maybe"))
    d = d.select("*", F.array_sort(F.transform("maybe", lambda p: F.struct(F.xxhash64(
        F.get("w", p), F.get("w", p + 1), F.get("w", p + 2)).alias("g"), p.alias("p")))).alias("entries"))
    d = d.select("*", F.sort_array(_same_neighbour(F.col("entries"))).alias("at"))
    covered = F.aggregate(F.transform("at", lambda p, i: F.least(
        F.lit(3), F.coalesce(F.get("at", i + 1) - p, F.lit(3)))), F.lit(0), lambda acc, x: acc + x)
    d = d.select("doc_id", "n_words", "lines", F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
                 F.when(F.col("marked"), F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).otherwise(0)
                 .cast("long").alias("n_symbols"),
                 (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
                 covered.cast("long").alias("n_repeat_words"),
                 F.filter("lines", lambda x: line_passes(x, F.col("marked"), F.col("phrased"))).alias("good"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    chars = [F.length(F.array_join(c, "")) for c in ("good", "lines")]
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                    failed.alias("base_failed"),
                    (~failed & (chars[0] >= MIN_KEPT_SHARE * chars[1])).alias("kept"),
                    F.array_join("good", "\n").alias("clean_text"))
