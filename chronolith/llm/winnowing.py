"""Document fingerprints by winnowing: the smallest k-gram hash of every window, the rightmost of equals,
with its position.  DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from chronolith.llm.common import WORD, stored

#: Words of a gram and grams of a window: any run of K + W - 1 equal words in two texts leaves a common hash.
K = 5
W = 8
#: A hash cut to 33 bits and the distance of its position from 2^31 share one long, so that the smallest
#: long of a window is the smallest hash and, among equals, the rightmost.
LOW = (1 << 31) - 1


def _select(frame: DataFrame, text: str, out: str) -> DataFrame:
    """The frame with `out`: the selected (hash, position) longs of the text, by position.

    A text of fewer than K words is one gram, a text of fewer than W grams one window; without words
    nothing is selected.  Every array that a lambda indexes is a column of its own.
    """
    words, grams = f"{out}_words", f"{out}_grams"
    high, low = F.lit(~LOW).cast("long"), F.lit(LOW).cast("long")

    def pack(h: Column, i: Column) -> Column:
        return h.bitwiseAND(high).bitwiseOR(low - i.cast("long"))

    w, g = F.col(words), F.col(grams)
    frame = frame.withColumn(words, F.regexp_extract_all(text, F.lit(WORD), F.lit(0)))
    frame = frame.withColumn(grams, F.when(F.size(w) >= K, F.transform(
        F.sequence(F.lit(0), F.size(w) - K), lambda i: pack(F.xxhash64(*[F.get(w, i + j) for j in range(K)]), i)))
        .when(F.size(w) > 0, F.array(pack(F.xxhash64(F.array_join(w, " ")), F.lit(0))))
        .otherwise(F.array().cast("array<bigint>")))
    return frame.withColumn(out, F.when(F.size(g) > W, F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.size(g) - W + 1), lambda j: F.array_min(F.slice(g, j, W)))))
        .when(F.size(g) > 0, F.array(F.array_min(g))).otherwise(g)).drop(words, grams)


def hashes(selected: str) -> Column:
    return F.array_distinct(F.transform(selected, lambda x: F.shiftrightunsigned(x, 31)))


def shown(selected: str) -> Column:
    """The fingerprint as text: hash:position, by position."""
    return F.array_join(F.transform(selected, lambda x: F.concat(
        F.lower(F.hex(F.shiftrightunsigned(x, 31))), F.lit(":"),
        (F.lit(LOW).cast("long") - x.bitwiseAND(F.lit(LOW).cast("long"))).cast("string"))), " ")


def likeness(a: str, b: str) -> Column:
    """Shared hashes among all hashes of two fingerprints; 1 for two empty ones."""
    common = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - common
    return F.when(union == 0, 1.0).otherwise(common / union)


def following(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(id, next_id, next_hash, need): for every id the next one in ascending order (null first; after the
    last the first), the smallest hash of the next one's texts, and how much of it is asked for.  Ids are
    structs of one field, so that a null id equals itself.

    Only ids are sorted, in ranges; a window runs inside each range, and the ranges' first ids are one row each.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    ids = (docs.groupBy(F.struct(F.col(doc_id).alias("v")).alias("id"))
           .agg(F.min(F.xxhash64(body)).alias("hash"), F.max(F.floor(F.length(body) / 2)).cast("int").alias("need")))
    ids = stored(ids.repartitionByRange("id").withColumn("range", F.spark_partition_id()), "ids")
    entry = F.struct("id", "hash")
    firsts = ids.groupBy("range").agg(F.min(entry).alias("first"))
    by_range = Window.orderBy("range")
    firsts = firsts.select(F.col("range"), F.coalesce(
        F.lead("first").over(by_range), F.first("first").over(by_range)).alias("other"))
    step = ids.withColumn("after", F.lead(entry).over(Window.partitionBy("range").orderBy("id")))
    after = F.coalesce("after", "other")
    return step.join(firsts, "range").select("id", after["id"].alias("next_id"), after["hash"].alias("next_hash"), "need")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next), one row per
    document row.

    The edited text has its last floor(n_chars / 2) code points replaced by the first ones of the next document
    in ascending id.  A null text is empty; empty fingerprints are alike.  Rows that share an id have the same
    next document, and where the next id has several texts, the one with the smallest hash stands for it.
    Texts are shuffled once, by id, for both joins; the second shuffle carries only the prefix that is asked
    for and the next one's hashes.
    """
    t = docs.select(F.struct(F.col(doc_id).alias("v")).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    links = stored(following(docs, doc_id, text), "next").withColumnRenamed("id", "asker")
    ahead = t.join(links, F.col("id") == F.col("next_id")).where(F.xxhash64("t").bitwiseXOR(F.col("next_hash")) == 0)
    ahead = _select(ahead.select("asker", "t", F.expr("substring(t, 1, need)").alias("prefix")), "t", "s")
    ahead = (ahead.select("asker", "prefix", hashes("s").alias("next_hashes"))
             .groupBy("asker").agg(F.first("prefix").alias("prefix"), F.first("next_hashes").alias("next_hashes")))
    both = t.join(ahead, F.col("id") == F.col("asker"), "left").select(F.col("id.v").alias("doc_id"), "t", "prefix", "next_hashes")
    both = both.withColumn("n", F.length("t")).withColumn("half", F.floor(F.col("n") / 2).cast("int"))
    both = both.withColumn("edited", F.concat(F.expr("substring(t, 1, n - half)"), F.expr("substring(prefix, 1, half)")))
    both = _select(_select(both, "t", "own"), "edited", "changed")
    both = both.withColumns({"h": hashes("own"), "he": hashes("changed")})
    return both.select("doc_id", F.col("n").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
                       shown("own").alias("fingerprint"), shown("changed").alias("edited_fingerprint"),
                       likeness("h", "he").alias("near_edited"), likeness("h", "next_hashes").alias("near_next"))
