"""Near-duplicate documents: one-permutation MinHash with optimal densification, banded buckets, star-shaped
candidate edges, and confirmation on whole shingle sets.

Equal sets are one class first, so copies never meet each other.  In each bucket one class is the centre and
is compared with those outside its component; what stays apart gets another centre in the next round.  What
the stars leave meets by an exact prefix filter: shingles in ascending frequency, and two classes are compared only
where they share one among so many of their rarest that a link without one is impossible.  So no link between
classes that share a bucket is lost, and classes full of edits of their own meet nobody.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from chronolith.llm.common import list_array, mix, signed, slices, span_hashes, stored, words

#: One-permutation bins, and the chance of missing a pair just at the threshold that sets the width of a band:
#: 6 bins at a similarity of 0.85 (0.623 ** 35), 5 bins at 0.8 (0.672 ** 42).
BINS = 210
MISS = 1e-7
#: Members of a star that are confirmed in one group.
GROUP = 256
#: Rounds of stars before what is still apart meets by the prefix filter.
STARS = 2
#: Bits for each class of the filter that tells which classes share a bucket, and its largest size (32 MB).
BITS_PER_CLASS, FILTER_BITS = 16, 1 << 28
EMPTY = np.uint64(2**64 - 1)
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def shingle_sets(column: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, sorted distinct shingle hashes of all texts of a slice, where each text begins)."""
    for s in slices(column):
        starts, ends, border = words(s)
        h = span_hashes(s.data, starts, ends)
        sets = []
        for a, b in zip(border[:-1].tolist(), border[1:].tolist()):
            w = h[a:b]
            n = min(width, len(w))
            if not n:
                sets.append(w)
                continue
            total = np.full(len(w) - n + 1, n, np.uint64)
            for k in range(n):
                total = mix(total * _MULTIPLIERS[k % 3] + w[k:len(w) - n + 1 + k])
            sets.append(np.unique(total))
        sizes = np.array([len(x) for x in sets], np.int64)
        yield s.first, (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum(sizes)])


def set_keys(flat: np.ndarray, border: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of each set; together they name the class of equal sets."""
    empty = np.diff(border) == 0
    sums = []
    for salt in (np.uint64(0x1F83D9ABFB41BD6B), np.uint64(0x5BE0CD19137E2179)):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(flat ^ salt), dtype=np.uint64)])
        value = mix(total[border[1:]] - total[border[:-1]] + np.diff(border).astype(np.uint64))
        value[empty] = 0
        sums.append(value)
    return sums[0], sums[1]


def signatures(flat: np.ndarray, border: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Smallest hash of each bin, one permutation for all bins (a hash's upper bits are its bin).

    An empty bin takes the value of the first non-empty bin in a random order of its own, the same for all
    sets (optimal densification), so two sets agree in a densified bin with their similarity as probability.
    """
    m = len(border) - 1
    sig = np.full((m, bins), EMPTY, np.uint64)
    doc = np.repeat(np.arange(m), np.diff(border))
    cell = doc * bins + ((flat >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
    if len(cell):
        first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))  # sets are sorted, so bins are too
        sig.reshape(-1)[cell[first]] = flat[first]
    full = sig != EMPTY
    todo_doc, todo_bin = np.nonzero(~full & full.any(1)[:, None])
    attempt = 0
    while len(todo_doc):
        pick = (mix(todo_bin.astype(np.uint64) * np.uint64(0x100000001B3) + np.uint64(attempt << 20)) % np.uint64(bins)).astype(np.int64)
        found = full[todo_doc, pick]
        sig[todo_doc[found], todo_bin[found]] = sig[todo_doc[found], pick[found]]
        todo_doc, todo_bin = todo_doc[~found], todo_bin[~found]
        attempt += 1
    return sig


def band_width(percent: int) -> int:
    """Bins of a band: as many as keep the chance of missing a pair at the threshold under MISS."""
    s = percent / 100
    return max([r for r in range(1, 16) if (1 - s ** r) ** (BINS // r) < MISS], default=1)


def band_hashes(sig: np.ndarray, rows: int) -> np.ndarray:
    m, bins = len(sig), sig.shape[1] // rows * rows
    grouped = sig[:, :bins].reshape(m, bins // rows, rows)
    total = np.arange(bins // rows, dtype=np.uint64)[None, :] * np.uint64(0xD6E8FEB86659FD93) + np.zeros((m, 1), np.uint64)
    for k in range(rows):
        total = mix(total + grouped[:, :, k])
    return total


def _sketch(width: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for first, flat, border in shingle_sets(batch.column(1), width):
                m = len(border) - 1
                a, b = set_keys(flat, border)
                bands = band_hashes(signatures(flat, border), rows)
                n = np.diff(border)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row + np.arange(m)), batch.column(0).slice(first, m), pa.array(n), pa.array(signed(a)),
                     pa.array(signed(b)), list_array(signed(bands.reshape(-1)), np.arange(m + 1) * bands.shape[1])],
                    ["row", "doc_id", "n", "a", "b", "bands"])
                row += m
    return run


def _filter_bits(a: np.ndarray, bits: int) -> tuple[np.ndarray, ...]:
    """Places of a key in a filter of so many bits."""
    return tuple((mix(a + np.uint64(k * 0x632BE59BD9B4E019 & (2**64 - 1))) % np.uint64(bits)).astype(np.int64) for k in (1, 2, 3))


def class_filter(active: DataFrame) -> np.ndarray:
    """A Bloom filter (packed bytes) over the classes' keys, sized by their number; what passes it wrongly is removed
    by a join later."""
    size = 1 << 12
    wanted = BITS_PER_CLASS * active.count()
    while size < min(wanted, FILTER_BITS):
        size *= 2

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = np.zeros(size // 8, np.uint8)
        for batch in batches:
            for place in _filter_bits(batch.column(0).to_numpy().view(np.uint64), size):
                np.bitwise_or.at(mine, place >> 3, (1 << (place & 7)).astype(np.uint8))
        packed = mine.view(np.int64)
        used = np.flatnonzero(packed)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(packed[used])], ["at", "bits"])

    got = active.select("a").mapInArrow(bits, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    packed = np.zeros(size // 64, np.int64)
    packed[got.column("at").to_numpy()] = got.column("bits").to_numpy()
    return packed.view(np.uint8)


def whole_sets(docs: DataFrame, text: str, width: int, active: DataFrame) -> DataFrame:
    """(c, shingles) of the active classes, built again from the texts: sets of other classes never travel, and those of
    one class are one before they are joined."""
    shared = docs.sparkSession.sparkContext.broadcast(class_filter(active))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        size = 8 * len(known)
        for batch in batches:
            for _first, flat, border in shingle_sets(batch.column(0), width):
                a, b = set_keys(flat, border)
                keep = np.logical_and.reduce([(known[p >> 3] >> (p & 7)) & 1 for p in _filter_bits(a, size)]).astype(bool) & (np.diff(border) > 0)
                once = np.unique(a[keep], return_index=True)[1]
                rows = np.flatnonzero(keep)[once]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(a[rows])), pa.array(signed(b[rows])),
                     pa.array([flat[border[i]:border[i + 1]].tobytes() for i in rows.tolist()], pa.binary())], ["a", "b", "shingles"])

    found = docs.select(F.col(f"`{text}`").cast("string").alias("t")).mapInArrow(run, "a long, b long, shingles binary")
    single = found.groupBy("a", "b").agg(F.first("shingles").alias("shingles"))
    return stored(active.select("a", "b", "c").join(single, ["a", "b"]).select("c", "shingles"), "sets")


def prefix_pairs(apart: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (centre, other) out of `apart` (c, n, root) that may reach the similarity, in different components.

    With sizes n and m a link needs at least k = ceil(percent * (n + m) / (100 + percent)) common shingles, so two linked
    classes share one among the first n - k + 1 of one and m - k + 1 of the other, in any order that is the same for both.
    The order is by frequency among these classes: shingles of a single class come first and match nothing, so only
    the others travel on.
    """
    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                own = np.frombuffer(batch.column(1)[k].as_py(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), batch.column(0)[k].as_py())), pa.array(own)], ["c", "shingle"])

    wanted = sets.join(apart.select("c"), "c", "left_semi")
    rows = wanted.mapInArrow(flat, "c long, shingle long")
    common = rows.groupBy("shingle").agg(F.count("*").alias("f")).where("f > 1")
    lists = rows.join(common, "shingle").groupBy("c").agg(F.sort_array(F.collect_list(F.struct("f", "shingle"))).alias("s"))
    n, alone = F.col("n"), F.col("n") - F.size("s")
    reach = n - F.ceil(n * percent / 100) + 1  # with the smallest partner
    # Positions 0 .. alone - 1 are the class's own shingles.
    keys = (lists.join(apart, "c").withColumn("take", (reach - alone).cast("int")).where("take > 0")
            .select("c", "n", "root", alone.alias("alone"), F.posexplode(F.slice("s", 1, F.col("take"))).alias("i", "e"))
            .select("c", "n", "root", (F.col("alone") + F.col("i")).alias("pos"), F.col("e.shingle").alias("shingle")))
    keys = stored(keys, "prefixes")
    x, y = keys.alias("x"), keys.alias("y")
    need = F.ceil((F.col("x.n") + F.col("y.n")) * percent / (100 + percent))
    close = ((F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.c") < F.col("y.c")) & (F.col("x.root") != F.col("y.root"))
             & (100 * F.least("x.n", "y.n") >= percent * F.greatest("x.n", "y.n"))
             & (F.col("x.pos") <= F.col("x.n") - need) & (F.col("y.pos") <= F.col("y.n") - need))
    return x.join(y, close).select(F.col("x.c").alias("centre"), F.col("y.c").alias("other")).distinct()


def confirm(edges: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The edges (centre, other) whose whole sets reach the similarity.

    A centre's set travels once for each GROUP of its members (about), never once for each edge, and no
    group grows with the star.
    """
    parts = edges.groupBy("centre").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("parts"))
    dealt = (edges.join(parts, "centre").select("centre", "other", F.pmod(F.xxhash64("other"), F.col("parts")).cast("int").alias("part")))
    members = dealt.select("centre", "part", F.col("other").alias("c"))
    centres = parts.select("centre", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("centre").alias("c"))
    rows = members.unionByName(centres).join(sets, "c").select("centre", "part", "c", "shingles")

    def compare(key, table):
        centre = key[0].as_py()
        ids, raw = table.column("c").to_pylist(), table.column("shingles")
        own = np.frombuffer(raw[ids.index(centre)].as_py(), np.uint64)
        linked = []
        for k, c in enumerate(ids):
            if c != centre:
                other = np.frombuffer(raw[k].as_py(), np.uint64)
                at = np.minimum(np.searchsorted(own, other), len(own) - 1)
                both = int((own[at] == other).sum())
                if 100 * both >= percent * (len(own) + len(other) - both):
                    linked.append(c)
        return pa.table({"centre": pa.array([centre] * len(linked), pa.int64()), "other": pa.array(linked, pa.int64())})

    return rows.groupBy("centre", "part").applyInArrow(compare, "centre long, other long")


def components(edges: DataFrame) -> DataFrame:
    """(c, root): for every node of the edges (centre, other), the smallest node of its component.

    Large-star and small-star steps alternate until nothing changes; each step is a minimum per node and a join, so
    a node with very many neighbours is split by the skew join and never collected.
    """
    edges = stored(edges.select(F.greatest("centre", "other").alias("hi"), F.least("centre", "other").alias("lo")).distinct(), "edges")
    while True:
        both = edges.select("hi", "lo").union(edges.select(F.col("lo"), F.col("hi"))).toDF("u", "v")
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small_low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(small_low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
                 .union(small_low.select("u", "m")).distinct())
        edges = stored(small.select(F.col("u").alias("hi"), F.col("v").alias("lo")), "edges")
        # Done when all are stars: no node has two smaller neighbours, no centre has one.
        roles = (edges.select(F.col("hi").alias("node"), F.lit(1).alias("up"))
                 .union(edges.select(F.col("lo"), F.lit(0))).groupBy("node").agg(F.sum("up").alias("up"), F.count("*").alias("n")))
        if roles.where("up > 1 OR (up = 1 AND n > 1)").isEmpty():
            return edges.select(F.col("hi").alias("c"), F.col("lo").alias("root"))


def candidates(entries: DataFrame, step: int, percent: int) -> DataFrame:
    """Distinct pairs (centre, other) to confirm, between components and of sizes that can reach the similarity.

    A step makes one star for each bucket: its centre is a class of the component that has most entries there, another
    one in each step, and its arms are the classes of other components.
    """
    parts = entries.groupBy("bucket", "root").agg(F.count("*").alias("k"), F.min_by(
        F.struct("c", "n"), F.struct(F.xxhash64("c", F.lit(step)), F.col("c"))).alias("x"))
    tops = parts.groupBy("bucket").agg(F.max_by(F.struct("root", "x"), F.struct(F.col("k"), -F.col("root"))).alias("top"))
    heads = tops.select("bucket", F.col("top.x.c").alias("centre"), F.col("top.x.n").alias("n1"), F.col("top.root").alias("root1"))
    other_component = (F.col("root") != F.col("root1")) & (100 * F.least("n", "n1") >= percent * F.greatest("n", "n1"))
    pairs = entries.alias("e").join(heads.alias("h"), (F.col("e.bucket") == F.col("h.bucket")) & other_component)
    return pairs.select(F.least("c", "centre").alias("centre"), F.greatest("c", "centre").alias("other")).distinct()


def near_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3, percent: int = 85,
               stars_only: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per document row.

    Sets hold the distinct shingles of `width` words (the whole sequence where there are fewer); two
    documents are linked where 100 * intersection >= percent * union.  A text without words, or null, has
    an empty set and no link.  component_id is the smallest id of the component, kept tells whether it is the
    row's own.  Rows that share an id are separate documents; where they are in one component and have its
    smallest id, each is kept.  A null id is larger than all others.  Other columns are ignored, whatever their names; an
    empty table gives no rows.  With `stars_only` the links that only the prefix filter finds are left out: for uses that
    need most of a group and no exact components.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    sketch = stored(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(
        _sketch(width, band_width(percent)), f"row long, doc_id {kind}, n long, a long, b long, bands array<long>"), "sketch")
    # A class is named by the first row that has its set.
    classes = stored(sketch.where("n > 0").groupBy("a", "b").agg(F.min("row").alias("c"), F.min("doc_id").alias("least"),
                                                                 F.first("n").alias("n"), F.first("bands").alias("bands")), "classes")
    buckets = classes.select("c", "n", F.explode("bands").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1").select("bucket")
    entries = stored(buckets.join(shared, "bucket").select("bucket", "c", "n", F.col("c").alias("root")), "entries")
    active = classes.join(entries.select("c").distinct(), "c", "left_semi").select("a", "b", "c")
    links = roots = None
    if not entries.isEmpty():
        sets = whole_sets(docs, text, width, active)
    for step in range(STARS + 1):
        if entries.isEmpty() or step == STARS and stars_only:
            break
        if step < STARS:
            pairs = stored(candidates(entries, step, percent), "stars")
        else:
            apart = stored(entries.groupBy("c").agg(F.first("n").alias("n"), F.first("root").alias("root")), "apart")
            pairs = stored(prefix_pairs(apart, sets, percent), "pairs")
        found = stored(confirm(pairs, sets, percent), "links")
        links = found if links is None else links.unionByName(found)
        roots = components(links)
        if step == STARS:
            break
        now = entries.drop("root").join(roots, "c", "left").withColumn("root", F.coalesce("root", "c"))
        # A bucket whose classes are in one component is settled.
        open_buckets = now.groupBy("bucket").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x < y").select("bucket")
        entries = stored(now.join(open_buckets, "bucket", "left_semi").select("bucket", "c", "n", "root"), "entries")
    if links is None:
        named = classes.select("a", "b", F.col("least").alias("component_id"))
    else:
        rooted = classes.join(roots, "c", "left").withColumn("root", F.coalesce("root", "c"))
        least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
        named = rooted.join(least, "root").select("a", "b", "component_id")
    out = sketch.select("row", "doc_id", "n", "a", "b").join(named, ["a", "b"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"),
                      F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")) \
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))
