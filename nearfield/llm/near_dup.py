"""MinHash near-dedup by circulant MinHash: two permutations give all signature coordinates.

Coordinate k of a set is the minimum over its elements x of pi((sigma(x) + k) mod 2**32): sigma and pi are fixed bijections of
32-bit words, and the circular shift by k takes the place of further permutations. Coordinates are banded; documents
that share a band are candidates; every link is confirmed by intersecting the full sets of 64-bit shingle hashes.

Exactness without all pairs of a bucket:
1. Equal sets are one class (partial aggregate by a 128-bit digest), a node with a number of its own; only one row of it goes
   on. Rows are known by doc_id and a 64-bit hash of their text, so rows that share a doc_id keep their own texts and links.
2. A bucket gives a star: its smallest node beside each other one. Confirmed stars give components.
3. Buckets that still hold members of several components form clusters. A cluster's members are dealt to classes of set
   size (a link joins neighbouring classes at most) and there to blocks of at most about ``BLOCK``; blocks meet in pairs, in tasks of
   bounded size that hold the two blocks' full sets. Members of a component larger than a block have blocks of their own,
   which don't meet each other, so a giant group costs no more than the blocks outside of it. Within a task, pairs of
   different components whose signatures agree enough are confirmed on their full sets, and only links that join
   components leave the task, so a group never gives all its pairs. The components are found anew over all links.
   Members are counted by partial aggregates, and the counts of a cluster are lent to ``SALTS`` tasks, so no task sees one whole.
So a link is lost only if no band meets (at the threshold 2e-8 for 56 bands of 8 at 0.85, 3e-7 for 64 of 7 at 0.80) or the
signature is off by five deviations.

Components: alternating large-star and small-star steps on (node, node) tables, each written to the shared folder; links
never reach the driver. Tables are deleted when nothing reads them any more.

Defined cases: null or empty text and text without words has an empty set and no links; fewer words than a shingle are one
shingle; rows of one doc_id with different texts are documents of their own, each in the component of its own text; rows
without doc_id are linked with nothing and kept; an empty table gives no rows. A text's set is held by one task. Other
columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm.common import WORD_CLASS, alone, among, bitmap, released, table, written

ROWS, BANDS, TILE, BLOCK, SALTS, HOT = 8, 56, 1 << 15, 512, 16, 10_000
SMALL = 1 << 14
#: Pairs in blocks go on if their estimated similarity is at most so far below the threshold.
MARGIN = 0.10

_DRAW = np.random.default_rng(7_041)
_ODD = lambda n, bits: _DRAW.integers(1, 1 << bits, n, np.uint64) | np.uint64(1)
WORD_KEYS, BAND_KEYS = _ODD(16, 63), _ODD((1, 16), 63)
SIGMA, PI_FIRST, PI_SECOND = np.uint32(0x85EBCA6B), np.uint32(0x7FEB352D), np.uint32(0x846CA68B)
MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * MIX
    x = (x ^ (x >> np.uint64(29))) * MIX
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None, words: int) -> np.ndarray:
    """The set of a text: ascending distinct 64-bit hashes of its runs of ``words`` words, A-Z folded, cut at ASCII blanks."""
    found = (text or "").encode().lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    hashed = np.array(list(map(xxhash.xxh3_64_intdigest, found)), np.uint64)
    n = max(1, len(hashed) - words + 1)
    total = np.full(n, min(words, len(hashed)), np.uint64)
    for j in range(min(words, len(hashed))):
        total += hashed[j : j + n] * WORD_KEYS[j]
    total = np.sort(_mixed(total))
    fresh = np.ones(n, bool)
    fresh[1:] = total[1:] != total[:-1]
    return total[fresh]


def signature(elements: np.ndarray, size: int) -> np.ndarray:
    """``size`` circulant coordinates (uint32) of a non-empty set."""
    x = (elements >> np.uint64(32)).astype(np.uint32)
    x = (x ^ (x >> np.uint32(16))) * SIGMA
    x ^= x >> np.uint32(13)
    shifted, shifts = x * PI_FIRST, np.arange(size, dtype=np.uint32) * PI_FIRST  # (x + k) * PI_FIRST, modulo 2**32
    out = np.empty(size, np.uint32)
    step = max(1, TILE // len(x))
    for a in range(0, size, step):
        t = np.add.outer(shifts[a : a + step], shifted)
        t ^= t >> np.uint32(15)
        t *= PI_SECOND
        t.min(axis=1, out=out[a : a + step])
    return out


def bands(coordinates: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key a band; the band's number is part of it."""
    groups = coordinates.reshape(-1, rows).astype(np.uint64) + np.uint64(1)
    total = (groups * BAND_KEYS[0, :rows]).sum(axis=1, dtype=np.uint64) + np.arange(len(groups), dtype=np.uint64) * WORD_KEYS[-1]
    return _mixed(total).view(np.int64)


def _signed(batches: Iterator[pa.RecordBatch], words: int, rows: int, n_bands: int) -> Iterator[pa.RecordBatch]:
    alone()
    for batch in batches:
        sizes, keys, marks, short = [], [], [], []
        for text in batch.column(1):
            own = shingles(text.as_py(), words)
            sizes.append(len(own))
            if len(own):
                coordinates = signature(own, rows * n_bands)
                keys.append(xxhash.xxh3_128_digest(own.tobytes()))
                marks.append(bands(coordinates, rows))
                short.append((coordinates & np.uint32(255)).astype(np.uint8).tobytes())
            else:
                keys.append(None)
                marks.append(None)
                short.append(None)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(marks, pa.list_(pa.int64())), pa.array(short, pa.binary())],
            ["doc_id", "mark", "n_shingles", "key", "bands", "short"],
        )


def _sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    alone()
    for batch in batches:
        found = [shingles(x.as_py(), words).view(np.int64) for x in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], ["node", "elements"])


def _block_links(rows: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows of block pairs, each pair's rows together: confirmed links that join components, one for each joining."""
    alone()
    names = ("cluster", "class", "low", "high", "block", "node", "component", "lower", "short")
    held, now = [], None

    def links(rows: list) -> pa.RecordBatch | None:
        low, high = rows[0][2], rows[0][3]
        left = [r for r in rows if r[4] == low]
        right = left if low == high else [r for r in rows if r[4] == high]
        if not left or not right:
            return None
        short = np.frombuffer(b"".join([r[8] for r in right]), np.uint8).reshape(len(right), -1)
        size = np.array([len(r[9]) for r in right])
        lower = np.array([r[7] for r in right])
        root = {r[6]: r[6] for r in rows}

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        component = np.array([r[6] for r in right])
        out = []
        for i, r in enumerate(left):
            n = len(r[9])
            near = (np.minimum(size, n) * 100 >= np.maximum(size, n) * percent) & (component != r[6]) & (lower | r[7])
            if low == high:
                near[: i + 1] = False
            at = np.flatnonzero(near)
            if len(at):
                at = at[(short[at] == np.frombuffer(r[8], np.uint8)).mean(axis=1) >= percent / 100 - MARGIN]
            for j in at:
                x, y = find(r[6]), find(int(component[j]))
                if x != y:
                    shared = len(np.intersect1d(r[9], right[j][9], assume_unique=True))
                    if 100 * shared >= percent * (n + int(size[j]) - shared):
                        root[max(x, y)] = min(x, y)
                        out.append((r[5], right[j][5]))
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["a", "b"]) if out else None

    for batch in rows:
        elements = batch.column("elements")
        flat, ends = elements.values.to_numpy(), elements.offsets.to_numpy()
        for k, row in enumerate(zip(*[batch.column(x).to_pylist() for x in names], strict=True)):
            if now != row[:4]:
                if held and (found := links(held)):
                    yield found
                held, now = [], row[:4]
            held.append((*row, flat[ends[k] : ends[k + 1]].copy()))
    if held and (found := links(held)):
        yield found


def block_links(members: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join components within clusters of ``members(cluster, node, component, short, elements)``."""
    step = -math.log(percent / 100)
    size_class = F.floor(F.log(F.size("elements").cast("double")) / step).cast("long")
    light = members.select("cluster", "node", "component", size_class.alias("own"))
    # A member is the lower kind in its own class and the higher kind in the class below; classes without lower kinds are empty.
    dealt = light.withColumn("class", F.explode(F.array(F.col("own"), F.col("own") - 1))).withColumn("lower", F.col("class") == F.col("own")).drop("own")
    group, big = ["cluster", "class"], F.col("size") > BLOCK
    sizes = written(dealt.groupBy(*group, "component").agg(F.count("*").alias("size"), F.max("lower").alias("lower")), "sizes")
    pooled = sizes.groupBy(*group).agg(F.sum(F.when(big, 0).otherwise(F.col("size"))).alias("pool"), F.count("*").alias("several"), F.max("lower").alias("lower"))
    pooled = pooled.where("several > 1 and lower").select(*group, "pool")
    owners = sizes.where(big).select(*group, F.col("component").alias("owner"), "size")  # a row for BLOCK members at least
    salted = lambda df: df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    spread = dealt.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
    spread = spread.join(salted(pooled), [*group, "salt"])
    lent = salted(owners).withColumnRenamed("owner", "component").withColumn("owner", F.col("component"))
    spread = spread.join(lent, [*group, "component", "salt"], "left")
    members_ = F.coalesce("size", "pool")
    # Small pools have smaller blocks: their few block pairs are then many tasks too.
    n_blocks = F.ceil(members_ / F.when(members_ > SMALL, BLOCK).otherwise(min(BLOCK, 128)))
    placed = spread.withColumn("number", F.pmod(F.xxhash64("node", F.lit(1)), n_blocks))
    laid = written(placed.select(*group, "salt", "node", "component", "lower", "owner", "number"), "blocks")
    name = F.concat(F.coalesce(F.concat(F.lit("c"), F.col("owner")), F.lit("m")), F.lit("-"), F.col("number"))
    placed = laid.withColumn("block", name)
    blocks = placed.select(*group, "owner", "block").distinct()
    mixed, owned = blocks.where("owner is null").drop("owner").withColumnRenamed("block", "other"), blocks.where("owner is not null").withColumnRenamed("block", "other")
    others = owned.select(*group, F.col("owner").alias("of")).distinct()
    spot = [*group, "salt"]
    to_mixed = placed.join(salted(mixed), spot)
    from_mixed = placed.where("owner is null").join(salted(owned.drop("owner")), spot)
    between = placed.where("owner is not null").join(salted(others), spot).where("owner <> of").join(salted(owned.withColumnRenamed("owner", "of")), [*spot, "of"]).drop("of")
    met = to_mixed.unionByName(from_mixed).unionByName(between)
    pairs = met.select(*group, F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "node", "component", "lower")
    full = pairs.join(members.select("node", "short", "elements"), "node")
    key = [*group, "low", "high"]
    ordered = full.repartition(*key).sortWithinPartitions(*key, "block", "node").select(*key, "block", "node", "component", "lower", "short", "elements")
    out = written(ordered.mapInArrow(lambda x: _block_links(x, percent), "a long, b long").distinct(), "joined")
    released(sizes, laid)
    return out


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of ``pairs(a, b)``, those whose full sets have 100 * intersection >= percent * union. Sorted joins; skew is split."""
    left = sets.select(F.col("node").alias("a"), F.col("elements").alias("left"))
    right = sets.select(F.col("node").alias("b"), F.col("elements").alias("right"))
    both = pairs.join(left, "a").where(F.size("left") > 0).join(right, "b")
    n, m, shared = F.size("left"), F.size("right"), F.size(F.array_intersect("left", "right"))
    # Sizes decide first: the intersection is no larger than the smaller set.
    return both.where((F.least(n, m) * 100 >= F.greatest(n, m) * percent)).where(shared * 100 >= (n + m - shared) * percent).select("a", "b").distinct()


def _with_least(rows: DataFrame, n: int) -> DataFrame:
    """Each of ``n`` ``rows(u, v)`` with ``m``, the least v of its u. Nodes with more than a ``HOT``-th of the rows, ``HOT`` of them
    at most, are lent to every task, so no task takes all rows of a hot node."""
    least, limit = rows.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), max(1000, n // HOT)
    hot = least.where(F.col("n") > limit).select("u", "m").collect() if n > limit else []
    if not hot:
        return rows.join(least.drop("n"), "u")
    lent = F.broadcast(rows.sparkSession.createDataFrame(hot, "u long, m long"))
    return rows.join(lent, "u").unionByName(rows.join(lent, "u", "left_anti").join(least.drop("n"), "u"))


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of ``links(a, b)``; component is the smallest node reachable."""
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    mark = (edges.count(), None)
    while True:
        # Large star: each larger neighbour of a node takes the smallest node of its neighbourhood.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both, 2 * mark[0]).withColumn("m", F.least("u", "m"))
        large = large.where("v > u and v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: a node and its smaller neighbours take the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.withColumnRenamed("m", "v")).distinct()
        before, edges = edges, written(small, "links")
        released(before)
        row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v") % (1 << 31)).alias("h")).head()
        if mark == (row.n, row.h):
            break
        mark = (row.n, row.h)
    out = edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    out._scratch = edges._scratch
    return out


def text_mark(text: str = "text"):
    """64 bits of a text, null as empty."""
    return F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))


def labelled(docs: DataFrame, words: int, percent: int, rows: int, n_bands: int) -> DataFrame:
    """A row a row of ``docs(doc_id, text)``: doc_id, mark, n_shingles, component_id and component_mark, the least pair of its
    component; both null for rows without doc_id, the row's own for empty sets."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), text_mark().alias("mark"))
    signed = written(texts.mapInArrow(lambda x: _signed(x, words, rows, n_bands), "doc_id long, mark long, n_shingles long, key binary, bands array<long>, short binary"), "signatures")
    named = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    # Equal sets have equal bands. The numbers are fixed once the table is written.
    classes = signed.where(named).groupBy("key").agg(F.min(F.struct("doc_id", "mark")).alias("row"), F.first("bands").alias("bands"), F.first("short").alias("short"))
    marks = written(classes.select("key", "row.doc_id", "row.mark", "bands", "short", F.monotonically_increasing_id().alias("node")), "marks")
    members = marks.select("node", F.explode("bands").alias("band"))
    shared = written(members.groupBy("band").agg(F.min("node").alias("center"), F.count("*").alias("n")).where("n > 1"), "buckets")
    met = written(members.join(shared, "band"), "met")
    stars = written(met.where("node <> center").select(F.col("center").alias("a"), F.col("node").alias("b")).distinct(), "stars")

    nodes = stars.select(F.col("a").alias("node")).unionByName(stars.select(F.col("b").alias("node"))).distinct()
    nodes = written(nodes.join(marks.select("node", "doc_id", "mark"), "node"), "nodes")
    near = among(texts.where("doc_id is not null"), bitmap(nodes, "doc_id", "mark"), "doc_id", "mark")
    near = near.groupBy("doc_id", "mark").agg(F.first("text").alias("text"))  # repeated rows meet before they are sent
    sets = written(near.join(nodes, ["doc_id", "mark"]).select("node", "text").mapInArrow(lambda x: _sets(x, words), "node long, elements array<long>"), "sets")
    first = written(confirmed(stars, sets, percent), "confirmed")
    released(shared, stars, nodes)
    found = components(first)
    # Buckets with several components after the stars, and the clusters that they form.
    placed = met.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    open_ = placed.groupBy("band").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("band")
    rest = written(placed.join(open_, "band", "left_semi").select("node", "center", "component"), "rest")
    released(met)
    if not rest.isEmpty():
        clusters = components(rest.select(F.col("node").alias("a"), F.col("center").alias("b")))
        members = rest.select("node", "component").distinct().join(clusters.withColumnRenamed("component", "cluster"), "node").join(marks.select("node", "short"), "node").join(sets, "node")
        members = written(members, "members")
        second = block_links(members, percent)
        if not second.isEmpty():
            released(found)
            found = components(first.unionByName(second))
        released(clusters, members, second)
    released(rest, sets, first)
    own = F.struct("doc_id", "mark")
    linked = found.join(marks.select("node", "doc_id", "mark"), "node").select("node", "component", own.alias("row"))
    linked = linked.join(linked.groupBy("component").agg(F.min("row").alias("least")), "component").select("node", "least")
    label = marks.select("key", "node", own.alias("row")).join(linked, "node", "left").select("key", F.coalesce("least", "row").alias("least"))
    columns = ["doc_id", "mark", "n_shingles"]
    with_set = signed.where(named).select(*columns, "key").join(label, "key").select(*columns, F.col("least.doc_id").alias("component_id"), F.col("least.mark").alias("component_mark"))
    alone = signed.where(~named).select(*columns, F.col("doc_id").alias("component_id"), F.when(F.col("doc_id").isNotNull(), F.col("mark")).alias("component_mark"))
    return with_set.unionByName(alone)


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, rows: int = ROWS, n_bands: int = BANDS) -> DataFrame:
    """A row a row of ``docs(doc_id, text)``: doc_id, n_shingles, component_id, kept."""
    out = labelled(docs, words, percent, rows, n_bands)
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, words: int = 5, percent: int = 80, rows: int = 7, n_bands: int = 64) -> DataFrame:
    """``docs`` with one row of each component: the least doc_id, then the least hash of the text; columns stay.

    Rows without doc_id or words are in no component and stay. Rows alike in doc_id and text are one; which of their other
    columns stay is settled by the least JSON form.
    """
    least = labelled(docs, words, percent, rows, n_bands).where("n_shingles > 0 and doc_id = component_id and mark = component_mark")
    kept = written(least.groupBy(F.col("doc_id").alias("__nf_kept"), F.col("mark").alias("__nf_as")).agg(F.count("*").alias("__nf_n")), "kept")
    in_component = F.col("doc_id").cast("long").isNotNull() & F.coalesce(F.col("text").cast("string").rlike(WORD_CLASS), F.lit(False))
    keyed = docs.where(in_component).withColumns({"__nf_id": F.col("doc_id").cast("long"), "__nf_mark": text_mark()})
    same = (F.col("__nf_id") == F.col("__nf_kept")) & (F.col("__nf_mark") == F.col("__nf_as"))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    out = docs.where(~in_component)
    out = out.unionByName(keyed.join(kept.where("__nf_n = 1"), same, "left_semi").select(*columns))
    repeated = kept.where("__nf_n > 1")
    if not repeated.isEmpty():
        whole = F.struct(*columns)
        rows_ = keyed.select("__nf_id", "__nf_mark", whole.alias("__nf_row")).groupBy("__nf_id", "__nf_mark").agg(F.min_by("__nf_row", F.to_json("__nf_row")).alias("__nf_row"))
        out = out.unionByName(rows_.join(repeated, same, "left_semi").select("__nf_row.*"))
    return out


def op6_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: 3 words, similarity 0.85."""
    return near_duplicates(table(spark, sf_dir, "documents"), 3, 85)
