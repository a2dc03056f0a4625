"""Document fingerprints by order MinHash (OMH): a sketch whose agreement falls with edit distance, not only with content.

A text's k-mers (runs of ``K`` code points) are numbered by occurrence, so all are distinct. For each of ``COORDINATES``
hash functions the ``TUPLE`` numbered k-mers of least hash are selected, put back into text order and hashed together.
The likeness of two fingerprints is the share of equal coordinates; a shift of a passage changes tuples as an edit does.

``edited_pairs`` compares each document with an edited form of it and with its successor. Plan: one range shuffle of the
texts by doc_id, hash of the text and a running number, so neither a repeated doc_id nor repeated rows are one task; every
partition is read in order with one document of look-ahead and written with its first and last document; then the last
of each partition meets the first of the next (two rows a partition). The plan doesn't grow with the partitions.

Defined cases: null text is empty; a text shorter than ``K`` is one k-mer, the empty one included; with fewer k-mers than
``TUPLE`` all are taken. Order: doc_id descending, nulls last, then the hash of the text; a null doc_id is a row like any
other. Repeated rows succeed each other. A single row succeeds itself. An empty table gives no rows; other columns are not
read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm.common import partitions, table, written

K, COORDINATES, TUPLE = 5, 32, 2
TILE = 1 << 17
PAIRS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

#: Rows of one partition: pairs (kind 0), its first document (1) and its last (2).
PARTS = "part int, kind int, text string, " + PAIRS

_DRAW = np.random.default_rng(20_240_601)
POWERS = _DRAW.integers(1, 1 << 63, 64, np.uint64) | np.uint64(1)
FIRST = _DRAW.integers(1, 1 << 32, 4096, np.uint32) | np.uint32(1)
SECOND = _DRAW.integers(1, 1 << 32, 4096, np.uint32) | np.uint32(1)
MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * MIX
    return x ^ (x >> np.uint64(29))


def numbered_kmers(text: str, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of (k-mer, occurrence number), and the position of each; in no set order."""
    signs = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    n = max(1, len(signs) - k + 1)
    if len(signs) < k:
        hashed = (signs * POWERS[: len(signs)]).sum(dtype=np.uint64, keepdims=True) * POWERS[-1] + np.uint64(len(signs) + 1)
    else:
        hashed = signs[:n] * POWERS[0]
        for j in range(1, k):
            hashed += signs[j : j + n] * POWERS[j]
    hashed = _mixed(hashed)
    if n < 1 << 20:  # hash and position in one word: one plain sort; 44 bits keep a text's k-mers apart
        packed = np.sort(hashed >> np.uint64(20) << np.uint64(20) | np.arange(n, dtype=np.uint64))
        place, key = (packed & np.uint64((1 << 20) - 1)).astype(np.int64), packed >> np.uint64(20)
    else:
        key = hashed >> np.uint64(20)
        place = np.argsort(key, kind="stable")
        key = key[place]
    at = np.arange(n)
    begins = np.ones(n, bool)
    begins[1:] = key[1:] != key[:-1]
    number = at - np.maximum.accumulate(np.where(begins, at, 0))
    return _mixed(key * POWERS[1] + number.astype(np.uint64) * POWERS[2]), place


def sketch(text: str, k: int = K, coordinates: int = COORDINATES, size: int = TUPLE) -> np.ndarray:
    """The fingerprint: ``coordinates`` hashes of 32 bits."""
    kmers, place = numbered_kmers(text, k)
    n, size = len(kmers), min(size, len(kmers))
    low = (kmers >> np.uint64(32)).astype(np.uint32)
    chosen = np.empty((coordinates, size), np.int64)
    step = max(1, TILE // n)
    for a in range(0, coordinates, step):
        b = min(coordinates, a + step)
        hashed = np.multiply.outer(FIRST[a:b], low)
        hashed ^= hashed >> np.uint32(15)
        hashed *= SECOND[a:b, None]
        rows = np.arange(b - a)
        for j in range(size):
            least = hashed.argmin(axis=1)
            chosen[a:b, j] = least
            hashed[rows, least] = 0xFFFFFFFF
    order = np.argsort(place[chosen], axis=1)
    in_text_order = kmers[np.take_along_axis(chosen, order, axis=1)]
    total = np.full(coordinates, size, np.uint64)
    for j in range(size):
        total = _mixed(total * MIX + in_text_order[:, j])
    return (total >> np.uint64(32)).astype(">u4")


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def edited(text: str, following: str) -> str:
    """``text`` with its last third replaced by as many first signs of ``following``, or all that it has."""
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [sketch(x.as_py() or "").tobytes().hex() for x in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], ["doc_id", "fingerprint"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` as doc_id, fingerprint (hex). No shuffle."""
    return _plain(docs).mapInArrow(_fingerprints, "doc_id long, fingerprint string")


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


TYPES = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())


def _pair(doc_id, text: str, mark: np.ndarray, following: str, next_mark: np.ndarray) -> tuple:
    other = edited(text, following)
    other_mark = sketch(other)
    return doc_id, len(text), hashlib.sha256(other.encode()).hexdigest(), mark.tobytes().hex(), other_mark.tobytes().hex(), likeness(mark, other_mark), likeness(mark, next_mark)


def _batch(rows: list[tuple], types: tuple, schema: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], schema.replace(",", "").split()[::2])


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, now, types = TaskContext.get().partitionId(), None, (pa.int32(), pa.int32(), pa.string(), *TYPES)
    edge = lambda kind, doc_id, text: (part, kind, text, doc_id, *[None] * 6)
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            following = (doc_id, text.as_py(), sketch(text.as_py()))
            rows.append((part, 0, None, *_pair(*now, *following[1:])) if now else edge(1, *following[:2]))
            now = following
        if rows:
            yield _batch(rows, types, PARTS)
    if now:
        yield _batch([edge(2, *now[:2])], types, PARTS)


def _at_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [_pair(doc_id, text, sketch(text), following, sketch(following)) for doc_id, text, following in zip(*[x.to_pylist() for x in batch.columns], strict=True)]
        if rows:
            yield _batch(rows, TYPES, PAIRS)


def edited_pairs(docs: DataFrame, shards: int) -> DataFrame:
    """Each document's fingerprint beside its edited text's and its successor's."""
    order = [F.col("doc_id").desc_nulls_last(), F.col("mark"), F.col("number")]
    keyed = _plain(docs).withColumns({"mark": F.xxhash64("text"), "number": F.monotonically_increasing_id()})
    ranged = keyed.repartitionByRange(shards, *order).sortWithinPartitions(*order).select("doc_id", "text")
    rows = written(ranged.mapInArrow(_in_order, PARTS), "omh-pairs")
    held = sorted(r.part for r in rows.where("kind = 1").select("part").collect())  # one row a partition
    following = docs.sparkSession.createDataFrame(list(zip(held, held[1:] + held[:1], strict=True)), "part int, following int")
    first = rows.where("kind = 1").select(F.col("part").alias("following"), F.col("text").alias("next_text"))
    met = rows.where("kind = 2").select("part", "doc_id", "text").join(following, "part").join(first, "following").select("doc_id", "text", "next_text")
    return rows.where("kind = 0").drop("part", "kind", "text").unionByName(met.mapInArrow(_at_edges, PAIRS))


def op4_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, in as many ranges as a shuffle has partitions."""
    return edited_pairs(table(spark, sf_dir, "documents"), partitions(spark))
