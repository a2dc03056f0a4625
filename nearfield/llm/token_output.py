"""Token-ID / binary output: ids in ascending document order, stored under one global canonical Huffman code.

Plan: one range shuffle orders the texts; every partition is a shard and emits blocks of whole documents (about
``BLOCK`` ids) that are written once as raw ids. Counts of all ids are summed from that table, the code is built from at
most one row per vocabulary entry, and each block is then coded on its own, in any order. Readers decode blocks
independently; the position of a block is the sum of its shard's and its predecessors' id counts.

Defined cases: a null or empty text holds the end id only; null doc_ids come first; repeated rows are repeated documents
(in the order they are read among equal doc_ids, and dealt to several shards if there are many); an empty table gives an empty file; other columns are not read. A document is
never split, so a block is larger than ``BLOCK`` only for a longer single document.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from nearfield.llm.chunks import Memory, distinct, slices, spread
from nearfield.llm.common import forgotten, held, partitions, removed, scratch
from nearfield.llm.huffman import Code, code_lengths

BLOCK = 1 << 18
#: Distinct chunks that one worker remembers for each of two generations.
REMEMBERED = 600_000

RAW = "shard int, block long, n_docs int, n_ids long, doc_ids binary, counts binary, ids binary"
CODED = "shard int, block long, n_docs int, n_ids long, doc_ids binary, counts binary, offsets binary, payload binary, crc long"


#: Letters whose lower case, composition and spelling in bytes are plain: ASCII and Latin-1.
LETTERS = re.compile("[a-zß-öø-ÿ]+")
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: Byte-level spelling: printable bytes stand for themselves, the others are numbered from 256.
SPELLING = str.maketrans({chr(b): chr(256 + n) for n, b in enumerate(b for b in range(256) if b not in _PLAIN)})


class ChunkIds:
    """Chunk of a text without white space -> its ids as bytes, each found by the library itself.

    White space is dropped by the tokenizer before words are formed and its rules look at no character beyond it, so a
    text's ids are those of its chunks in order; ASCII capitals may be folded first as the tokenizer folds them. A full
    stop or comma after an ASCII letter or digit is a word of its own. A chunk of plain letters is one word and goes to the
    library's merging model directly, where probes show that its other steps leave it alone. Special tokens are matched
    in a text as it is, so texts with their brackets are not folded.
    """

    def __init__(self, tokenizer, dtype):
        self.tokenizer, self.encode, self.merge = tokenizer, tokenizer.encode, tokenizer.model.tokenize
        self.dtype, self.kind = dtype, {"<u2": "H", "<u4": "I"}[dtype]
        self.known = Memory(self.made, REMEMBERED)
        self.direct = all(self.whole(x) == self.merged(x) for x in ("the", "tokenizer", "été", "straße", "zürich", "ÿþð", "qxzvkjw"))

    def whole(self, chunk: str) -> bytes:
        return array(self.kind, self.encode(chunk, add_special_tokens=False).ids).tobytes()

    def merged(self, chunk: str) -> bytes:
        return array(self.kind, [x.id for x in self.merge(chunk.encode().decode("latin-1").translate(SPELLING))]).tobytes()

    def made(self, chunk: str) -> bytes:
        if self.direct and LETTERS.fullmatch(chunk):
            return self.merged(chunk)
        if len(chunk) > 1 and chunk[-1] in ".," and chunk[-2].isascii() and chunk[-2].isalnum():
            return self.known[chunk[:-1]] + self.known[chunk[-1:]]
        return self.whole(chunk)

    def texts(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of each text, in order."""
        for part in slices(texts):
            marked = pc.match_substring(part, "<|")
            folded = pc.if_else(marked, part, pc.ascii_lower(part))
            chunks, places, offsets = distinct(pc.ascii_split_whitespace(folded))
            ids, ends = spread(list(map(self.known.__getitem__, chunks)), self.dtype, places, offsets)
            for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                yield ids[a:b].tobytes()


def chunk_ids(path: str) -> tuple[ChunkIds, int]:
    """The tokenizer of this worker, loaded once, and its vocabulary size."""

    def load() -> tuple[ChunkIds, int]:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        size = tokenizer.get_vocab_size(with_added_tokens=True)
        return ChunkIds(tokenizer, id_type(size)), size

    return held(f"tokens {path}", load)


def id_type(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def _raw_blocks(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    words, _ = chunk_ids(path)
    end, width = np.array([end_id], words.dtype).tobytes(), np.dtype(words.dtype).itemsize
    shard, block, docs, ids, held = TaskContext.get().partitionId(), 0, [], [], 0

    def flush() -> pa.RecordBatch:
        counts = np.array([len(x) // width for x in ids], "<u4")
        keys = pa.array(docs, pa.int64())
        null = np.array([x is None for x in docs], np.uint8).tobytes()
        known = keys.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes()
        row = [[shard], [block], [len(docs)], [int(counts.sum(dtype=np.int64))], [known + null], [counts.tobytes()], [b"".join(ids)]]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], RAW.replace(",", "").split()[::2])

    for batch in batches:
        for doc_id, found in zip(batch.column(0).to_pylist(), words.texts(batch.column(1)), strict=True):
            coded = found + end
            if docs and held + len(coded) > BLOCK * width:
                yield flush()
                block, docs, ids, held = block + 1, [], [], 0
            docs.append(doc_id)
            ids.append(coded)
            held += len(coded)
    if docs:
        yield flush()


def _histogram(batches: Iterator[pa.RecordBatch], vocabulary: int) -> Iterator[pa.RecordBatch]:
    total = np.zeros(vocabulary, np.int64)
    for batch in batches:
        for x in batch.column(0):
            total += np.bincount(np.frombuffer(x.as_buffer(), id_type(vocabulary)), minlength=vocabulary)
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], ["id", "n"])


def _coded(batches: Iterator[pa.RecordBatch], lengths: bytes, vocabulary: int) -> Iterator[pa.RecordBatch]:
    code = Code(np.frombuffer(lengths, np.uint8))
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1)
            payload, offsets = code.encode(np.frombuffer(row.column("ids")[0].as_buffer(), id_type(vocabulary)))
            kept = [row.column(x) for x in ("shard", "block", "n_docs", "n_ids", "doc_ids", "counts")]
            more = [pa.array([offsets.astype("<u8").tobytes()], pa.binary()), pa.array([payload], pa.binary()), pa.array([zlib.crc32(payload)], pa.int64())]
            yield pa.RecordBatch.from_arrays(kept + more, CODED.replace(",", "").split()[::2])


def write(docs: DataFrame, tokenizer_path: str, end_id: int, limit: int = 16) -> str:
    """Encode ``docs(doc_id, text)`` and write blocks and code under a fresh shared path, which is returned."""
    spark = docs.sparkSession
    path = scratch(spark, "token-ids")
    _, vocabulary = chunk_ids(tokenizer_path)
    vocabulary = max(vocabulary, end_id + 1)
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # Rows of one doc_id are told apart by a number, so a doc_id that a third of the rows share is no single shard.
    order = ["doc_id", "number"]
    ordered = ordered.withColumn("number", F.monotonically_increasing_id()).repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    ordered.select("doc_id", "text").mapInArrow(lambda x: _raw_blocks(x, tokenizer_path, end_id), RAW).write.option("compression", "zstd").parquet(f"{path}/raw")
    del ordered
    forgotten(spark)
    raw = spark.read.schema(RAW).parquet(f"{path}/raw")
    counts = np.zeros(vocabulary, np.int64)
    found = raw.select("ids").mapInArrow(lambda x: _histogram(x, vocabulary), "id long, n long")
    for row in found.groupBy("id").agg(F.sum("n").alias("n")).collect():  # one row a vocabulary entry at most
        counts[row.id] = row.n
    lengths = code_lengths(counts, limit).tobytes()
    spark.createDataFrame([(vocabulary, end_id, bytearray(lengths))], "vocabulary long, end_id long, lengths binary").coalesce(1).write.parquet(f"{path}/code")
    raw.mapInArrow(lambda x: _coded(x, lengths, vocabulary), CODED).write.option("compression", "none").parquet(f"{path}/blocks")
    removed(spark, f"{path}/raw")
    return path


def _documents(batches: Iterator[pa.RecordBatch], lengths: bytes, with_ids: bool) -> Iterator[pa.RecordBatch]:
    code = Code(np.frombuffer(lengths, np.uint8))
    for batch in batches:
        for k in range(batch.num_rows):
            get = lambda name: batch.column(name)[k]  # noqa: B023, E731
            payload, n = get("payload").as_py(), get("n_ids").as_py()
            if zlib.crc32(payload) != get("crc").as_py():
                raise ValueError(f"block {get('block').as_py()} of shard {get('shard').as_py()} is damaged")
            ids = code.decode(payload, np.frombuffer(get("offsets").as_buffer(), "<u8"), n).astype("<u4")
            counts = np.frombuffer(get("counts").as_buffer(), "<u4").astype(np.int64)
            ends, m = np.cumsum(counts), len(counts)
            key = get("doc_ids").as_py()
            doc_ids = pa.array(np.frombuffer(key[: 8 * m], "<i8"), pa.int64(), mask=np.frombuffer(key[8 * m :], np.uint8).astype(bool))
            view = memoryview(ids.tobytes())
            parts = [view[4 * (e - c) : 4 * e] for e, c in zip(ends.tolist(), counts.tolist(), strict=True)]
            place = [pa.array([get(x).as_py()] * m, t) for x, t in (("shard", pa.int32()), ("block", pa.int64()))]
            out = [*place, doc_ids, pa.array(ends - counts, pa.int64()), pa.array(counts, pa.int64()), pa.array([zlib.crc32(x) for x in parts], pa.int64())]
            names = ["shard", "block", "doc_id", "start", "n_tokens", "ids_crc32"]
            if with_ids:
                out, names = [*out, pa.array([np.frombuffer(x, "<u4").astype(np.int64) for x in parts], pa.list_(pa.int64()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(out, names)


def read(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Decode every block: doc_id, start, n_tokens, ids_crc32 (and the ids). A damaged block is an error."""
    blocks = spark.read.schema(CODED).parquet(f"{path}/blocks")
    lengths = bytes(spark.read.parquet(f"{path}/code").head().lengths)
    sizes = blocks.select("shard", "block", "n_ids")
    shards = sizes.groupBy("shard").agg(F.sum("n_ids").alias("total"))  # a row a partition of the writer
    before = shards.select("shard", (F.sum("total").over(W.orderBy("shard")) - F.col("total")).alias("before"))
    within = sizes.select("shard", "block", (F.sum("n_ids").over(W.partitionBy("shard").orderBy("block")) - F.col("n_ids")).alias("within"))
    starts = within.join(before, "shard").select("shard", "block", (F.col("before") + F.col("within")).alias("first"))
    schema = "shard int, block long, doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    docs = blocks.mapInArrow(lambda x: _documents(x, lengths, with_ids), schema)  # payloads stay where they are read
    found = docs.join(starts, ["shard", "block"]).withColumn("start", F.col("first") + F.col("start"))
    return found.select("doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids)


def op1_huffman_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents under the 49k word BPE, end id 2, written and read back."""
    import public_tokenizers

    from nearfield.llm.common import table

    return read(spark, write(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2))
