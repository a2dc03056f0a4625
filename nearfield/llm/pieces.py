"""SentencePiece encoding and decoding of whole texts by a prefix table of last tokens.

The model joins neighbouring symbols in the order of piece scores. Two facts make that a table: a sequence of pieces is
the result for its text exactly if each neighbouring pair is the result for the pair's own text, and each prefix of a text
has one last piece. So, for each end position, the pieces that end there come from an Aho-Corasick automaton, the one
that is compatible with the last piece of the prefix before it is stored, and ids are recovered backwards.

No piece has the blank sign after another sign, so a text falls apart at blanks and each segment has its own ids, which a
bounded memory keeps. Signs outside the vocabulary stand alone and become byte pieces. Pieces of several blanks have equal
scores, where the two facts don't hold: segments that start with more than one blank are joined step by step.

Every row is independent: no shuffle. Defined cases: a null text is empty and has no ids; repeated rows repeat; an empty
table gives no rows; extra columns stay out of the way.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm.chunks import Memory, distinct, slices, spread
from nearfield.llm.common import held, table

BLANK = "▁"
#: Segments that one worker remembers for each of two generations, and pairs; what is forgotten is found again.
REMEMBERED, PAIRS = 150_000, 300_000
SEGMENT = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class Pieces:
    """One model's vocabulary, the automaton over its pieces, and the pair test."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        self.model = model = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [k for k in range(model.vocab_size()) if not (model.is_byte(k) or model.is_control(k) or model.is_unknown(k))]
        self.id = {model.id_to_piece(k): k for k in plain}
        self.score = {model.id_to_piece(k): model.get_score(k) for k in plain}
        self.byte = [model.piece_to_id(f"<0x{k:02X}>") for k in range(256)]
        self.automaton = ahocorasick.Automaton()
        for piece in self.id:
            if self.joined(piece) == [piece]:  # a piece that no joins lead to is never a result
                self.automaton.add_word(piece, piece)
        self.automaton.make_automaton()
        self.pairs: dict[tuple[str, str], bool] = {}

    def joined(self, text: str) -> list[str]:
        """Pieces of ``text`` by the definition: join the pair of best score, leftmost first, until none is left."""
        signs, n = list(text), len(text)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        queue: list[tuple[float, int, str]] = []

        def offer(k: int) -> None:
            if k >= 0 and after[k] >= 0 and (both := signs[k] + signs[after[k]]) in self.score:
                heapq.heappush(queue, (-self.score[both], k, both))

        for k in range(n):
            offer(k)
        while queue:
            _, k, both = heapq.heappop(queue)
            if not signs[k] or after[k] < 0 or signs[k] + signs[after[k]] != both:
                continue
            gone = after[k]
            signs[k], signs[gone], after[k] = both, "", after[gone]
            if after[k] >= 0:
                before[after[k]] = k
            offer(before[k])
            offer(k)
        return [x for x in signs if x]

    def compatible(self, left: str, right: str) -> bool:
        """Whether this pair is the result for its own text."""
        found = self.pairs.get((left, right))
        if found is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            found = self.pairs[left, right] = self.joined(left + right) == [left, right]
        return found

    def split(self, text: str) -> list[str]:
        """Pieces of ``text``, by the prefix table. Signs of no piece stand alone."""
        n, known = len(text), self.pairs
        last: list[str | None] = [None] * n
        for end, piece in self.automaton.iter(text):
            if last[end] is None:
                start = end - len(piece)
                if start < 0:
                    last[end] = piece
                    continue
                left = last[start]
                if left is None or (known.get((left, piece)) if (left, piece) in known else self.compatible(left, piece)):
                    last[end] = piece
        out, end = [], n - 1
        while end >= 0:
            piece = last[end] or text[end]
            out.append(piece)
            end -= len(piece)
        out.reverse()
        return out

    def ids(self, segment: str) -> bytes:
        found = self.joined(segment) if segment.startswith(BLANK * 2) else self.split(segment)
        out = array("I")
        for piece in found:
            k = self.id.get(piece)
            if k is None:
                out.extend([self.byte[b] for b in piece.encode()])
            else:
                out.append(k)
        return out.tobytes()


class SegmentIds:
    """Segment without its first blank -> its ids as 32-bit words."""

    def __init__(self, pieces: Pieces):
        self.pieces, self.known, self.parts = pieces, Memory(self.made, REMEMBERED), Memory(pieces.ids, REMEMBERED // 2)
        self.decimal = pa.array([str(k) for k in range(pieces.model.vocab_size())], pa.string())

    def made(self, rest: str) -> bytes:
        segment = BLANK + rest
        if "\n" not in rest or "\n" in self.pieces.id:
            return self.pieces.ids(segment)
        # A line end is outside every piece, so it ends all joins: what stands between is encoded by itself.
        line_end = array("I", [self.pieces.byte[10]]).tobytes()
        return line_end.join([self.parts[x] if x else b"" for x in segment.split("\n")])

    def odd(self, text: str) -> np.ndarray:
        """The ids of any text."""
        segments = SEGMENT.findall(BLANK + text.replace(" ", BLANK)) if text else []
        return np.frombuffer(b"".join([self.known[x[1:]] for x in segments]), "<u4")

    def texts(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, str]]:
        """The ids of each text and the same in decimal, in order. Texts whose segments are not just what stands between
        single blanks are cut one at a time."""
        for part in slices(texts):
            mask = pc.or_(pc.match_substring(part, "  "), pc.match_substring(part, BLANK))
            mask = pc.or_(pc.or_(mask, pc.starts_with(part, " ")), pc.or_(pc.ends_with(part, " "), pc.equal(part, "")))
            chunks, places, offsets = distinct(pc.split_pattern(pc.if_else(mask, "", part), " "))
            ids, ends = spread(list(map(self.known.__getitem__, chunks)), "<u4", places, offsets)
            rows = [self.odd(part[k].as_py()) if is_odd else ids[ends[k] : ends[k + 1]] for k, is_odd in enumerate(mask.to_pylist())]
            bounds = np.concatenate([[0], np.cumsum([len(x) for x in rows])])
            signs = self.decimal.take(pa.array(np.concatenate(rows).astype(np.int32)))
            yield from zip(rows, pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), signs), ",").to_pylist(), strict=True)


def segment_ids(path: str) -> SegmentIds:
    return held(f"pieces {path}", lambda: SegmentIds(Pieces(path)))


def _digests(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    known = segment_ids(path)
    decode = known.pieces.model.decode
    for batch in batches:
        counts, coded, decoded = [], [], []
        for ids, decimal in known.texts(batch.column(1)):
            counts.append(len(ids))
            coded.append(hashlib.sha256(decimal.encode()).hexdigest())
            decoded.append(hashlib.sha256((decode(ids.tolist()) if len(ids) else "").encode()).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())], DIGESTS.replace(",", "").split()[::2])


def _encoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    known = segment_ids(path)
    for batch in batches:
        ids = [x.astype(np.int32) for x, _ in known.texts(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])


def _decoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    decode = segment_ids(path).pieces.model.decode
    for batch in batches:
        texts = [decode(ids) if ids else "" for ids in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``docs(doc_id, text)`` as doc_id, ids."""
    return _plain(docs).mapInArrow(lambda x: _encoded(x, path), "doc_id long, ids array<int>")


def decode(ids: DataFrame, path: str) -> DataFrame:
    """``ids(doc_id, ids)`` as doc_id, text; null or empty ids are the empty text."""
    return ids.select("doc_id", F.col("ids").cast("array<int>").alias("ids")).mapInArrow(lambda x: _decoded(x, path), "doc_id long, text string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Encoding and decoding of each text, as counts and checksums."""
    return _plain(docs).mapInArrow(lambda x: _digests(x, path), DIGESTS)


def op3_prefix_table_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents under the 32k piece model."""
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
