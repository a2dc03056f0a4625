"""License scans by fuzzy short-notice search.

A notice within ``errors`` edits of a phrase holds one of ``errors + 1`` pieces of the phrase unchanged. One Aho-Corasick
pass over the folded words of a text (joined by single blanks) finds those pieces; around each, the regex library's
bounded-error matching decides for each run of whole words within reach how many edits it needs. Where a run has as many
words as the phrase, each word may have one edit in ``LETTERS`` letters: short names such as mit or bsd stand unedited, since
other words are a single edit away. Where blanks came or went, the short words of the phrase must be there.

Every row is independent: no shuffle; a text is held whole by one task. Defined cases: null text is empty; a text without
words has no spans; spans of one phrase that overlap are one, the best; repeated rows repeat; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm.common import table

#: The contract's phrases and labels. Their unedited places are the base.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Further short notices; edits allowed are in ``edits``.
MORE = {
    "gnu lesser general public license": "lgpl",
    "mozilla public license": "mpl",
    "creative commons attribution": "cc-by",
    "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "released under the mit license": "mit",
    "licensed under the apache license version": "apache",
    "bsd license": "bsd",
    "unlicense": "unlicense",
}
#: Bytes that belong to no word, as blanks.
FOLD = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
LETTERS = 5
ROW = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
SPANS = "doc_id long, label string, phrase string, first_word long, n_words long, edits int, found string"


def edits(phrase: str) -> int:
    """Edits allowed: one in ten signs, none under ten."""
    return len(phrase) // 10


def distance(a: str, b: str) -> int:
    """Edit distance of two words."""
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(last[j] + 1, now[-1] + 1, last[j - 1] + (x != y)))
        last = now
    return last[-1]


def alike(found: str, phrase: str) -> bool:
    """No word of the phrase is edited beyond one edit in ``LETTERS`` letters."""
    here, there = found.split(" "), phrase.split(" ")
    if len(here) == len(there):
        return all(x == y or distance(x, y) <= len(y) // LETTERS for x, y in zip(here, there, strict=True))
    return all(x in here for x in there if len(x) < LETTERS)


@cache
def search():
    """The automaton: piece -> [(phrase, label, offset of the piece, errors, pattern)]."""
    import ahocorasick
    import regex

    held: dict[str, list] = {}
    for phrase, label in (BASE | MORE).items():
        errors = edits(phrase)
        pattern = regex.compile(f"(?b)(?:{regex.escape(phrase, literal_spaces=True)}){{e<={errors}}}") if errors else None
        cuts = [len(phrase) * k // (errors + 1) for k in range(errors + 2)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            held.setdefault(phrase[a:b], []).append((phrase, label, a, errors, pattern))
    automaton = ahocorasick.Automaton()
    for piece, uses in held.items():
        automaton.add_word(piece, (len(piece), uses))
    automaton.make_automaton()
    return automaton


def folded(text: str | None) -> str:
    """Words with one blank before, between and after. Bytes stand for signs: words are cut at ASCII signs alone."""
    words = (text or "").encode().lower().translate(FOLD).split()
    return (b" " + b" ".join(words) + b" ").decode("latin-1")


def spans(joined: str) -> list[tuple[int, int, str, str, int]]:
    """(start, end, phrase, label, edits) of the notices in ``folded`` text, by start; the best of those that overlap."""
    found: dict[tuple[str, int], tuple[int, int, str, str, int]] = {}
    tried: dict[str, int] = {}
    for last, (size, uses) in search().iter(joined):
        for phrase, label, offset, errors, pattern in uses:
            start = last + 1 - size - offset
            if start >= 1 and joined.startswith(phrase, start) and joined[start - 1] == " " and joined[start + len(phrase) : start + len(phrase) + 1] == " ":
                found[phrase, start] = (start, start + len(phrase), phrase, label, 0)
            elif pattern is not None:
                if tried.get(phrase) == start:
                    continue
                tried[phrase] = start
                until_ = start + len(phrase)
                ends = [b for b in range(max(0, until_ - errors), min(len(joined) - 1, until_ + errors) + 1) if joined[b] == " " and joined[b - 1] != " "]
                for a in range(max(1, start - errors), min(len(joined) - 1, start + errors + 1)):
                    if joined[a - 1] == " " and joined[a] != " ":
                        for b in ends:
                            match = pattern.fullmatch(joined, a, b) if a < b else None
                            if match and alike(match[0], phrase):
                                n = sum(match.fuzzy_counts)
                                old = found.get((phrase, a))
                                if old is None or n < old[4]:
                                    found[phrase, a] = (a, b, phrase, label, n)
    best: list[tuple[int, int, str, str, int]] = []
    until: dict[str, int] = {}
    for span in sorted(found.values(), key=lambda x: (x[2], x[0])):
        if best and best[-1][2] == span[2] and span[0] < until[span[2]]:
            if span[4] >= best[-1][4]:
                continue
            best.pop()
        best.append(span)
        until[span[2]] = span[1]
    return sorted(best)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            joined = folded(text.as_py())
            n_words = joined.count(" ") - 1 if len(joined) > 2 else 0
            found = spans(joined)
            base = [x for x in found if x[4] == 0 and x[2] in BASE]
            first, last = (joined.count(" ", 0, base[k][0]) - 1 if base else None for k in (0, -1))
            names = lambda x: ",".join(sorted({y[3] for y in x}))
            rows.append((doc_id, n_words, len(base), first, last, names(base), names(found), max([1 - x[4] / len(x[2]) for x in found], default=0.0)))
        columns = list(zip(*rows, strict=True)) or [()] * 8
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types, strict=True)], ROW.replace(",", "").split()[::2])


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string())
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            joined = folded(text.as_py())
            for start, end, phrase, label, n in spans(joined):
                words = joined[start:end].encode("latin-1").decode("utf-8", "replace")
                rows.append((doc_id, label, phrase, joined.count(" ", 0, start) - 1, words.count(" ") + 1, n, words))
        columns = list(zip(*rows, strict=True)) or [()] * 7
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types, strict=True)], SPANS.replace(",", "").split()[::2])


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def scanned(docs: DataFrame) -> DataFrame:
    """A row a row of ``docs(doc_id, text)`` with counts, labels and score (1 less edits a sign of the best notice)."""
    return _plain(docs).mapInArrow(_rows, ROW)


def notices(docs: DataFrame) -> DataFrame:
    """A row a notice: where it stands (words from 0), its edits and its folded words."""
    return _plain(docs).mapInArrow(_spans, SPANS)


def op9_fuzzy_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents."""
    return scanned(table(spark, sf_dir, "documents"))
