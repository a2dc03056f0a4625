"""Toxicity by non-negative positive-unlabelled learning: a numpy classifier from confirmed toxic texts and any texts.

Features: runs of ``GRAM`` bytes within words (word ends marked), present or not, so spellings of a word share features. A
run is its bytes read as a number, never a hash: what was not seen in training has no weight, however long the text. In how
many texts a run is, is counted over all training rows: over the confirmed toxic ones for every run, over all for the runs
that are in a ``SHARE`` of the toxic ones. Those that are ``LIFT`` times as common among the toxic ones get weights. Only the
gradient steps use samples: at most ``POSITIVE`` confirmed toxic texts and ``UNLABELLED`` texts of any kind, the first by a hash of doc_id; the bounds are
parameters. The class prior is the toxic share of the labelled training rows. The weights minimise the corrected risk
prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)); where the second term is negative, its gradient is walked back.

Plan: a bitmap of bounded size and a join find the toxic training texts, which are written, and a partial aggregate counts their runs; one map over all training texts that
gives a row a run and partition; one broadcast join fetches the sample. What reaches the driver is bounded by the runs that
a ``SHARE`` of texts can have and by the sample. Scoring is a map over all texts; no shuffle. Labels choose training rows
only: label, lang, source and doc_id are no inputs of a score. Defined cases: null text is empty and has the score of the
bias; texts with equal words have equal scores; without positives or texts to train on, all scores are 0; repeated labels of
a doc_id count toxic if any is; rows that repeat a doc_id are one row of the sample and each counted; null labels are no
labels; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm.common import alone, among, bitmap, released, table, written

GRAM = 5
POSITIVE, UNLABELLED, LIFT, SHARE = 3_000, 9_000, 2.0, 0.004
THRESHOLD, BLOCK = 0.7, 1 << 20
#: Words are runs of letters; this is what stands between them.
OTHERS = re.compile(r"[\W\d_]+")
SCORES = "doc_id long, score double"


def held_out():
    """Rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


@dataclass
class Model:
    """Weights of the chosen grams; ``bias`` -inf scores 0."""

    features: dict[int, float]
    bias: float


def _present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    alone()
    for batch in batches:
        found = [np.unique(np.concatenate([run for _, run in runs([text.as_py()])])) for text in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64())), batch.column(2)], ["positive", "grams", "doc_id"])


def runs(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, run) of all runs of the texts, about ``BLOCK`` bytes at a time; a run comes as often as it stands there.

    Words are written as <word> with a blank between, so runs are windows of ``GRAM`` bytes without a blank; a word too short for
    one is a run itself. Blocks end at blanks, so a long text is no larger step than many short ones.
    """
    words = [f"<{OTHERS.sub('> <', (text or '').lower())}> ".encode() for text in texts]
    ends, data = np.cumsum([len(x) for x in words]), np.frombuffer(b"".join(words) + b" " * GRAM, np.uint8)
    del words
    blanks, start, last = np.flatnonzero(data == 32), 0, len(data) - GRAM
    while start < last:
        stop = min(last, start + BLOCK)
        if stop < last:
            stop = int(blanks[np.searchsorted(blanks, stop)]) + 1  # a word is no longer than the text
        n = stop - start
        held, blank = np.zeros(n, np.int64), np.zeros(n, bool)
        for k in range(GRAM):
            own = data[start + k : stop + k]
            held = held << 8 | own
            blank |= own == 32
        found = [(np.flatnonzero(~blank), held)]
        opens = data[start:stop] == 60
        for size in range(3, GRAM):  # <a> and <ab> are shorter than a run
            short = opens & (data[start + size - 1 : stop + size - 1] == 62)
            for k in range(1, size - 1):
                short &= data[start + k : stop + k] > 62
            found.append((np.flatnonzero(short), held >> 8 * (GRAM - size)))
        at, run = np.concatenate([x for x, _ in found]), np.concatenate([y[x] for x, y in found])
        yield np.searchsorted(ends, at + start, side="right"), run
        start = stop


def once(numbers: np.ndarray) -> np.ndarray:
    """The distinct numbers, ascending: marked where they are dense, sorted where they are not."""
    low = int(numbers.min()) if len(numbers) else 0
    size = int(numbers.max()) - low + 1 if len(numbers) else 0
    if not 0 < size <= min(1 << 27, 64 * len(numbers)):
        return np.unique(numbers)
    marks = np.zeros(size, bool)
    marks[numbers - low] = True
    return np.flatnonzero(marks) + low


class Places:
    """The places of ``chosen`` runs: a table by hash, and a sorted rest for those that share an entry."""

    def __init__(self, chosen: np.ndarray):
        self.chosen, bits = chosen, max(12, (64 * len(chosen)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.table = np.full(1 << bits, -1, np.int32)
        self.table[self.entry(chosen)] = np.arange(len(chosen))
        self.rest = np.flatnonzero(self.table[self.entry(chosen)] != np.arange(len(chosen)))

    def entry(self, run: np.ndarray) -> np.ndarray:
        return (run.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).view(np.int64)

    def of(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(row, place) of the chosen runs that the texts hold, each pair once, ascending."""
        width, out = max(1, len(self.chosen)), []
        for row, run in runs(texts):
            place = self.table[self.entry(run)]
            taken = np.flatnonzero(place >= 0)
            row, run, place = row[taken], run[taken], place[taken].astype(np.int64)
            right = self.chosen[place] == run
            pairs = row[right] * width + place[right]
            if len(self.rest):
                other, of = run[~right], row[~right]
                spot = np.minimum(np.searchsorted(self.chosen[self.rest], other), len(self.rest) - 1)
                same = self.chosen[self.rest[spot]] == other
                pairs = np.concatenate([pairs, of[same] * width + self.rest[spot[same]]])
            out.append(once(pairs))
        pairs = np.unique(np.concatenate(out)) if len(out) > 1 else out[0] if out else np.zeros(0, np.int64)
        return pairs // width, pairs % width


def parts(texts: pa.Array) -> Iterator[list[str | None]]:
    """The texts, a few megabytes at a time."""
    held, size = [], 0
    for text in texts:
        held.append(text.as_py())
        size += len(held[-1] or "")
        if size >= BLOCK:
            yield held
            held, size = [], 0
    if held:
        yield held


def _counted(batches: Iterator[pa.RecordBatch], chosen: np.ndarray) -> Iterator[pa.RecordBatch]:
    """In how many texts each of the ``chosen`` runs is; -1 stands for the number of texts."""
    alone()
    places, rows, total = Places(chosen), 0, np.zeros(len(chosen), np.int64)
    for batch in batches:
        for texts in parts(batch.column(0)):
            rows += len(texts)
            total += np.bincount(places.of(texts)[1], minlength=len(chosen))
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(chosen[seen], -1), pa.int64()), pa.array(np.append(total[seen], rows), pa.int64())], ["gram", "n"])


def _sparse(batches: Iterator[pa.RecordBatch], chosen: np.ndarray) -> Iterator[pa.RecordBatch]:
    alone()
    for batch in batches:
        held = [np.intersect1d(own.values.to_numpy(), chosen, assume_unique=True).tobytes() for own in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held, pa.binary())], ["positive", "grams"])


def telling(grams_: np.ndarray, p: np.ndarray, u: np.ndarray, positive: int, unlabelled: int) -> np.ndarray:
    """The telling runs, ascending: run k is in p[k] of ``positive`` toxic texts and u[k] of ``unlabelled`` texts."""
    # A run of the positive class alone is 1 / prior times as common among positives; one of its language, once to twice.
    lift = (p / positive + 0.5 / positive) / (u / unlabelled + 0.5 / unlabelled + 1e-4)
    return np.sort(grams_[(p >= max(3, SHARE * positive)) & (lift >= LIFT)])


def chosen_grams(texts: DataFrame, toxic: DataFrame) -> np.ndarray:
    """The telling runs of training ``texts(doc_id, text)`` where ``toxic(doc_id)`` are confirmed; counts over all of them."""
    near = among(texts, bitmap(toxic, "doc_id"), "doc_id")  # the join that follows sends their texts alone
    # Written between the two maps: in one stage each task would have two workers.
    near = written(near.join(toxic, "doc_id").select(F.lit(True).alias("positive"), "text", "doc_id"), "toxic-texts")
    own = written(near.mapInArrow(_present, "positive boolean, grams array<long>, doc_id long"), "toxicity-positive")
    released(near)
    positive = own.count()
    counts = own.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count("*").alias("p"))
    frequent = counts.where(F.col("p") >= max(3, SHARE * positive)).orderBy("gram").toArrow()  # 1 / SHARE times a text's runs at most
    released(own)
    held, p = (frequent.column(x).to_numpy() for x in ("gram", "p"))
    if not len(held):
        return np.zeros(0, np.int64)
    found = texts.select("text").mapInArrow(lambda x: _counted(x, held), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    n = dict(zip(found.column("gram").to_pylist(), found.column("n").to_pylist(), strict=True))
    return telling(held, p, np.array([n.get(g, 0) for g in held.tolist()]), positive, n[-1])


def sample(docs: DataFrame, labels: DataFrame, positive: int, unlabelled: int) -> tuple[list[np.ndarray], list[np.ndarray], float]:
    """The telling runs in each row of the positive and the unlabelled sample, and the prior; at most ``positive + unlabelled`` rows travel."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.col("doc_id").isNotNull() & ~held_out())
    rows = texts.select("doc_id").distinct().join(known, "doc_id", "left").withColumn("order", F.xxhash64("doc_id"))
    prior = rows.where("toxic is not null").agg(F.avg((F.col("toxic") == 1).cast("double"))).head()[0] or 0.0
    found = chosen_grams(texts, known.where("toxic = 1").select("doc_id"))
    picked = (
        rows.where("toxic = 1").orderBy("order", "doc_id").limit(positive).select("doc_id", F.lit(True).alias("positive"))
        .unionByName(rows.orderBy("order", "doc_id").limit(unlabelled).select("doc_id", F.lit(False).alias("positive")))
    )
    fetched = texts.join(F.broadcast(picked), "doc_id")  # at most positive + unlabelled ids
    own = fetched.select("positive", "text", "doc_id").mapInArrow(_present, "positive boolean, grams array<long>, doc_id long")
    held = own.groupBy("positive", "doc_id").agg(F.min("grams").alias("grams")).select("positive", "grams")  # rows that repeat a doc_id are one row of the sample
    sparse = held.mapInArrow(lambda x: _sparse(x, found), "positive boolean, grams binary").toArrow()
    p, u = [], []
    for is_positive, runs in zip(*(sparse.column(x).to_pylist() for x in ("positive", "grams")), strict=True):
        (p if is_positive else u).append(np.frombuffer(runs, np.int64))
    del sparse
    pa.default_memory_pool().release_unused()
    return p, u, prior


class Rows:
    """Texts as the places of the runs that they hold: a sparse matrix of ones."""

    def __init__(self, texts: list[np.ndarray], chosen: np.ndarray):
        self.n, self.width = len(texts), len(chosen)
        self.place = np.searchsorted(chosen, np.concatenate(texts)) if texts else np.zeros(0, np.int64)
        self.row = np.repeat(np.arange(self.n), [len(x) for x in texts])

    def times(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights[self.place], self.n)

    def transposed(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.place, values[self.row], self.width)


def risk(zp: np.ndarray, zu: np.ndarray, prior: float, sigmoid: bool) -> tuple[float, float]:
    """prior * R_p(+) and R_u(-) - prior * R_p(-) of the texts' sums, under the logistic or the sigmoid loss."""
    sp, su = (1 / (1 + np.exp(-np.clip(z, -30, 30))) for z in (zp, zu))
    if sigmoid:
        return prior * float((1 - sp).mean()), float(su.mean() - prior * sp.mean())
    alarm = lambda s: -np.log1p(-np.minimum(s, 1 - 1e-7)).mean()
    return prior * float(-np.log(np.maximum(sp, 1e-7)).mean()), float(alarm(su) - prior * alarm(sp))


def slopes(p: Rows, u: Rows, weights: np.ndarray, prior: float, sigmoid: bool) -> np.ndarray:
    """The direction of a step, the last entry the bias': the gradient of the corrected risk, or where its second term is
    negative, that term's gradient walked back."""
    zp, zu = (x.times(weights[:-1]) + weights[-1] for x in (p, u))
    sp, su = (1 / (1 + np.exp(-np.clip(z, -30, 30))) for z in (zp, zu))
    if sigmoid:
        miss = alarm = sp * (1 - sp) / p.n
        wrong = su * (1 - su) / u.n
    else:
        miss, alarm, wrong = (1 - sp) / p.n, sp / p.n, su / u.n
    as_positive = -prior * np.append(p.transposed(miss), miss.sum())
    as_negative = np.append(u.transposed(wrong), wrong.sum()) - prior * np.append(p.transposed(alarm), alarm.sum())
    return as_positive + as_negative if risk(zp, zu, prior, sigmoid)[1] >= 0 else -as_negative


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, steps: int = 300, rate: float = 0.05) -> Model:
    """Weights by Adam on the non-negative risk, for each run that a row holds; rows in a set order, so reruns agree.

    A third of the steps take the logistic loss, which finds the class from anywhere; the rest the sigmoid loss, which no longer
    pulls at texts that are plainly of one class and so leaves chance runs alone.
    """
    if not positive or not unlabelled or not 0 < prior < 1:
        return Model({}, float("-inf"))
    positive, unlabelled = (sorted(x, key=lambda y: y.tobytes()) for x in (positive, unlabelled))
    chosen = np.unique(np.concatenate([*positive, *unlabelled]))
    p, u, decay = Rows(positive, chosen), Rows(unlabelled, chosen), 1e-5
    w, first, second = np.zeros(len(chosen) + 1), 0.0, 0.0
    w[-1] = -2.0
    for step in range(1, steps + 1):
        gradient = slopes(p, u, w, prior, step > steps // 3) + decay * np.append(w[:-1], 0)
        first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
        w -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return Model({int(g): float(x) for g, x in zip(chosen, w[:-1], strict=True)}, float(w[-1]))


class Scorer:
    """Scores of texts under a model."""

    def __init__(self, model: Model):
        chosen = np.array(sorted(model.features), np.int64)
        self.bias, self.weights, self.places = model.bias, np.array([model.features[g] for g in chosen.tolist()], float), Places(chosen)

    def scores(self, texts: pa.Array) -> np.ndarray:
        if self.bias == float("-inf") or not len(texts):
            return np.zeros(len(texts))
        sums = []
        for held in parts(texts):
            row, place = self.places.of(held)
            sums.append(np.bincount(row, self.weights[place], len(held)))
        return 1 / (1 + np.exp(-np.clip(self.bias + np.concatenate(sums), -700, 700)))


def _scores(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    alone()
    scorer = Scorer(model)
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scorer.scores(batch.column(1)), pa.float64())], ["doc_id", "score"])


def trained(docs: DataFrame, labels: DataFrame, positive: int = POSITIVE, unlabelled: int = UNLABELLED) -> Model:
    return fit(*sample(docs, labels, positive, unlabelled))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (0 to 1) of each row of ``docs(doc_id, text)``."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lambda x: _scores(x, model), SCORES)


def _clean(batches: Iterator[pa.RecordBatch], model: Model, threshold: float) -> Iterator[pa.RecordBatch]:
    alone()
    scorer = Scorer(model)
    for batch in batches:
        yield batch.filter(pa.array(scorer.scores(batch.column("text").cast(pa.string())) < threshold, pa.bool_()))


def cleaned(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more; all columns stay."""
    return docs.mapInArrow(lambda x: _clean(x, model, threshold), docs.schema)


def op5_nnpu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents."""
    docs = table(spark, sf_dir, "documents")
    out = scored(docs, trained(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
