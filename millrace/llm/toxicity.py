"""Toxicity scores by non-negative positive-unlabelled learning.

The positives are rows labelled toxic; everything else, labelled or not, is
unlabelled. With the class prior p, the negative risk of the unlabelled rows
contains that of the hidden positives, so the estimator is

    p * E_pos[loss(+)] + max(0, E_unl[loss(-)] - p * E_pos[loss(-)])

and, where the second term turns negative, its gradient is followed upwards
instead. The classifier is a logistic model on the presence of words and of the
first 4, 5 and 6 characters of words, trained by numpy on a bounded sample.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from millrace.llm import columns
from millrace.llm.scratch import written
from millrace.llm.textnum import release_memory

#: Most positives and unlabelled rows that the classifier is fitted on (chosen by seeded hashes; in expectation).
MAX_POSITIVE, MAX_UNLABELLED = 8_000, 16_000
#: Hash space of the features, and so their number at most.
SPACE = 1 << 22
#: Highest score of a text without known features.
UNKNOWN = 0.49
#: Words whose features a task keeps.
WORDS = 150_000
_PLAIN = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> set[bytes]:
    """Distinct lower-cased words of the whole text."""
    return set() if not text else set(text.lower().encode("utf-8", "surrogatepass").translate(_PLAIN).split())


def features_of(word: bytes) -> tuple[int, ...]:
    """Hashed features of one word: itself, and its first 4, 5 and 6 characters."""
    letters = word.decode("utf-8", "replace")
    found = [zlib.crc32(b"w " + word)]
    found += [zlib.crc32(b"%d " % k + letters[:k].encode()) for k in (4, 5, 6) if len(letters) >= k]
    return tuple(h % SPACE for h in found)


@dataclass
class Model:
    """Weights by feature; a text's score is the logistic of their sum over its distinct features.

    A text without a known feature has nothing that speaks against it: its
    score is UNKNOWN at most, whatever the bias.
    """

    bias: float = -20.0
    weights: dict[int, float] = field(default_factory=dict)

    def scores(self, texts: list[str | None], known: dict[bytes, tuple[int, ...]] | None = None) -> list[float]:
        known = {} if known is None else known
        weights, out = self.weights, []
        for text in texts:
            hit: set[int] = set()
            for word in words_of(text):
                f = known.get(word)
                if f is None:
                    f = known[word] = tuple(k for k in features_of(word) if k in weights)
                if f:
                    hit.update(f)
            found = 1.0 / (1.0 + float(np.exp(-np.clip(self.bias + sum(weights[k] for k in sorted(hit)), -30, 30))))
            out.append(found if hit else min(found, UNKNOWN))
            if len(known) > WORDS:
                known.clear()
        return out


def risk(g: np.ndarray, positive: np.ndarray, prior: float) -> tuple[float, float, np.ndarray]:
    """Positive and negative risk at margins g with logistic loss, and the slope in g of what a step descends.

    That is their sum, or, where the negative risk is below 0, its opposite.
    """
    n_pos, n_unl = int(positive.sum()), int((~positive).sum())
    s = 1.0 / (1.0 + np.exp(-np.clip(g, -30, 30)))
    below = np.logaddexp(0.0, g)  # loss of calling a row negative
    above = prior * float(np.logaddexp(0.0, -g)[positive].mean())
    negative = float(below[~positive].mean() - prior * below[positive].mean())
    pull = np.where(positive, -prior * s / n_pos, s / n_unl)  # of the negative risk
    push = np.where(positive, -prior * (1 - s) / n_pos, 0.0)  # of the positive risk
    return above, negative, push + pull if negative >= 0 else -pull


def _descend(rows: np.ndarray, places: np.ndarray, n: int, k: int, positive: np.ndarray, prior: float, steps: int, rate: float, decay: float, weights: np.ndarray, bias: float) -> tuple[np.ndarray, float]:
    """Full-batch Adam on the non-negative risk."""
    first, second = np.zeros(k + 1), np.zeros(k + 1)
    for t in range(1, steps + 1):
        _, _, d = risk(np.bincount(rows, weights=weights[places], minlength=n) + bias, positive, prior)
        gradient = np.append(np.bincount(places, weights=d[rows], minlength=k) + decay * weights, d.sum())
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        step = rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
        weights, bias = weights - step[:-1], bias - step[-1]
    return weights, float(bias)


def fit(documents: list[np.ndarray], positive: np.ndarray, prior: float, chosen: list[int], steps: int = 400, rate: float = 0.05, decay: float = 1e-3) -> Model:
    """The model of ``documents``, each the places in ``chosen`` of its features, of which some are confirmed positives.

    Without positives, unlabelled rows or features nothing is learnt.
    """
    n_pos, n_unl = int(positive.sum()), int((~positive).sum())
    if not n_pos or not n_unl or not chosen or not 0 < prior < 1:
        return Model()
    rows = np.repeat(np.arange(len(documents)), [len(d) for d in documents])
    places = np.concatenate(documents).astype(np.int64)
    start = np.full(len(chosen), 2.0)
    weights, bias = _descend(rows, places, len(documents), len(chosen), positive, prior, steps, rate, decay, start, float(np.log(prior / (1 - prior))))
    return Model(bias, dict(zip(chosen, weights.tolist())))


def held_out(doc_id: Column) -> Column:
    """Rows that the labels are never learnt from: crc32 of the doc_id as text, modulo 5, is 0 (false for a null)."""
    return F.coalesce(F.crc32(doc_id.cast("long").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED, seed: int = 7) -> Model:
    """The model of ``docs(doc_id, text)`` and ``labels(doc_id, toxic)``, from rows that are not held out.

    Features that do not come clearly more often in the positives than in the
    unlabelled rows get no weight; without labels, positives or documents every
    score is about 0.

    The class prior is the share of 1 among the labels used. The sample is
    bounded by the two parameters (in expectation); the rows are chosen by
    hashes of their ids, and of rows with one doc_id one is used.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select(F.col("doc_id").cast("long").alias("doc_id"), "toxic")
    counts = known.agg(F.count("*"), F.count_if(F.col("toxic") == 1)).first()
    others = docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select(F.col("doc_id").cast("long").alias("doc_id"))
    total = others.count()
    if not counts[1] or not total:
        return Model()

    def drawn(rows: DataFrame, most: int, of: int, salt: int) -> DataFrame:
        scale = 1 << 40
        return rows.where(F.pmod(F.xxhash64("doc_id", F.lit(seed + salt)), F.lit(scale)) < min(scale, scale * most // of))

    positives = drawn(known.where("toxic = 1").select("doc_id").distinct(), max_positive, counts[1], 0).withColumn("positive", F.lit(True))
    unlabelled = drawn(others, max_unlabelled, total, 1).distinct().withColumn("positive", F.lit(False))
    chosen = positives.unionByName(unlabelled)

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: dict[bytes, tuple[int, ...]] = {}
        for batch in batches:
            found = []
            for text in batch.column(2).to_pylist():
                own: set[int] = set()
                for word in words_of(text):
                    f = table.get(word)
                    if f is None:
                        f = table[word] = features_of(word)
                    own.update(f)
                found.append(np.array(sorted(own), "<i4").tobytes())
                if len(table) > WORDS:
                    table.clear()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], ["doc_id", "positive", "features"])
        table.clear()
        release_memory()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides: dict[bool, list[np.ndarray]] = {True: [np.zeros(0, "<i4")], False: [np.zeros(0, "<i4")]}
            for p, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sides[p].append(np.frombuffer(b, "<i4"))
            for p, parts in sides.items():
                f, n = np.unique(np.concatenate(parts), return_counts=True)
                zero = np.zeros(len(f), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(f.astype(np.int64)), pa.array(n if p else zero), pa.array(zero if p else n)], ["feature", "pos", "unl"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sample = written(texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "positive", "text").mapInArrow(featured, "doc_id long, positive boolean, features binary").groupBy("doc_id", "positive").agg(F.min("features").alias("features")), "sample")
    sizes = sample.agg(F.count_if("positive"), F.count_if(~F.col("positive"))).first()
    if not sizes[0] or not sizes[1]:
        return Model()
    prior = counts[1] / counts[0]
    # features that come clearly more often in the positives than in the unlabelled rows
    sums = sample.select("positive", "features").mapInArrow(counted, "feature long, pos long, unl long").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("unl").alias("unl"))
    sums = sums.withColumn("expected", F.col("unl") * (sizes[0] / sizes[1])).withColumn("surplus", (F.col("pos") - F.col("expected")) / F.sqrt(F.col("expected") + 1))
    ratio = 1 / (4 * prior) if prior < 0.2 else 1.5
    sums = sums.where((F.col("pos") >= 3) & (F.col("surplus") >= 3.5) & (F.col("pos") >= ratio * F.col("expected")))
    kept = sorted(r["feature"] for r in sums.select("feature").collect())  # features of the bounded sample, fewer than SPACE
    known_features = np.array(kept, np.int64)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = []
            for b in batch.column(2).to_pylist():
                f = np.frombuffer(b, "<i4")
                at = np.searchsorted(known_features, f)
                at[at == len(known_features)] = 0
                places.append((at[known_features[at] == f] if len(known_features) else at[:0]).astype("<i4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(places, pa.binary())], ["doc_id", "positive", "places"])

    rows = sample.mapInArrow(placed, "doc_id long, positive boolean, places binary").toPandas().sort_values(["doc_id", "positive"], kind="stable")
    return fit([np.frombuffer(b, "<i4") for b in rows["places"]], rows["positive"].to_numpy(bool), prior, kept)


def _scored(docs: DataFrame, model: Model, names: Sequence[str]) -> DataFrame:
    """``score``, and ``names`` as k_0, k_1 ..."""
    rows, fields = columns.carried(docs, names)
    kept = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, tuple[int, ...]] = {}
        for batch in batches:
            for first in range(0, batch.num_rows, 1024):
                part = batch.slice(first, 1024)
                scores = pa.array(model.scores(part.column(0).to_pylist(), known), pa.float64())
                yield pa.RecordBatch.from_arrays([scores, *part.columns[1:]], ["score", *kept])
        known.clear()
        release_memory()

    return rows.select("text", *kept).mapInArrow(run, columns.schema("score double", fields))


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` -> ``(score, *keep)`` with the score in 0..1 of each whole text.

    Null and empty texts are scored by the bias alone, UNKNOWN at most; equal texts alike; an
    empty table gives no rows; ``keep`` may not hold ``score``.
    """
    columns.clash(["score"], keep)
    return columns.returned(_scored(docs, model, keep), ["score"], keep)


def without_toxic(docs: DataFrame, model: Model, limit: float = 0.5) -> DataFrame:
    """The rows of ``docs`` scored below ``limit``, all columns as they are, whatever their names."""
    return columns.returned(_scored(docs, model, docs.columns).where(F.col("score") < limit), [], docs.columns)
