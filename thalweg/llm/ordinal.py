"""Quality classifier: cumulative-link (proportional odds) regression on graded ratings.

A text is the set of its words; each word gives hashed features (the word and two of its openings) and
the text a few more for repetition and symbols. One weight vector is shared by all grades; ordered
thresholds turn the score into P(grade <= k). The expected grade ranks, the tail probability
P(grade >= KEEP_GRADE) selects.

Grades from `labels`: 0 toxic, 1 poor but not toxic, 2 good and not toxic. The model is fitted on the
driver on at most SAMPLE labelled rows (the smallest hashes of doc_id, so the choice is stable and does
not follow the table's order); what reaches the driver are the numbers of the telling features of these texts.
Scoring reads whole texts as well.

Null or empty text: the features of an empty text. No labelled row, or one grade only: nothing is known,
expected grade and probability are null and every document is kept. Repeated rows and ids: a row each (a
document labelled twice counts twice); in fitting, equal rows are one with their number as its weight, while rows
of a labelled doc_id whose texts differ all take part, so many of these are more for the driver. Empty table: empty result. Null labels are left out. Ties: equal
probabilities get equal verdicts. Very long texts: whole, in fitting and in scoring. Given columns named
expected_grade, p_keep or kept are replaced by `classify` and stay in `keep`; all others stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, limit_batches

BITS = 18
SAMPLE = 6000
GRADES = 3
KEEP_GRADE = 2
KEEP_ODDS = 0.6
LEAST_TEXTS = 3
LEAST_Z = 3.0
STEPS = 250
RATE = 0.15
SHRINK = 1e-5
WORDS_KEPT = 150_000
SYMBOLS = "#*$%&|<>"
EDGE = re.compile(r"^\W+|\W+$")


def _bucket(x: str) -> int:
    return xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass")) >> 64 - BITS


def word_features(raw: str) -> tuple[int, int, int]:
    w = EDGE.sub("", raw) or raw
    return _bucket(w), _bucket("^" + w[:4]), _bucket("^" + w[:6])


def marks(words: list[str], distinct: int, symbols: int) -> list[int]:
    """Features of the text as a whole, in steps."""
    n = len(words)
    again = sum(map(eq, words, words[1:]))
    step = lambda x: min(8, int(20 * x / max(1, n)))
    return [_bucket(f"\\x00{k}{v}") for k,
        v in (("n", min(n, 1 << 14).bit_length() if n < 16 else 5), ("again", step(again)), ("symbol", step(symbols)),
            ("distinct", min(9, 10 * distinct // max(1, n)) if n < 400 else 10))]


def split(text: str) -> tuple[list[str], set[str], list[int]]:
    words = text.lower().split()
    some = set(words)
    return words, some, marks(words, len(some), sum(map(text.count, SYMBOLS)))


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray  # rising, one fewer than the grades

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1 and up."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -40, 40)))


def _telling(hits: np.ndarray, grades: np.ndarray) -> np.ndarray:
    """Features in LEAST_TEXTS texts or more whose share in a grade is at least LEAST_Z standard errors off.

    hits: texts of each grade (a row) that a feature stands in; grades: how many texts have each grade.
    """
    n, seen = grades.sum(), hits.sum(axis=0)
    out = np.zeros(hits.shape[1], bool)
    for k, share in enumerate(grades / n):
        # the variance of a share allows for overlap between the seen texts and all texts
        out |= np.abs(hits[k] - share * seen) >= LEAST_Z * np.sqrt(np.maximum(share * (1 - share) * seen * (1 - seen / n), 1e-9))
    return out & (seen >= LEAST_TEXTS)


def fit(
        y: np.ndarray, sizes: np.ndarray, marked: np.ndarray, cols: np.ndarray, counts: np.ndarray,
        times: np.ndarray | None = None) -> Model | None:
    """Full-batch Adam on the cumulative-link likelihood.

    y: grades; cols, counts: the texts' features one text after another, each feature once a text, and how
    often it stands there (0 for a mark); sizes: word features of each text with repeats; marked: features
    of each text; times: how many rows each text stands for (one, if not given). Arrays as long as the features are kept to a few of 32 bits.
    """
    if len(np.unique(y)) < 2:
        return None
    texts = len(y)
    times = np.ones(texts) if times is None else times.astype(float)
    n = times.sum()
    row = np.repeat(np.arange(texts, dtype=np.int32), marked)
    grade = y[row]
    hits = np.stack([np.bincount(cols[grade == k], weights=times[row[grade == k]], minlength=1 << BITS) for k in range(GRADES)])
    keep = _telling(hits, np.bincount(y, weights=times, minlength=GRADES))[cols]
    cols, row, counts = cols[keep], row[keep], counts[keep]
    used, cols = np.unique(cols, return_inverse=True)  # the weights of all others stay 0
    value = np.where(counts == 0, 1.0, counts / np.sqrt(np.maximum(1, sizes))[row])
    counts = np.array([np.clip(times[y <= k].sum() / n, 0.01 * (k + 1), 0.98 + 0.005 * k) for k in range(GRADES - 1)])
    base = np.log(counts / (1 - counts))
    t = np.concatenate(([base[0]], np.log(np.maximum(np.diff(base), 1e-2))))  # first threshold, then logs of the gaps
    w = np.zeros(len(used))
    m1, m2, u1, u2 = np.zeros_like(w), np.zeros_like(w), np.zeros_like(t), np.zeros_like(t)
    for step in range(1, STEPS + 1):
        th = np.concatenate(([-np.inf], np.cumsum(np.concatenate(([t[0]], np.exp(t[1:])))), [np.inf]))
        s = np.bincount(row, weights=value * w[cols], minlength=texts)
        with np.errstate(over="ignore"):
            hi, lo = 1 / (1 + np.exp(s - th[y + 1])), 1 / (1 + np.exp(s - th[y]))
        p = np.maximum(hi - lo, 1e-9)
        dhi, dlo = hi * (1 - hi) / p, lo * (1 - lo) / p
        dhi, dlo = times * dhi, times * dlo
        ds = (dhi - dlo) / n  # of the loss by the score
        g = np.bincount(cols, weights=value * ds[row], minlength=len(used)) + SHRINK * w
        dth = np.array([(-dhi[y == k].sum() + dlo[y == k + 1].sum()) / n for k in range(GRADES - 1)])
        after = dth[::-1].cumsum()[::-1]
        gt = np.concatenate(([after[0]], after[1:] * np.exp(t[1:])))
        for x, grad, a, b in ((w, g, m1, m2), (t, gt, u1, u2)):
            a *= 0.9
            a += 0.1 * grad
            b *= 0.99
            b += 0.01 * grad * grad
            x -= RATE * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-7)
    weights = np.zeros(1 << BITS, np.float32)
    weights[used] = w
    return Model(weights, np.cumsum(np.concatenate(([t[0]], np.exp(t[1:])))))


def features(text: str) -> tuple[int, np.ndarray, np.ndarray]:
    """Word features with repeats, and the text's features, each once, with their counts (0 for marks)."""
    _, some, m = split(text)
    f, c = np.unique(np.array([word_features(w) for w in some], np.int32).reshape(-1), return_counts=True)
    extra = np.setdiff1d(np.array(m, np.int32), f)
    return 3 * len(some), np.concatenate((f, extra)), np.concatenate((c, np.zeros(len(extra)))).astype(np.int32)


FEATURES = ["id", "grade", "times", "n", "f", "c"]
FEATURE_ROWS = "id long, grade int, times long, n int, f array<int>, c array<int>"


def _training(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        got = [features(t.as_py() or "") for t in b.column(3)]
        yield pa.RecordBatch.from_arrays(
            [*b.columns[:3], pa.array([n for n, _, _ in got], pa.int32()),
                pa.array([f for _, f, _ in got], pa.list_(pa.int32())),
                pa.array([c for _, _, c in got], pa.list_(pa.int32()))], names=FEATURES)


def graded(labels: DataFrame) -> DataFrame:
    """(doc_id, grade) of the labelled rows."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 1, 2).otherwise(1)
    return labels.filter(
        F.col("toxic").isNotNull() & F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).select(
        F.col("doc_id").alias("_id"), grade.alias("_grade"))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    chosen = graded(labels).orderBy(F.xxhash64("_id"), "_id", "_grade").limit(sample).groupBy("_id", "_grade").agg(F.count("*").alias("_labels"))
    limit_batches(docs.sparkSession)
    # The broadcast side has at most `sample` rows of three numbers. A labelled doc_id may have any number of rows: equal ones become one.
    rows = Scratch(docs.sparkSession).keep(
        docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).groupBy("_id", "_grade", "text").agg(
            F.sum("_labels").alias("_times")).select("_id", "_grade", "_times", "text").mapInArrow(_training, FEATURE_ROWS), "features")
    # Which features tell the grades apart is counted in Spark; the driver gets a row for each feature, then only the telling ones of each text.
    of = [F.sum(F.when(F.col("grade") == k, F.col("times")).otherwise(0)).alias(f"g{k}") for k in range(GRADES)]
    counts = rows.select("grade", "times", F.explode("f").alias("f")).groupBy("f").agg(*of).toArrow()
    hits = np.zeros((GRADES, 1 << BITS), np.int64)
    for k in range(GRADES):
        hits[k, counts["f"].to_numpy()] = counts[f"g{k}"].to_numpy()
    total = rows.agg(*of).first()
    telling = _telling(hits, np.array([total[f"g{k}"] for k in range(GRADES)])) if any(total) else np.zeros(1 << BITS, bool)

    def only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f, c = ([np.asarray(x, np.int32) for x in col.to_pylist()] for col in (b.column(4), b.column(5)))
            told = [telling[x] for x in f]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:4], *(pa.array([x[t] for x, t in zip(col, told)], pa.list_(pa.int32())) for col in (f, c))], names=FEATURES)

    # In one order, so that the sums, and so the model, are the same every time.
    got = rows.mapInArrow(only, FEATURE_ROWS).orderBy("id", "grade", "n", F.xxhash64("f")).select("grade", "n", "f", "c", "times").toArrow()
    flat = lambda k: np.concatenate(
        [x.values.to_numpy()[x.offsets[0].as_py():x.offsets[-1].as_py()] for x in got.column(k).chunks] or [np.empty(
            0, np.int32)])
    lengths = got.column(2).combine_chunks().value_lengths().to_numpy() if got.num_rows else np.empty(0, np.int32)
    return fit(got.column(0).to_numpy(), got.column(1).to_numpy(), lengths, flat(2), flat(3), got.column(4).to_numpy())


class Scorer:
    """Scores of texts, the sums of words' weights kept in a bounded table."""

    def __init__(self, model: Model):
        self.model, self.known = model, {}

    def __call__(self, text: str) -> float:
        _, some, m = split(text)
        known, w, total = self.known, self.model.weights, 0.0
        for x in some:
            v = known.get(x)
            if v is None:
                a, b, c = word_features(x)
                v = float(w[a]) + float(w[b]) + float(w[c])
                if len(known) < WORDS_KEPT and len(x) <= 64:
                    known[x] = v
            total += v
        return total / max(1, 3 * len(some)) ** 0.5 + float(w[m].sum())


@lru_cache(maxsize=2)
def _scorer(weights: bytes, thresholds: bytes) -> Scorer:
    return Scorer(Model(np.frombuffer(weights, np.float32), np.frombuffer(thresholds, np.float64)))


EXTRA = (("expected_grade", pa.float64()), ("p_keep", pa.float64()), ("kept", pa.bool_()))


def _apply(docs: DataFrame, model: Model | None, only_kept: bool) -> DataFrame:
    """The given rows with the classifier's columns, or only the rows it keeps, unchanged."""
    blobs = None if model is None else (model.weights.tobytes(), model.thresholds.tobytes())
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = None if blobs is None else _scorer(*blobs)
        for b in batches:
            if score is None:
                grade = p = [None] * b.num_rows
                kept = [True] * b.num_rows
            else:
                tails = score.model.tails(np.array([score(t.as_py() or "") for t in b.column(at)]))
                grade, p = tails.sum(axis=1), tails[:, KEEP_GRADE - 1]
                kept = p >= KEEP_ODDS
            if only_kept:
                yield b.filter(pa.array(kept, pa.bool_()))
            else:
                new = [pa.array(c, t) for c, (_, t) in zip((grade, p, kept), EXTRA, strict=True)]
                yield pa.RecordBatch.from_arrays([*b.columns, *new], names=[*b.schema.names, *(n for n, _ in EXTRA)])

    limit_batches(docs.sparkSession)
    schema = T.StructType(list(docs.schema.fields))
    if not only_kept:
        for name, kind in zip((n for n, _ in EXTRA), ("double", "double", "boolean"), strict=True):
            schema = schema.add(name, kind)
    return docs.mapInArrow(run, schema)


def classify(docs: DataFrame, model: Model | None) -> DataFrame:
    return _apply(docs.drop(*(n for n, _ in EXTRA)), model, False)


def keep(docs: DataFrame, model: Model | None) -> DataFrame:
    return _apply(docs, model, True)


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The query's columns."""
    return classify(docs.select("doc_id", "text"), train(docs, labels)).drop("text")
