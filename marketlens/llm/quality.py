"""Quality classifier from weak labels.

Heuristic labellers vote good, bad or nothing on every document. Expectation-maximisation
over the counts of vote patterns, which cover all documents and number at most 3 to the power of the labellers,
estimates each labeller's accuracies and the share of good documents. The posterior of a document's pattern is its label:
a linear scorer over hashed shapes of words learns from them and scores every document.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType

from marketlens.llm.common import bounded_batches, whole_text
from marketlens.sources.scratch import materialise

HASHED = 1 << 12
# The scorer is fitted on about so many documents, those with the smallest hashes of id and text.
TRAINING_ROWS = 20_000
# Rounds of expectation-maximisation at most; it ends when no posterior changes by more than the tolerance.
ROUNDS = 200
TOLERANCE = 1e-9
# Documents are kept from this score on.
MIN_SCORE = 0.5
# Shapes remembered by a Python worker.
MAX_SHAPES = 200_000

# Capitals, small letters (and all that is not ASCII) and digits become one character each; marks stay.
_SHAPE = bytes(
    ord("A") if chr(b).isupper() and b < 128 else ord("a") if b >= 128 or chr(b).islower() else ord("0") if chr(b).isdigit() else b
    for b in range(256)
)
_RUNS = re.compile(rb"([aA0])\1+")
_PLAIN = re.compile(rb"[aA'-]+[.,;:!?]?")
_LETTERS = np.array([_SHAPE[b] in b"aA" and not 0x80 <= b < 0xC0 for b in range(256)])
_UPPER = np.array([_SHAPE[b] == ord("A") for b in range(256)])
_SYMBOLS = np.isin(np.arange(256), list(b"#$%&*|~^<>{}=_\\@"))
_MARKS = np.isin(np.arange(256), list(b"|!"))

# Measures between 0 and 1 of which the scorer is told beside the hashed shapes.
MEASURES = ("symbols", "upper", "marks", "plain", "variety", "adjacent", "length")


class Reader:
    """Measures and hashed shapes of texts; remembers the shapes of words."""

    def __init__(self):
        self.codes: dict[bytes, int] = {}
        self.buckets: list[int] = []
        self.plain: list[bool] = []

    def _code(self, shape: bytes) -> int:
        code = self.codes.get(shape)
        if code is None:
            code = self.codes[shape] = len(self.buckets)
            self.buckets.append(zlib.crc32(_RUNS.sub(rb"\1", shape)) % HASHED)
            self.plain.append(_PLAIN.fullmatch(shape) is not None)
        return code

    def __call__(self, text: str) -> tuple[int, np.ndarray, np.ndarray]:
        """(number of words, measures, counts per hash bucket scaled to length 1)."""
        if len(self.codes) > MAX_SHAPES:
            self.__init__()
        raw = text.encode("utf-8", "surrogatepass")
        words = raw.lower().split()
        n = len(words)
        if not n:
            return 0, np.zeros(len(MEASURES)), np.zeros(HASHED)
        codes = np.fromiter(map(self._code, raw.translate(_SHAPE).split()), dtype=np.int64, count=n)
        used, times = np.unique(codes, return_counts=True)
        hashed = np.bincount([self.buckets[c] for c in used.tolist()], weights=times, minlength=HASHED)
        plain = sum(t for c, t in zip(used.tolist(), times.tolist()) if self.plain[c])
        seen = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
        letters = int(seen[_LETTERS].sum())
        values = [
            seen[_SYMBOLS].sum() / len(text),
            seen[_UPPER].sum() / max(letters, 1),
            min(seen[_MARKS].sum() / n, 1.0),
            plain / n,
            # Long texts repeat words by nature: what counts as varied grows with the square root of the length.
            len(set(words)) / min(n, 6 * n**0.5),
            sum(map(eq, words, words[1:])) / n,
            min(letters / n / 20, 1.0),
        ]
        return n, np.minimum(values, 1.0), hashed / np.sqrt((hashed * hashed).sum())


def votes(words: int, measures: np.ndarray) -> list[int]:
    """One vote per labeller: 1 good, 0 bad, -1 none. Short texts give too little to judge most by."""
    symbols, upper, marks, plain, variety, adjacent, length = measures
    bad_from = (
        (3, symbols > 0.03),
        (8, upper > 0.2),
        (8, marks > 0.1),
        (16, plain < 0.75),
        (20, variety < 0.55),
        (8, adjacent > 0.08),
        (8, length < 0.1 or length > 0.7),
    )
    return [-1 if words < least else int(not bad) for least, bad in bad_from]


class LabelModel:
    """Share of good documents and, per labeller, the chances of its votes (bad, good) given the class (bad, good)."""

    def __init__(self, patterns: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS):
        """``patterns`` has a row of votes for each of ``counts``."""
        self.patterns = patterns
        # Where to begin: every bad vote makes a document three times less likely to be good.
        self.posterior = 0.95 / 3.0 ** (patterns == 0).sum(axis=1)
        total = counts.sum()
        self.rounds = 0
        for self.rounds in range(1, (rounds if total else 0) + 1):
            before = self.posterior
            weights = np.stack([counts * (1 - self.posterior), counts * self.posterior])
            self.share = (weights[1].sum() + 1) / (total + 2)
            # Smoothed towards better than chance, so that classes cannot swap.
            self.chances = np.empty((2, patterns.shape[1], 2))
            for kind in (0, 1):
                for value in (0, 1):
                    seen = weights[kind] @ (patterns == value)
                    self.chances[kind, :, value] = seen + (0.8 if kind == value else 0.2)
                self.chances[kind] /= self.chances[kind].sum(axis=1, keepdims=True)
            self.posterior = self._posterior()
            if np.abs(self.posterior - before).max() <= TOLERANCE:
                break

    def _posterior(self) -> np.ndarray:
        logs = np.log([1 - self.share, self.share])[:, None] + np.zeros(len(self.patterns))
        for labeller in range(self.patterns.shape[1]):
            vote = self.patterns[:, labeller]
            for kind in (0, 1):
                logs[kind] += np.where(vote >= 0, np.log(self.chances[kind, labeller, vote.clip(0)]), 0.0)
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -60, 60)))


@F.pandas_udf(ArrayType(IntegerType()))
def _votes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    reader = Reader()
    for texts in batches:
        yield pd.Series([votes(*reader(text)[:2]) for text in texts], dtype=object)


_READER: list[Reader] = []


@F.udf(VectorUDT())
def _vector(text: str) -> SparseVector:
    """Only for the training rows, a bounded number: their features as a vector, which Arrow functions cannot return."""
    if not _READER:
        # Kept by the worker, with the shapes it has seen.
        _READER.append(Reader())
    _, measures, hashed = _READER[0](text)
    whole = np.concatenate([hashed, measures])
    at = np.flatnonzero(whole)
    return SparseVector(len(whole), at, whole[at])


class Scorer:
    """A fitted linear scorer: one weight per feature and a constant."""

    def __init__(self, weights: np.ndarray, constant: float):
        self.weights = weights
        self.constant = constant

    def column(self, text: Column) -> Column:
        """The chance that a text is good."""
        weights, constant = self.weights, self.constant

        @F.pandas_udf(DoubleType())
        def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            reader = Reader()
            for texts in batches:
                found = [reader(text)[1:] for text in texts]
                sums = [hashed @ weights[:HASHED] + measures @ weights[HASHED:] for measures, hashed in found]
                yield pd.Series(1 / (1 + np.exp(-np.clip(np.asarray(sums, dtype=float) + constant, -60, 60))))

        return score(text)


def fit(docs: DataFrame) -> tuple[LabelModel, Scorer]:
    """The label model over all of ``docs`` (doc_id, text) and the scorer on about ``TRAINING_ROWS`` of them.

    An empty table gives a scorer that says 1/2.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    text = whole_text()
    voted = materialise(docs.select(F.xxhash64("doc_id", text).alias("_hash"), _votes(text).alias("_votes")))
    found = voted.groupBy("_votes").agg(F.count(F.lit(1)).alias("n")).orderBy("_votes").collect()
    patterns = np.asarray([row["_votes"] for row in found], dtype=np.int64).reshape(len(found), len(MEASURES))
    labels = LabelModel(patterns, np.asarray([row["n"] for row in found], dtype=np.float64))
    if not found:
        return labels, Scorer(np.zeros(HASHED + len(MEASURES)), 0.0)
    # One row per pattern, bounded by the number of labellers.
    known = spark.createDataFrame(
        [(row["_votes"], float(p)) for row, p in zip(found, labels.posterior)], "_pattern array<int>, _good double"
    )
    # Hashes are spread evenly, so a bound on them takes a share of the rows; copies of a row count once.
    share = min(1.0, TRAINING_ROWS / sum(row["n"] for row in found))
    bound = min(int(-(2**63) + share * 2**64), 2**63 - 1)
    chosen = docs.select(F.xxhash64("doc_id", text).alias("_hash"), text.alias("_text")).where(F.col("_hash") <= bound)
    sample = chosen.groupBy("_hash").agg(F.min("_text").alias("_text"))
    # Written before the vectors are made: two Python functions in one stage would take two workers per task.
    soft = materialise(sample.withColumn("_pattern", _votes(F.col("_text")))).join(F.broadcast(known), "_pattern")
    # A soft label is two weighted rows.
    classes = F.array(
        F.struct(F.lit(1.0).alias("label"), F.col("_good").alias("weight")),
        F.struct(F.lit(0.0).alias("label"), (1 - F.col("_good")).alias("weight")),
    )
    weighted = materialise(
        soft.select(_vector("_text").alias("features"), "_good").select("features", F.explode(classes).alias("_row")).select("features", "_row.*")
    )
    model = LogisticRegression(weightCol="weight", regParam=1e-4, maxIter=40).fit(weighted.where("weight > 0"))
    return labels, Scorer(model.coefficients.toArray(), float(model.intercept))


def score(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_score``, the chance that a document is good, and ``_kept``.

    Both models are fitted on ``docs`` itself. Null texts count as empty; empty and very short texts get few votes
    and mostly the prior's score. Repeated rows get equal scores.
    """
    _, scorer = fit(docs)
    scored = docs.withColumn("_score", scorer.column(whole_text()))
    return scored.withColumn("_kept", F.col("_score") >= MIN_SCORE)


def keep_good(docs: DataFrame) -> DataFrame:
    """``docs`` without those the classifier rejects; columns unchanged."""
    _, scorer = fit(docs)
    return docs.where(scorer.column(whole_text()) >= MIN_SCORE)
