"""A quality classifier trained on weak labels.

Heuristic labellers overlap and disagree; expectation-maximisation over their votes on the whole corpus
estimates how accurate each is, and gives every document a posterior label. A bounded sample of posterior
labels trains a linear scorer over hashed features: word forms, endings, shapes and how often things are
repeated. The scorer then reads every document; unlike the labellers it weighs all of the text's words.

Documents are read three times and never shuffled: for the votes, for the texts of the sample, and for the
result, where a text is measured again and its pattern of votes, broadcast with at most 3 to the power of
the labellers, gives its label. So any number of copies of one text stay where they are.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseflow.llm.common import stored, table, texts
from caseflow.llm.quality_rules import measured, pattern_probabilities, with_verdicts

#: Documents that the scorer is trained on, at most; those of least hash.
TRAINING_ROWS = 5000
#: Hashed features.
BITS = 14
STEPS, RATE, PENALTY = 150, 0.3, 1e-4
_SHAPES = bytes(
    ord("X") if 65 <= b <= 90 else ord("x") if 97 <= b <= 122 or b >= 128 else ord("0") if 48 <= b <= 57 else b
    for b in range(256)
)


def _bucket(name: bytes) -> int:
    return zlib.crc32(name) >> (32 - BITS)


def word_features(word: bytes) -> tuple[int, int, int]:
    """The form, the last two bytes, and the shape of a word, equal letters in a row counted once."""
    shape, last = bytearray(), -1
    for byte in word.translate(_SHAPES):
        if byte != last:
            shape.append(byte)
        last = byte
    return _bucket(b"w " + word.lower()), _bucket(b"e " + word[-2:]), _bucket(b"s " + bytes(shape))


def text_features(words: list[bytes], text: bytes) -> list[int]:
    """Features of a whole text: length, and shares in tenths of distinct and repeated things."""
    n = max(1, len(words))
    lines = [line for line in text.split(b"\n") if line.strip()]
    again = sum(a == b for a, b in zip(words, words[1:], strict=False))
    return [
        _bucket(b"n %d" % len(words).bit_length()),
        _bucket(b"d %d" % (10 * len(set(words)) // n)),
        _bucket(b"l %d" % (10 * (len(lines) - len(set(lines))) // max(1, len(lines)))),
        _bucket(b"a %d" % (10 * again // n)),
        _bucket(b"bias"),
    ]


class Scorer:
    """Scores texts with the weights of the hashed features; sums are kept by word."""

    def __init__(self, weights: np.ndarray) -> None:
        self.weights = weights
        self.known: dict[bytes, float] = {}

    def score(self, text: str | None) -> float:
        """Probability of good, also of a text without words."""
        raw = (text or "").encode("utf-8", "surrogatepass")
        words = raw.split()
        if len(self.known) > 400_000:
            self.known.clear()
        known, weights = self.known, self.weights
        for word in {word for word in words if word not in known}:
            known[word] = float(weights[list(word_features(word))].sum())
        total = sum([known[word] for word in words]) / max(1, len(words))
        total += float(weights[text_features(words, raw)].sum())
        return float(1 / (1 + np.exp(-np.clip(total, -30, 30))))


def trained(sample: list[tuple[str, float]]) -> np.ndarray:
    """Weights by gradient descent on the logistic loss of posterior labels."""
    size = 1 << BITS
    weights = np.zeros(size)
    if not sample:
        return weights
    rows, columns, values = [], [], []
    for row, (text, _) in enumerate(sample):
        raw = (text or "").encode("utf-8", "surrogatepass")
        words = raw.split()
        counts: dict[int, float] = dict.fromkeys(text_features(words, raw), 1.0)
        for word in words:
            for at in word_features(word):
                counts[at] = counts.get(at, 0.0) + 1 / len(words)
        rows.append(np.full(len(counts), row))
        columns.append(np.fromiter(counts, np.int64, len(counts)))
        values.append(np.fromiter(counts.values(), float, len(counts)))
    row, column, value = map(np.concatenate, (rows, columns, values))
    wanted = np.asarray([label for _, label in sample])
    # The rarer class weighs as much as the other, within bounds, whatever their shares.
    share = float(np.clip(wanted.mean(), 0.05, 0.95))
    weigh = wanted / share + (1 - wanted) / (1 - share)
    first, second = np.zeros(size), np.zeros(size)
    for step in range(1, STEPS + 1):
        chance = 1 / (1 + np.exp(-np.clip(np.bincount(row, value * weights[column], len(sample)), -30, 30)))
        wrong = (chance - wanted) * weigh / (2 * len(sample))
        slope = np.bincount(column, value * wrong[row], size) + PENALTY * weights
        first = 0.9 * first + 0.1 * slope
        second = 0.999 * second + 0.001 * slope**2
        weights -= RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return weights


def learn(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> np.ndarray:
    """Weights from at most ``rows`` documents of different texts; one task trains them."""
    sample = labels.dropDuplicates(["key"]).orderBy("key").limit(rows).select("key", "label")
    joined = docs.join(F.broadcast(sample), "key").dropDuplicates(["key"]).select("text", "label")

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pairs = [p for b in batches for p in zip(b["text"], b["label"], strict=True)]
        yield pd.DataFrame({"weights": [trained(sorted(pairs)).astype("<f4").tobytes()]})

    row = joined.coalesce(1).mapInPandas(fit, "weights binary").first()
    return np.frombuffer(row["weights"], "<f4").astype(float) if row else np.zeros(1 << BITS)


def classified(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """(doc_id, label, score, kept) for each document.

    ``label`` is the posterior of the labellers, ``score`` the scorer's probability of good, and ``kept``
    whether that is at least one half. A null text counts as empty and is scored like any other; a text of
    any length is read whole. Repeated rows are scored each alike; a null id stays null; an empty table gives no rows; further
    columns are ignored.
    """
    # Texts alone decide: equal texts have one key.
    rows = texts(docs, text_column=text_column).withColumn("key", F.xxhash64("text"))
    measures = stored(rows.select("key", measured(F.col("text")).alias("quality")))
    known = pattern_probabilities(measures)
    labels = with_verdicts(measures, known).select("key", F.col("probability").alias("label"))
    sent = docs.sparkSession.sparkContext.broadcast(learn(rows, labels))
    made: list[Scorer] = []

    def score(batch: pd.Series) -> pd.Series:
        if not made:
            made.append(Scorer(sent.value))
        return pd.Series([made[0].score(text) for text in batch])

    scored = rows.select(
        "doc_id", measured(F.col("text")).alias("quality"), F.pandas_udf(score, "double")("text").alias("score")
    )
    return with_verdicts(scored, known).select(
        "doc_id", F.col("probability").alias("label"), "score", (F.col("score") >= 0.5).alias("kept")
    )


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified(table(spark, sf_dir, "documents")).select(
        "doc_id", F.round("label", 6).alias("label"), F.round("score", 6).alias("score"), "kept"
    )
