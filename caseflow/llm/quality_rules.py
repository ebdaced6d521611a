"""Quality rules as weak supervision.

Each rule votes good, votes bad or abstains on a document. Expectation-maximisation estimates the
accuracy of every rule from agreements alone, and the posterior probability of "good" replaces the
demand that every rule passes. The estimation needs only the number of documents with each pattern of
votes: at most 3 to the power of the number of rules, however many documents there are.
"""

from __future__ import annotations

import itertools
import string
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseflow.llm.common import SPACES, stored, table

SYMBOLS = "#*$%&|<>"
#: Bytes of a plain word: letters, any byte of a non-ASCII character, marks within or after a word.
PLAIN = string.ascii_letters.encode() + bytes(range(128, 256)) + b".,;:!?'-"
FEATURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_distinct", "n_upper", "n_letters", "n_plain", "n_marked",
)

_SYMBOL_BYTES = SYMBOLS.encode()


def repeated_words(ids: np.ndarray, distinct: int) -> int:
    """Words covered by a 3-word window that occurs twice or more, first occurrence included."""
    if len(ids) < 4:
        return 0
    pairs = ids[:-2] * distinct + ids[1:-1]
    if distinct > 2_000_000:  # three factors would pass 63 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
        keys = pairs * distinct + ids[2:]
    else:
        keys = pairs * distinct + ids[2:]
    order = np.sort(keys)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    twice = np.unique(twice)
    at = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
    starts = twice[at] == keys
    covered = np.zeros(len(ids), bool)
    for shift in range(3):
        covered[shift : len(ids) - 2 + shift] |= starts
    return int(covered.sum())


def measures(text: str | None) -> tuple[int, ...]:
    """The columns of ``FEATURES`` for one text; all zero for None and the empty text."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes split on exactly the six ASCII spaces
    index: dict[bytes, int] = {}
    ids = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, len(words))
    times = np.bincount(ids, minlength=len(index))
    plain = np.fromiter((not w.translate(None, PLAIN) for w in index), bool, len(index))
    marked = np.fromiter((w[-1] in _SYMBOL_BYTES for w in index), bool, len(index))
    lines = [line for line in raw.split(b"\n") if line.strip()]
    octets = np.frombuffer(raw, np.uint8)
    upper = int(((octets >= 65) & (octets <= 90)).sum())
    lower = int(((octets >= 97) & (octets <= 122)).sum())
    return (
        len(words),
        len(text) - sum(text.count(c) for c in SPACES),
        sum(text.count(c) for c in SYMBOLS),
        len(lines) - len(set(lines)),
        repeated_words(ids, max(1, len(index))),
        len(lines),
        len(index),
        upper,
        upper + lower,
        int(times[plain].sum()),
        int(times[marked].sum()),
    )


def measured(text: Column) -> Column:
    """A struct of ``FEATURES``, each a long."""

    def rows(batch: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([measures(t) for t in batch], columns=list(FEATURES), dtype="int64")

    return F.pandas_udf(rows, ", ".join(f"{name} long" for name in FEATURES))(text)


@dataclass(frozen=True)
class Rule:
    """Votes bad (0) where ``bad`` holds, else good (1) where ``good`` holds, else abstains (-1)."""

    name: str
    bad: str
    good: str

    def vote(self, measure: str) -> Column:
        as_expression = lambda text: F.expr(text.replace("@", f"{measure}."))
        return F.when(as_expression(self.bad), 0).when(as_expression(self.good), 1).otherwise(-1)


RULES = (
    Rule("length", "@n_words < 30", "@n_words >= 80"),
    Rule("repetition", "10 * @n_repeat_words > 3 * @n_words", "20 * @n_repeat_words <= @n_words"),
    Rule("lines", "2 * @n_dup_lines > @n_lines", "@n_dup_lines = 0 and @n_lines > 0"),
    Rule("symbols", "10 * @n_symbols > @n_words", "100 * @n_symbols <= @n_words and @n_words > 0"),
    Rule("plain_words", "10 * @n_plain < 7 * @n_words", "10 * @n_plain >= 9 * @n_words and @n_words > 0"),
    Rule("marked_words", "10 * @n_marked > @n_words", "100 * @n_marked <= @n_words and @n_words > 0"),
    Rule("capitals", "2 * @n_upper > @n_letters", "10 * @n_upper <= @n_letters and @n_letters > 0"),
    Rule("variety", "10 * @n_distinct < 3 * @n_words", "2 * @n_distinct >= @n_words and @n_words >= 30"),
    Rule("word_size", "@word_chars < 3 * @n_words or @word_chars > 12 * @n_words",
         "2 * @word_chars >= 7 * @n_words and @word_chars <= 9 * @n_words and @n_words > 0"),
)


@dataclass(frozen=True)
class VoteModel:
    """``prior`` of good; ``rates[rule, class, vote]`` with votes bad, good, abstain; classes bad, good."""

    prior: float
    rates: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Probability of good for rows of votes in (-1, 0, 1)."""
        return _expect(self.prior, self.rates, votes % 3)


def _expect(prior: float, rates: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    rules = np.arange(rates.shape[0])
    logs = np.log(rates)
    good = np.log(prior) + logs[rules, 1, kinds].sum(axis=1)
    bad = np.log(1 - prior) + logs[rules, 0, kinds].sum(axis=1)
    return 1 / (1 + np.exp(np.clip(bad - good, -500, 500)))


def fit_votes(votes: np.ndarray, counts: np.ndarray, rounds: int = 60) -> VoteModel:
    """Expectation-maximisation over distinct vote patterns weighted by their counts.

    Starts from the share of good votes of each pattern, so "good" keeps its meaning. Abstaining is a
    third outcome with a rate of its own in each class. Add-one smoothing keeps all rates above 0; with
    no rows the posterior follows the votes' majority through the same smoothing.
    """
    votes, counts = np.asarray(votes, int), np.asarray(counts, float)
    m = votes.shape[1]
    kinds = votes % 3  # -1 becomes 2
    good = ((votes == 1).sum(axis=1) + 0.7) / ((votes >= 0).sum(axis=1) + 1)
    prior, rates = 0.5, np.full((m, 2, 3), 1 / 3)
    # Every rule is taken to be right more often than not: worth ten documents of each class.
    belief = np.array([[[8.0, 1.0, 1.0], [1.0, 8.0, 1.0]]] * m)
    for _ in range(rounds):
        rates = belief.copy()
        for rule, kind in itertools.product(range(m), range(3)):
            at = kinds[:, rule] == kind
            rates[rule, 1, kind] += (good * counts)[at].sum()
            rates[rule, 0, kind] += ((1 - good) * counts)[at].sum()
        rates /= rates.sum(axis=2, keepdims=True)
        prior = float(((good * counts).sum() + 7) / (counts.sum() + 10))
        good = _expect(prior, rates, kinds)
    return VoteModel(prior, rates)


def vote_names(rules: tuple[Rule, ...] = RULES) -> list[str]:
    return [f"vote_{rule.name}" for rule in rules]


def voted(frame: DataFrame, measure: str = "quality", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds the vote of each rule to a frame with measures."""
    return frame.withColumns({f"vote_{rule.name}": rule.vote(measure) for rule in rules})


def pattern_probabilities(frame: DataFrame, measure: str = "quality", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(votes, probability): the posterior of good of each pattern of votes in ``frame``.

    Bounded work on the driver: one row for each pattern, at most 3 to the power of the rules.
    """
    names = vote_names(rules)
    patterns = voted(frame, measure, rules).groupBy(*names).count().toPandas()
    model = fit_votes(patterns[names].to_numpy(), patterns["count"].to_numpy())
    patterns["probability"] = (
        model.posterior(patterns[names].to_numpy(int)) if len(patterns) else np.zeros(0)
    )
    schema = ", ".join(f"{n} int" for n in names) + ", probability double"
    rows = [
        (*map(int, row[:-1]), float(row[-1]))
        for row in patterns[[*names, "probability"]].itertuples(index=False)
    ]
    return frame.sparkSession.createDataFrame(rows, schema)


def with_verdicts(
    frame: DataFrame, known: DataFrame, measure: str = "quality", rules: tuple[Rule, ...] = RULES
) -> DataFrame:
    """Adds ``base_failed``, ``probability`` and ``kept``, by the pattern of each row's votes."""
    failed = F.expr(
        f"{measure}.n_words < 50 or 100 * {measure}.n_repeat_words > 50 * {measure}.n_words"
    )
    return (
        voted(frame, measure, rules)
        .join(F.broadcast(known), vote_names(rules))
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & (F.col("probability") >= 0.5))
    )


def judged(frame: DataFrame, measure: str = "quality", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds ``base_failed``, ``probability`` (posterior of good) and ``kept`` to a frame with measures.

    ``frame`` is read twice, so it should be stored.
    """
    return with_verdicts(frame, pattern_probabilities(frame, measure, rules), measure, rules)


def quality_verdicts(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """One row for each document: its id, measures, votes, posterior and verdict.

    A null text counts as empty: zero words, so it fails. Repeated rows are judged each alike; a null
    id stays null; an empty table gives no rows; further columns of ``docs`` are ignored.
    """
    measured_rows = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"), measured(docs[text_column]).alias("quality")
    )
    return judged(stored(measured_rows))


def kept_documents(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """The documents whose verdict is to keep, with all their columns and nothing else.

    A null or empty text fails, a text of any length is measured whole. Repeated rows stay or go together,
    a null id decides nothing, and an empty table gives no rows.
    """
    carried = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("row"),
        measured(docs[text_column]).alias("quality"),
    )
    return judged(stored(carried)).where("kept").select("row.*")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "quality.n_words",
        "quality.word_chars",
        "quality.n_symbols",
        "quality.n_dup_lines",
        "quality.n_repeat_words",
        "base_failed",
        "kept",
        F.round("probability", 6).alias("probability"),
    )
