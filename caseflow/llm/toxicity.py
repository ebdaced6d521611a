"""Toxicity from a learned lexicon, found through misspellings and read in context.

Labelled documents give the lexicon: words, and stems that many words begin with, that toxic documents
use far more often than others. The lexicon is a trie. A word is looked up by intersecting the trie with
the Levenshtein automaton of that word: the pairs (trie node, errors so far) that reading it can reach.
Sets of such pairs are the states of a deterministic automaton that is built as words need it, so a
word costs one lookup for each letter and most words end early. How many errors an entry may have follows
from its length and its log-odds alone, so more and more varied labels never make the search stricter. A word
that clean training documents use is a word of its own and no misspelling. Hits are scored in windows of words:
a hit between quotation marks counts little, several near each other count more. A logistic model
over a few such measures of the whole text gives the score.
"""

from __future__ import annotations

import bisect
import itertools
import math
import re
from collections.abc import Collection, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseflow.llm.common import stored, table

#: Labelled documents that the lexicon and the model are fitted on, at most; those of least hash.
TRAINING_ROWS = 6000
#: Folds by crc32 of the id; the held-out one is never learned from.
FOLDS, HELD_OUT = 4, 2
#: Toxic training documents that an entry needs, its least log-odds, and lengths of stems.
SUPPORT, LEAST_ODDS, STEMS = 4, 1.2, (4, 5, 6, 7)
#: Log-odds that count as strong, and that an entry needs to be found with errors.
STRONG_ODDS = 3.0
#: Letters that words and stems need, at least, to be found with one and with two errors.
WORD_ERRORS, STEM_ERRORS = (4, 8), (6, 12)
#: (half, toxic) of training rows, and the halves that lexicons are learned from: two to measure the rows of
#: halves 0 and 1 with, and the one that is kept.
KINDS, LEARNED_FROM = ((0, 0), (0, 1), (1, 0), (1, 1)), ((1,), (0,), (0, 1))
#: Words of a context window.
WINDOW = 24
QUOTED_WEIGHT = 0.25
THRESHOLD = 0.3

_WORD = re.compile(r"\w+(?:[@$*!]\w+)*")
#: Quotations of any length within a line; none holds its own opening mark, so that a search is linear.
_QUOTED = re.compile(r"\"[^\"\n]+\"|“[^“”\n]+”|„[^„“\n]+“|«[^«»\n]+»|^>[^\n]*", re.M)


@dataclass(frozen=True)
class Entry:
    """A lexicon word, or with ``stem`` the beginning of words, and its log-odds."""

    term: str
    odds: float
    stem: bool = False

    @property
    def errors(self) -> int:
        """The most errors with which the entry is found: by its length, none unless its odds are strong."""
        if self.odds < STRONG_ODDS:
            return 0
        return sum(len(self.term) >= least for least in (STEM_ERRORS if self.stem else WORD_ERRORS))


def _rank(hit: tuple[Entry, int]) -> tuple[int, float, bool]:
    """Order of the entries found for a word: fewest errors, then greatest odds, then words before stems."""
    return hit[1], -hit[0].odds, hit[0].stem


@dataclass
class _Node:
    children: dict[str, int] = field(default_factory=dict)
    word: Entry | None = None
    stem: Entry | None = None
    errors: int = 0  # the most that any word below allows


class Matcher:
    """The lexicon's trie intersected with the Levenshtein automata of the words it is asked for.

    A state maps trie nodes to the fewest errors with which the letters read so far reach them.
    """

    def __init__(self, lexicon: Iterable[Entry]) -> None:
        self.nodes = [_Node()]
        for entry in lexicon:
            at = 0
            self.nodes[0].errors = max(self.nodes[0].errors, entry.errors)
            for letter in entry.term:
                if letter not in self.nodes[at].children:
                    self.nodes[at].children[letter] = len(self.nodes)
                    self.nodes.append(_Node())
                at = self.nodes[at].children[letter]
                self.nodes[at].errors = max(self.nodes[at].errors, entry.errors)
            if entry.stem:
                self.nodes[at].stem = entry
            else:
                self.nodes[at].word = entry
        self.states: list[dict[int, int]] = []
        self.numbers: dict[frozenset, int] = {}
        self.steps: list[dict[str, int]] = []
        self.accepted: list[tuple[Entry, int] | None] = []
        self.begun: list[tuple[Entry, int] | None] = []
        self._number({})  # 0: dead
        self.start = self._number(self._closed({0: 0}))

    def _closed(self, state: dict[int, int]) -> dict[int, int]:
        """With letters of the lexicon left out of the word: an error each."""
        todo = list(state.items())
        while todo:
            at, errors = todo.pop()
            for child in self.nodes[at].children.values():
                more = errors + 1
                if more <= self.nodes[child].errors and more < state.get(child, 99):
                    state[child] = more
                    todo.append((child, more))
        return state

    def _number(self, state: dict[int, int]) -> int:
        key = frozenset(state.items())
        if key not in self.numbers:
            self.numbers[key] = len(self.states)
            self.states.append(state)
            self.steps.append({})
            words = [(self.nodes[at].word, errors) for at, errors in state.items()]
            stems = [(self.nodes[at].stem, errors) for at, errors in state.items()]
            for entries, best in ((words, self.accepted), (stems, self.begun)):
                within = [(entry, errors) for entry, errors in entries if entry and errors <= entry.errors]
                best.append(min(within, key=_rank, default=None))
        return self.numbers[key]

    def _step(self, state: int, letter: str) -> int:
        after: dict[int, int] = {}
        for at, errors in self.states[state].items():
            node = self.nodes[at]
            for other, child in node.children.items():  # the letter, or another in its place
                cost = errors + (other != letter)
                if cost <= self.nodes[child].errors and cost < after.get(child, 99):
                    after[child] = cost
            if errors + 1 <= node.errors and errors + 1 < after.get(at, 99):  # a letter too many
                after[at] = errors + 1
        # A node is kept with no error even if no word below allows any.
        number = self._number(self._closed(after))
        if len(self.steps[state]) < 4096:
            self.steps[state][letter] = number
        return number

    def match(self, word: str) -> tuple[Entry, int] | None:
        """The entry that is nearest to a lower-case word and the errors between them, or None.

        A stem is as near as the beginning of the word that is nearest to it.
        """
        state, found = self.start, []
        for letter in word:
            state = self.steps[state].get(letter) if letter in self.steps[state] else self._step(state, letter)
            if not state:
                break
            if self.begun[state]:
                found.append(self.begun[state])
        if state and self.accepted[state]:
            found.append(self.accepted[state])
        return min(found, key=_rank, default=None)


MEASURES = (
    "bias", "sum_odds", "strongest", "density", "window", "distinct", "strong_hits", "words",
)


class Reader:
    """Measures of a text for the model."""

    def __init__(self, lexicon: Iterable[Entry], usual: Collection[str] = ()) -> None:
        """``usual`` words are found without errors only."""
        self.matcher = Matcher(lexicon)
        self.usual = frozenset(usual)
        self.known: dict[str, tuple[Entry, int] | None] = {}

    def _match(self, word: str) -> tuple[Entry, int] | None:
        if word not in self.known:
            if len(self.known) > 300_000:
                self.known.clear()
            found = self.matcher.match(word)
            self.known[word] = None if found and found[1] and word in self.usual else found
        return self.known[word]

    def measures(self, text: str | None) -> list[float]:
        """The values of ``MEASURES``; a text without words has all but the bias at zero."""
        text = (text or "").lower()
        words = _WORD.findall(text)
        hits = [(at, m) for at, m in enumerate(map(self._match, words)) if m]
        if not hits:
            return [1.0, 0, 0, 0, 0, 0, 0, math.log1p(len(words)) / 10]
        quoted = self._quoted(text, hits)
        best: dict[str, float] = {}
        places, weights, strong = [], [], 0.0
        for (at, (entry, errors)), inside in zip(hits, quoted, strict=True):
            weight = entry.odds * (1 - 0.2 * errors) * (QUOTED_WEIGHT if inside else 1)
            best[entry.term] = max(best.get(entry.term, 0), weight)
            places.append(at)
            weights.append(weight)
            strong += (entry.odds >= STRONG_ODDS) * (QUOTED_WEIGHT if inside else 1)
        sums = np.r_[0, np.cumsum(weights)]
        ends = np.searchsorted(places, np.asarray(places) + WINDOW)
        near = float((sums[ends] - sums[:-1][: len(ends)]).max())
        return [
            1.0,
            math.log1p(sum(best.values())),
            max(best.values()) / 4,
            math.log1p(100 * sum(weights) / len(words)) / 2,
            math.log1p(near),
            math.log1p(len(best)),
            math.log1p(strong),
            math.log1p(len(words)) / 10,
        ]

    @staticmethod
    def _quoted(text: str, hits: list) -> list[bool]:
        """Whether each hit lies between quotation marks, or in a line marked as quoted."""
        spans = [m.span() for m in _QUOTED.finditer(text)]
        if not spans:
            return [False] * len(hits)
        starts = [m.start() for m in _WORD.finditer(text)]
        begins = np.asarray([s for s, _ in spans])
        out = []
        for at, _ in hits:
            span = int(np.searchsorted(begins, starts[at], side="right")) - 1
            out.append(span >= 0 and starts[at] < spans[span][1])
        return out


# --- learning -------------------------------------------------------------------------------------


def candidate_terms(text: str | None) -> set[str]:
    """Words of a text, and as ``stem*`` what its longer words begin with."""
    words = {w for w in _WORD.findall((text or "").lower()) if w.isalpha() and 3 <= len(w) <= 40}
    stems = {w[:n] + "*" for w in words for n in STEMS if len(w) > n}
    return words | stems


def training_set(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> DataFrame:
    """(text, toxic, half) of at most ``rows`` labelled documents outside the held-out fold.

    Equal texts are in one half.

    A document with different labels is left out, as is one without an id.
    """
    usable = (
        labels.where("doc_id is not null and toxic in (0, 1)")
        .groupBy("doc_id")
        .agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most"))
        .where("toxic = most")
        .where(fold("doc_id") != HELD_OUT)
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)  # the documented bound of the training sample
        .select("doc_id", "toxic")
    )
    half = F.pmod(F.xxhash64("text"), F.lit(2)).cast("int").alias("half")
    return docs.join(F.broadcast(usable), "doc_id").select("text", "toxic", half)


def fold(id_column: str):
    return F.pmod(F.crc32(F.col(id_column).cast("string").cast("binary")), F.lit(FOLDS))


def learned_lexicon(counts: pd.DataFrame, toxic: int, clean: int) -> list[Entry]:
    """Entries from (term, pos, neg) counts over ``toxic`` and ``clean`` training documents.

    A stem that adds little to a longer stem or a word of the same documents is left out. What begins with
    a stem stands together in the order of terms, and a word is in that of few stems.
    """
    odds = np.log((counts["pos"] + 0.5) / (toxic + 1)) - np.log((counts["neg"] + 0.5) / (clean + 1))
    chosen = counts.assign(odds=odds)[(odds >= LEAST_ODDS) & (counts["pos"] >= SUPPORT)]
    rows = {t: (p, float(o)) for t, p, o in chosen[["term", "pos", "odds"]].itertuples(index=False)}
    ordered = sorted(rows)
    out = []
    for term, (pos, odd) in rows.items():
        body = term.removesuffix("*")
        stem = body != term
        if stem:
            begin = bisect.bisect_left(ordered, body)
            longer = itertools.takewhile(lambda t: t.startswith(body), itertools.islice(ordered, begin, None))
            if any(t != term and abs(rows[t][0] - pos) <= 0.1 * pos and rows[t][1] >= odd for t in longer):
                continue
        out.append(Entry(body, odd, stem))
    return out


def fitted(measures: np.ndarray, toxic: np.ndarray, penalty: float = 1.0) -> np.ndarray:
    """Weights of a logistic regression by Newton steps; the bias is not penalised."""
    weights = np.zeros(measures.shape[1])
    if not len(toxic):
        return weights
    keep = np.full(len(weights), penalty)
    keep[0] = 1e-3
    for _ in range(30):
        chance = 1 / (1 + np.exp(-np.clip(measures @ weights, -30, 30)))
        slope = measures.T @ (toxic - chance) - keep * weights
        curve = (measures * (chance * (1 - chance))[:, None]).T @ measures + np.diag(keep)
        step = np.linalg.solve(curve, slope)
        weights += step
        if np.abs(step).max() < 1e-8:
            break
    return weights


@dataclass
class Model:
    lexicon: list[Entry]
    usual: list[str]
    weights: np.ndarray


def term_counts(sample: DataFrame) -> DataFrame:
    """(term, n00, n01, n10, n11): rows of ``training_set`` that hold a term, n<half><toxic>."""
    names = [f"n{half}{toxic}" for half, toxic in KINDS]

    def terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            counts: dict[str, list[int]] = {}
            for text, toxic, half in zip(batch["text"], batch["toxic"], batch["half"], strict=True):
                for term in candidate_terms(text):
                    counts.setdefault(term, [0, 0, 0, 0])[2 * half + int(toxic)] += 1
            yield pd.DataFrame([(term, *n) for term, n in counts.items()], columns=["term", *names])

    schema = "term string, " + ", ".join(f"{name} long" for name in names)
    return sample.mapInPandas(terms, schema).groupBy("term").agg(*(F.sum(n).alias(n) for n in names))


def usual_words(counts: DataFrame, lexicons: list[list[Entry]]) -> list[list[str]]:
    """For each lexicon, in order of ``LEARNED_FROM``, words of clean documents that it finds with errors."""
    sent = counts.sparkSession.sparkContext.broadcast(lexicons)

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matchers = [Matcher(lexicon) for lexicon in sent.value]
        for batch in batches:
            for number, (matcher, halves) in enumerate(zip(matchers, LEARNED_FROM, strict=True)):
                clean = batch["term"][sum(batch[f"n{half}0"] for half in halves) > 0]
                found = [term for term in clean if (matcher.match(term) or (None, 0))[1]]
                yield pd.DataFrame({"lexicon": np.full(len(found), number, np.int32), "word": np.array(found, object)})

    words = counts.where(~F.col("term").endswith("*")).mapInPandas(near, "lexicon int, word string")
    rows = words.orderBy("lexicon", "word").collect()  # bounded by the training sample
    return [[row["word"] for row in rows if row["lexicon"] == number] for number in range(len(lexicons))]


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """Lexicon and weights from a bounded training sample. Without labels every score is one half.

    The model must not trust words because they came from the very documents it is fitted on. So the
    documents of each half are measured with a lexicon of the other half; the one that is kept is learned
    from both.
    """
    spark = docs.sparkSession
    sample = stored(training_set(docs, labels))
    totals = dict.fromkeys(KINDS, 0)
    for row in sample.groupBy("half", "toxic").agg(F.count("*").alias("n")).collect():
        totals[row["half"], row["toxic"]] = row["n"]
    every = stored(term_counts(sample))
    counts = (
        every.where(F.col("n01") + F.col("n11") >= SUPPORT)
        .toPandas()  # bounded by the training sample
        .sort_values("term")
    )

    def lexicon_of(halves: tuple[int, ...]) -> list[Entry]:
        own = pd.DataFrame(
            {
                "term": counts["term"],
                "pos": sum(counts[f"n{h}1"] for h in halves),
                "neg": sum(counts[f"n{h}0"] for h in halves),
            }
        )
        return learned_lexicon(own, *(sum(totals[h, t] for h in halves) for t in (1, 0)))

    lexicons = [lexicon_of(halves) for halves in LEARNED_FROM]
    usual = usual_words(every, lexicons)
    sent = spark.sparkContext.broadcast((lexicons[:2], usual[:2]))

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        readers = list(map(Reader, *sent.value))
        for batch in batches:
            found = [readers[h].measures(t) for t, h in zip(batch["text"], batch["half"], strict=True)]
            yield pd.DataFrame({"m": found, "toxic": batch["toxic"]})

    rows = sample.mapInPandas(measure, "m array<double>, toxic int").toPandas()
    measures = np.stack(rows["m"].to_list()) if len(rows) else np.zeros((0, len(MEASURES)))
    return Model(lexicons[2], usual[2], fitted(measures, rows["toxic"].to_numpy(float)))


def toxicity(docs: DataFrame, labels: DataFrame, text_column: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for each document.

    Only the text makes the score. A null or empty text has the score of a text without words. A null
    id is never held out and never learned from. Repeated rows are scored each alike; an empty table
    gives no rows; further columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs[text_column].alias("text"))
    sent = spark.sparkContext.broadcast(learn(rows, labels))
    made: list[Reader] = []

    def score(batch: pd.Series) -> pd.Series:
        model = sent.value
        if not made:
            made.append(Reader(model.lexicon, model.usual))
        values = np.asarray([made[0].measures(t) for t in batch]).reshape(len(batch), len(MEASURES))
        return pd.Series(1 / (1 + np.exp(-np.clip(values @ model.weights, -30, 30))))

    scored = rows.select(
        "doc_id",
        F.coalesce(fold("doc_id") == HELD_OUT, F.lit(False)).alias("held_out"),
        F.pandas_udf(score, "double")("text").alias("score"),
    )
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
