from collections import Counter

import numpy as np
import pytest

import brute
from caseflow.llm import quality_classifier, quality_rules
from conftest import awkward_rows


def test_measures(awkward, empty, documents, document_rows):
    for frame, rows in ((awkward, awkward_rows()), (documents, document_rows)):
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
        found = quality_rules.quality_verdicts(frame).select(
            "doc_id", *(f"quality.{n}" for n in names), "base_failed", "kept"
        )
        found = found.collect()
        wanted = Counter()
        for doc, text in rows:
            values = brute.measures(text)
            wanted[(doc, *values, values[0] < 50 or 100 * values[4] > 50 * values[0])] += 1
        assert Counter(tuple(row)[:-1] for row in found) == wanted
        assert not any(row["kept"] for row in found if row["base_failed"])
    assert quality_rules.quality_verdicts(empty).count() == 0
    assert quality_rules.kept_documents(empty).count() == 0


def test_kept_documents_keep_their_columns(documents, awkward):
    for frame in (documents, awkward):
        kept = quality_rules.kept_documents(frame)
        verdicts = quality_rules.quality_verdicts(frame).where("kept")
        assert kept.columns == frame.columns
        assert Counter(r["doc_id"] for r in kept.collect()) == Counter(
            r["doc_id"] for r in verdicts.collect()
        )


def test_expectation_maximisation_finds_planted_accuracies():
    """The expectation step over patterns equals that over rows, and the accuracies come back."""
    chance = np.random.default_rng(0)
    truth = chance.random(20_000) < 0.8
    right = [0.95, 0.9, 0.85, 0.7, 0.9]
    votes = np.stack([np.where(chance.random(20_000) < p, truth, ~truth) for p in right], 1).astype(int)
    votes[chance.random(votes.shape) < 0.1] = -1
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = quality_rules.fit_votes(patterns, counts)
    assert abs(model.prior - 0.8) < 0.02
    for rule, p in enumerate(right):
        told = model.rates[rule, 1, 1] / model.rates[rule, 1, :2].sum()
        assert abs(told - p) < 0.03
    assert ((model.posterior(votes) >= 0.5) == truth).mean() > 0.95


def test_no_votes_at_all():
    model = quality_rules.fit_votes(np.zeros((0, 3)), np.zeros(0))
    assert model.posterior(np.asarray([[1, 1, 1], [0, 0, 0]])).tolist() == pytest.approx([1, 0], abs=0.1)


def accuracy(spark, found):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = found.select("doc_id", "kept").join(labels, "doc_id").select("kept", "quality").collect()
    return np.mean([row["kept"] == bool(row["quality"]) for row in rows])


def test_verdicts_agree_with_labels(spark):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    long_enough = quality_rules.quality_verdicts(documents).where("quality.n_words >= 50")
    assert accuracy(spark, long_enough) > 0.97
    assert accuracy(spark, quality_classifier.classified(documents)) > 0.93


def test_classifier_covers_every_row(awkward, empty):
    found = quality_classifier.classified(awkward).collect()
    assert Counter(r["doc_id"] for r in found) == Counter(doc for doc, _ in awkward_rows())
    assert all(0 <= r["score"] <= 1 and 0 <= r["label"] <= 1 for r in found)
    assert quality_classifier.classified(empty).count() == 0


def test_training_separates_what_differs():
    sample = [("good words here " + "fine " * n, 1.0) for n in range(30)]
    sample += [("### $$$ %%% " * (1 + n), 0.0) for n in range(30)]
    scorer = quality_classifier.Scorer(quality_classifier.trained(sample))
    assert scorer.score("fine good words") > 0.9 > 0.1 > scorer.score("%%% ### $$$ ###")


def labels_by_hand(votes):
    """Expectation-maximisation over single documents, in plain loops."""
    good = [(sum(v == 1 for v in row) + 0.7) / (sum(v >= 0 for v in row) + 1) for row in votes]
    kinds = [1, 0, -1]  # good, bad, abstain
    for _ in range(60):
        prior = (sum(good) + 7) / (len(votes) + 10)
        rates = []
        for rule in range(len(votes[0])):
            own = {}
            for cls in (0, 1):
                belief = {k: (8.0 if k == cls else 1.0) for k in kinds}
                for row, g in zip(votes, good, strict=True):
                    belief[row[rule]] += g if cls else 1 - g
                own[cls] = {k: belief[k] / sum(belief.values()) for k in kinds}
            rates.append(own)
        good = []
        for row in votes:
            one, zero = prior, 1 - prior
            for rule, v in enumerate(row):
                one, zero = one * rates[rule][1][v], zero * rates[rule][0][v]
            good.append(one / (one + zero))
    return good


def weights_by_hand(sample):
    """Adam on the whole, dense matrix of features."""
    size, steps, rate, penalty = 1 << quality_classifier.BITS, 150, 0.3, 1e-4
    x = np.zeros((len(sample), size))
    for row, (text, _) in enumerate(sample):
        raw = (text or "").encode()
        words = raw.split()
        for at in quality_classifier.text_features(words, raw):
            x[row, at] = 1.0
        for word in words:
            for at in quality_classifier.word_features(word):
                x[row, at] += 1 / len(words)
    y = np.asarray([label for _, label in sample])
    share = min(0.95, max(0.05, y.mean()))
    weight = np.where(y >= 0, y / share + (1 - y) / (1 - share), 0) / (2 * len(y))
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for step in range(1, steps + 1):
        g = x.T @ ((1 / (1 + np.exp(-x @ w)) - y) * weight) + penalty * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w


def test_labels_and_scores_equal_a_plain_version(documents):
    names = quality_rules.vote_names()
    rows = quality_rules.quality_verdicts(documents).join(documents.select("doc_id", "text"), "doc_id").collect()
    labels = labels_by_hand([[r[n] for n in names] for r in rows])
    sample = {r["text"] or "": label for r, label in zip(rows, labels, strict=True)}
    w = weights_by_hand(sorted(sample.items()))
    wanted = {r["doc_id"]: label for r, label in zip(rows, labels, strict=True)}
    for row in quality_classifier.classified(documents).join(documents.select("doc_id", "text"), "doc_id").collect():
        raw = (row["text"] or "").encode()
        words = raw.split()
        total = w[quality_classifier.text_features(words, raw)].sum()
        total += sum(w[list(quality_classifier.word_features(word))].sum() for word in words) / max(1, len(words))
        assert row["label"] == pytest.approx(wanted[row["doc_id"]], abs=1e-9)
        assert row["score"] == pytest.approx(1 / (1 + np.exp(-total)), abs=2e-3)
        assert row["kept"] == (row["score"] >= 0.5)


def test_shapes_read_whole_words():
    long = b"Aa" * 60
    assert quality_classifier.word_features(long + b"0")[2] != quality_classifier.word_features(long)[2]
