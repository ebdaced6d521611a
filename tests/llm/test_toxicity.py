import math
import random
import time
import zlib
from collections import Counter

import pandas as pd
import pytest

from caseflow.llm import toxicity
from caseflow.llm.toxicity import Entry, Matcher, Reader
from conftest import awkward_rows


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def test_matcher_finds_what_distances_find():
    lexicon = [Entry(t, 5.0) for t in ("idiot", "trash", "worthless", "moron", "scum", "abc", "morons")]
    matcher = Matcher(lexicon)
    words = ["idiot", "idiott", "idot", "id1ot", "idjt", "trsh", "trashy", "wortless", "w0rthles", "worthles5x",
             "mron", "scm", "sccum", "abd", "abc", "harmless", "xidiot", "", "i", "morons", "moron", "mxrxn"]
    for word in words:
        near = [(distance(word, e.term), e) for e in lexicon if distance(word, e.term) <= e.errors]
        found = matcher.match(word)
        assert (found is None) == (not near), word
        if near:
            assert found[1] == min(near, key=lambda n: n[0])[0]
            assert distance(word, found[0].term) == found[1]


def test_stems_and_weak_words_match_exactly():
    matcher = Matcher([Entry("achlich", 2.0, stem=True), Entry("mild", 1.5)])
    assert matcher.match("achlichung")[0].term == "achlich"
    assert matcher.match("achlik") is None and matcher.match("achlxchung") is None and matcher.match("milt") is None
    assert matcher.match("mild")[1] == 0


def test_budget_follows_length_and_odds_alone():
    assert [Entry("x" * n, 3.0).errors for n in (3, 4, 7, 8, 30)] == [0, 1, 1, 2, 2]
    assert [Entry("x" * n, 3.0, stem=True).errors for n in (5, 6, 11, 12)] == [0, 1, 1, 2]
    assert Entry("x" * 30, 2.9).errors == 0


def nearest(lexicon, word):
    """Fewest errors, then greatest odds, then words; a stem against every beginning of the word."""
    hits = []
    for entry in lexicon:
        ends = range(len(word) + 1) if entry.stem else [len(word)]
        errors = min(distance(word[:end], entry.term) for end in ends)
        if errors <= entry.errors:
            hits.append((errors, -entry.odds, entry.stem))
    return min(hits, default=None)


def test_matcher_equals_brute_force_on_random_words():
    rnd = random.Random(3)
    word = lambda least, most: "".join(rnd.choices("abc", k=rnd.randint(least, most)))
    for _ in range(30):
        lexicon = list({(t := word(3, 9), s := rnd.random() < 0.5): Entry(t, 1.5 + rnd.random() * 3, s) for _ in range(6)}.values())
        matcher = Matcher(lexicon)
        for asked in [word(0, 12) for _ in range(60)]:
            found = matcher.match(asked)
            assert (found and (found[1], -found[0].odds, found[0].stem)) == nearest(lexicon, asked), (asked, lexicon)


def test_usual_words_are_no_misspellings():
    reader = Reader([Entry("idiot", 6.0)], {"idiom", "idiot"})
    assert reader.measures("an idiom here")[1] == 0
    assert reader.measures("an idiot here")[1] > reader.measures("an idiod here")[1] > 0


def test_long_quotations_and_unclosed_marks():
    reader = Reader([Entry("idiot", 6.0)])
    strongest = toxicity.MEASURES.index("strongest")
    for begin, end in ('""', "“”", "„“", "«»"):
        quoted = f"they wrote {begin}{'so it is ' * 100}idiot{end} there"
        assert reader.measures(quoted)[strongest] < 0.5 * reader.measures(quoted.replace(end, " "))[strongest]
        started = time.time()
        reader.measures(f"idiot {begin}" + f"{begin} a" * 100_000)
        assert time.time() - started < 10  # linear; a quadratic search takes minutes


def test_lexicon_and_usual_words_equal_brute_force(spark):
    bad, good = "you filthy grumbol go away", "the grumbal is a filthy river"
    rows = [(f"{bad} number {n}", 1, n % 2) for n in range(12)] + [(f"{good} number {n}", 0, n % 2) for n in range(15)]
    sample = spark.createDataFrame(rows, "text string, toxic int, half int").repartition(3)
    counts = toxicity.term_counts(sample)
    wanted = Counter((term, 2 * half + toxic) for text, toxic, half in rows for term in toxicity.candidate_terms(text))
    found = {r["term"]: r[1:] for r in counts.collect()}
    assert found == {term: tuple(wanted[term, kind] for kind in range(4)) for term, _ in wanted}
    entries = [Entry("grumbol", 4.0), Entry("filthy", 4.0)]
    assert toxicity.usual_words(counts, [entries] * 3) == [["grumbal"]] * 3


def test_lexicon_filter_equals_comparing_all_pairs():
    rnd = random.Random(9)
    terms = sorted({"".join(rnd.choices("ab", k=rnd.randint(3, 7))) + rnd.choice(["", "*"]) for _ in range(120)})
    counts = pd.DataFrame({"term": terms, "pos": [rnd.randint(4, 30) for _ in terms], "neg": [rnd.randint(0, 4) for _ in terms]})
    odds = {t: math.log((p + 0.5) / 41) - math.log((n + 0.5) / 61) for t, p, n in counts.itertuples(index=False)}
    pos = dict(zip(counts["term"], counts["pos"], strict=True))
    chosen = [t for t in terms if odds[t] >= toxicity.LEAST_ODDS]
    wanted = set()
    for term in chosen:
        body = term.rstrip("*")
        longer = [t for t in chosen if t != term and t.startswith(body) and abs(pos[t] - pos[term]) <= 0.1 * pos[term] and odds[t] >= odds[term] - 1e-12]
        if not (term.endswith("*") and longer):
            wanted.add((body, term.endswith("*")))
    assert {(e.term, e.stem) for e in toxicity.learned_lexicon(counts, 40, 60)} == wanted


def test_quotation_counts_less():
    reader = Reader([Entry("idiot", 6.0)])
    names = toxicity.MEASURES
    said = dict(zip(names, reader.measures('they wrote "you idiot" there'), strict=True))
    meant = dict(zip(names, reader.measures("they wrote you idiot there"), strict=True))
    assert said["strongest"] < 0.5 * meant["strongest"] and said["window"] < meant["window"]


def auc(rows):
    bad = [r["score"] for r in rows if r["toxic"]]
    good = [r["score"] for r in rows if not r["toxic"]]
    return sum((b > g) + 0.5 * (b == g) for b in bad for g in good) / (len(bad) * len(good))


def test_held_out_accuracy(spark):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    scored = toxicity.toxicity(documents, labels)
    rows = scored.join(labels, "doc_id").where("held_out").collect()
    assert auc(rows) > 0.85
    for row in rows:
        assert zlib.crc32(str(row["doc_id"]).encode()) % 4 == 2
        assert row["predicted"] == (row["score"] >= 0.3)


def test_held_out_labels_do_not_matter(spark, documents):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    held = toxicity.fold("doc_id") == 2
    changed = labels.where(~held).unionByName(
        labels.where(held).withColumn("toxic", (1 - labels["toxic"]).cast("int"))
    )
    first, second = (
        {r["doc_id"]: r["score"] for r in toxicity.toxicity(documents, own).collect()}
        for own in (labels, changed)
    )
    assert first == pytest.approx(second)


def test_every_row_is_scored(spark, awkward, empty):
    schema = "doc_id long, quality int, toxic int"
    labels = spark.createDataFrame(
        [(4, 1, 0), (4, 1, 1), (None, 1, 1), (7, 1, 1), (17, 1, 0), (18, None, None), (19, 0, 1)], schema
    )
    for own in (labels, labels.limit(0)):
        rows = toxicity.toxicity(awkward, own).collect()
        assert Counter(r["doc_id"] for r in rows) == Counter(doc for doc, _ in awkward_rows())
        assert all(0 <= r["score"] <= 1 and r["held_out"] is not None for r in rows)
    assert toxicity.toxicity(empty, labels).count() == 0
