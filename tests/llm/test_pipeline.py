"""The pipeline against its stages' contracts in plain Python, and the registered queries."""

from collections import Counter

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

import __spark_entry__
import brute
import corpus_pipeline
from caseflow.llm import catalog, common, packing, quality_rules
from check import connect, difference
from conftest import TABLES


def expected(document_rows, benchmark):
    """doc_id to text before packing. No term is added to the personal data of so small a table."""
    measures = [quality_rules.measures(text) for _, text in document_rows]
    frame = np.asarray(measures)
    names = quality_rules.FEATURES
    con = duckdb.connect()
    con.execute("CREATE TABLE m (" + ", ".join(f"{n} BIGINT" for n in names) + ", place BIGINT)")
    con.executemany("INSERT INTO m VALUES (" + "?," * len(names) + "?)", [(*map(int, r), i) for i, r in enumerate(frame)])
    votes = []
    for rule in quality_rules.RULES:
        bad, good = (e.replace("@", "") for e in (rule.bad, rule.good))
        sql = f"SELECT CASE WHEN {bad} THEN 0 WHEN {good} THEN 1 ELSE -1 END FROM m ORDER BY place"
        votes.append([row[0] for row in con.execute(sql).fetchall()])
    votes = np.asarray(votes).T
    model = quality_rules.fit_votes(votes, np.ones(len(votes)))  # row by row, not by pattern
    good = model.posterior(votes) >= 0.5
    kept = [
        row
        for row, m, g in zip(document_rows, measures, good, strict=True)
        if g and not (m[0] < 50 or 100 * m[4] > 50 * m[0])
    ]
    root = brute.components([text for _, text in kept])
    first = {}
    for (doc, _), at in zip(kept, root, strict=True):
        first[at] = min(first.get(at, doc), doc)
    kept = [row for row in kept if row[0] in set(first.values())]
    kept = [row for row in kept if not brute.contained(row[1], benchmark)]
    out = {}
    for doc, text in kept:
        new, at = [], 0
        for start, _, end, kind in brute.spans(brute.PERSONAL, text):
            if start >= at:
                new += [text[at:start], f"[{kind.upper()}]"]
            at = max(at, end)
        out[doc] = "".join(new) + text[at:]
    return out


def test_pipeline(spark, document_rows):
    benchmark = spark.read.parquet(f"{TABLES}/benchmark.parquet")
    items = [(r["item_id"], r["text"]) for r in benchmark.collect()]
    texts = expected(document_rows, items)
    assert 0 < len(texts) < len(document_rows)
    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    wanted = Counter()
    for doc, text in texts.items():
        count = len(tokenizer.encode(text, add_special_tokens=False).ids) + 1
        for piece, start in enumerate(range(0, count, packing.SEQUENCE)):
            wanted[(doc, piece, start, min(packing.SEQUENCE, count - start))] += 1
    found = corpus_pipeline.run(spark, TABLES).collect()
    assert Counter(tuple(row)[:4] for row in found) == wanted


def test_stages_keep_the_columns(spark, awkward):
    docs = awkward
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, TABLES)
        assert docs.columns == awkward.columns
        docs.count()


def test_stages_of_an_empty_table(spark, empty):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, empty, TABLES)
        assert docs.columns == empty.columns and docs.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, empty, TABLES).count() == 0


def test_a_cluster_must_name_its_shared_folder():
    class Session:
        conf = {}
        sparkContext = type("Context", (), {"master": "spark://far:7077"})

    with pytest.raises(ValueError, match="checkpoint.dir"):
        common.shared_folder(Session)
    Session.conf = {"spark.checkpoint.dir": "hdfs://far/shared/"}
    assert common.shared_folder(Session) == "hdfs://far/shared"


def test_each_operator_has_one_query():
    names = [name for name in __spark_entry__.queries() if name.startswith("op")]
    assert sorted(int(name[2:].split("_")[0]) for name in names) == list(range(1, 14))
    assert "pipeline" in __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_sql(spark, name):
    frame = catalog.QUERIES[name](spark, TABLES)
    assert difference(frame, connect(TABLES), catalog.SQL[name])[1] == ""
