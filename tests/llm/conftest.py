import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

TABLES = "/root/testdata/sf0.001"
# Names that operators use inside, as further columns of the documents.
CLASHES = (
    "key", "row", "hits", "n_words", "kept", "group", "shard", "score", "node", "base", "length",
    "quality", "marks", "spans", "rank", "label", "piece", "document", "searched", "n_chars",
)
SECRET = "AKIA" + "IOSFODNN7EXAMPLE"


def awkward_rows():
    """(doc_id, text): nulls, empty and very long texts, ties, repeated rows, odd characters."""
    chance = random.Random(5)
    plain = [f"w{chance.randrange(400)}" for _ in range(300)]
    passage = " ".join(f"shared{at}" for at in range(60))
    near = plain.copy()
    near[150] = "other"
    far = [w if chance.random() > 0.5 else w + "x" for w in plain]
    hexes = "".join(chance.choice("0123456789abcdef") for _ in range(40))
    rows = [
        (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "One"), (6, "two words"),
        (None, "no id here " + passage), (None, None), (7, " ".join(plain)), (7, " ".join(plain)),
        (8, " ".join(near)), (9, " ".join(far)), (10, " ".join(plain)),
        (11, "start " + passage + " end"), (12, passage + "\n" + passage),
        (13, f'token = "{hexes}" and {SECRET} x'), (14, f"password: {'a' * 8} secret=short api_key='abcdefgh1'"),
        (15, "mail a.b@c.example.com, a@b.c_x@d.e +1 (555) 555-0100 10.0.0.255 10.0.0.256 1.2.3.4.5"),
        (16, "4111 1111 1111 1111 and 4111-1111-1111-1112 " + "7" * 30),
        (17, "é à   ünï " * 40), (18, "a\x00b \x1c c d 你好。 ﬁ <|endoftext|> ΑΣ don't"),
        (19, "same line\nsame line\n\nsame line\nother"), (20, "### " * 30 + "%%% | <>"),
        (21, " ".join(chance.choice(plain) for _ in range(40_000))), (22, "x" * 3000),
        (23, "abc" * 300), (24, "7 " * 9000), (25, "@" * 500 + "a@b" * 50), (-3, "negative id"),
    ]
    return rows


@pytest.fixture(scope="session")
def awkward(spark):
    rows = [(*row, *(f"{c}?" for c in CLASHES)) for row in awkward_rows()]
    schema = "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in CLASHES)
    return spark.createDataFrame(rows, schema).repartition(5)


@pytest.fixture(scope="session")
def empty(awkward):
    return awkward.limit(0)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{TABLES}/documents.parquet")


@pytest.fixture(scope="session")
def document_rows(documents):
    return [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]
