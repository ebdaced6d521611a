import hashlib
import json
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from caseflow.llm import byte_bpe
from conftest import awkward_rows

ODD = [
    "", " ", "  ", "a", "'s", "''s", " 's", "  's", "a's 're 'x don't we'll they've I'm I'd 'll'", "a'", "'",
    "\n's", "\n\n  x\n", "tab\t\tx \t", "<|endoftext|>", "a<|endoftext|>b  <|endoftext|> <|endoftext",
    "!'s", "'s's 'd's", "x" * 3000, "我" * 500, "=-=-" * 60, "l" + "o" * 90 + "l", "͸\U000e0100🤞🏽" * 3,
    "\x00\x01", "�", "12345678901234567890 1½²", "ՠ֋౜",
]


@pytest.fixture(scope="module")
def path():
    return byte_bpe.tokenizer_path()


@pytest.fixture(scope="module")
def tokenizer(path):
    return Tokenizer.from_file(path)


def ids_of(own, values):
    return [np.concatenate([np.zeros(0, np.uint32), *p]).tolist() for p in byte_bpe._gathered(own, values)]


def wanted(tokenizer, value):
    ids = tokenizer.encode(value, add_special_tokens=False).ids
    return ids, tokenizer.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("part", [1 << 20, 50])
def test_equals_the_library(path, tokenizer, document_rows, monkeypatch, part):
    monkeypatch.setattr(byte_bpe, "PART", part)
    chance = random.Random(3)
    values = ODD + [t or "" for _, t in (awkward_rows() + document_rows if part > 50 else [])]
    for _ in range(500):
        values.append("".join(chance.choice("ab  '’srtvelmd\n\t1.é你 😀!-") for _ in range(chance.randrange(90))))
        scripts = [(32, 127), (0x80, 0x3000), (0x3000, 0xD800), (0xE000, 0x11000), (0x1F000, 0x20000)]
        values.append("".join(chr(chance.randrange(*chance.choice(scripts))) for _ in range(chance.randrange(60))))
    own = byte_bpe.ByteBpe(path)
    for value, ids in zip(values, ids_of(own, values), strict=True):
        assert (ids, own.decode(np.asarray(ids, np.int64))) == wanted(tokenizer, value)


@pytest.mark.parametrize("seed", range(12))
def test_any_order_of_merges(tmp_path, seed):
    """Vocabularies no training gives: parts that come later than what they make, tokens never reached."""
    chance = random.Random(seed)
    letters = list(byte_bpe._byte_letters())
    vocabulary, merges = list(letters), []
    made = ["a", "b", "c"]
    while len(merges) < 25:
        pair = [chance.choice(made), chance.choice(made)]
        if len(pair[0] + pair[1]) <= 6 and pair not in merges:
            merges.append(pair)
            if pair[0] + pair[1] not in vocabulary:
                vocabulary.append(pair[0] + pair[1])
            made.append(pair[0] + pair[1])
    if seed % 2:
        chance.shuffle(merges)
    cut = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
    parts = {
        "version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": None,
        "pre_tokenizer": cut, "post_processor": None, "decoder": cut,
        "model": {"type": "BPE", "vocab": {v: n for n, v in enumerate(vocabulary)}, "merges": merges},
    }
    file = tmp_path / "own.json"
    file.write_text(json.dumps(parts))
    tokenizer, own = Tokenizer.from_file(str(file)), byte_bpe.ByteBpe(str(file))
    values = ["".join(chance.choice("abc") for _ in range(chance.randrange(1, 90))) for _ in range(400)]
    failing = 0
    for value, ids in zip(values, ids_of(own, values), strict=True):
        assert ids == tokenizer.encode(value, add_special_tokens=False).ids, value
        failing += ids != own._long_proposed(value.encode())
    assert failing  # the proposal alone would not do


def test_pairs_are_those_that_merging_gives(path, tokenizer):
    own = byte_bpe.ByteBpe(path)
    chance = np.random.default_rng(2)
    first, second = chance.integers(0, 50256, (2, 3000))
    for a, b, fine in zip(first.tolist(), second.tolist(), own.compatible(first, second).tolist(), strict=True):
        raw = own.decode_bytes(np.asarray([a, b]))
        assert fine == (own._long_merged(raw) == [a, b])


def test_columns_of_the_query(spark, awkward, empty, documents, document_rows, tokenizer):
    def digest(raw):
        return hashlib.sha256(raw).hexdigest()

    def expected(rows):
        for doc, text in rows:
            ids, back = wanted(tokenizer, text or "")
            yield doc, len(ids), digest(np.asarray(ids, "<u4").tobytes()), digest(back.encode())

    for frame, rows in ((awkward, awkward_rows()), (documents, document_rows)):
        found = [tuple(r) for r in byte_bpe.round_trip(frame).collect()]
        assert sorted(found, key=str) == sorted(expected(rows), key=str)
    assert byte_bpe.round_trip(empty).count() == 0


def test_encoded_and_decoded(spark, awkward, empty, tokenizer):
    ids = byte_bpe.encoded(awkward).collect()
    assert sorted(((r["doc_id"], r["ids"]) for r in ids), key=str) == sorted(
        ((doc, wanted(tokenizer, text or "")[0]) for doc, text in awkward_rows()), key=str
    )
    back = byte_bpe.decoded(byte_bpe.encoded(awkward)).collect()
    assert sorted(map(str, back)) == sorted(
        str(r) for r in awkward.selectExpr("cast(doc_id as long) doc_id", "coalesce(text, '') text").collect()
    )
    rows = spark.createDataFrame([(1, [199]), (2, None), (3, [None, 50256]), (4, [])], "doc_id long, ids array<int>")
    assert {r["doc_id"]: r["text"] for r in byte_bpe.decoded(rows).collect()} == {
        1: tokenizer.decode([199], skip_special_tokens=False), 2: "", 3: "<|endoftext|>", 4: ""
    }
    assert byte_bpe.encoded(empty).count() == byte_bpe.decoded(byte_bpe.encoded(empty)).count() == 0


def test_other_kinds_of_tokenizers_raise():
    with pytest.raises(ValueError):
        byte_bpe.ByteBpe(byte_bpe.tokenizer_path("word_bpe_49k.json"))
