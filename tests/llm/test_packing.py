import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from caseflow.llm import packing
from conftest import awkward_rows


@pytest.fixture(scope="module")
def path():
    return packing.tokenizer_path()


@pytest.fixture(scope="module")
def tokenizer(path):
    return Tokenizer.from_file(path)


def check_plan(histogram, sequence):
    runs = packing.plan(dict(histogram), sequence)
    placed, held = Counter(), defaultdict(list)
    for run in runs:
        placed[run.length] += run.count
        for at in range(run.count):
            held[run.bins + at].append((run.offset, run.length))
    assert placed == Counter(histogram)
    for parts in held.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= sequence
    return len(held)


def test_plan_of_known_optimum():
    assert check_plan({60: 10, 40: 10}, 100) == 10
    assert check_plan({50: 7}, 100) == 4
    assert check_plan({1: 250}, 100) == 3
    assert check_plan({100: 5, 1: 1}, 100) == 6
    assert check_plan({}, 100) == 0


@pytest.mark.parametrize("seed", range(4))
def test_plan_is_close_to_the_lower_bound(seed):
    chance = np.random.default_rng(seed)
    lengths = np.minimum(4096, chance.lognormal(6, 1, 3000).astype(int) + 1)
    histogram = {int(n): int(c) * (1 + 40 * seed) for n, c in Counter(lengths.tolist()).items()}
    total = sum(n * c for n, c in histogram.items())
    assert check_plan(histogram, 4096) <= 1.02 * -(-total // 4096) + 1


def test_ids_are_the_tokenizer_s_own(path, tokenizer, document_rows):
    odd = [
        "it's don't a.b,c... x..y <|endoftext|> x<|endoftext|>y ΑΣ Σ. İx é é,, 你好。 ﬁ ½ a​b \x1c x́ ẞ. word...,",
        "CAPS, Caps. caps 1234 a1b2", "  x", ".,.,", "",
    ]
    texts = odd + [text for _, text in document_rows]
    own = packing.WordTokenizer(path)
    for text, ids in zip(texts, own.ids(texts), strict=True):
        wanted = tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == wanted


def check_packed(rows, found, tokenizer, sequence):
    wanted, held = Counter(), defaultdict(list)
    for doc, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, packing.END]
        for piece, start in enumerate(range(0, len(ids), sequence)):
            own = ids[start : start + sequence]
            crc = zlib.crc32(np.asarray(own, "<u4").tobytes())
            wanted[(doc, piece, start, len(own), crc)] += 1
    assert Counter(tuple(row)[:5] for row in found) == wanted
    for row in found:
        held[row["sequence_id"]].append((row["offset"], row["length"]))
    for parts in held.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= sequence
    return len(held)


@pytest.mark.parametrize("sequence", [64, 4096])
def test_packed(awkward, empty, documents, document_rows, tokenizer, sequence):
    check_packed(awkward_rows(), packing.packed(awkward, sequence=sequence).collect(), tokenizer, sequence)
    found = packing.packed(documents, sequence=sequence).collect()
    bins = check_packed(document_rows, found, tokenizer, sequence)
    assert bins <= 1.1 * -(-sum(r["length"] for r in found) // sequence) + 1
    assert packing.packed(empty, sequence=sequence).count() == 0
