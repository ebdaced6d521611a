import hashlib
import random
import zlib
from collections import defaultdict

import brute
import pytest

from caseflow.llm import prefix_trie
from conftest import TABLES

SCHEMA = "conv_id long, turn long, role string, text string, node string, depth string, at string, name string"


def expected(rows):
    """The contract, one conversation after the other."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            key = hashlib.md5(f"{len(role or '')}:{role or ''}{text or ''}".encode()).digest()
            own[conv].append((turn is not None, turn or 0, key, role or "", text or ""))
    own = {c: [(r, t) for *_, r, t in sorted(turns)] for c, turns in own.items()}
    made = {}
    for c, turns in own.items():
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        h = zlib.crc32(str(c).encode()) % 4
        made[c] = own.get(base, [])[:h] + turns[h:]
    members, ends, children = defaultdict(list), defaultdict(list), defaultdict(set)
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
            if d:
                children[tuple(turns[: d - 1])].add(tuple(turns[:d]))
        ends[tuple(turns)].append(c)
    out = []
    leaves, saved = defaultdict(int), defaultdict(int)
    for node in sorted(members, key=len, reverse=True):
        words = len(brute.words(node[-1][1])) if node else 0
        leaves[node] += not children[node]
        saved[node] += (len(members[node]) - 1) * words
        if node:
            leaves[node[:-1]] += leaves[node]
            saved[node[:-1]] += saved[node]
    for node, inside in members.items():
        ids = ",".join(map(str, sorted(ends[node])))
        parent = min(members[node[:-1]]) if node else None
        out.append(
            (min(inside), len(node), parent, len(inside), len(children[node]), leaves[node], saved[node], brute.sha(ids))
        )
    return sorted(out, key=str)


def check(frame, rows):
    found = frame.collect()
    assert frame.columns == [
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"
    ]
    assert sorted((tuple(r) for r in found), key=str) == expected(rows)


def frame_of(spark, rows):
    return spark.createDataFrame([(*r, "n", "d", "a", "x") for r in rows], SCHEMA).repartition(3)


def test_tables(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{TABLES}/conversations.parquet").collect()]
    check(prefix_trie.op11_conversation_prefix_trie(spark, TABLES), rows)


def test_odd_rows(spark):
    rows = [
        (0, 1, "user", "hello there"), (0, None, "system", "be kind"), (0, 2, None, None), (0, 2, "user", "tie"),
        (0, 2, "user", "tie"), (1, 0, "user", "hello there"), (2, 5, "system", "be kind"), (2, 6, "user", "hello there"),
        (3, 0, "", ""), (3, 1, None, None), (25, 0, "user", "alone"), (45, 0, "u", "a b"), (45, 1, "u", "a\x0bb c"),
        (-3, 0, "user", "negative"), (-20, 0, "user", "hello there"), (None, 0, "user", "in none"),
        (40, 0, "ab", "c"), (60, 0, "a", "bc"), (7, 0, "system", "be kind"), (7, 1, "user", "x " * 20000),
        (7, 2, "user", "y"), (7, 3, "user", "z"), (8, 0, "user", "1"), (8, 1, "user", "2"), (8, 2, "user", "3"),
        (9223372036854775807, 0, "user", "last"),
    ]
    check(prefix_trie.prefix_trie(frame_of(spark, rows)), rows)


@pytest.mark.parametrize("seed", range(2))
def test_many_alike(spark, seed):
    """A few turns in all, so that prefixes meet at every depth; lengths around powers of two."""
    chance = random.Random(seed)
    rows = []
    for c in range(0, 400):
        length = chance.choice([1, 2, 3, 4, 7, 8, 9, 15, 16, 17])
        same = chance.random() < 0.4  # one large group
        for t in range(length):
            rows.append((c, t, "user", "always" if same else chance.choice(["a", "a", "a", "b c"])))
    check(prefix_trie.prefix_trie(frame_of(spark, rows)), rows)


def test_long_conversation_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", 4)
    chance = random.Random(9)
    rows = [(0, t, "user", "a" if t < 50 else str(t)) for t in range(90)]
    rows += [(c, t, "user", "a") for c in range(1, 24) for t in range(chance.randrange(1, 70))]
    check(prefix_trie.prefix_trie(frame_of(spark, rows)), rows)


def test_turnless_and_empty(spark):
    # crc32 of these ids leaves nothing of a single turn, and their family has no first conversation.
    alone = [c for c in range(21, 400) if c % 20 and zlib.crc32(str(c).encode()) % 4][:5]
    rows = [(c, 0, "user", "gone") for c in alone]
    check(prefix_trie.prefix_trie(frame_of(spark, rows)), rows)
    assert prefix_trie.prefix_trie(frame_of(spark, rows).limit(0)).count() == 0
    nothing = frame_of(spark, [(None, 0, "user", "x")])
    assert prefix_trie.prefix_trie(nothing).count() == 0


def test_sql_gives_the_same(spark):
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW conversations AS SELECT * FROM '{TABLES}/conversations.parquet'")
    cursor = connection.execute(prefix_trie.OP11_SQL)
    names = [c[0] for c in cursor.description]
    rows = [tuple(r) for r in spark.read.parquet(f"{TABLES}/conversations.parquet").collect()]
    order = [names.index(c) for c in (
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"
    )]
    assert sorted((tuple(r[i] for i in order) for r in cursor.fetchall()), key=str) == expected(rows)
