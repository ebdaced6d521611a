"""Plain single-process versions of the operators' contracts, for small tables."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

import regex

SECRETS = [
    (
        "assign",
        r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        lambda m: len(m[1]) >= 8,
    ),
    ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 16),
    ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 32),
]


def digits(text):
    return re.sub(r"[^0-9]", "", text)


def luhn(text):
    total = 0
    for at, digit in enumerate(reversed(text)):
        value = int(digit) * (1 + at % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


PERSONAL = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    (
        "ip",
        r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        lambda m: all(int(part) <= 255 for part in m[0].split(".")),
    ),
    (
        "card",
        r"[0-9]([\x20-]?[0-9])+",
        lambda m: 14 <= len(digits(m[0])) <= 19 and luhn(digits(m[0])),
    ),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m[0])) <= 15),
]


def spans(kinds, text):
    """(start, rank, end, kind) sorted."""
    return sorted(
        (m.start(), rank, m.end(), kind)
        for rank, (kind, pattern, passes) in enumerate(kinds)
        for m in re.finditer(pattern, text or "")
        if passes(m)
    )


def listed(found):
    return ",".join(f"{kind}:{start}:{end}" for start, _, end, kind in found)


def words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())


def shingles(text):
    split = [w.lower() for w in words(text)]
    if not split:
        return set()
    size = min(5, len(split))
    return {tuple(split[at : at + size]) for at in range(len(split) - size + 1)}


def components(texts):
    """Index of the first text of each text's component."""
    sets = [shingles(text) for text in texts]
    root = list(range(len(texts)))

    def find(node):
        while root[node] != node:
            node = root[node]
        return node

    for a, first in enumerate(sets):
        for b in range(a):
            common = len(first & sets[b])
            if common and 100 * common >= 75 * len(first | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [find(node) for node in range(len(texts))]


def removed(texts, length=200):
    """(n_removed, n_spans, kept) of each text."""
    raw = [(text or "").encode() for text in texts]
    times = Counter(r[at : at + length] for r in raw for at in range(len(r) - length + 1))
    out = []
    for r in raw:
        covered = bytearray(len(r))
        for at in range(len(r) - length + 1):
            if times[r[at : at + length]] > 1:
                covered[at : at + length] = b"\1" * length
        runs = sum(c and not before for c, before in zip(covered, b"\0" + covered, strict=False))
        kept = bytes(b for b, c in zip(r, covered, strict=True) if not c)
        out.append((sum(covered), runs, kept))
    return out


def measures(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    split = [w.decode() for w in words(text)]
    lines, seen, repeated_lines = text.split("\n"), set(), 0
    for line in lines:
        if words(line):
            repeated_lines += line in seen
            seen.add(line)
    windows = [tuple(split[at : at + 3]) for at in range(len(split) - 2)]
    times = Counter(windows)
    covered = {at + k for at, w in enumerate(windows) if times[w] > 1 for k in range(3)}
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return len(split), sum(map(len, split)), symbols, repeated_lines, len(covered)


def contained(text, items):
    """Ids of the items (id, text) of which three quarters of the shingles are in the text."""
    split = [w.lower() for w in words(text)]
    out = []
    for item_id, item in items:
        wanted = shingles(item)
        if not wanted:
            continue
        size = len(next(iter(wanted)))
        own = {tuple(split[at : at + size]) for at in range(len(split) - size + 1)}
        if 100 * len(wanted & own) >= 75 * len(wanted):
            out.append(item_id)
    return sorted(set(out))


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def sanitised(pii, rows, alpha):
    """Listed spans and new text of each row (doc_id, text), by counting documents in plain Python."""
    pattern = regex.compile(pii.TERM)
    rows = [(doc_id, text or "") for doc_id, text in rows]
    total = max(2, len(rows))
    base = [spans(PERSONAL, text) for _, text in rows]
    held = [{(kind, text[a:b]) for a, _, b, kind in own} for (_, text), own in zip(rows, base, strict=True)]
    words_of = [{m[0].lower() for m in pattern.finditer(text)} for _, text in rows]
    classes_of = [
        {w[:n] + "*" for w in own for n in pii.LEVELS if len(w) > n} for own in words_of
    ]
    n = Counter(w for own in words_of for w in own) + Counter(c for own in classes_of for c in own)
    n_entity = Counter(e for own in held for e in own)
    together, copies = Counter(), defaultdict(set)
    for (_, text), own, entities in zip(rows, words_of, held, strict=True):
        for e in entities:
            for w in own:
                together[e, w] += 1
                copies[e, w].add(text)

    def reveals(entity, word):
        content = math.log(total / n_entity[entity])
        k = len(copies[entity, word])
        p = (k - 1 / 3) / (k * n[word] / together[entity, word] + 1 / 3)
        return content > 0 and 1 + math.log(p) / content >= 1 / alpha

    out = []
    for (_, text), own, entities in zip(rows, base, held, strict=True):
        added, label = [], {}
        for m in pattern.finditer(text):
            if any(a < m.end() and m.start() < b for a, _, b, _ in own):
                continue
            word = m[0].lower()
            if not any(reveals(e, word) for e in entities):
                continue
            most = max(n_entity[e] ** (1 / alpha) * total ** (1 - 1 / alpha) for e in entities)
            safe = [word[:k] + "*" for k in pii.LEVELS if k < len(word) and n[word[:k] + "*"] > most]
            kind = "term_generalised" if safe else "term_removed"
            added.append((m.start(), pii.TERM_RANKS[kind], m.end(), kind))
            label[m.start()] = max(safe, key=len, default="")
        new, at = [], 0
        for start, _, end, kind in sorted(own + added):
            if start >= at:
                new += [text[at:start], label[start] if kind in pii.TERM_RANKS else f"[{kind.upper()}]"]
            at = max(at, end)
        out.append((listed(sorted(own + added)), "".join(new) + text[at:]))
    return out
