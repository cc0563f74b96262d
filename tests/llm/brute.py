"""Plain versions of the operators' rules, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
from xxhash import xxh64_intdigest

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = str.maketrans(UPPER, UPPER.lower())
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fold(text):
    return (text or "").translate(LOWER)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def fingerprint(text):
    words = WORD.findall(fold(text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    bits = [2 * sum(h >> b & 1 for h in hashes) > len(hashes) for b in range(64)]
    return sum(1 << b for b, one in enumerate(bits) if one)


def components(ids, values, max_bits):
    """Smallest id reachable over values at most ``max_bits`` bits apart."""
    array = np.array(values, np.uint64)
    parent = list(range(len(ids)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(array[i + 1 :] ^ array[i]) <= max_bits) + i + 1:
            parent[find(j)] = find(i)
    smallest = {}
    for i, ident in enumerate(ids):
        smallest[find(i)] = min(ident, smallest.get(find(i), ident))
    return {ident: smallest[find(i)] for i, ident in enumerate(ids)}


def repeated_words(words):
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts = Counter(grams)
    covered = set()
    for i, g in enumerate(grams):
        if counts[g] > 1:
            covered |= {i, i + 1, i + 2}
    return len(covered)


def luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


BASE = (
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda m: True),
    (
        "ip",
        re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        lambda m: all(int(p) <= 255 for p in m.split(".")),
    ),
    (
        "card",
        re.compile(r"[0-9]([\x20-]?[0-9])+"),
        lambda m: 14 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and luhn(d),
    ),
    (
        "phone",
        re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
        lambda m: 10 <= len(re.sub("[^0-9]", "", m)) <= 15,
    ),
)


def base_spans(text):
    found = []
    for rank, (kind, pattern, valid) in enumerate(BASE):
        for m in pattern.finditer(text or ""):
            if valid(m.group()):
                found.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(s for _, _, s in sorted(found))


def targets(sizes, cap=3):
    """Target of each source by resharing the excess until nothing is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    full = set()
    total = sum(sizes.values())
    while True:
        rest = [s for s in names if s not in full]
        level = (total - sum(cap * sizes[s] for s in full)) / (sum(weight[s] for s in rest) or 1)
        over = {s for s in rest if weight[s] * level > cap * sizes[s]}
        if not over:
            return {s: cap * sizes[s] if s in full else weight[s] * level for s in names}
        full |= over


def shared_runs(texts, n):
    """(i, place) where document i has n words in a row that an earlier one has."""
    seen, found = {}, []
    for i, text in enumerate(texts):
        words = WORD.findall(fold(text))
        grams = [" ".join(words[p : p + n]) for p in range(len(words) - n + 1)]
        found += [(i, p) for p, g in enumerate(grams) if g in seen]
        for g in grams:
            seen.setdefault(g, i)
    return found


def common_words(a, b):
    """Length of a longest common subsequence."""
    line = [0] * (len(b) + 1)
    for word in a:
        last = 0
        for j, other in enumerate(b, 1):
            last, line[j] = line[j], last + 1 if word == other else max(line[j], line[j - 1])
    return line[-1]


def spectrum(text):
    """Strings of one to three signs of a text of a-z words, spaces around it."""
    line = re.sub("[^a-z]+", " ", f" {text.lower()} ")
    return {line[i : i + n] for n in (1, 2, 3) for i in range(n == 1, len(line) - n + (n != 1))}


def kernel(texts, others):
    """Shared n-grams over the geometric mean of the set sizes."""
    left, right = [spectrum(t) for t in texts], [spectrum(t) for t in others]
    return [[len(a & b) / (len(a) * len(b)) ** 0.5 for b in right] for a in left]
