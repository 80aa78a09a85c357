"""Brute force for the text operators."""

import hashlib
import re
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
CLEAN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def fingerprint(text, n=4):
    words = WORD.findall(lower(text))
    if not words:
        return 0
    size = min(n, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + size]).encode(), 42) for i in range(len(words) - size + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(fingerprints, radius=4):
    """{id: smallest id reachable}."""
    ids = sorted(fingerprints)
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in ids:
        for j in ids:
            if i < j and (fingerprints[i] ^ fingerprints[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def removals(docs, n=13):
    first = {}
    for i, text in docs:
        words = WORD.findall(text or "")
        for k in range(len(words) - n + 1):
            key = tuple(words[k : k + n])
            first[key] = min(first.get(key, i), i)
    out = {}
    for i, text in docs:
        words = WORD.findall(text or "")
        gone = {k + x for k in range(len(words) - n + 1) if first[tuple(words[k : k + n])] < i for x in range(n)}
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        out[i] = (len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def contamination(docs, items, n=8):
    windows = defaultdict(set)
    for item, text in items:
        words = CLEAN.findall(lower(text))
        for k in range(max(1, len(words) - n + 1) if words else 0):
            windows[tuple(words[k : k + n])].add(str(item))
    out = {}
    for i, text in docs:
        words, hit, found = CLEAN.findall(lower(text)), set(), set()
        for w, own in windows.items():
            for k in range(len(words) - len(w) + 1):
                if tuple(words[k : k + len(w)]) == w:
                    hit.update(range(k, k + len(w)))
                    found |= own
        out[i] = (len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(found) >= 2)
    return out


def base_rules(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = Counter(windows)
    hit = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)
