"""Plain versions of the training-data operators, for small inputs."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def sha(data) -> str:
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def windows(words, size):
    size = min(size, len(words))
    return [tuple(words[a : a + size]) for a in range(len(words) - size + 1)] if size else []


def contaminated(docs, items, window=10):
    """docs, items: lists of (id, text); rows (words, hits, item ids, contaminated)."""
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    known = defaultdict(set)
    for item, text in items:
        for one in windows(split(text), window):
            known[one].add("null" if item is None else str(item))
    sizes = {len(one) for one in known}
    out = []
    for _, text in docs:
        words, hit, found = split(text), set(), set()
        for size in sizes:
            for a in range(len(words) - size + 1):
                got = known.get(tuple(words[a : a + size]))
                if got:
                    hit.update(range(a, a + size))
                    found |= got
        out.append((len(words), len(hit), sorted(found), bool(hit)))
    return out


def shingles(text, size=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if len(words) >= size:
        return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    return frozenset([tuple(words)]) if words else frozenset()


def classes(docs, size=4, least=(85, 100)):
    """Rows (set size, smallest id reachable) of documents with unique ids."""
    sets = {key: shingles(text, size) for key, text in docs}
    root = {key: key for key in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    lists = defaultdict(list)
    for key, mine in sets.items():
        common = Counter(other for s in mine for other in lists[s])
        for s in mine:
            lists[s].append(key)
        for other, n in common.items():
            if least[1] * n >= least[0] * (len(mine) + len(sets[other]) - n):
                a, b = find(key), find(other)
                root[max(a, b)] = min(a, b)
    return {key: (len(sets[key]), find(key)) for key in sets}


def repeats(texts, length=100):
    """Rows (bytes, removed, spans, kept bytes) of texts in order."""
    seen, out = set(), []
    for text in texts:
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for a in range(len(data) - length + 1):
            one = data[a : a + length]
            if one in seen:
                gone[a : a + length] = True
            seen.add(one)
        edges = np.diff(np.concatenate([[0], gone.astype(int), [0]]))
        kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
        out.append((len(data), int(gone.sum()), int((edges == 1).sum()), kept))
    return out


def crc_mod3(key) -> int:
    return zlib.crc32(str(key).encode()) % 3


LICENSES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def license_places(text):
    """Words and the places of the base phrases, as (word, label)."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    found = []
    for phrase, label in LICENSES.items():
        parts = phrase.split()
        found += [(a, label) for a in range(len(words)) if words[a : a + len(parts)] == parts]
    return len(words), sorted(found)


def ranked(docs, items, k=50):
    """Rows (item, rank, doc, score) of lists of (id, text); ids are unique."""
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    counts = {key: Counter(split(text)) for key, text in docs}
    counts = {key: c for key, c in counts.items() if c}
    sizes = {key: sum(c.values()) for key, c in counts.items()}
    total, n = sum(sizes.values()), len(counts)
    holding = Counter(t for c in counts.values() for t in c)
    out = []
    for item, text in items:
        terms = set(split(text))
        scores = {}
        for key, c in counts.items():
            m = 50 + (50 * sizes[key] * n) // total
            score = 0
            for t in terms & c.keys():
                w = math.floor(1000 * math.log((2 * n + 2) / (2 * holding[t] + 1)))
                score += w * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m))
            if score > 0:
                scores[key] = score
        best = sorted(scores, key=lambda d: (-scores[d], d))[:k]
        out += [(item, place + 1, d, scores[d]) for place, d in enumerate(best)]
    return out


def planted_words(key, text):
    """Words of a document with the stretch that its id makes repeat."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(key).encode()), len(words)
    if key is None or h % 10 or not n:
        return words
    a = (h // 10) % n
    p = 1 + (n - a) // (3 + (h // 10) % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def periodic(words):
    """Runs (start, length, period) and the words that stay."""
    found = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i > start and i + q - start >= max(6, 4 * q):
                found.setdefault((start, i + q - start), q)
            i += i == start
    runs = sorted((s, n, q) for (s, n), q in found.items())
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return runs, [w for i, w in enumerate(words) if i not in gone]
