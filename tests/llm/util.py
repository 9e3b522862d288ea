"""Plain Python forms of the contracts, and awkward documents."""

import hashlib
import random
import re
from collections import defaultdict

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
UPPER_LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def words(text, fold=False):
    text = text or ""
    return SPACED.findall(text.translate(UPPER_LOWER) if fold else text)


def shingle_set(text, k=5):
    w = words(text, True)
    m = min(k, len(w))
    return {tuple(w[i : i + m]) for i in range(len(w) - m + 1)} if m else set()


def components(texts):
    """doc_id -> smallest doc_id reachable by links of Jaccard 0.8 or more."""
    sets = {d: shingle_set(t) for d, t in texts.items()}
    root = {d: d for d in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}


def dedup(texts, window=20):
    """doc_id -> (n_words, n_removed, kept words)."""
    seen, out = set(), {}
    for d in sorted(texts):
        w = words(texts[d])
        gone = set()
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            if key in seen:
                gone |= set(range(i, i + window))
            seen.add(key)
        out[d] = (len(w), len(gone), [x for i, x in enumerate(w) if i not in gone])
    return out


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def corpus(seed=1):
    """doc_id -> text with copies, near copies, shared passages, nulls, empties and a long text."""
    rng = random.Random(seed)
    texts = {i: prose(rng, rng.randrange(1, 120)) for i in range(40)}
    passage, base = prose(rng, 60), prose(rng, 150)
    for i in range(40, 50):
        texts[i] = prose(rng, 30) + "\n" + passage + "\t" + prose(rng, 15)
    for i in range(50, 75):
        w = base.split()
        for _ in range(rng.randrange(0, 4)):
            w[rng.randrange(len(w))] = "changed"
        texts[i] = " ".join(w)
    texts |= {75: texts[3], 76: texts[3].upper(), 77: None, 78: "", 79: " \n\t", 80: "one two", 81: "one two", 82: "One Two three", 83: prose(rng, 5000), 84: "é😀 ﬁ ſecret \x0b K", 85: passage * 3}
    return texts


def rows(spark, texts):
    """documents with columns whose names clash with the operators' own."""
    data = [(d, t, None if d % 7 == 0 else f"s{d % 4}", "x", 1, "r", 0.5, "f") for d, t in texts.items()]
    return spark.createDataFrame(data, "doc_id long, text string, source string, root string, n long, id string, score double, fp string").repartition(3)


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def base_spans(text):
    """The contract's patterns, applied literally."""
    text, out = text or "", []
    kinds = {
        "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m.group(2)) >= 12),
        "access": (re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m.group()) >= 18),
        "hex": (re.compile(r"[0-9a-f]+"), lambda m: len(m.group()) >= 16),
    }
    for k, (p, ok) in kinds.items():
        out += [(k, m.start(), m.end()) for m in p.finditer(text) if ok(m)]
    return sorted(out, key=lambda x: (x[1], list(kinds).index(x[0])))


def phrase_places(text, phrases):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER_LOWER))
    found = defaultdict(list)
    for p, label in phrases.items():
        k = p.split()
        found[label] += [i for i in range(len(w)) if w[i : i + len(k)] == k]
    return len(w), {k: v for k, v in found.items() if v}
