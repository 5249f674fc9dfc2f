"""Plain versions of the operators, for small inputs."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(b):
    return hashlib.sha256(b).hexdigest()


def substring_words(rows, window=50):
    least = {}
    tokens = {i: WORD.findall(t or "") for i, t in rows}
    for i, w in tokens.items():
        for p in range(len(w) - window + 1):
            k = tuple(w[p : p + window])
            least[k] = min(least.get(k, i), i)
    out = {}
    for i, w in tokens.items():
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            if least[tuple(w[p : p + window])] < i:
                gone[p : p + window] = [True] * window
        kept = [x for x, g in zip(w, gone) if not g]
        out[i] = (len(w), sum(gone), sha(" ".join(kept).encode()))
    return out


def substring_bytes(rows, window=200):
    texts = [(i, (t or "").encode()) for i, t in rows]
    count = Counter(b[p : p + window] for _, b in texts for p in range(len(b) - window + 1))
    out = []
    for i, b in texts:
        gone = [False] * len(b)
        for p in range(len(b) - window + 1):
            if count[b[p : p + window]] > 1:
                gone[p : p + window] = [True] * window
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone) if not g))))
    return sorted(out, key=str)


def lower_ascii(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def contamination(rows, items, window=13):
    index = defaultdict(set)
    sizes = set()
    for item, text in items:
        w = ITEM_WORD.findall(lower_ascii(text or ""))
        for p in range(max(1, len(w) - window + 1)) if w else ():
            k = tuple(w[p : p + window])
            index[k].add(item)
            sizes.add(len(k))
    out = {}
    for i, t in rows:
        w = ITEM_WORD.findall(lower_ascii(t or ""))
        hit, found = [False] * len(w), set()
        for z in sizes:
            for p in range(len(w) - z + 1):
                if (k := tuple(w[p : p + z])) in index:
                    found |= index[k]
                    hit[p : p + z] = [True] * z
        n = sum(hit)
        out[i] = (len(w), n, len(found), sha(",".join(sorted(map(str, found))).encode()), n > 0 and 20 * n >= len(w))
    return out


def near_links(rows, k=5, least=0.8):
    """Pairs of rows with word-shingle Jaccard of ``least`` or more, and the class (least id) of every row."""
    sets = {}
    for i, t in rows:
        w = WORD.findall(t or "")
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}
