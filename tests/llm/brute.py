"""Plain Python versions of the operators, straight from their definitions, for small inputs."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def components(nodes, edges):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def ngram_join(docs):
    sets = {}
    for i, t in docs:
        w = SPLIT.findall(lower(t or ""))
        sets[i] = {tuple(w[k:k + 3]) for k in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} if w else set()
    by = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            by[x].append(i)
    edges = []
    for i, s in sets.items():
        common = Counter(j for x in s for j in by[x] if j > i)
        edges += [(i, j) for j, c in common.items() if 100 * c >= 90 * (len(s) + len(sets[j]) - c)]
    own = components(sets, edges)
    return {(i, len(s), own[i]) for i, s in sets.items()}


def substring(docs, size=20):
    words = {i: SPLIT.findall(t or "") for i, t in docs}
    first, out = {}, set()
    for i in sorted(words):
        w = words[i]
        gone = set()
        for k in range(len(w) - size + 1):
            key = tuple(w[k:k + size])
            if key in first:
                gone.update(range(k, k + size))
            else:
                first[key] = (i, k)
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.add((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def secrets(docs):
    out = set()
    for i, t in docs:
        t = t or ""
        spans = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
        spans += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        spans += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        n = Counter(s[2] for s in spans)
        text = ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(spans))
        out.add((i, n["assign"], n["access"], n["hex"], hashlib.sha256(text.encode()).hexdigest()))
    return out


def exact(docs):
    by = defaultdict(list)
    for i, t in docs:
        by[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    return {(i, min(g), len(g), i == min(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in by.items() for i in g}


PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))


def licenses(docs):
    out = set()
    for i, t in docs:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or ""))
        at = [(k, label) for p, label in PHRASES for k in range(len(w)) if w[k:k + len(p.split())] == p.split()]
        starts = [k for k, _ in at]
        out.add((i, len(w), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at}))))
    return out


def quality(docs):
    out = set()
    for i, t in docs:
        t = t or ""
        w = SPLIT.findall(t)
        lines = [x for x in t.split("\n") if SPLIT.search(x)]
        windows = Counter(tuple(w[k:k + 5]) for k in range(len(w) - 4))
        again = {j for k in range(len(w) - 4) if windows[tuple(w[k:k + 5])] > 1 for j in range(k, k + 5)}
        out.add((i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(again),
                 len(w) < 10 or 100 * len(again) > 20 * len(w)))
    return out


def pieces(docs, encode, window=1024):
    out = Counter()
    for i, t in docs:
        ids = [*encode(t or ""), 0]
        for a in range(0, len(ids), window):
            p = ids[a:a + window]
            out[i, a, len(p), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in p)), len(ids)] += 1
    return out


def near_kept(docs, size=5, num=80, den=100):
    """Documents that name their component, from all pairs of shingle sets."""
    sets = {}
    for i, t in docs:
        w = SPLIT.findall(lower(t or ""))
        sets[i] = {tuple(w[k:k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
    by = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            by[x].append(i)
    edges = []
    for i, s in sets.items():
        common = Counter(j for x in s for j in by[x] if j > i)
        edges += [(i, j) for j, c in common.items() if den * c >= num * (len(s) + len(sets[j]) - c)]
    return {i for i, c in components(sets, edges).items() if i == c}
