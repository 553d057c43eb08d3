"""Plain versions of the operators, for small inputs."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def find(parent, x):
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def near_duplicates(rows, size, percent):
    """doc_id -> (n_shingles, component_id, kept) for distinct ids."""
    sets = {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        sets[d] = frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])
    parent = {d: d for d in sets}
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            if x and y:
                n = len(x & y)
                if 100 * n >= percent * (len(x) + len(y) - n):
                    p, q = find(parent, a), find(parent, b)
                    parent[max(p, q)] = min(p, q)
    return {d: (len(s), find(parent, d), find(parent, d) == d) for d, s in sets.items()}


def vectors(rows, threshold=0.93):
    """[(vec_id, n_links, component_id)] in order of rows with distinct ids."""
    good = [(v, lab, np.array(e, float)) for v, lab, e in rows if lab is not None and e is not None and all(x is not None for x in e) and np.isfinite(e).all() and np.any(e)]
    parent, links = {v: v for v, _, _ in rows}, Counter()
    for i, (v, lab, e) in enumerate(good):
        for u, lab2, f in good[:i]:
            if lab == lab2 and len(e) == len(f) and e @ f / np.sqrt((e @ e) * (f @ f)) >= threshold:
                links[v] += 1
                links[u] += 1
                p, q = find(parent, v), find(parent, u)
                parent[max(p, q)] = min(p, q)
    return {v: (links[v], find(parent, v)) for v, _, _ in rows}


def repeats(rows, length):
    """[(n_bytes, n_removed, n_spans, digest)] in order of rows."""
    raws = [(t or "").encode() for _, t in rows]
    seen = Counter(b[i : i + length] for b in raws for i in range(len(b) - length + 1))
    out = []
    for b in raws:
        cover = np.zeros(len(b) + 1, int)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                cover[i] += 1
                cover[i + length] -= 1
        hit = np.cumsum(cover)[:-1] > 0
        rest = np.frombuffer(b, np.uint8)[~hit].tobytes()
        out.append((len(b), int(hit.sum()), int((np.diff(np.concatenate(([0], hit.astype(int)))) == 1).sum()), hashlib.sha256(rest).hexdigest()))
    return out


def shared_words(rows, n):
    """[(covered words, runs)] of strings of n words that a row of another id holds too, in order of rows."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", lower(t)) for _, t in rows]
    holders = defaultdict(set)
    for (d, _), w in zip(rows, words):
        for i in range(len(w) - n + 1):
            holders[tuple(w[i : i + n])].add(d)
    out = []
    for w in words:
        hit = [0] * (len(w) + 1)
        for i in range(len(w) - n + 1):
            if len(holders[tuple(w[i : i + n])]) > 1:
                hit[i : i + n] = [1] * n
        out.append((sum(hit), sum(hit[i] > (hit[i - 1] if i else 0) for i in range(len(w)))))
    return out


def contamination(rows, items, window=10):
    """[(n_words, n_hit, items)] in order of rows."""
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = defaultdict(set)
    for i, t in items:
        w = word.findall(lower(t))
        for k in range(max(1, len(w) - window + 1) if w else 0):
            windows[tuple(w[k : k + window])].add("" if i is None else str(i))
    out = []
    for _, t in rows:
        w = word.findall(lower(t))
        hit, found = [0] * len(w), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    found |= windows[tuple(w[k : k + n])]
                    hit[k : k + n] = [1] * n
        out.append((len(w), sum(hit), ",".join(sorted(found))))
    return out


def secrets(text):
    """[(kind, start, end)] of the base kinds."""
    text = text or ""
    assign = re.compile(r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.A)
    found = [(m.start(), 0, m.end(), "assign") for m in assign.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return [(k, s, e) for s, _, e, k in sorted(found)]


def targets(sizes):
    """source -> target, by handing the excess round until none is above its cap."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    capped, total = {}, sum(sizes.values())
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(capped.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return capped | share
        capped |= {s: 3.0 * sizes[s] for s in over}
