"""Plain versions of what the operators compute, for small inputs."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text, n):
    w = WORD.findall(lower(text))
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def linked_components(sets, percent):
    """``sets``: list of (id, set); the smallest id of each row's component."""
    found = defaultdict(list)
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, s) in enumerate(sets):
        for j, overlap in Counter(j for g in s for j in found[g]).items():
            if 100 * overlap >= percent * (len(s) + len(sets[j][1]) - overlap):
                parent[max(root(i), root(j))] = min(root(i), root(j))
        for g in s:
            found[g].append(i)
    least = {}
    for i, (key, _) in enumerate(sets):
        least.setdefault(root(i), []).append(key)
    return [min(least[root(i)]) for i in range(len(sets))]


def targets(sizes, weights=(3, 1, 2), share=1.5, cap=2.0):
    """``sizes``: size by source. The excess over a cap is shared out again until no source is above."""
    order = sorted(sizes, key=lambda s: (s is None, s.encode() if s is not None else b""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out, free = {}, set(order)
    total = share * sum(sizes.values())
    while True:
        left = total - sum(out.values())
        unit = left / sum(weight[s] for s in free) if free else 0
        over = [s for s in free if unit * weight[s] > cap * sizes[s]]
        if not over:
            return {**out, **{s: unit * weight[s] for s in free}}
        for s in over:
            out[s] = cap * sizes[s]
            free.remove(s)


SECRET = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)


def secret_spans(text):
    text, spans = text or "", []
    spans += [(m.start(), 0, m.end()) for m in SECRET.finditer(text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(("assign", "access", "hex")[k], a, e) for a, k, e in sorted(spans)]
