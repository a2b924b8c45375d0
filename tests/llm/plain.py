"""The operators' rules computed plainly, one row after the other, without their code."""

import re
import zlib
from collections import Counter

import numpy as np

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def lowered(raw):
    return bytes(b + 32 if 65 <= b <= 90 else b for b in raw)


def words(text, lower=False):
    raw = (text or "").encode()
    return WORD.findall(lowered(raw) if lower else raw)


def statistics(text):
    raw, own = (text or "").encode(), words(text)
    letters = b"".join(own)
    share = lambda kinds: (sum(letters.count(bytes([k])) for k in kinds) / (100 + len(letters))) ** 0.5
    n = len(own) + 20
    return [
        np.log((100 + len(letters)) / n), share(range(65, 91)), share(range(48, 58)), share(b"#$%&*|@^~=+<>{}[]\\/_`!"), share(b".,;:'\"?()-"),
        np.log(len(set(own)) + 20) / np.log(n), (sum(a == b for a, b in zip(own, own[1:])) / n) ** 0.5, ((sum(len(w) <= 3 for w in own) + 5) / n) ** 0.5,
    ]


def quality(texts, labels):
    """Scores by id: the two classes' Gaussians with covariances shrunk by a tenth towards their mean variance."""
    x = {d: np.array(statistics(t)) for d, t in texts.items()}
    own = {c: np.array([x[d] for d, q in labels.items() if q == c and d in x and zlib.crc32(str(d).encode()) % 4 != 2]) for c in (0, 1)}
    every = np.concatenate([own[0], own[1]])
    centre, scale = every.mean(axis=0), every.std(axis=0)
    logs = []
    for c in (0, 1):
        z = (own[c] - centre) / scale
        cov = np.cov(z.T, bias=True)
        cov = 0.9 * cov + 0.1 * np.trace(cov) / len(cov) * np.eye(len(cov))
        logs.append(lambda v, m=z.mean(axis=0), s=cov, p=len(own[c]) / len(every): np.log(p) - 0.5 * np.linalg.slogdet(s)[1] - 0.5 * (v - m) @ np.linalg.solve(s, v - m))
    score = lambda v: 1 / (1 + np.exp(np.clip(logs[0](v) - logs[1](v), -500, 500)))
    return {d: score((v - centre) / scale) for d, v in x.items()}


def fewest_edits(item, text):
    """Between the item and any stretch of the text, by the whole table of the edit distance."""
    names = {w: i for i, w in enumerate({*item, *text})}
    symbols, idx = np.array([names[w] for w in text], int), np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, int)
    for w in item:
        step = row + 1
        step[1:] = np.minimum(step[1:], row[:-1] + (symbols != names[w]))
        row = np.minimum.accumulate(step - idx) + idx
    return int(row.min())


def leaks(texts, items):
    """(document, item) with the fewest edits, where they are a fifth of the item's words at most."""
    wanted = {i: words(t, True) for i, t in items.items()}
    out = {}
    for d, t in texts.items():
        own = words(t, True)
        for i, item in wanted.items():
            if item and own and (n := fewest_edits(item, own)) <= len(item) // 5:
                out[d, i] = n
    return out


def components(texts):
    """Smallest id reachable over links of similarity three quarters."""
    sets = {}
    for d, t in texts.items():
        w = words(t, True)
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {d: d for d in texts}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    order = sorted(texts)
    for k, a in enumerate(order):
        for b in order[:k]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: find(d) for d in texts}


def common_leaves(a, b):
    """Share of the characters of two texts that lie in sentences which both have: an upper bound for what equal branches can tell."""
    cut = lambda t: Counter(x for line in t.split("\n") for x in re.findall(r"[^.!?]*[.!?]+\s*|[^.!?]+", line))
    x, y = cut(a), cut(b)
    size = sum(len(k) * n for k, n in (x + y).items())
    return 2 * sum(len(k) * n for k, n in (x & y).items()) / size if size else 1.0
