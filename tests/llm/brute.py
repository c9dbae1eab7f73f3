"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import math
from collections import Counter

import numpy as np

LOWER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def components(docs, percent: int = 85, k: int = 4) -> set:
    """(id, set size, smallest id reachable) by counting shared shingles of all pairs that share one."""
    sets = []
    for _, text in docs:
        w = (text or "").translate(LOWER).encode().split()
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    parent = list(range(len(docs)))

    def root(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    holders: dict = {}
    for i, s in enumerate(sets):
        shared = Counter(j for g in s for j in holders.get(g, ()))
        for j, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                parent[root(i)] = root(j)
        for g in s:
            holders.setdefault(g, []).append(i)
    least: dict[int, int] = {}
    for i, (d, _) in enumerate(docs):
        r = root(i)
        least[r] = min(least.get(r, d), d)
    return {(d, len(sets[i]), least[root(i)]) for i, (d, _) in enumerate(docs)}


def repeats(docs, n: int = 13) -> dict:
    """id -> (words, removed, digest of the kept words)."""
    first: dict = {}
    words = {d: (t or "").encode().split() for d, t in docs}
    for d, w in words.items():
        for i in range(len(w) - n + 1):
            g = tuple(w[i : i + n])
            first[g] = min(first.get(g, d), d)
    out = {}
    for d, w in words.items():
        gone = set()
        for i in range(len(w) - n + 1):
            if first[tuple(w[i : i + n])] < d:
                gone.update(range(i, i + n))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out[d] = (len(w), len(gone), hashlib.sha256(kept).hexdigest())
    return out


def parse(docs, n: int = 13) -> dict:
    """id -> spans (first word, words, reference, place, across a factor's end) of the greedy parse, for distinct ids.

    Word by word: the longest match of the words from here on with the places where windows stand first.
    """
    words = {d: (t or "").encode().split() for d, t in docs}
    first: dict = {}
    for d in sorted(words):
        for i in range(len(words[d]) - n + 1):
            first.setdefault(tuple(words[d][i : i + n]), (d, i))
    out = {}
    for d, w in words.items():
        at = lambda i: first.get(tuple(w[i : i + n])) if 0 <= i <= len(w) - n else None  # noqa: B023, E731

        def match(i: int, most: int = 1 << 60) -> tuple | None:
            """(words, reference, place) of the longest match from word i, of at most ``most`` windows."""
            got = at(i)  # noqa: B023
            if got is None or got[0] >= d:  # noqa: B023
                return None
            k = 1
            while k < most and at(i + k) == (got[0], got[1] + k):  # noqa: B023
                k += 1
            return k + n - 1, *got

        i, spans = 0, []
        while i <= len(w) - n:
            if (got := match(i)) is None:
                i += 1
                continue
            spans.append((i, *got, False))
            end, j = i + got[0], i + got[0] - n + 1
            while j < end:  # windows that start in the factor and end past it
                if more := match(j, end - j):
                    spans.append((j, *more, True))
                    j += more[0] - n + 1
                else:
                    j += 1
            i = end
        if spans:
            out[d] = spans
    return out


def minimax(sizes, shards: int) -> int:
    """The smallest largest run, by trying every cut."""
    best = [0] + [float("inf")] * len(sizes)
    for _ in range(shards):
        new = best[:]
        for j in range(1, len(sizes) + 1):
            total = 0
            for i in range(j - 1, -1, -1):
                total += sizes[i]
                new[j] = min(new[j], max(best[i], total))
        best = new
    return best[-1]


def plain_log_mel(payload: bytes, rate: int = 8000):
    """(frames, log-mel energies, segments in seconds) of 8-bit samples, by the definitions: one output at a time."""
    x = [(b - 128) / 128 for b in payload]
    half, cut = 32, 0.5  # half-length of the low-pass in input samples, its corner as a share of the input's
    taps = [np.sinc(t * cut) * (0.5 + 0.5 * math.cos(math.pi * t / half)) for t in range(-half, half)]
    scale = sum(taps)
    y = [sum(taps[t + half] / scale * x[j + t] for t in range(-half, half) if 0 <= j + t < len(x)) for j in range(0, len(x), 2)]
    rate, window, hop, mels = rate // 2, 256, 128, 16
    frames = max(1, -(-max(0, len(y) - window) // hop) + 1)
    y += [0.0] * ((frames - 1) * hop + window - len(y))
    mel = lambda f: 2595 * math.log10(1 + f / 700)
    low, high = mel(20.0), mel(rate / 2)
    edge = [700 * (10 ** ((low + (high - low) * i / (mels + 1)) / 2595) - 1) for i in range(mels + 2)]
    values, energy = [], []
    for f in range(frames):
        part = [y[f * hop + i] * (0.5 - 0.5 * math.cos(2 * math.pi * i / window)) for i in range(window)]
        energy.append(sum(v * v for v in part))
        power = [abs(v) ** 2 for v in np.fft.rfft(part)]
        row = []
        for m in range(mels):
            a, b, c = edge[m : m + 3]
            row.append(math.log(1e-6 + sum(p * max(0.0, min((k * rate / window - a) / (b - a), (c - k * rate / window) / (c - b))) for k, p in enumerate(power))))
        values.append(row)
    mean, spans, at = sum(energy) / frames, [], 0
    level = [10 * math.log10(e / mean + 1e-12) if mean > 0 else -99.0 for e in energy]
    while at < frames:
        end = at
        while end < frames and level[end] >= -6.0:
            end += 1
        if end - at >= 2 and max(level[at:end]) >= -3.0:
            spans.append((at * hop / rate, ((end - 1) * hop + window) / rate))
        at = max(end, at + 1)
    return frames, np.array(values), spans
