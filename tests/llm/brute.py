"""Plain versions of the operators, for comparison on small inputs."""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import xxhash

SPACE = " \t\n\x0b\f\r"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(s: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def kept_lines(rows: list[tuple[int | None, str | None]]) -> list[tuple[int, int, str]]:
    ids: dict[str, set] = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            k = lower(x.strip(SPACE))
            if len(k) >= 20 and i is not None:
                ids[k].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if len(ids.get(k := lower(x.strip(SPACE)), ())) < 3 or i == max(ids[k])]
        out.append((len(lines), len(lines) - len(keep), "\n".join(keep)))
    return out


def fingerprint(text: str | None, n: int = 3) -> int:
    w = [x for x in re.split(r"[\x20\x09-\x0d]+", lower(text or "")) if x]
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + n]).encode(), 42) for i in range(max(1, len(w) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(fps: list[int], ids: list[int]) -> list[int]:
    f = np.array(fps, dtype=np.uint64)
    up = list(range(len(f)))

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for i in range(len(f)):
        for j in np.flatnonzero(np.bitwise_count(f ^ f[i]) <= 3):
            a, b = find(i), find(int(j))
            up[a] = b
    low: dict[int, int] = {}
    for i, x in enumerate(ids):
        low[find(i)] = min(low.get(find(i), x), x)
    return [low[find(i)] for i in range(len(f))]


def overlap(text: str | None, items: list[tuple[int, str | None]]) -> tuple[int, int, list[str]]:
    w = WORD.findall(lower(text or ""))
    hit, found = set(), set()
    for item, t in items:
        b = WORD.findall(lower(t or ""))
        n = min(10, len(b))
        grams = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)} if n else set()
        for i in range(len(w) - n + 1):
            if tuple(w[i : i + n]) in grams:
                hit |= set(range(i, i + n))
                found.add(str(item))
    return len(w), len(hit), sorted(found)
