"""Plain versions of the operators for small inputs."""

import hashlib
import re

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fingerprint(text, width=4):
    lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = WORD.findall(lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(ids, prints, radius=4):
    """The smallest id reachable for each row."""
    distinct = sorted(set(prints))
    values, label = np.array(distinct, np.uint64), list(range(len(distinct)))

    def find(x):
        while label[x] != x:
            label[x] = label[label[x]]
            x = label[x]
        return x

    for i in range(len(distinct)):
        for j in np.flatnonzero(np.bitwise_count(values[i + 1 :] ^ values[i]) <= radius) + i + 1:
            label[find(int(j))] = find(i)
    at = {p: find(i) for i, p in enumerate(distinct)}
    least = {}
    for d, p in zip(ids, prints, strict=True):
        if d is not None:
            least[at[p]] = min(d, least.get(at[p], d))
    return [least.get(at[p]) for p in prints]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()
