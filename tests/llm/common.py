"""Small fixtures and brute-force counterparts."""

import itertools
import re

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")
VOCABULARY = "byte_bpe_50k.json"


def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(VOCABULARY)
    return path, Tokenizer.from_file(path)


def joined(n, links):
    """The smallest member of each one's component."""
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return [find(i) for i in range(n)]


def jaccard(rows, k=4, num=85, den=100):
    """id -> (set size, smallest id of the component), over all pairs."""
    rows = sorted(rows)
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else []))
    links = [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j])]
    root = joined(len(rows), links)
    return {rows[i][0]: (len(sets[i]), rows[root[i]][0]) for i in range(len(rows))}


def cosines(rows, t):
    """id -> (links, smallest id of the component), over all pairs."""
    rows = sorted(rows, key=lambda r: r[0])
    ok = [r[2] is not None and len(r[2]) > 0 and all(x is not None and np.isfinite(x) for x in r[2]) and any(r[2]) and r[1] is not None for r in rows]
    links = []
    for i, j in itertools.combinations(range(len(rows)), 2):
        if ok[i] and ok[j] and rows[i][1] == rows[j][1] and len(rows[i][2]) == len(rows[j][2]):
            x, y = np.array(rows[i][2], float), np.array(rows[j][2], float)
            if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= t:
                links.append((i, j))
    root = joined(len(rows), links)
    return {r[0]: (sum(i in x for x in links), rows[root[i]][0]) for i, r in enumerate(rows)}


def shuffled(spark, run):
    """Bytes that the stages of run() write to shuffles."""

    def stages():
        context = spark.sparkContext._jsc.sc()
        context.listenerBus().waitUntilEmpty(30_000)
        store = context.statusStore()
        found = store.stageList(*(getattr(store, f"stageList$default${i}")() if i > 1 else None for i in range(1, 6)))
        return {(s.stageId(), s.attemptId()): s.shuffleWriteBytes() for s in map(found.apply, range(found.size()))}

    before = stages()
    run()
    return sum(n for key, n in stages().items() if key not in before)
