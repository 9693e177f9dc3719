import random
import re

import numpy as np
import xxhash

from tremor.llm import simhash


def slow_fingerprint(text, n=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall("[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    shingles = [" ".join(w[i:i + n]) for i in range(len(w) - n + 1)] or [" ".join(w)]
    hs = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute(fps, budget=2):
    up = {x: x for x in fps}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    u = np.array(sorted(fps), dtype=np.uint64)
    for i in range(len(u)):
        for j in np.flatnonzero(np.bitwise_count(u[i + 1:] ^ u[i]) <= budget):
            a, b = root(int(u[i])), root(int(u[i + 1 + j]))
            up[max(a, b)] = min(a, b)
    return {x: root(x) for x in fps}


def expected(rows):
    fp = [slow_fingerprint(t) for _, t in rows]
    root = brute(set(fp))
    least = {}
    for (i, _), f in zip(rows, fp):
        if i is not None:
            least[root[f]] = min(i, least.get(root[f], i))
    return sorted(((i, f"{f:016x}", least.get(root[f])) for (i, _), f in zip(rows, fp)), key=str)


def test_groups_equal_brute_force(documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in simhash.groups(documents).collect()), key=str)
    assert got == expected(rows)
    assert len({c for _, _, c in got}) < len(rows)


def test_hard_rows(hard, empty):
    rows = [(r["doc_id"], r["text"]) for r in hard.collect()]
    assert sorted((tuple(r) for r in simhash.groups(hard).collect()), key=str) == expected(rows)
    assert simhash.groups(empty).collect() == []
    one = simhash.one_per_group(hard)
    assert one.columns == hard.columns
    kept = [(r["doc_id"], r["text"]) for r in one.collect()]
    want = expected(rows)
    assert len(kept) == len({c for _, _, c in want})
    assert sorted(k for k, _ in kept if k is not None) == sorted({c for _, _, c in want if c is not None})
    assert simhash.one_per_group(empty).collect() == []


def test_links_over_many_blocks(spark, monkeypatch):
    rng = random.Random(3)
    fps = {0, 1, 3, (1 << 64) - 1}
    for _ in range(200):
        x = rng.getrandbits(64)
        fps.add(x)
        for _ in range(rng.randint(0, 12)):
            for _ in range(rng.randint(1, 3)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    # A dense region: very many fingerprints under one node.
    fps |= {rng.getrandbits(12) for _ in range(300)}
    monkeypatch.setattr(simhash, "block_size", lambda n, most: 64)
    scratch = simhash.Scratch(spark, "test")
    df = scratch.keep(spark.createDataFrame([(simhash._signed(x),) for x in fps], "fp long"), "fp")
    roots = {r["node"]: r["root"] for r in simhash.components(scratch, simhash.links(scratch, df)).collect()}
    got, want = {}, {}
    for x in fps:
        s = simhash._signed(x)
        got.setdefault(roots.get(s, s), set()).add(x)
    for x, r in brute(fps).items():
        want.setdefault(r, set()).add(x)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_components_of_a_long_chain_and_a_star(spark):
    scratch = simhash.Scratch(spark, "test")
    edges = [(k, k + 1) for k in range(1, 400)] + [(1000, k) for k in range(2000, 2400)] + [(5000, 5000)]
    df = scratch.keep(spark.createDataFrame(edges, "u long, v long"), "e")
    roots = {r["node"]: r["root"] for r in simhash.components(scratch, df).collect()}
    assert all(roots[k] == 1 for k in range(2, 401)) and all(roots[k] == 1000 for k in range(2000, 2400))
