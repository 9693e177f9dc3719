import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tremor.llm import mixing

SCHEMA = "doc_id long, text string, source string, weight int, rest string"


def corpus(spark, sizes, words=10):
    rows, k = [], 0
    for s, n in sizes.items():
        for _ in range(n):
            rows.append((k, " ".join(["w"] * (1 + (k * 7) % (2 * words))), s, 1, "r"))
            k += 1
    return spark.createDataFrame(rows, SCHEMA)


def shares(df):
    out = Counter()
    for r in df.collect():
        out[r["source"]] += len(re.findall("[^\x20\x09-\x0D]+", r["text"] or ""))
    return out


def slow_exponent(tokens, entropy, repeats):
    """By fine bisection over the definition."""
    t = [v for v in tokens.values() if v]
    p = [v / sum(t) for v in t]

    def h(a):
        w = [x ** a for x in p]
        z = sum(w)
        return -sum(x / z * math.log(x / z) for x in w)

    def at(ok):
        lo, hi = 0.0, 1.0
        if ok(1.0):
            return 1.0
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if ok(mid) else (lo, mid)
        return lo

    a = [] if entropy is None else [at(lambda x: h(x) >= entropy * math.log(len(p)))]
    if repeats is not None:
        a.append(max(0.0, 1 - math.log(repeats) / math.log(max(p) / min(p))))
    return max(a)


@pytest.mark.parametrize("entropy,repeats", [(0.9, 4.0), (0.95, 1.5), (None, 1.25), (0.99, None), (1.0, 100.0)])
def test_weights_and_budgets(spark, entropy, repeats):
    df = corpus(spark, {"big": 600, "mid": 150, "small": 40, "tiny": 12})
    tokens = shares(df)
    a = slow_exponent(tokens, entropy, repeats)
    out = mixing.mix(df, target_entropy=entropy, max_repeats=repeats, block_docs=32)
    read, got = shares(out), Counter()
    longest = 20
    for s, t in tokens.items():
        # The largest source is read once; the others (share / largest share)^(a - 1) times.
        want = t * (tokens["big"] / t) ** (1 - a)
        assert abs(read[s] - want) <= longest + 1, (s, read[s], want)
    rows = out.collect()
    for r in rows:
        got[r["doc_id"]] += 1
    assert len(got) == df.count()
    times = {}
    for r in df.collect():
        times.setdefault(r["source"], set()).add(got[r["doc_id"]])
    assert all(max(v) - min(v) <= 1 for v in times.values()) and times["big"] == {1}


def test_last_epoch_is_a_prefix_of_its_permutation(spark):
    df = corpus(spark, {"big": 500, "small": 200})
    out = mixing.mix(df, target_entropy=1.0, max_repeats=None, block_docs=16)
    rows = [r for r in out.collect() if r["source"] == "small"]
    last = max(r["epoch"] for r in rows)
    full = {(r["doc_id"]) for r in rows if r["epoch"] == 0}
    assert full == {r["doc_id"] for r in df.collect() if r["source"] == "small"}
    orders = {e: [r["doc_id"] for r in sorted((r for r in rows if r["epoch"] == e), key=lambda r: (r["block"], r["place"]))] for e in range(last)}
    assert len({tuple(o) for o in orders.values()}) == len(orders)  # another permutation each epoch
    assert len({r["block"] for r in rows if r["epoch"] == 0}) > 5


def test_budget_below_the_corpus(spark):
    df = corpus(spark, {"big": 600, "small": 100})
    out = mixing.mix(df, target_entropy=1.0, max_repeats=None, budget=2000, block_docs=8)
    read = shares(out)
    assert all(abs(read[s] - 1000) <= 20 for s in ("big", "small"))


def test_natural_mix_reads_everything_once(spark):
    df = corpus(spark, {"a": 50, "b": 50})
    assert mixing.mix(df, target_entropy=None, max_repeats=1.0).count() == 100


def test_hard_rows(hard, empty):
    out = mixing.mix(hard, max_repeats=2.0)
    assert out.columns == [*hard.columns, "epoch", "block", "place"]
    first = out.where("epoch = 0").select(*[F.col(f"`{c}`") for c in hard.columns])
    assert sorted(str(tuple(r)) for r in first.collect()) == sorted(str(tuple(r)) for r in hard.collect())
    assert mixing.mix(empty).collect() == []
    with pytest.raises(ValueError):
        mixing.mix(hard.withColumnRenamed("id", "Epoch"))


def test_deterministic(spark, documents):
    pick = lambda: sorted(map(tuple, mixing.mix(documents.repartition(5)).select("doc_id", "epoch", "block", "place").collect()))
    assert pick() == pick()
