import hashlib
import math
import random
import re
from zlib import crc32

import numpy as np

from tremor.llm import queries, resample
from tremor.llm.common import Scratch

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def runs(text):
    words = WORDS.findall(lower(text))
    return words, [" ".join(words[i:i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def brute(docs, target, buckets=10_000, percent=5, min_words=20, seed=42):
    """docs: (id, text) rows; the result rows in the order of ``docs``."""
    s, t = [0] * buckets, [0] * buckets
    for counts, texts in ((s, [x for _, x in docs]), (t, target)):
        for text in texts:
            for f in runs(text)[1]:
                counts[crc32(f.encode("utf-8", "surrogatepass")) % buckets] += 1
    S, T = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((b + 1) * (S + buckets) / ((a + 1) * (T + buckets)))) for a, b in zip(s, t)]
    out = []
    for i, text in docs:
        words, found = runs(text)
        weight = sum(gain[crc32(f.encode("utf-8", "surrogatepass")) % buckets] for f in found)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words) >= min_words])
    drawn = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0]))
    rank = {id(r): n + 1 for n, r in enumerate(drawn[:len(drawn) * percent // 100])}
    return [(*r[:4], rank.get(id(r))) for r in out]


def canon(rows):
    return sorted([tuple(r) for r in rows], key=lambda r: tuple((x is None, x) for x in r))


def test_query_equals_brute_force(spark, sf, documents):
    docs = [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]
    target = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = brute(docs, target)
    got = queries.QUERIES["op12_resampling"](spark, sf)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert canon(got.collect()) == canon(want)
    assert sum(r[4] is not None for r in want) > 5


def test_hard_rows(spark, hard, empty):
    target = spark.createDataFrame([("one two Three four",), (None,), ("",)], "text string")
    docs = [(r["doc_id"], r["text"]) for r in hard.select("doc_id", "text").collect()]
    got = resample.resample(hard, target, min_words=3, percent=60)
    assert canon(got.collect()) == canon(brute(docs, ["one two Three four", None, ""], min_words=3, percent=60))
    assert resample.resample(empty, target).collect() == []
    nothing = resample.resample(hard, target.limit(0), min_words=3, percent=60)
    assert canon(nothing.collect()) == canon(brute(docs, [], min_words=3, percent=60))


def test_pieces_of_a_long_text_have_all_features():
    text = " ".join(random.Random(3).choice(["alpha", "b", "Cé", "漢字", "x9"]) for _ in range(500))
    whole = np.sort(np.concatenate([f for _, f in resample.features(text, 10_000)]))
    for size in (1, 2, 7, 40):
        parts = list(resample.features(text, 10_000, size))
        assert sum(n for n, _ in parts) == 500 and len(parts) > 5
        assert (np.sort(np.concatenate([f for _, f in parts])) == whole).all()


def test_radix_sort_is_stable_on_any_longs(spark):
    rng = random.Random(4)
    keys = [-(1 << 63), (1 << 63) - 1, 0, -1, 1] + [rng.randrange(-50, 50) for _ in range(300)] + [7] * 200
    rng.shuffle(keys)
    rows = spark.createDataFrame([(n, k, k % 3) for n, k in enumerate(keys)], "pos long, key long, minor long")
    for order in (["key"], ["minor", "key"]):
        done = resample.radix_sort(Scratch(spark, "radix"), rows.withColumnRenamed("pos", "was").selectExpr("was", "was as pos", "key", "minor"),
                                   order, bits=8, block_rows=64)
        got = [r["was"] for r in done.orderBy("pos").collect()]
        assert sorted(r["pos"] for r in done.collect()) == list(range(len(keys)))
        want = sorted(range(len(keys)), key=lambda n: tuple({"key": keys[n], "minor": keys[n] % 3}[c] for c in order))
        assert got == want


def test_equal_keys_stay_in_blocks(spark):
    """A key that all rows share is sorted in groups of at most a block."""
    rows = spark.range(1000).selectExpr("id as pos", "cast(5 as long) as key", "id as was")
    one = resample.counting_pass(rows, "key", 0, bits=4, block_rows=100)
    assert [r["was"] for r in one.orderBy("pos").collect()] == list(range(1000))
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(block" in plan
