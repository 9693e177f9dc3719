import zlib
from collections import Counter

import numpy as np
import pytest

from tremor.llm import langid


def slow_profile(texts, size=300):
    total = Counter()
    for t in texts:
        for w in langid.WORD.findall((t or "").lower()):
            p = f" {w} "
            total.update(w)
            total.update(p[i:i + n] for n in (2, 3) for i in range(len(p) - n + 1))
    return [g for g, _ in sorted(total.items(), key=lambda x: (-x[1], langid_order(x[0])))[:size]]


def langid_order(gram):
    v = 0
    for c in gram:
        v = (v << 21) | ord(c)
    return v


def slow_predict(profiles, text, size=300):
    own = slow_profile([text], size)
    if not any(c.isalpha() for c in text or ""):
        return "und", 0.0
    cost = {lang: sum(abs(p.index(g) - i) if g in p else size for i, g in enumerate(own)) for lang, p in profiles.items()}
    best = min(sorted(cost), key=lambda x: cost[x])
    return best, 1 - cost[best] / (size * len(own))


def test_equals_brute_force_and_held_out_accuracy(documents):
    rows = documents.collect()
    held = {r["doc_id"]: zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in rows}
    texts = {}
    for r in rows:
        if not held[r["doc_id"]] and r["text"] is not None and r["lang"] is not None:
            texts.setdefault(r["lang"], []).append(r["text"])
    profiles = {lang: slow_profile(t) for lang, t in texts.items()}
    got = {r["doc_id"]: r for r in langid.identify(documents).collect()}
    assert len(got) == len(rows)
    for r in rows:
        lang, score = slow_predict(profiles, r["text"])
        assert (got[r["doc_id"]]["lang_pred"], got[r["doc_id"]]["held_out"]) == (lang, held[r["doc_id"]])
        assert got[r["doc_id"]]["score"] == pytest.approx(score)
    out = [got[r["doc_id"]]["lang_pred"] == r["lang"] for r in rows if held[r["doc_id"]]]
    assert np.mean(out) >= 0.97


def test_prediction_does_not_see_labels(spark, documents):
    from pyspark.sql import functions as F

    base = langid.learn(documents, "doc_id", "text", "lang")
    hidden = documents.withColumn("lang", F.when(~langid.held_out(F.col("doc_id")), F.col("lang")))
    assert langid.learn(hidden, "doc_id", "text", "lang") == base


def test_sample_bound(documents):
    few = langid.learn(documents, "doc_id", "text", "lang", size=50, per_language=5)
    assert set(few) <= {"en", "fr", "de", "es"} and all(len(v) <= 50 for v in few.values())


def test_hard_rows(hard, empty):
    rows = langid.identify(hard).collect()
    pred = {}
    for r in rows:
        pred.setdefault(r["doc_id"], []).append(r["lang_pred"])
        assert 0 <= r["score"] <= 1
    assert pred[2] == pred[3] == pred[4] == pred[8] == ["und"] and len(rows) == 11 and pred[5] == pred[5][:1] * 2
    assert langid.identify(empty).collect() == []
    kept = langid.identify(hard, carry=True)
    assert kept.columns == [*hard.columns, "held_out", "lang_pred", "score"]
    assert sorted(str(tuple(r)[:len(hard.columns)]) for r in kept.collect()) == sorted(str(tuple(r)) for r in hard.collect())
    with pytest.raises(ValueError):
        langid.identify(hard.withColumnRenamed("id", "Score"), carry=True)
