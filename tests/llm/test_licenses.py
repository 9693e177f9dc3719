import random

import pytest

from tremor.llm import licenses, queries
from .test_resample import WORDS, lower


def words(text):
    return WORDS.findall(lower(text or ""))


def base(text):
    own = words(text)
    places = [(i, label) for phrase, label in licenses.PHRASES for i in range(len(own))
              if own[i:i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in places]
    return (len(own), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places})))


def spans_by_all_diagonals(text):
    """Every diagonal of every template as a candidate, without votes."""
    own = [w.encode() for w in words(text)]
    known = licenses.templates()
    return licenses.verify(own, [(n, list(range(-len(t.words), len(own)))) for n, t in enumerate(known)], known)


def test_query_equals_brute_force(spark, sf, documents):
    got = {r["doc_id"]: r for r in queries.QUERIES["op13_licenses"](spark, sf).collect()}
    rows = documents.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    named = 0
    for r in rows:
        g, b = got[r["doc_id"]], base(r["text"])
        spans = spans_by_all_diagonals(r["text"]) if "icense" in (r["text"] or "") else []
        labels = {s.label for s in spans} | set(filter(None, b[4].split(",")))
        assert (g["n_words"], g["n_base"], g["first_word"], g["last_word"], g["base_labels"]) == b
        assert g["labels"] == ",".join(sorted(labels))
        assert g["score"] == pytest.approx(1.0 if b[1] else max((s.coverage for s in spans), default=0.0))
        named += bool(labels)
    assert 0 < named < len(rows) / 4


LONG = {label: text for label, text in licenses.TEMPLATES if len(text) > 200}


def scan(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r for r in sorted(licenses.scan(df).collect(), key=lambda r: r["id"])]


def edited(text, rng, share):
    """Words of a text with a share of them replaced, dropped or followed by another."""
    out = []
    for w in text.split():
        roll = rng.random()
        out += [] if roll < share / 3 else ["zzz"] if roll < 2 * share / 3 else [w, "zzz"] if roll < share else [w]
    return " ".join(out)


def test_edited_copies_are_found_inside_other_text(spark):
    rng = random.Random(8)
    filler = lambda n: " ".join(rng.choice("lorem ipsum dolor sit amet the of software in use".split()) for _ in range(n))
    texts = [filler(300) + "\n# " + edited(t, rng, 0.04) + "\n" + filler(200) for t in LONG.values()]
    for label, text, r in zip(LONG, texts, scan(spark, texts)):
        assert label in r["labels"].split(","), (label, r["labels"])
        span = [s for s in r["spans"] if s["label"] == label][0]
        assert 280 <= span["first"] and span["last"] <= len(words(text)) - 180


def test_prose_and_fragments_have_no_label(spark):
    rng = random.Random(9)
    scrambled = [" ".join(rng.sample(t.split(), len(t.split()))) for t in LONG.values()]
    halves = [" ".join(t.split()[:len(t.split()) // 2]) for label, t in LONG.items() if label not in ("apache", "gpl")]
    for r in scan(spark, scrambled + halves + ["the license of the software is in use under the terms"]):
        assert r["base_labels"] == "" and r["labels"] == "", r


def test_the_more_specific_notice_wins(spark):
    rows = scan(spark, ["Licensed under CC BY-NC 4.0.", "x licensed under CC-BY-SA", "licensed under CC BY", "mit license MIT License mit LICENSE",
                        "Licensed under CC BY-NC-SA.\n\nReleased under the MIT License."])
    assert [r["labels"] for r in rows] == ["cc-by-nc", "cc-by-sa", "cc-by", "mit", "cc-by-nc-sa,mit"]
    assert (rows[3]["n_base"], rows[3]["first_word"], rows[3]["last_word"], rows[3]["score"]) == (3, 0, 4, 1.0)


def test_many_copies_in_one_long_text(spark):
    notice = "released under the MIT License. "
    rows = scan(spark, [notice * 20_000, " ".join(["under the license"] * 30_000)])
    assert rows[0]["n_words"] == 100_000 and rows[0]["n_base"] == 20_000 and len(rows[0]["spans"]) >= 10_000
    assert rows[1]["labels"] == "" and rows[1]["n_words"] == 90_000


def test_hard_rows(spark, hard, empty):
    rows = licenses.scan(hard).collect()
    texts = [r["text"] for r in hard.select("text").collect()]
    assert sorted(r["n_words"] for r in rows) == sorted(len(words(t)) for t in texts)
    assert {r["labels"] for r in rows} == {""} and {r["score"] for r in rows} == {0.0} and {r["first_word"] for r in rows} == {None}
    assert licenses.scan(empty).collect() == []


def test_templates_are_checked(spark):
    with pytest.raises(ValueError):
        licenses.templates([("x", "two words")])
    with pytest.raises(ValueError):
        licenses.templates([("x,y", "one two three")])
