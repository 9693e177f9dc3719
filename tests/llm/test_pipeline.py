"""The pipeline against the operators' definitions, stage by stage, and its contract."""

from collections import Counter

import corpus_pipeline as pipe
from pyspark.sql import functions as F

from tremor.llm import langid, queries

from .test_langid import slow_predict, slow_profile
from .test_lineruns import slow as slow_lines
from .test_packing import check
from .test_simhash import expected as slow_groups

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_equal_brute_force(spark, sf, documents, tmp_path):
    docs, kept = documents, {}
    for k, (name, stage) in enumerate(pipe.STAGES):
        out = stage(spark, docs, sf)
        out.write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        kept[name] = ([r.asDict() for r in docs.collect()], [r.asDict() for r in out.collect()])
        if k < len(pipe.STAGES) - 1:
            assert out.columns == COLUMNS
        docs = out
    before, after = kept["language_id"]
    train = {}
    for r in before:
        if not spark.range(1).select(langid.held_out(F.lit(r["doc_id"]))).first()[0] and r["text"] and r["lang"]:
            train.setdefault(r["lang"], []).append(r["text"])
    profiles = {lang: slow_profile(t) for lang, t in train.items()}
    ok = [r["doc_id"] for r in before if (p := slow_predict(profiles, r["text"]))[0] != "und" and p[1] >= pipe.MIN_LANGUAGE_SCORE]
    assert sorted(r["doc_id"] for r in after) == sorted(ok)
    before, after = kept["line_dedup"]
    gone = slow_lines([(r["doc_id"], r["text"]) for r in before], pipe.MIN_RUN_WORDS)
    want = {}
    for r in before:
        text = "\n".join(s for k, s in enumerate(r["text"].split("\n")) if k not in set(gone[r["doc_id"]]))
        if not gone[r["doc_id"]] or text.split():
            want[r["doc_id"]] = (text, len(text) if gone[r["doc_id"]] else r["n_chars"])
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in after} == want
    before, after = kept["simhash_near_dedup"]
    groups = slow_groups([(r["doc_id"], r["text"]) for r in before])
    assert sorted(r["doc_id"] for r in after) == sorted({c for _, _, c in groups})
    before, after = kept["mixing"]
    times = Counter(r["doc_id"] for r in after)
    assert set(times) == {r["doc_id"] for r in before} and max(times.values()) <= 2
    before, after = kept["packing"]
    texts = {}
    for r in before:
        texts.setdefault(r["doc_id"], []).append(r["text"])
    check(after, texts)


def test_run_takes_hard_rows(spark, hard, empty, tmp_path):
    for name, df in (("hard", hard), ("empty", empty)):
        base = tmp_path / name
        df.select(*COLUMNS).write.parquet(str(base / "documents.parquet"))
        rows = pipe.run(spark, str(base)).collect()
        assert bool(rows) == (name == "hard")
    assert {r["doc_id"] for r in rows} == set()


NAMES = ("slot", "shard", "deleted_lines", "epoch", "block", "place", "score", "held_out", "lang_pred", "Rank")


def test_documents_with_the_names_of_results(spark, documents, tmp_path):
    """Queries and stages take tables that have columns called like their results."""
    few = documents.limit(60).select("*", *[F.lit("own").alias(n) for n in NAMES]).cache()
    few.write.parquet(f"{tmp_path}/documents.parquet")
    few.limit(3).select("text").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name in ("op2_sharding", "op6_line_dedup", "op10_mixing", "op12_resampling"):
        assert queries.QUERIES[name](spark, str(tmp_path)).count() >= 60, name
    for name, stage in pipe.STAGES[:-1]:
        out = stage(spark, few, str(tmp_path))
        assert out.columns == few.columns, name
        assert {tuple(r) for r in out.select(*NAMES).distinct().collect()} == {("own",) * len(NAMES)}, name
