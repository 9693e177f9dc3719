import random
import re

import duckdb
import pytest

from tremor.llm import lineruns, queries

WORD = re.compile("[^\x20\x09-\x0D]+")


def slow(rows, min_words):
    """Deleted lines by definition: every run of at least min_words words that occurs
    earlier, blank lines aside. ``rows``: (id, text), distinct."""
    seqs = []
    for i, text in rows:
        lines = (text or "").split("\n")
        seqs.append([(k, s, len(WORD.findall(s))) for k, s in enumerate(lines) if WORD.search(s)])
    seen, gone = set(), [set() for _ in rows]
    for d in sorted(range(len(rows)), key=lambda d: rows[d][0]):
        q = seqs[d]
        for a in range(len(q)):
            total = 0
            for b in range(a, len(q)):
                total += q[b][2]
                run = tuple(s for _, s, _ in q[a:b + 1])
                if total >= min_words:
                    if run in seen:
                        gone[d].update(k for k, _, _ in q[a:b + 1])
                    seen.add(run)
    return {rows[d][0]: sorted(gone[d]) for d in range(len(rows))}


def run(spark, rows, min_words):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = lineruns.dedup_lines(df, min_words=min_words).collect()
    for r in out:
        lines = dict(rows)[r["doc_id"]].split("\n")
        assert r["text"] == "\n".join(s for k, s in enumerate(lines) if k not in set(r["deleted_lines"]))
    return {r["doc_id"]: r["deleted_lines"] for r in out}


@pytest.mark.parametrize("min_words,seed", [(1, 1), (5, 2), (8, 3), (20, 4)])
def test_random_documents_equal_brute_force(spark, min_words, seed):
    rng = random.Random(seed)
    vocabulary = ["a", "b b", "c c c", "d d d d d", "", "  ", "e e", "f", "g g g g g g g g"] + [f"u{k}" for k in range(3)]
    rows = [(k, "\n".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 25)))) for k in range(25)]
    rows += [(100 + k, rows[k][1]) for k in range(5)] + [(200, "\n".join(["g g g g g g g g"] * 50))]
    assert run(spark, rows, min_words) == slow(rows, min_words)


def test_hot_line_is_divided(spark, monkeypatch):
    monkeypatch.setattr(lineruns, "ROWS_PER_RANGE", 7)
    rng = random.Random(9)
    rows = [(k, "\n".join(["the common line of all", rng.choice("xyzw") + " next line", "tail " + rng.choice("pq")])) for k in range(60)]
    assert run(spark, rows, 6) == slow(rows, 6)


def test_a_long_passage_across_documents(spark):
    passage = "\n".join(" ".join(f"p{k}_{j}" for j in range(20)) for k in range(3))
    rows = [(1, "intro one\n" + passage + "\nend"), (2, passage), (3, "other text\n\n" + passage + "\nmore"), (4, "clean text of its own")]
    assert run(spark, rows, 20) == {1: [], 2: [0, 1, 2], 3: [2, 3, 4], 4: []}


def test_hard_rows(hard, empty):
    out = lineruns.dedup_lines(hard, min_words=4)
    rows = out.collect()
    assert out.columns == [*hard.columns, "deleted_lines"] and len(rows) == 11
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append((r["text"], r["deleted_lines"]))
    assert by[2] == [(None, [])] and by[3] == [("", [])] and by[1][0][1] == []
    assert by[5][0] == by[5][1] and by[5][0][1] == []  # one document read twice
    assert sorted(x[1] for x in by[7]) == [[], [0]]
    assert lineruns.dedup_lines(empty).collect() == []
    with pytest.raises(ValueError):
        lineruns.dedup_lines(hard.withColumnRenamed("id", "Deleted_Lines"))


def test_query_equals_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    cur = con.execute(queries.SQL["op6_line_dedup"])
    names = [d[0] for d in cur.description]
    want = sorted(cur.fetchall())
    got = sorted(tuple(r) for r in queries.op6_line_dedup(spark, sf).select(*names).collect())
    assert got == want
