import random

import numpy as np

from tremor.llm import hamming


def brute(codes, queries, k):
    out = []
    for q, qc in queries.items():
        near = sorted((bin(c ^ qc).count("1"), i) for i, c in codes.items() if i != q)[:k]
        out += [(q, i, d, n + 1) for n, (d, i) in enumerate(near)]
    return sorted(out)


def frame(spark, codes, words=1):
    mask = (1 << 64) - 1
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows = [(i, [signed(c >> 64 * w & mask) for w in range(words)]) for i, c in codes.items()]
    return spark.createDataFrame(rows, "id long, code array<long>")


def result(df):
    return sorted((r["query_id"], r["id"], r["distance"], r["rank"]) for r in df.collect())


def test_clustered_and_equal_codes(spark):
    rng = random.Random(5)
    centres = [rng.getrandbits(64) for _ in range(6)]
    codes = {i: rng.choice(centres) ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 2))) & ((1 << 64) - 1) for i in range(150)}
    codes |= {1000 + i: centres[0] for i in range(120)}  # one code of very many rows
    codes |= {2000 + i: rng.getrandbits(64) for i in range(30)}
    asked = {i: c for i, c in codes.items() if i % 25 == 0}
    assert result(hamming.search(frame(spark, codes), frame(spark, asked), 5, bits=8)) == brute(codes, asked, 5)


def test_two_words_and_fewer_rows_than_k(spark):
    rng = random.Random(6)
    codes = {i: rng.getrandbits(128) for i in range(6)}
    assert result(hamming.search(frame(spark, codes, 2), frame(spark, codes, 2), 10, bits=8)) == brute(codes, codes, 10)


def test_hard_rows(spark):
    schema = "vec_id long, embedding array<float>, label int, id string, code int"
    vec = [1.0, -1.0] * 32
    rows = [(0, vec, 1, "x", 1), (0, vec, 1, "x", 1), (50, [-x for x in vec], 1, "y", 1), (3, None, 1, "z", 1), (None, vec, 1, "n", 1),
            (4, [1.0], 1, "s", 1), (5, [None, *vec[1:]], 1, "e", 1), (6, [float("nan"), *vec[1:]], 1, "f", 1)]
    df = spark.createDataFrame(rows, schema)
    got = result(hamming.nearest_by_sign(df, bits=8))
    assert [g for g in got if g[0] == 0] == [(0, 5, 1, 2), (0, 6, 0, 1), (0, 50, 64, 3)]
    assert len(got) == 6
    assert hamming.nearest_by_sign(df.limit(0)).collect() == []


def test_query_equals_brute_force(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    codes = {r["vec_id"]: int.from_bytes(np.packbits(np.array(r["embedding"]) > 0).tobytes(), "big") for r in df.collect()}
    asked = {i: c for i, c in codes.items() if i % 50 == 0}
    assert result(hamming.nearest_by_sign(df)) == brute(codes, asked, 10)


def test_vectors_of_other_lengths(spark):
    rng = np.random.default_rng(9)
    for dims in (128, 40):
        x = rng.normal(size=(60, dims))
        rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)] + [(900, [1.0]), (950, None), (951, [])]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        codes = {i: sum(int(v > 0) << k for k, v in enumerate(row)) for i, row in enumerate(x)}
        asked = {i: c for i, c in codes.items() if i % 50 == 0}
        assert result(hamming.nearest_by_sign(df, bits=8)) == brute(codes, asked, 10)
