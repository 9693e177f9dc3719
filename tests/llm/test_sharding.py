import pytest

from tremor.llm import sharding

NAMES = [f"shard-{k:03d}" for k in range(64)]


def slow_fill(names, size):
    """Each turn, each shard in order claims the first free slot of its permutation."""
    import hashlib

    prefer = []
    for n in names:
        d = hashlib.sha256(n.encode()).digest()
        a, b = int.from_bytes(d[:8], "big") % size, int.from_bytes(d[8:16], "big") % (size - 1) + 1
        prefer.append([(a + b * j) % size for j in range(size)])
    owner = {}
    while len(owner) < size:
        for k in range(len(names)):
            free = [s for s in prefer[k] if s not in owner]
            if free:
                owner[free[0]] = k
    return [owner[s] for s in range(size)]


def test_fill_by_definition_and_balance():
    assert sharding.fill(NAMES[:5], 101) == slow_fill(NAMES[:5], 101)
    owner = sharding.fill(NAMES)
    counts = [owner.count(k) for k in range(64)]
    assert max(counts) - min(counts) <= 1


def test_few_slots_move_when_a_shard_leaves():
    a, b = sharding.fill(NAMES), sharding.fill(NAMES[:-1])
    moved = sum(x != y for x, y in zip(a, b) if x != 63)
    assert moved < 0.05 * len(a)


def test_query_equals_the_table(spark, documents):
    out = sharding.shard(documents, NAMES).select("doc_id", "slot", "shard").collect()
    owner = sharding.fill(NAMES)
    assert len(out) == documents.count()
    assert all(r["shard"] == NAMES[owner[r["slot"]]] for r in out)


def test_slots_are_the_hash_of_the_key(spark):
    import xxhash

    df = spark.createDataFrame([(k, "t") for k in (0, 1, -5, 10 ** 15)], "doc_id long, text string")
    for r in sharding.shard(df, NAMES).collect():
        h = xxhash.xxh64(r["doc_id"].to_bytes(8, "little", signed=True), seed=42).intdigest()
        assert r["slot"] == (h - (1 << 64) if h >> 63 else h) % sharding.TABLE_SIZE


def test_hard_rows(hard, empty):
    out = sharding.shard(hard, NAMES)
    rows = out.collect()
    assert len(rows) == 11 and out.columns[-2:] == ["slot", "shard"] and out.columns[:-2] == hard.columns
    assert all(r["shard"] in NAMES for r in rows)
    assert len({r["shard"] for r in rows if r["doc_id"] == 5}) == 1
    assert sharding.shard(empty, NAMES).collect() == []
    with pytest.raises(ValueError):
        sharding.shard(hard.withColumnRenamed("id", "Shard"), NAMES)
    for bad in ((NAMES, 100), ([], 101), (["a", "a"], 101), (NAMES, 61)):
        with pytest.raises(ValueError):
            sharding.fill(*bad)
