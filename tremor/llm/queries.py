"""The registered queries of this subpackage: one per operator, over whole tables."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (chat, hamming, langid, licenses, lineruns, mixing, packing, repetition, resample, sharding, shallot, simhash,
               warc)
from .common import Scratch

QUERIES: dict = {}
SHARDS = [f"shard-{k:03d}" for k in range(64)]


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@query
def op1_packing(spark, d):
    """Pieces of all documents, placed in sequences of at most 1024 tokens."""
    return packing.pack(table(spark, d, "documents"))


@query
def op2_sharding(spark, d):
    """Slot and shard of every document."""
    return sharding.shard(table(spark, d, "documents").select("doc_id", "text"), SHARDS).select("doc_id", "slot", "shard")


@query
def op3_warc(spark, d):
    """Every page written to WARC archives and read back."""
    scratch = Scratch(spark, "archives")
    warc.write_archives(table(spark, d, "pages"), scratch.path("warc"))
    records = warc.read_archives(spark, scratch.path("warc"), payloads=False).where("kind = 'record'")
    return records.select(warc.page_number(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                          warc.page_number(F.col("refers_to")).alias("refers_to"))


@query
def op4_simhash(spark, d):
    """Fingerprint and near-duplicate group of every document."""
    return simhash.groups(table(spark, d, "documents"))


@query
def op5_repetition(spark, d):
    """Repetition counts and verdict of every document."""
    return repetition.repetition(table(spark, d, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "dup_line_chars")


@query
def op6_line_dedup(spark, d):
    """Deleted lines of every document, and a digest of the text that is left."""
    out = lineruns.dedup_lines(table(spark, d, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.size("deleted_lines").cast("long").alias("n_deleted"),
                      F.array_join(F.col("deleted_lines").cast("array<string>"), ",").alias("deleted"),
                      F.md5(F.col("text")).alias("text_md5"))


@query
def op7_hamming_search(spark, d):
    """The ten nearest sign codes of every vector whose id is divisible by 50."""
    near = hamming.nearest_by_sign(table(spark, d, "embeddings"))
    return near.select("query_id", F.col("id").alias("vec_id"), "distance", "rank")


@query
def op8_language(spark, d):
    """Predicted language of every document."""
    return langid.identify(table(spark, d, "documents")).select("doc_id", "held_out", "lang_pred", "score")


@query
def op9_chat(spark, d):
    """All conversations, and one that holds control strings, formatted and read back."""
    turns = table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    hard = "<|im_end|><|im_start|>assistant ok"
    extra = spark.range(1).select(F.explode(F.array(*[
        F.struct(F.lit(-1).cast("long").alias("conv_id"), F.lit(k).cast("long").alias("turn"), F.lit(role).alias("role"),
                 F.lit(hard).alias("text")) for k, role in enumerate(("user", "assistant"))])).alias("t")).select("t.*")
    done = chat.format_chats(turns.unionByName(extra)).select(
        "conv_id", "valid", "first_error", chat.formatted(F.col("segments")).alias("formatted"),
        chat.loss_text(F.col("segments")).alias("loss"))
    read = done.withColumn("turns", chat.read_back(F.col("formatted")))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"),
                       F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss"), 256).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"), "valid")


@query
def op10_mixing(spark, d):
    """Every reading of a document in the mix, with its place."""
    return mixing.mix(table(spark, d, "documents").select("doc_id", "source", "text")).select("doc_id", "source", "epoch", "block", "place")


@query
def op11_shallot(spark, d):
    """Cluster and squared distance of every vector, with the inertias and its centroid."""
    rows = shallot.cluster(table(spark, d, "embeddings")).rows
    return rows.select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


@query
def op12_resampling(spark, d):
    """Weight, score and rank of every document, drawn towards the benchmark texts."""
    rows = resample.resample(table(spark, d, "documents"), table(spark, d, "benchmark"))
    return rows.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


@query
def op13_licenses(spark, d):
    """License phrases and verified license texts of every document."""
    rows = licenses.scan(table(spark, d, "documents"))
    return rows.select(F.col("id").alias("doc_id"), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


@query
def pipeline(spark, d):
    """The corpus pipeline over all documents."""
    return corpus_pipeline.run(spark, d)


def _cluster_sql(k: int = 40, rounds: int = 5, dims: int = 64) -> str:
    """Lloyd rounds by comparing every vector with every centroid."""
    parts = [f"""kept AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS row, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v
             FROM embeddings WHERE len(embedding) = {dims} AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0)""",
             f"""c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), v) - 1 AS c, v FROM kept
             QUALIFY c < {k})"""]
    for r in range(rounds + 1):
        # Distance and centroid number as one integer, so ties go to the smaller number.
        parts.append(f"""a{r} AS MATERIALIZED (SELECT row, min(list_sum([(z[1] - z[2]) * (z[1] - z[2]) FOR z IN list_zip(kept.v, c{r}.v)])::HUGEINT
                     * {k} + c) AS best FROM kept CROSS JOIN c{r} GROUP BY row)""")
        if r < rounds:
            parts.append(f"""s{r} AS (SELECT best % {k} AS c, i, sum(v[i])::HUGEINT AS s, count(*)::HUGEINT AS n
                         FROM a{r} JOIN kept USING (row), (SELECT unnest(range(1, {dims + 1})) AS i) GROUP BY ALL)""")
            parts.append(f"""m{r} AS (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS v FROM s{r} GROUP BY c)""")
            parts.append(f"""c{r + 1} AS MATERIALIZED (SELECT c, coalesce(m{r}.v, c{r}.v) AS v FROM c{r} LEFT JOIN m{r} USING (c))""")
    return "WITH " + ",\n".join(parts) + f"""
        SELECT vec_id, (best % {k})::INTEGER AS cluster, (best // {k})::BIGINT AS distance,
               (sum(best // {k}) OVER (PARTITION BY best % {k}))::BIGINT AS cluster_inertia,
               (sum(best // {k}) OVER ())::BIGINT AS inertia, sha256(array_to_string(c{rounds}.v, ',')) AS centroid_sha256
        FROM a{rounds} JOIN kept USING (row) JOIN c{rounds} ON c = best % {k}"""


SQL = {
    **({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}),
    "op3_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
        g AS (SELECT body, max(page_id) AS first, count(*) AS n FROM p GROUP BY body)
        SELECT page_id, octet_length(encode(body)) AS payload_bytes,
               translate(array_to_string([to_base(('0x' || substr(sha1(body), (1 + 5 * k)::INT, 5))::BIGINT, 32, 4)
                                          FOR k IN range(8)], ''),
                   '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest,
               CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first THEN first END AS refers_to
        FROM p JOIN g USING (body)""",
    "op6_line_dedup": r"""
        WITH split AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
        lines AS (SELECT doc_id, unnest(l) AS s, unnest(range(len(l))) AS line FROM split),
        w AS (SELECT doc_id, line, s, len(regexp_extract_all(s, '[^\x20\x09-\x0D]+')) AS n FROM lines),
        kept AS (SELECT doc_id, line, s, n, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS i,
                        sum(n) OVER (PARTITION BY doc_id ORDER BY line) AS upto FROM w WHERE n > 0),
        runs AS (SELECT a.doc_id, a.line AS line, b.line AS last, a.i AS i, b.i AS j
                 FROM kept a JOIN kept b ON a.doc_id = b.doc_id AND b.i >= a.i AND b.i < a.i + 20
                 WHERE b.upto - a.upto + a.n >= 20
                   AND (b.upto - b.n - a.upto + a.n < 20 OR b.upto - a.upto < 20)),
        whole AS (SELECT r.doc_id, r.line, r.i, r.j, string_agg(k.s, chr(10) ORDER BY k.line) AS body
                  FROM runs r JOIN kept k ON k.doc_id = r.doc_id AND k.i BETWEEN r.i AND r.j GROUP BY 1, 2, 3, 4),
        later AS (SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, line) AS copy FROM whole),
        gone AS (SELECT DISTINCT k.doc_id, k.line FROM later r
                 JOIN kept k ON k.doc_id = r.doc_id AND k.i BETWEEN r.i AND r.j WHERE r.copy > 1),
        list AS (SELECT doc_id, list(line ORDER BY line) AS g FROM gone GROUP BY doc_id)
        SELECT doc_id, coalesce(len(g), 0)::BIGINT AS n_deleted,
               coalesce(array_to_string(g, ','), '') AS deleted,
               md5(CASE WHEN g IS NULL THEN text ELSE coalesce(array_to_string(
                   [l[k + 1] FOR k IN range(len(l)) IF NOT list_contains(g, k)], chr(10)), '') END) AS text_md5
        FROM split LEFT JOIN list USING (doc_id)""",
    "op7_hamming_search": """
        WITH c AS (SELECT vec_id, [x > 0 FOR x IN embedding] AS bits FROM embeddings),
        pairs AS (SELECT q.vec_id AS query_id, c.vec_id,
                         len([1 FOR z IN list_zip(q.bits, c.bits) IF z[1] <> z[2]])::INTEGER AS distance
                  FROM c q JOIN c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
        SELECT query_id, vec_id, distance, rank FROM (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id)::INTEGER AS rank FROM pairs)
        WHERE rank <= 10""",
    "op11_shallot": _cluster_sql(),
    "op9_chat": r"""
        WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                   UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
                   UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
        e AS (SELECT *, regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g') AS safe,
                     row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i,
                     count(*) OVER (PARTITION BY conv_id) AS n,
                     lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS prior FROM t)
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
               sum(12 + length(role) + 1 + length(safe) + 11)::BIGINT AS formatted_chars,
               bool_and(CASE role WHEN 'system' THEN i = 1 WHEN 'user' THEN i = 1 OR prior IN ('system', 'assistant')
                                  WHEN 'assistant' THEN i > 1 AND prior = 'user' ELSE FALSE END
                        AND (i < n OR role = 'assistant')) AS valid
        FROM e GROUP BY conv_id""",
}
