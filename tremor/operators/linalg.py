"""Sparse linear algebra on long (COO) tables.

Matrices are DataFrames ``(producer_region, producer_sector, consumer_region,
consumer_sector, value)``; vectors are ``(*keys, region, sector, value)`` where
``keys`` (for instance ``scenario_id``) let one plan carry many vectors at once.
A product is a join on the shared label followed by ``groupBy(...).sum``; Spark
does a partial (map-side) sum before the shuffle, so a round moves at most
``keys × labels`` rows per partition whatever the number of matrix cells.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import DEFAULT_BROADCAST_ROWS, broadcast_if_small, cut_lineage, ensure_checkpoint_dir
from . import tiles

PRODUCER = ("producer_region", "producer_sector")
CONSUMER = ("consumer_region", "consumer_sector")
LABEL = ("region", "sector")
# Products of the series loop handled by one task (upper bound), and the least
# worth spreading over another core.
ROWS_PER_TASK = 20_000_000
MIN_ROWS_PER_TASK = 100_000
# Rows of the build side of the loop's hash join in one task.
BUILD_ROWS = 2_000_000


def _side(orientation: str) -> tuple[tuple[str, str], tuple[str, str]]:
    """(source label, target label) of the matrix for a product direction.

    ``"row"``  : target_j = Σ_i v_i · M_ij  (vector times matrix, join on producer)
    ``"column"``: target_i = Σ_j M_ij · v_j (matrix times vector, join on consumer)
    """
    if orientation == "row":
        return PRODUCER, CONSUMER
    if orientation == "column":
        return CONSUMER, PRODUCER
    raise ValueError(f"orientation must be 'row' or 'column', not {orientation!r}")


def oriented(matrix: DataFrame, orientation: str, system: Column | str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Matrix as ``(system, src_region, src_sector, dst_region, dst_sector, value)``, with
    the columns ``by`` before these."""
    src, dst = _side(orientation)
    cols = [
        *by,
        F.col(src[0]).alias("src_region"), F.col(src[1]).alias("src_sector"),
        F.col(dst[0]).alias("dst_region"), F.col(dst[1]).alias("dst_sector"),
        F.col("value").cast("double").alias("value"),
    ]
    if system is not None:
        cols.insert(0, (F.lit(system) if isinstance(system, str) else system).alias("system"))
    return matrix.select(*cols)


def product(matrix: DataFrame, vector: DataFrame, orientation: str,
            keys: Sequence[str] = (), by: Sequence[str] = ()) -> DataFrame:
    """One product of a (keyed) vector with a matrix; zero results are dropped. ``by``
    names keys that the matrix has too, such as the year."""
    m = oriented(matrix, orientation, by=by)
    on = (F.col("v.region") == F.col("m.src_region")) & (F.col("v.sector") == F.col("m.src_sector"))
    for key in by:
        on = on & (F.col(f"v.{key}") == F.col(f"m.{key}"))
    joined = vector.alias("v").join(m.alias("m"), on)
    return (
        joined.groupBy(*[F.col(f"v.{k}").alias(k) for k in keys],
                       F.col("m.dst_region").alias("region"), F.col("m.dst_sector").alias("sector"))
        .agg(F.sum(F.col("v.value") * F.col("m.value")).alias("value"))
    )


def matvec(matrix: DataFrame, vector: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``M · v``: result_i = Σ_j M_ij v_j."""
    return product(matrix, vector, "column", keys)


def vecmat(vector: DataFrame, matrix: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``vᵀ · M``: result_j = Σ_i v_i M_ij."""
    return product(matrix, vector, "row", keys)


def matmul(left: DataFrame, right: DataFrame) -> DataFrame:
    """``L · R`` of long tables by dense tiles (:mod:`tiles`): the non-zero cells."""
    left, right = cut_lineage(left), cut_lineage(right)
    grid = tiles.grid_of(cut_lineage(tiles.labels_of(left, right)))
    return tiles.to_cells(tiles.multiply(tiles.to_tiles(left, grid), tiles.to_tiles(right, grid), grid), grid)


def transpose(matrix: DataFrame) -> DataFrame:
    return matrix.select(
        F.col("consumer_region").alias("producer_region"), F.col("consumer_sector").alias("producer_sector"),
        F.col("producer_region").alias("consumer_region"), F.col("producer_sector").alias("consumer_sector"),
        "value",
    )


def residual(matrix: DataFrame, vector: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``(I − M) · v`` without an identity matrix: ``v − M·v`` by a full outer join."""
    mv = matvec(matrix, vector, keys).withColumnRenamed("value", "mv")
    on = [*keys, *LABEL]
    return (
        vector.select(*on, F.col("value").alias("v"))
        .join(mv, on, "full_outer")
        .select(*on, (F.coalesce(F.col("v"), F.lit(0.0)) - F.coalesce(F.col("mv"), F.lit(0.0))).alias("value"))
    )


class NotConvergent(ValueError):
    """The geometric series of a system does not settle."""


def series_solve(systems: DataFrame, seed: DataFrame, terms: int | None = None,
                 mask: DataFrame | None = None, checkpoint_every: int = 10,
                 tol: float = 1e-16, broadcast_rows: int = DEFAULT_BROADCAST_ROWS,
                 keys: Sequence[str] = ("system", "run_id"), max_rounds: int = 5000) -> DataFrame:
    """Geometric series ``Σ_k Mᵏ b`` for many right-hand sides in one plan, summed until
    it has converged.

    ``systems``: ``(system, src_region, src_sector, dst_region, dst_sector, value)``,
    several matrices told apart by ``system`` (see :func:`oriented`).
    ``seed``: ``(*keys, region, sector, value)``, the ``k = 0`` term; ``keys`` names
    the run columns and must include ``system``.
    ``mask``: ``(*keys, region, sector)``: labels taken out of the system of that
    run (the shocked set of a mixed model). Masking the vector after every product
    is the same as using the sub-matrix ``M_nn``, but keeps one shared matrix for
    all runs.

    If a norm of every system is below one (:func:`contracts`), the sum is found by Krylov
    cycles, see :func:`_krylov`: never more rounds than the plain series needs to the same
    residual, and a small part of them where it falls slowly. Otherwise, and for partial
    sums, the terms are summed.

    The plain loop ends when, in every run, the bound of what is left out (last term times
    ``ρ / (1 − ρ)``, with ρ the rate at which terms fell since the check before) is at
    most ``tol`` of the largest sum. It raises :class:`NotConvergent` if terms stop
    falling or ``max_rounds`` is reached. With ``terms`` a caller asks for a partial sum:
    the loop then ends after so many terms at the latest, and does not raise for that.

    Inside the loop runs and labels are dense integers: the state is
    ``(run, key, term, acc)`` with ``key = system·2³² + label``, so each round is one
    join and one aggregation on two longs with a map-side partial sum; the state never
    grows beyond runs × labels rows. A matrix of at most ``broadcast_rows`` cells is
    broadcast. A larger one is placed once, see :func:`_place`, and stays where it is.
    The loop runs in a session of its own, on tables in the shared checkpoint folder, so
    its static planning does not touch the caller's settings; every
    ``checkpoint_every`` rounds the state is written there.
    """
    keys = list(keys)
    spark = seed.sparkSession
    cores = spark.sparkContext.defaultParallelism
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/series-{uuid.uuid4().hex}"
    loop = spark.newSession()
    # Seeds and systems are unions of many small branches: evaluated once, at a width
    # that fits the cluster.
    seed = cut_lineage(seed.select(*keys, *LABEL, F.col("value").cast("double").alias("value")).repartition(cores, *LABEL))
    systems = cut_lineage(systems.repartition(cores, "src_region", "src_sector"))
    if mask is not None:
        mask = cut_lineage(mask.select(*keys, *LABEL).distinct())
    # Dictionaries: systems (a handful), labels (bounded by the economy), runs.
    # System and label numbers are deterministic (ordered windows over a handful of
    # systems and the label dimension), so they need no cut; run numbers are not.
    sys_ids = (systems.select("system").union(seed.select("system")).distinct()
               .withColumn("sys_id", F.row_number().over(Window.orderBy("system")).cast("long")))
    lab = (systems.select(F.col("src_region").alias("region"), F.col("src_sector").alias("sector"))
           .union(systems.select(F.col("dst_region").alias("region"), F.col("dst_sector").alias("sector")))
           .union(seed.select(*LABEL)).distinct())
    # One numbering window over the label dimension (≤ labels rows).
    lab_ids = lab.withColumn("lab_id", F.row_number().over(Window.orderBy(*LABEL)).cast("long"))
    run_ids = cut_lineage(seed.select(*keys).distinct().withColumn("run", F.monotonically_increasing_id()))
    n_runs, n_labels = run_ids.count(), lab_ids.count()
    sb = F.broadcast(sys_ids)
    lb = broadcast_if_small(lab_ids, broadcast_rows)
    rb = broadcast_if_small(run_ids, broadcast_rows)

    def code(df, region, sector, name):
        l2 = lb.select(F.col("region").alias(region), F.col("sector").alias(sector), F.col("lab_id").alias(f"{name}_lab"))
        return df.join(l2, [region, sector]).withColumn(name, F.shiftleft(F.col("sys_id"), 32) + F.col(f"{name}_lab"))

    def kept(df, name):
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        return loop.read.schema(df.schema).parquet(f"{folder}/{name}")

    m = systems.join(sb, "system")
    m = code(code(m, "src_region", "src_sector", "src"), "dst_region", "dst_sector", "dst")
    krylov = terms is None and contracts(m)
    real = m.select("src", "dst", F.col("value").cast("double").alias("value"), F.lit(False).alias("carry"))
    ident = (real.select(F.col("src").alias("k")).union(real.select(F.col("dst").alias("k"))).distinct()
             .select(F.col("k").alias("src"), F.col("k").alias("dst"), F.lit(1.0).alias("value"), F.lit(True).alias("carry")))

    def encode_runs(df):
        return code(df.join(rb, keys).join(sb, "system"), "region", "sector", "key")

    seed_i = encode_runs(seed).select("run", "key", F.col("value").alias("term"))
    ident = ident.union(seed_i.select(F.col("key").alias("src"), F.col("key").alias("dst"), F.lit(1.0).alias("value"),
                                      F.lit(True).alias("carry"))).distinct()
    stepper = kept(real.unionByName(ident), "matrix")
    n_step = stepper.count()
    # Size the loop's shuffle from the work of a round (state rows × average
    # out-degree), and plan it statically: the state is keyed uniformly by
    # (run, label), so run-time re-planning has nothing to fix here.
    degree = max(1.0, n_step / max(1, n_labels))
    products = n_runs * n_labels * degree
    parts = int(max(1, min(100_000, max(math.ceil(products / ROWS_PER_TASK),
                                        min(cores, math.ceil(products / MIN_ROWS_PER_TASK))))))
    loop.conf.set("spark.sql.autoBroadcastJoinThreshold", spark.conf.get("spark.sql.autoBroadcastJoinThreshold"))
    loop.conf.set("spark.sql.adaptive.enabled", "false")
    loop.conf.set("spark.sql.shuffle.partitions", str(parts))
    first = seed_i.groupBy("run", "key").agg(F.sum("term").alias("term")).withColumn("acc", F.lit(0.0))
    table = None
    if n_step <= broadcast_rows:
        step = lambda state, sums=None: _round(state, F.broadcast(stepper), sums)
    else:
        # The build side of a task's hash join: the matrix or the state, whichever has
        # fewer rows to a key; parts are added until it is of moderate size.
        build = "matrix" if n_runs > degree else "state"
        parts = min(100_000, max(parts, math.ceil(min(n_step, n_runs * n_labels) / BUILD_ROWS)))
        loop.conf.set("spark.sql.shuffle.partitions", str(parts))
        fans = kept(stepper.groupBy("src").agg(F.count("*").alias("cells")).select(
            F.col("src").alias("key"), _fan(F.col("cells"), n_runs).alias("fan")), "fans")
        table = f"series_{uuid.uuid4().hex}"
        placed = _place(loop, stepper, fans, parts, table, f"{folder}/placed")
        first = first.join(loop.read.schema(fans.schema).parquet(f"{folder}/fans"), "key").select("run", "key", "term", "acc", "fan")
        step = lambda state, sums=None: _round_placed(state, placed, build, *([sums] if sums else []))
    mk = None
    if mask is not None:
        mk = broadcast_if_small(kept(encode_runs(mask).select("run", "key"), "mask"), broadcast_rows)

    def apply_mask(df: DataFrame) -> DataFrame:
        return df.join(mk, ["run", "key"], "left_anti") if mk is not None else df

    state = apply_mask(kept(first, "state0"))
    try:
        if krylov:
            small = F.broadcast if n_runs <= broadcast_rows else (lambda df: df)
            tables = _krylov(state, step, apply_mask, kept, tol, max_rounds, small)
        else:
            tables = [_iterate(state, step, apply_mask, kept, tol, max_rounds, checkpoint_every, terms)]
    finally:
        if table:
            loop.sql(f"DROP TABLE IF EXISTS {table}")
    done = None
    for name, schema in tables:
        part = spark.read.schema(schema).parquet(f"{folder}/{name}").select("run", "key", "term", "acc")
        done = part if done is None else done.unionByName(part)
    out = (done.select("run", "key", (F.col("acc") + F.col("term")).alias("value"))
           .join(rb, "run")
           .withColumn("lab_id", F.col("key").bitwiseAND(F.lit(0xFFFFFFFF)))
           .join(lb, "lab_id"))
    return out.select(*keys, *LABEL, "value")


def _fan(cells: Column, runs: int) -> Column:
    """Parts of a label's cells: a part times the runs is at most the work of a task, so
    a hub label, or a label under very many runs, is no task's bottleneck."""
    return F.greatest(F.ceil(cells * F.lit(runs) / F.lit(ROWS_PER_TASK)), F.lit(1)).cast("int")


def _place(loop, stepper: DataFrame, fans: DataFrame, parts: int, table: str, path: str) -> DataFrame:
    """The matrix as a table bucketed by (src, salt), one file a bucket: rounds join it
    without an exchange and without a sort. ``salt`` deals the cells of a source to the
    ``fan`` parts of it; ``dst_fan`` is the fan of the target as a source, which the state
    carries along, so that no round looks it up."""
    salted = (stepper.join(fans.withColumnRenamed("key", "src"), "src")
              .join(fans.select(F.col("key").alias("dst"), F.col("fan").alias("dst_fan")), "dst")
              .withColumn("salt", F.pmod(F.xxhash64("dst"), F.col("fan")).cast("int")))
    (salted.select("src", "salt", "dst", "value", "carry", "dst_fan").repartition(parts, "src", "salt")
     .write.format("parquet").bucketBy(parts, "src", "salt").option("path", path).saveAsTable(table))
    return loop.table(table)


def _sums() -> list[Column]:
    return [F.sum(F.when(~F.col("m.carry"), F.col("s.term") * F.col("m.value")).otherwise(0.0)).alias("term"),
            F.sum(F.when(F.col("m.carry"), F.col("s.acc") + F.col("s.term")).otherwise(0.0)).alias("acc")]


def _round(state: DataFrame, m: DataFrame, sums: list[Column] | None = None) -> DataFrame:
    return (state.alias("s").join(m.alias("m"), F.col("s.key") == F.col("m.src"))
            .groupBy(F.col("s.run").alias("run"), F.col("m.dst").alias("key")).agg(*(sums or _sums())))


def _round_placed(state: DataFrame, m: DataFrame, build: str, sums: list[Column] | None = None) -> DataFrame:
    """A round on the placed matrix. Two exchanges: the state to the buckets (runs ×
    labels rows, times the fan of hubs) and the partial sums by (run, label)."""
    state = state.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("fan") - 1)))
    if build == "matrix":
        m = m.hint("shuffle_hash")
    else:
        state = state.hint("shuffle_hash")
    on = (F.col("s.key") == F.col("m.src")) & (F.col("s.salt") == F.col("m.salt"))
    return (state.alias("s").join(m.alias("m"), on)
            .groupBy(F.col("s.run").alias("run"), F.col("m.dst").alias("key")).agg(*(sums or _sums()), F.max("m.dst_fan").alias("fan")))


def contracts(coded: DataFrame) -> bool:
    """Whether every system has a norm below one: its largest column sum or its largest
    row sum of absolute values. Then so has every system with labels masked out, the
    series converges, and ``I − M`` is regular. ``coded``: (sys_id, src, dst, value)."""
    size = F.sum(F.abs(F.col("value").cast("double"))).alias("s")
    sides = [coded.groupBy("sys_id", c).agg(size).groupBy("sys_id").agg(F.max("s").alias("s")) for c in ("src", "dst")]
    worst = sides[0].unionByName(sides[1]).groupBy("sys_id").agg(F.min("s").alias("s")).agg(F.max("s")).first()[0]
    return worst is None or worst < 1.0


# Products of the residual in a Krylov cycle.
BASIS = 6


def _krylov(state, step, apply_mask, kept, tol, max_rounds, small):
    """[(name, schema)] of tables that hold the solution ``acc + term`` of all runs.

    A cycle multiplies the residual ``k0`` of each run ``BASIS`` times, ``k_j = Mʲ k0``, and
    moves to the combination of ``k_0 … k_(BASIS−1)`` that leaves the smallest residual
    (a restarted minimal residual method). The plain series is the combination with all
    coefficients one, so a cycle never does worse than as many terms of it. A run's inner
    products are one aggregation, its small least-squares problem one row; the update and
    the new residual come from the same coefficients, so rounding in these does not
    spoil the sum. Runs that are done leave when they are a quarter of all."""
    K = [f"k{j}" for j in range(BASIS + 1)]
    carry = lambda c: F.sum(F.when(F.col("m.carry"), F.col(f"s.{c}")).otherwise(0.0)).alias(c)
    state = state.withColumnRenamed("term", "k0")
    tables, rounds, cycle = [], 0, 0

    def finish(part):
        name = f"solved{cycle}"
        part = kept(part.select("run", "key", F.col("k0").alias("term"), "acc"), name)
        tables.append((name, part.schema))

    while True:
        for j in range(BASIS):
            new = F.sum(F.when(~F.col("m.carry"), F.col(f"s.{K[j]}") * F.col("m.value")).otherwise(0.0)).alias(K[j + 1])
            state = apply_mask(step(state, [carry("acc"), *map(carry, K[:j + 1]), new]))
        rounds += BASIS
        basis = kept(state, f"basis{cycle}")
        weights = kept(_coefficients(basis), f"weights{cycle}")
        c = [F.element_at("c", j + 1) for j in range(BASIS)]
        acc = sum((c[j] * F.col(K[j]) for j in range(BASIS)), F.col("acc"))
        left = sum((-c[j] * (F.col(K[j]) - F.col(K[j + 1])) for j in range(BASIS)), F.col("k0"))
        fan = ["fan"] if "fan" in basis.columns else []
        state = basis.join(small(weights), "run").select("run", "key", acc.alias("acc"), left.alias("k0"), *fan)
        sizes = state.groupBy("run").agg(F.max(F.abs("k0")).alias("r"), F.max(F.abs(F.col("acc") + F.col("k0"))).alias("a"))
        settled = kept(sizes.select("run", (F.col("r") <= F.lit(tol) * F.col("a")).alias("settled")), f"settled{cycle}")
        n = settled.agg(F.count("*").alias("runs"), F.count_if("settled").alias("settled")).first()
        if n["runs"] == n["settled"]:
            finish(state)
            return tables
        if 4 * n["settled"] >= n["runs"]:
            gone = small(settled.where("settled").select("run"))
            finish(state.join(gone, "run", "left_semi"))
            state = state.join(gone, "run", "left_anti")
        if rounds >= max_rounds:
            raise NotConvergent(f"no convergence to {tol:g} in {max_rounds} rounds")
        cycle += 1


def _coefficients(basis: DataFrame) -> DataFrame:
    """(run, c): the least-squares coefficients of every run, from its inner products."""
    diff = [F.col(f"k{j}") - F.col(f"k{j + 1}") for j in range(BASIS)]
    products = [diff[i] * diff[j] for i in range(BASIS) for j in range(i, BASIS)] + [d * F.col("k0") for d in diff]
    products += [F.col("k0") * F.col("k0"), F.col(f"k{BASIS}") * F.col(f"k{BASIS}")]
    sums = basis.groupBy("run").agg(*[F.sum(p).alias(f"p{n}") for n, p in enumerate(products)])
    sums = sums.select("run", F.array(*[f"p{n}" for n in range(len(products))]).alias("p"))

    def solve(batches):
        upper = np.triu_indices(BASIS)
        for rows in batches:
            out = []
            for p in rows["p"]:
                p = np.asarray(p, dtype=np.float64)
                G = np.zeros((BASIS, BASIS))
                G[upper] = p[:len(upper[0])]
                G = G + np.triu(G, 1).T
                g, start, series = p[len(upper[0]):-2], p[-2], p[-1]
                scale = np.sqrt(np.diag(G))
                scale[scale == 0] = 1.0
                try:
                    c = np.linalg.pinv(G / np.outer(scale, scale), rcond=1e-13, hermitian=True) @ (g / scale) / scale
                    good = bool(np.isfinite(c).all()) and c @ G @ c - 2 * g @ c + start <= max(series, 1e-14 * start)
                except np.linalg.LinAlgError:
                    good = False
                out.append((c if good else np.ones(BASIS)).tolist())  # ones: the terms of the series
            yield pd.DataFrame({"run": rows["run"], "c": out})

    return sums.mapInPandas(solve, "run long, c array<double>")


def _iterate(state, step, apply_mask, kept, tol, max_rounds, every, terms):
    """(name, schema) of the table that holds the final state."""
    k, last, flat = 1, None, 0
    while True:
        upto = k + every if terms is None else min(k + every, terms)
        while k < upto:
            state = apply_mask(step(state))
            k += 1
        name = f"state{k}"
        state = kept(state, name)
        if terms is not None and k >= terms:
            return name, state.schema
        # Per run, the last term against the largest sum; two scalars reach the driver.
        top = (state.groupBy("run").agg(F.max(F.abs("term")).alias("t"), F.max(F.abs(F.col("acc") + F.col("term"))).alias("a"))
               .agg(F.max(F.when(F.col("t") > 0, F.col("t") / F.col("a"))).alias("share"), F.max("t").alias("t")).first())
        share = top["share"]
        if not share:
            return name, state.schema
        if last is not None:
            rate = max(top["t"] / last["t"], share / last["share"]) ** (1 / every)
            if rate < 1 and share * rate / (1 - rate) <= tol:
                return name, state.schema
            flat = flat + 1 if rate >= 1 - 1e-9 else 0
            if flat == 3 or not math.isfinite(top["t"]):
                raise NotConvergent(f"the terms of the series do not fall (share {share:.3g} after {k} terms)")
        if k >= max_rounds:
            raise NotConvergent(f"no convergence to {tol:g} in {max_rounds} terms (share {share:.3g})")
        last = top


def identity(labels: DataFrame) -> DataFrame:
    return labels.select(F.col("region").alias("producer_region"), F.col("sector").alias("producer_sector"),
                         F.col("region").alias("consumer_region"), F.col("sector").alias("consumer_sector"),
                         F.lit(1.0).alias("value"))


def power_series(matrix: DataFrame, labels: DataFrame, terms: int | None = None, tol: float = 1e-16,
                 max_doublings: int = 24, tile: int = tiles.TILE) -> DataFrame:
    """Full ``Σ_k Mᵏ`` (M8/M9: Leontief or Ghosh inverse) by binary doubling,
    ``S_2n = S_n + Mⁿ·S_n``: two matrix products double the number of terms.

    Doubling goes on until the norm of ``Mⁿ`` (largest absolute column sum) shows that
    the remainder is below ``tol``; :class:`NotConvergent` if the norm grows without
    bound or ``max_doublings`` do not suffice. ``terms`` sums exactly so many terms
    (``S_n+1 = I + M·S_n`` for the odd steps). All products run on dense tiles
    (:mod:`tiles`) in groups of bounded size; cells are formed once, at the end."""
    m = cut_lineage(matrix.select(*PRODUCER, *CONSUMER, F.col("value").cast("double").alias("value")))
    grid = tiles.grid_of(cut_lineage(tiles.labels_of(m).union(labels.select(*LABEL)).distinct()), tile)
    eye = cut_lineage(tiles.to_tiles(identity(labels), grid))
    m = cut_lineage(tiles.to_tiles(m, grid))
    times = lambda a, b, plus=None: cut_lineage(tiles.multiply(a, b, grid, plus))
    if terms is None:
        s, p = eye, m  # S_n and Mⁿ
        for _ in range(max_doublings):
            norm = tiles.column_norm(p, grid)
            if not math.isfinite(norm) or norm > 1e12:
                raise NotConvergent(f"the powers of the matrix grow (norm {norm:.3g})")
            s = times(p, s, s)
            if norm <= 0.5 and norm * norm <= tol:  # the terms left out are at most norm² / (1 − norm) of S
                return tiles.to_cells(s, grid)
            p = times(p, p)
        raise NotConvergent(f"no convergence to {tol:g} in {max_doublings} doublings")
    s, p, n = eye, m, 1
    bits = bin(terms)[3:]
    for i, bit in enumerate(bits):
        last = i == len(bits) - 1
        s = times(p, s, s)
        if not (last and bit == "0"):  # Mⁿ is not needed after the final step
            p = times(p, p)
        n *= 2
        if bit == "1":
            s = times(m, s, eye)
            if not last:
                p = times(p, m)
            n += 1
    return tiles.to_cells(s, grid)


def similarity_scale(matrix: DataFrame, x: DataFrame) -> DataFrame:
    """``x̂⁻¹ · M · x̂``: cell (i, j) times ``x_j / x_i``; labels with ``x = 0`` drop out."""
    xi = x.select(F.col("region").alias("producer_region"), F.col("sector").alias("producer_sector"), F.col("value").alias("xi"))
    xj = x.select(F.col("region").alias("consumer_region"), F.col("sector").alias("consumer_sector"), F.col("value").alias("xj"))
    if x.count() <= DEFAULT_BROADCAST_ROWS:  # a label vector: bounded by the label dimension
        xi, xj = F.broadcast(xi), F.broadcast(xj)
    return (matrix.join(xi, list(PRODUCER)).join(xj, list(CONSUMER))
            .where((F.col("xi") != 0) & (F.col("xj") != 0))
            .select(*PRODUCER, *CONSUMER, (F.col("value") * F.col("xj") / F.col("xi")).alias("value")))


def column_sums(matrix: DataFrame) -> DataFrame:
    """Σ_i M_ij per consumer j (V4: all below 1 is sufficient for the Leontief series)."""
    return matrix.groupBy(F.col("consumer_region").alias("region"),
                          F.col("consumer_sector").alias("sector")).agg(F.sum("value").alias("value"))


def row_sums(matrix: DataFrame) -> DataFrame:
    """Σ_j M_ij per producer i (V4 for the Ghosh series)."""
    return matrix.groupBy(F.col("producer_region").alias("region"),
                          F.col("producer_sector").alias("sector")).agg(F.sum("value").alias("value"))


def check_convergent(matrix: DataFrame, orientation: str) -> float:
    """V4: largest column (Leontief) or row (Ghosh) sum; raises if not below 1.

    Reads one scalar; the sums themselves stay distributed."""
    sums = column_sums(matrix) if orientation == "column" else row_sums(matrix)
    top = sums.agg(F.max("value")).first()[0] or 0.0
    if top >= 1.0:
        raise ValueError(f"series may diverge: largest {'column' if orientation == 'column' else 'row'} sum {top}")
    return top
