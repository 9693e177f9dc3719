"""Sources and sinks (S1-S13): economy tables, ratings, materiality map, scenario
and portfolio records, production history.

Matrices live on disk either long (``producer_region, producer_sector,
consumer_region, consumer_sector, value``, partitioned by ``year``) or wide (one
row per producer label, one column per consumer label, as pandas writes a square
frame). Wide files are turned long once at read time.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import yaml_records

LABEL = ["region", "sector"]
CELL = ["producer_region", "producer_sector", "consumer_region", "consumer_sector"]
# Wide files up to this many value columns are turned long with ``unpivot``; wider
# ones are read in slices of ``SLICE_COLUMNS`` columns, each a pruned scan of its own.
UNPIVOT_MAX_COLUMNS = 500
SLICE_COLUMNS = 256
# Rows of a wide file laid out at a time (64 rows of 8,000 columns are 4 MB).
WIDE_ROWS = 64
# Separator of a flattened two-level column name when it is not a tuple literal.
LABEL_SEPARATOR = "|"
VECTOR_COLUMNS = {"GrossOutput": "X", "FinalDemand": "Y", "LandUse": "E"}
SHOCK_FIELDS = ["region", "sector", "magnitude"]
PORTFOLIO_FIELDS = ["region", "sector", "weight"]


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(p)


def _is_json_array(spark: SparkSession, path: str) -> bool:
    """Whether the file, or the first data file of the folder, starts with ``[``; read
    through the file system of the path, wherever that is."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(conf)
    files = sorted((f.getPath().toString(), f.getPath()) for f in fs.listStatus(p)
                   if f.isFile() and f.getLen() > 0 and not f.getPath().getName().startswith(("_", ".")))
    for _, file in files[:1]:
        stream = fs.open(file)
        try:
            byte = stream.read()
            while byte in b" \t\r\n\xef\xbb\xbf":
                byte = stream.read()
            return byte == ord("[")
        finally:
            stream.close()
    return False


def parse_label(name: str) -> tuple[str, str]:
    """Column name of a wide matrix → (region, sector): a tuple literal
    ``"('AT', 'Cultivation of wheat')"`` or ``"AT|Cultivation of wheat"``."""
    s = name.strip()
    if s.startswith("("):
        region, sector = ast.literal_eval(s)
        return str(region), str(sector)
    region, sector = s.split(LABEL_SEPARATOR, 1)
    return region, sector


def label_column(region: str, sector: str) -> str:
    return f"{region}{LABEL_SEPARATOR}{sector}"


def _slice_cells(wide: DataFrame, index: Sequence[str], cols: Sequence[str], first: int, drop_zeros: bool) -> DataFrame:
    """(producer_region, producer_sector, pos, value) of the columns ``cols``, the first
    of which has position ``first``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = np.empty((batch.num_rows, len(cols)))
            for j in range(len(cols)):
                block[:, j] = batch.column(j + 2).to_numpy(zero_copy_only=False)
            missing = np.isnan(block)
            if missing.any():  # only a null is a missing cell, a stored NaN stays
                for j in np.flatnonzero(missing.any(axis=0)):
                    missing[:, j] = batch.column(int(j) + 2).is_null().to_numpy(zero_copy_only=False)
            row, at = np.nonzero(~missing & (block != 0) if drop_zeros else np.ones(block.shape, dtype=bool))
            rows = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(rows), batch.column(1).take(rows), pa.array((at + first).astype(np.int32)),
                 pa.array(block[row, at], mask=missing[row, at])], names=["producer_region", "producer_sector", "pos", "value"])

    # As text: a Column object per column costs more than the scan.
    part = wide.selectExpr(*[f"CAST({_quoted(c)} AS STRING)" for c in index], *[f"CAST({_quoted(c)} AS DOUBLE) AS c{j}" for j, c in enumerate(cols)])
    return part.mapInArrow(run, "producer_region string, producer_sector string, pos int, value double")


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def wide_to_long(wide: DataFrame, index: Sequence[str] = LABEL, drop_zeros: bool = True, path: str | None = None) -> DataFrame:
    """Wide square matrix → long cells; zero (and null) cells dropped.

    A file of real width (some 8,000 columns) is read in slices: each slice is a scan
    of its columns alone, whose Arrow columns become cells in numpy before they are rows,
    so no task or projection ever holds a whole row and the slices run side by side.
    With the ``path`` of the Parquet file at hand each slice is declared by its own
    schema; otherwise every slice is planned from all columns (seconds a slice)."""
    spark = wide.sparkSession
    value_cols = [c for c in wide.columns if c not in index]
    dim = spark.createDataFrame([(i, *parse_label(c)) for i, c in enumerate(value_cols)],
                                "pos int, consumer_region string, consumer_sector string")
    if len(value_cols) <= UNPIVOT_MAX_COLUMNS:
        base = wide.select(F.col(index[0]).alias("producer_region"), F.col(index[1]).alias("producer_sector"),
                           *[F.col(_quoted(c)).cast("double").alias(f"c{i}") for i, c in enumerate(value_cols)])
        long = base.unpivot(["producer_region", "producer_sector"], [f"c{i}" for i in range(len(value_cols))], "col", "value")
        long = long.withColumn("pos", F.substring("col", 2, 10).cast("int")).drop("col")
    else:
        types, slices = {f.name: f for f in wide.schema.fields}, []
        for lo in range(0, len(value_cols), SLICE_COLUMNS):
            cols = value_cols[lo:lo + SLICE_COLUMNS]
            part = wide if path is None else spark.read.schema(T.StructType([types[c] for c in [*index, *cols]])).parquet(path)
            slices.append(_slice_cells(part, index, cols, lo, drop_zeros))
        long = reduce(DataFrame.union, slices)
    out = long.join(F.broadcast(dim), "pos").select(*CELL, "value")  # one row per column of the header
    return out.where(F.col("value").isNotNull() & (F.col("value") != 0)) if drop_zeros else out


def long_to_wide(long: DataFrame, labels: DataFrame, producers: DataFrame | None = None) -> DataFrame:
    """Inverse of :func:`wide_to_long` (for writing a square file, or one with the rows of
    ``producers`` alone, as rectangular tables have them). The labels name the
    columns, so they reach the driver (some 8,000 in a real economy). Up to
    ``UNPIVOT_MAX_COLUMNS`` columns are pivoted; beyond, each producer's cells are gathered
    as (column, value) pairs, at most one per label, and laid out as Arrow columns."""
    names = [(r.region, r.sector) for r in labels.select(*LABEL).distinct().orderBy(*LABEL).collect()]
    cols = [label_column(*n) for n in names]
    listed = (labels if producers is None else producers).select(*LABEL).distinct()
    if len(cols) <= UNPIVOT_MAX_COLUMNS:
        keyed = long.withColumn("col", F.concat_ws(LABEL_SEPARATOR, "consumer_region", "consumer_sector"))
        wide = (keyed.groupBy(F.col("producer_region").alias("region"), F.col("producer_sector").alias("sector"))
                .pivot("col", cols).agg(F.first("value")))
        full = listed.join(wide, LABEL, "left")
        return full.fillna(0.0, subset=cols)
    dim = labels.sparkSession.createDataFrame([(i, *n) for i, n in enumerate(names)], "pos int, consumer_region string, consumer_sector string")
    rows = (long.join(F.broadcast(dim), ["consumer_region", "consumer_sector"])
            .groupBy(F.col("producer_region").alias("region"), F.col("producer_sector").alias("sector"))
            .agg(F.collect_list(F.struct("pos", F.col("value").cast("double").alias("value"))).alias("cells")))
    full = listed.join(rows, LABEL, "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, WIDE_ROWS):
                batch = whole.slice(lo, WIDE_ROWS)
                cells = batch.column("cells")
                sizes = cells.value_lengths().fill_null(0).to_numpy()
                flat = cells.flatten()
                block = np.zeros((len(cols), batch.num_rows))
                block[flat.field("pos").to_numpy(), np.repeat(np.arange(batch.num_rows), sizes)] = flat.field("value").to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c) for c in block]], names=[*LABEL, *cols])

    schema = T.StructType([T.StructField(n, T.StringType()) for n in LABEL] + [T.StructField(c, T.DoubleType()) for c in cols])
    return full.mapInArrow(run, schema)


def read_matrix(spark: SparkSession, path: str, year: int | None = None, wide: bool = False) -> DataFrame:
    """A matrix, long (partitioned by year) or wide."""
    df = spark.read.parquet(path)
    if wide:
        return wide_to_long(df, path=path)
    if year is not None and "year" in df.columns:
        df = df.where(F.col("year") == year)
    return df.select(*CELL, "value")


def load_tables(spark: SparkSession, base: str, year: int, names: Sequence[str]):
    """Several named tables of one year in the order asked; one name gives the
    table itself. Tables are stored as ``{base}/{name}`` partitioned by year."""
    out = []
    for n in names:
        df = spark.read.parquet(f"{base}/{n}")
        if "year" in df.columns:
            df = df.where(F.col("year") == year).drop("year")
        out.append(df)
    return out[0] if len(out) == 1 else tuple(out)


def read_vector(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """S3: a one-column vector (``GrossOutput``/``FinalDemand``/``LandUse``) or a long
    ``value`` column → ``(region, sector, value)``."""
    df = spark.read.parquet(path)
    col = kind if kind and kind in df.columns else ("value" if "value" in df.columns else
                                                    next(c for c in df.columns if c in VECTOR_COLUMNS))
    return df.select(*LABEL, F.col(col).cast("double").alias("value"))


def labels_of(flows: DataFrame) -> DataFrame:
    """Distinct labels seen on either side of a matrix."""
    return (flows.select(F.col("producer_region").alias("region"), F.col("producer_sector").alias("sector"))
            .union(flows.select(F.col("consumer_region").alias("region"), F.col("consumer_sector").alias("sector")))
            .distinct())


def write_tables(tables: dict[str, DataFrame], base: str, year: int, mode: str = "overwrite") -> None:
    """Every table under ``{base}/{name}/year={year}`` (dynamic partition overwrite)."""
    for name, df in tables.items():
        (df.withColumn("year", F.lit(year)).write.mode(mode)
         .option("partitionOverwriteMode", "dynamic").partitionBy("year").parquet(f"{base}/{name}"))


def write_by_year(df: DataFrame, base: str, name: str, mode: str = "overwrite") -> None:
    """S9 for a table that already carries ``year``: one write, one folder per year."""
    (df.write.mode(mode).option("partitionOverwriteMode", "dynamic")
     .partitionBy("year").parquet(f"{base}/{name}"))


def load_year_files(spark: SparkSession, base: str, year: int, names: Sequence[str], prefix: str = ""):
    """S2 for the layout ``{base}/{year}/{prefix}{name}.parquet``: square tables come back
    long, vectors as ``(region, sector, value)``, in the order asked; one name gives the
    table itself."""
    out = []
    for n in names:
        path = f"{base}/{year}/{prefix}{n}.parquet"
        wide = set(spark.read.parquet(path).columns) - set(LABEL)
        out.append(read_vector(spark, path) if wide & {*VECTOR_COLUMNS, "value"} else read_matrix(spark, path, wide=True))
    return out[0] if len(out) == 1 else tuple(out)


def read_year_files(spark: SparkSession, base: str, name: str = "X", prefix: str = "") -> DataFrame:
    """S5 for folders named by digits: the vector of every year that has the file, tagged
    with its year; years without it are skipped."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(base)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    years = sorted(f.getPath().getName() for f in fs.listStatus(root) if f.isDirectory() and f.getPath().getName().isdigit())
    out = spark.createDataFrame([], "region string, sector string, value double, year int")
    for y in years:  # a handful of folders
        path = f"{base}/{y}/{prefix}{name}.parquet"
        if _exists(spark, path):
            out = out.unionByName(read_vector(spark, path).withColumn("year", F.lit(int(y))))
    return out


def read_years(spark: SparkSession, base: str, name: str = "X") -> DataFrame:
    """Every year folder of a vector, tagged with its year by partition
    discovery; years without the file are simply absent."""
    path = f"{base}/{name}"
    if not _exists(spark, path):
        return spark.createDataFrame([], "region string, sector string, value double, year int")
    return spark.read.option("basePath", path).parquet(path).select(*LABEL, "value", F.col("year").cast("int"))


def read_history(spark: SparkSession, path: str) -> DataFrame | None:
    """Production history as ``(region, sector, year, value)``; an absent file gives
    ``None`` ("no data"). Years may be rows or, as the wide file has them, columns."""
    if not _exists(spark, path):
        return None
    df = spark.read.parquet(path)
    years = [c for c in df.columns if c.isdigit()]
    if not years:
        return df
    long = df.unpivot(LABEL, [F.col(f"`{c}`").cast("double").alias(c) for c in years], "year", "value")
    return long.withColumn("year", F.col("year").cast("int")).where(F.col("value").isNotNull())


# Headers of the published files, and the names used here.
RATING_HEADERS = {"ISIC Section": "isic_section", "ISIC Division": "isic_division", "ISIC Group": "isic_group",
                  "ISIC Class": "isic_class", "EXIOBASE": "sector"}


def _read_strings(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.option("header", True).option("inferSchema", False).csv(path)
    return df.select(*[F.col(f"`{c}`").alias(RATING_HEADERS.get(c.strip(), c)) for c in df.columns])


def read_ratings(spark: SparkSession, path: str) -> DataFrame:
    """Ratings CSV, every column a string; published headers become our key names."""
    return _read_strings(spark, path)


def read_crosswalk(spark: SparkSession, path: str) -> DataFrame:
    """Crosswalk CSV, every column a string; headers as for the ratings."""
    return _read_strings(spark, path)


def write_joined(df: DataFrame, path: str) -> None:
    """Joined ratings detail as CSV with header."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_materiality(df: DataFrame, path: str) -> None:
    """``(service, sectors)`` with sorted sectors; services with none omitted."""
    (df.where(F.size("sectors") > 0).select("service", F.sort_array("sectors").alias("sectors"))
     .write.mode("overwrite").json(path))


def read_materiality(spark: SparkSession, path: str) -> DataFrame | None:
    """Materiality map exploded to ``(service, sector)``; absent file → None.
    Accepts JSON lines or a single JSON array."""
    if not _exists(spark, path):
        return None
    df = spark.read.option("multiLine", _is_json_array(spark, path)).schema("service string, sectors array<string>").json(path)
    return df.select("service", F.explode("sectors").alias("sector"))


def _is_yaml(path: str) -> bool:
    return path.rstrip("/").endswith(yaml_records.SUFFIXES)


def _read_records(spark: SparkSession, path: str, fields: Sequence[str], key: str, schema: str) -> DataFrame | None:
    if _is_yaml(path):
        # An uploaded file is one scenario or portfolio and need not name it: its own name does.
        records, rejected = yaml_records.read(spark, path, schema, fields)
        if not rejected.isEmpty():
            return None
        named = F.regexp_replace(F.element_at(F.split(yaml_records.FILE, "/"), -1), r"\.ya?ml$", "")
        return records.withColumn(key, F.coalesce(key, named)).drop(yaml_records.FILE)
    fmt = "csv" if path.endswith(".csv") else "json"
    reader = spark.read.schema(schema)
    df = (reader.option("header", True).csv(path) if fmt == "csv"
          else reader.option("multiLine", _is_json_array(spark, path)).json(path))
    incomplete = df.where(" OR ".join(f"{f} IS NULL" for f in fields)).limit(1).count()
    if incomplete:
        return None  # the whole file is rejected, as the reference does
    return df


def _write_records(df: DataFrame, path: str, fmt: str) -> None:
    if _is_yaml(path):
        yaml_records.write(df, path)
    elif fmt == "csv":
        df.write.mode("overwrite").option("header", True).csv(path)
    else:
        df.write.mode("overwrite").json(path)


def read_scenarios(spark: SparkSession, path: str) -> DataFrame | None:
    """Records ``scenario_id, region, sector, magnitude`` (percent), as JSON, CSV or
    YAML by the end of the path; None if any record lacks a required field."""
    df = _read_records(spark, path, SHOCK_FIELDS, "scenario_id",
                       "scenario_id string, region string, sector string, magnitude double")
    return None if df is None else df.select("scenario_id", *LABEL, (F.col("magnitude") / 100.0).alias("magnitude"))


def write_scenarios(shocks: DataFrame, path: str) -> None:
    """Magnitudes written back in percent; YAML for a path that ends so, else JSON."""
    _write_records(shocks.select("scenario_id", *LABEL, (F.col("magnitude") * 100.0).alias("magnitude")), path, "json")


def read_portfolios(spark: SparkSession, path: str) -> DataFrame | None:
    """Records ``portfolio_id, region, sector, weight`` (percent); formats as for scenarios."""
    return _read_records(spark, path, PORTFOLIO_FIELDS, "portfolio_id",
                         "portfolio_id string, region string, sector string, weight double")


def write_portfolios(pf: DataFrame, path: str) -> None:
    """YAML for a path that ends so, else CSV."""
    _write_records(pf.select("portfolio_id", *LABEL, "weight"), path, "csv")
