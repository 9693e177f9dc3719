"""YAML record files as a Spark data source: ``spark.read.format("yaml_records")``.

A file is a list of mappings, as users upload them. Each file is one partition, read
through the file system of its path (local, HDFS or an object store). A file that is
not YAML, not a list of mappings, or has a record without a required field is rejected
whole: it gives one row that names it, and no record.

Options: ``path`` (a file, or a folder of ``.yaml`` / ``.yml`` files), ``required``
(comma-separated fields that every record must have) and, for writing, nothing else.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

FILE, REASON = "source_file", "rejected"
SUFFIXES = (".yaml", ".yml")


def _open_place(path: str):
    """(file system, path on it); a path without a scheme is local."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def parse(content: bytes, required: Sequence[str]) -> list[dict]:
    """Records of one file; ValueError says why the file is rejected."""
    import yaml

    try:
        records = yaml.load(content, Loader=getattr(yaml, "CSafeLoader", yaml.SafeLoader))
    except (yaml.YAMLError, UnicodeDecodeError) as bad:
        raise ValueError(f"not YAML: {str(bad).splitlines()[0]}") from None
    if not isinstance(records, list) or not all(isinstance(r, dict) for r in records):
        raise ValueError("not a list of records")
    for n, record in enumerate(records):
        missing = [f for f in required if record.get(f) is None]
        if missing:
            raise ValueError(f"record {n} lacks {', '.join(missing)}")
    return records


def _typed(value, kind: T.DataType):
    """``value`` as the column's type; ValueError if it is none."""
    if value is None:
        return None
    if isinstance(kind, T.StringType):
        # Plain scalars that YAML reads as other types (NO is false) are names here.
        return value if isinstance(value, str) else {True: "true", False: "false"}[value] if isinstance(value, bool) else str(value)
    if isinstance(value, bool):
        raise ValueError(f"not a number: {value}")
    try:
        return float(value) if isinstance(kind, T.DoubleType) else int(value)
    except (TypeError, ValueError):
        raise ValueError(f"not a number: {str(value)[:40]}") from None


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.fields = [f for f in schema.fields if f.name not in (FILE, REASON)]
        self.path = options["path"]
        self.required = [f.strip() for f in options.get("required", "").split(",") if f.strip()]

    def partitions(self):
        from pyarrow import fs

        system, place = _open_place(self.path)
        info = system.get_file_info(place)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        if info.type == fs.FileType.File:
            return [_File(self.path)]
        head = self.path[:len(self.path) - len(place)] if self.path.endswith(place) else ""
        found = system.get_file_info(fs.FileSelector(place))
        return [_File(head + f.path) for f in sorted(found, key=lambda f: f.path)
                if f.type == fs.FileType.File and f.path.endswith(SUFFIXES) and f.base_name[0] not in "_."] or [_File("")]

    def read(self, partition: _File) -> Iterator[tuple]:
        if not partition.path:  # a folder without a file has one empty partition
            return
        system, place = _open_place(partition.path)
        with system.open_input_stream(place) as stream:
            content = stream.read()
        try:
            rows = [tuple(_typed(r.get(f.name), f.dataType) for f in self.fields) for r in parse(content, self.required)]
        except ValueError as bad:
            rows = [(*[None] * len(self.fields), partition.path, str(bad))]
            yield from rows
            return
        for row in rows:
            yield (*row, partition.path, None)


class _Written(WriterCommitMessage):
    def __init__(self, path: str):
        self.path = path


class _Writer(DataSourceWriter):
    def __init__(self, schema: T.StructType, options: dict):
        self.names = schema.fieldNames()
        self.path = options["path"]

    def write(self, rows: Iterator) -> _Written:
        import yaml

        system, place = _open_place(self.path)
        system.create_dir(place, recursive=True)
        name = posixpath.join(place, f"part-{uuid.uuid4().hex}.yaml")
        hidden = posixpath.join(place, f"_{posixpath.basename(name)}")
        n = 0
        with system.open_output_stream(hidden) as out:
            for row in rows:  # one record at a time: a list is its items one below the other
                out.write(yaml.safe_dump([dict(zip(self.names, row))], allow_unicode=True, sort_keys=False).encode())
                n += 1
        return _Written(name if n else "")

    def commit(self, messages) -> None:
        """Files become visible only when every task has ended."""
        system, _ = _open_place(self.path)
        for m in messages:
            if m and m.path:
                folder, name = posixpath.split(m.path)
                system.move(posixpath.join(folder, f"_{name}"), m.path)

    def abort(self, messages) -> None:
        system, _ = _open_place(self.path)
        for m in messages:
            if m and m.path:
                folder, name = posixpath.split(m.path)
                system.delete_file(posixpath.join(folder, f"_{name}"))


class YamlRecords(DataSource):
    """See the module. The schema is the caller's, followed by ``source_file`` and
    ``rejected`` (null for a record; the reason for a rejected file)."""

    @classmethod
    def name(cls) -> str:
        return "yaml_records"

    def schema(self):
        raise ValueError("yaml_records needs a schema")

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(schema, self.options)

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(schema, self.options)


def read(spark: SparkSession, path: str, schema: str, required: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(records with ``source_file``, rejected files with the reason). Both are views of
    one scan; numbers that are not numbers reject their file too."""
    spark.dataSource.register(YamlRecords)
    rows = (spark.read.format("yaml_records").schema(f"{schema}, {FILE} string, {REASON} string")
            .option("required", ",".join(required)).load(path))
    return rows.where(F.col(REASON).isNull()).drop(REASON), rows.where(F.col(REASON).isNotNull()).select(FILE, REASON)


def write(df: DataFrame, path: str) -> None:
    """One file per task under the folder ``path``, added to what is there."""
    df.sparkSession.dataSource.register(YamlRecords)
    df.write.format("yaml_records").mode("append").save(path)
