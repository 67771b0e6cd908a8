"""A feed's schemas over time. New files are looked at before they are read; columns that they add or widen make a new
version, and rows are stored by the version that they were read with, so reading needs no file's footer."""

from __future__ import annotations

import csv
import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .sinks import hadoop

#: Types that hold all values of those before them. Whatever else meets becomes a string.
NUMBERS: list[type[T.DataType]] = [T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DoubleType]
DAYS: list[type[T.DataType]] = [T.DateType, T.TimestampType]
#: Lines that could not be read, whole.
RESCUED = "_rescued"


def widen(a: T.DataType, b: T.DataType) -> T.DataType:
    """The least type that holds the values of both."""
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        return merge(a, b)
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(widen(a.elementType, b.elementType))
    for ladder in (NUMBERS, DAYS):
        if type(a) in ladder and type(b) in ladder:
            return max(a, b, key=lambda t: ladder.index(type(t)))
    return T.StringType()


def merge(a: T.StructType, b: T.StructType) -> T.StructType:
    """The columns of both, those of `a` first; names that differ in case only are one."""
    fields = {f.name.lower(): f for f in a}
    for f in b:
        have = fields.get(f.name.lower())
        fields[f.name.lower()] = T.StructField(have.name, widen(have.dataType, f.dataType)) if have else T.StructField(f.name, f.dataType)
    return T.StructType(list(fields.values()))


def settled(kind: T.DataType) -> T.DataType:
    """Without types that nothing is known of yet: these are strings."""
    if isinstance(kind, T.NullType):
        return T.StringType()
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, settled(f.dataType)) for f in kind])
    return T.ArrayType(settled(kind.elementType)) if isinstance(kind, T.ArrayType) else kind


def _as(value: Column, old: T.DataType, new: T.DataType) -> Column:
    """A value of a narrower type in the wider one that `widen` gave."""
    if old == new:
        return value
    if isinstance(new, T.StructType) and isinstance(old, T.StructType):
        have = {f.name.lower(): f for f in old}
        parts = [_as(value[have[f.name.lower()].name], have[f.name.lower()].dataType, f.dataType).alias(f.name) if f.name.lower() in have else F.lit(None).cast(f.dataType).alias(f.name) for f in new]
        return F.when(value.isNotNull(), F.struct(*parts))
    if isinstance(new, T.ArrayType) and isinstance(old, T.ArrayType):
        return F.transform(value, lambda x: _as(x, old.elementType, new.elementType))
    if isinstance(new, T.StringType) and isinstance(old, (T.StructType, T.ArrayType)):
        return F.to_json(value)
    return value.cast(new)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """`df` with the columns and types of a later version of its schema."""
    have = {f.name.lower(): f for f in df.schema}
    return df.select(*[_as(F.col(f"`{have[f.name.lower()].name}`"), have[f.name.lower()].dataType, f.dataType).alias(f.name) if f.name.lower() in have else F.lit(None).cast(f.dataType).alias(f.name) for f in schema])


class SchemaLog:
    """The versions of one feed's format, in `path`: `<version>.json` with the schema and the newest file looked at."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def versions(self) -> dict[int, dict]:
        at, fs = hadoop(self.spark, self.path)
        if not fs.exists(at):
            return {}
        out = {}
        for status in fs.listStatus(at):
            name = status.getPath().getName()
            if name.endswith(".json"):
                stream = fs.open(status.getPath())
                try:
                    out[int(name[:-5])] = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
                finally:
                    stream.close()
        return dict(sorted(out.items()))

    def schemas(self) -> dict[int, T.StructType]:
        return {n: T.StructType.fromJson(v["schema"]) for n, v in self.versions().items()}

    def _put(self, version: int, entry: dict) -> None:
        at, fs = hadoop(self.spark, f"{self.path}/.{version}.next")
        stream = fs.create(at, True)
        try:
            stream.write(bytearray(json.dumps(entry).encode()))
        finally:
            stream.close()
        to, _ = hadoop(self.spark, f"{self.path}/{version}.json")
        fs.delete(to, False)
        if not fs.rename(at, to):
            raise OSError(f"cannot write {to}")

    def _new_files(self, folder: str, pattern: str, seen: int) -> list[tuple[str, int]]:
        """Files as new as the newest that was looked at, or newer: two may have one time stamp."""
        at, fs = hadoop(self.spark, f"{folder}/{pattern}")
        return sorted((s.getPath().toString(), s.getModificationTime()) for s in fs.globStatus(at) or [] if s.isFile() and s.getModificationTime() >= seen)

    def look(self, folder: str, kind: str, pattern: str) -> int | None:
        """Take the files that are new into account; gives the version to read them with, None if the feed has had
        no files."""
        known = self.versions()
        last = max(known, default=0)
        files = self._new_files(folder, pattern, known[last]["seen"] if known else 0)
        if not files:
            return last or None
        before = T.StructType.fromJson(known[last]["schema"]) if known else T.StructType()
        found = before
        for schema in self._inferred(kind, [f for f, _ in files], found):
            found = merge(found, schema)
        seen = max(t for _, t in files)
        if known and found == before:
            self._put(last, known[last] | {"seen": seen})
            return last
        self._put(last + 1, {"schema": found.jsonValue(), "seen": seen})
        return last + 1

    def _inferred(self, kind: str, files: list[str], known: T.StructType) -> Iterator[T.StructType]:
        if kind == "json":
            rows = self.spark.read.option("columnNameOfCorruptRecord", RESCUED).json(files)
            yield T.StructType([f for f in settled(rows.schema) if f.name != RESCUED])
        elif kind == "csv":
            # columns of text are told apart by their places: a header must begin as the known one does, or go on as it does
            order = [f.name for f in known]
            for file in files:
                names = self._header(file)
                if names[: len(order)] != order[: len(names)]:
                    raise ValueError(f"{file}: the columns {names} are not {order}, fewer of these or more after them")
                order = max(order, names, key=len)
            yield T.StructType([T.StructField(n, T.StringType()) for n in order])
        else:
            for file in files:
                yield self.spark.read.format(kind).load(file).schema

    def _header(self, file: str) -> list[str]:
        at, fs = hadoop(self.spark, file)
        reader = self.spark._jvm.java.io.BufferedReader(self.spark._jvm.java.io.InputStreamReader(fs.open(at), "UTF-8"))
        try:
            return next(csv.reader([reader.readLine() or ""]), [])
        finally:
            reader.close()
