"""Logical sources as DataFrames, and references as columns over them.

`Records` is what a logical source gives: a DataFrame with a row for each record, and `values(reference)`, the
array<string> of a reference's values in a record (`one(reference)`, where a record has one value at most).
"""

import os
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom.errors import MappingError
from quadloom.expr import jsonpath, xpath
from quadloom.mapping.model import LogicalSource
from quadloom.rdf.terms import QL

TABLE = "http://quadloom.example/ns#Table"
#: JSON records are taken apart at once from so many keys on (fewer are faster one by one).
FEW = 4
NONE = lambda: F.array().cast("array<string>")
Resolver = Callable[[str], object]
SAFE = {"tinyint", "smallint", "int", "bigint", "float", "double", "decimal", "boolean", "date"}
PLAIN = SAFE | {"timestamp", "timestamp_ntz"}


@dataclass
class Records:
    df: DataFrame
    values: Callable[[str], Column]
    one: Callable[[str], Column | None] = field(default=lambda ref: None)
    #: Whether the values are known to be ASCII (numbers, dates).
    plain: Callable[[str], bool] = field(default=lambda ref: False)
    #: Whether the values are known to need no escape in IRIs (numbers, not times).
    safe: Callable[[str], bool] = field(default=lambda ref: False)
    #: Bytes of the files that df scans (0: it is no mere scan of files).
    size: int = 0


# ---- resolvers


def file_resolver(base: str | os.PathLike) -> Resolver:
    """Paths below base; nothing if there is no such file. A base that is a URL is joined without a look."""

    def resolve(path: str):
        full = os.path.join(os.fspath(base), path)
        return full if "://" in full or os.path.exists(full) else None

    return resolve


def package_resolver(package: str, folder: str = "") -> Resolver:
    """Files that are shipped in a Python package."""
    from importlib.resources import files

    def resolve(path: str):
        at = files(package).joinpath(folder, path)
        return str(at) if at.is_file() else None

    return resolve


def tables_resolver(spark: SparkSession, folder: str) -> Resolver:
    """Tables kept as folder/name.parquet."""
    return lambda name: spark.read.parquet(f"{folder}/{name}.parquet")


def first_of(resolvers: Iterable[Resolver]) -> Resolver:
    resolvers = list(resolvers)

    def resolve(path: str):
        for r in resolvers:
            if (found := r(path)) is not None:
                return found
        return None

    return resolve


# ---- formulations


def csv_delimiter(lines: list[str]) -> str:
    """The sign that is neither letter, digit nor quote and stands equally often in each record, most often."""
    counts: dict[str, list[int]] = {}
    for line in lines:
        bare, inside = [], False
        for c in line:
            if c == '"':
                inside = not inside
            elif not inside:
                bare.append(c)
        for c in {c for c in bare if not c.isalnum() and c not in " _.-'()@:/#"}:
            counts.setdefault(c, []).append(bare.count(c))
    if not counts:
        return ","
    return max(counts, key=lambda c: (len(counts[c]) == len(lines) and len(set(counts[c])) == 1, len(counts[c]), counts[c][0], c == ","))


def csv_records(spark: SparkSession, logical: LogicalSource, found, provided: bool, options: dict) -> Records:
    if isinstance(found, DataFrame):
        df = found
    else:
        head = spark.read.text(str(found)).limit(20)
        lines = [r.value for r in head.collect() if r.value and not r.value.startswith("#")]
        multiline = options.get("multiline")
        if multiline is None:  # a file with line breaks in quotes cannot be split, so files are looked through first
            odd = F.pmod(F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit(""))), F.lit(2)) == 1
            multiline = bool(spark.read.text(str(found)).where(odd).take(1))
        reader = spark.read.options(header=True, multiLine=multiline, escape='"', quote='"', maxCharsPerColumn=-1, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, comment="#", emptyValue="", nullValue="", sep=csv_delimiter(_whole(lines)), enforceSchema=False)
        df = reader.csv(str(found)) if lines else spark.createDataFrame([], "`_none` string")
    return _columns(df, bool(df.columns) and df.columns != ["_none"])


def _whole(lines: list[str]) -> list[str]:
    """Lines that are records of their own: those before the first with an open quote."""
    out = []
    for line in lines:
        if line.count('"') % 2:
            break
        out.append(line)
    return out or lines[:1]


def table_records(spark: SparkSession, logical: LogicalSource, found, provided: bool, options: dict) -> Records:
    df = found if isinstance(found, DataFrame) else spark.read.parquet(str(found))
    records = _columns(df, True)
    records.size = _scanned(df)
    return records


def _scanned(df: DataFrame) -> int:
    """Bytes of the files, if df is a scan of files and nothing else."""
    plan = df._jdf.queryExecution().analyzed()
    return int(str(plan.stats().sizeInBytes())) if plan.getClass().getSimpleName() == "LogicalRelation" else 0


def _columns(df: DataFrame, strict: bool) -> Records:
    types = dict(df.dtypes)

    def column(ref: str) -> Column:
        if ref not in types:
            if not strict:
                return F.lit(None).cast("string")
            raise MappingError(f"there is no column {ref!r}; columns: {', '.join(types)}")
        return F.col("`" + ref.replace("`", "``") + "`")

    def one(ref: str) -> Column | None:
        c = column(ref)
        return None if types.get(ref, "").startswith("array") else c.cast("string")

    def values(ref: str) -> Column:
        c = column(ref)
        if types.get(ref, "").startswith("array"):
            return F.coalesce(F.filter(c.cast("array<string>"), lambda x: x.isNotNull()), NONE())
        return F.when(c.isNull(), NONE()).otherwise(F.array(c.cast("string")))

    kind = lambda ref: types.get(ref, "string").split("(")[0]
    return Records(df, values, one, lambda ref: kind(ref) in PLAIN, lambda ref: kind(ref) in SAFE)


def json_records(spark: SparkSession, logical: LogicalSource, found, provided: bool, options: dict) -> Records:
    """Texts of whole documents (or lines, with the option lines); a DataFrame has them in its first column."""
    docs = found if isinstance(found, DataFrame) else spark.read.text(str(found), wholetext=not options.get("lines"))
    first = F.col(f"`{docs.columns[0]}`")
    df = docs.where(F.trim(first) != "").select(F.explode(jsonpath.records(first, logical.iterator, provided)).alias("record"))
    keys = list(dict.fromkeys(k for ref in options.get("references", ()) if (k := jsonpath.single_key(ref)) is not None))
    if len(keys) < FEW:
        keys = []
    else:  # one look at a record for all of its keys
        df = df.select("record", F.json_tuple("record", *keys).alias(*[f"__key{i}" for i in range(len(keys))]))
    made = Records(df, lambda ref: NONE())

    def values(ref: str) -> Column:
        key = jsonpath.single_key(ref)
        if key in keys:
            return jsonpath.listed(F.col(f"__key{keys.index(key)}"), F.col("record"), ref)
        if (path := jsonpath.native(ref)) is not None:
            name = f"__path{len(made.df.columns)}"
            made.df = made.df.withColumn(name, F.get_json_object("record", path))
            return jsonpath.listed(F.col(name), F.col("record"), ref)
        return jsonpath.reference(F.col("record"), ref)

    made.values = values
    return made


def xml_records(spark: SparkSession, logical: LogicalSource, found, provided: bool, options: dict) -> Records:
    docs = found if isinstance(found, DataFrame) else spark.read.text(str(found), wholetext=True)
    spaces = dict(logical.source.namespaces) if logical.source else {}
    spaces.pop("", None)
    as_text = options.get("text_extraction", True)
    iterator = logical.iterator or "/*"
    xpath.compile_path(iterator, spaces)  # errors show when the plan is made

    refs = list(dict.fromkeys(options.get("references", ())))
    for ref in refs:
        xpath.compile_path(ref, spaces)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find, each = xpath.compile_path(iterator, spaces), [xpath.compile_path(ref, spaces) for ref in refs]
        for batch in batches:
            out = []
            for text in batch.iloc[:, 0]:
                if text and text.strip():
                    for n in find(xpath.parse_document(text)):
                        if isinstance(n, xpath.Node):  # a record is an element without what stands around it
                            top = xpath.Document(n.element).top
                            out.append([xpath.values(f(top), as_text) for f in each])
            yield pd.DataFrame({f"r{i}": pd.Series([row[i] for row in out], dtype=object) for i in range(len(refs))} | {"record": pd.Series([True] * len(out), dtype=bool)})

    fields = "".join(f"r{i} array<string>, " for i in range(len(refs)))
    df = docs.select(docs.columns[0]).mapInPandas(run, fields + "record boolean")

    def values(ref: str) -> Column:
        if ref not in refs:
            raise MappingError(f"the XML source was read without the reference {ref!r}")
        return F.col(f"r{refs.index(ref)}")

    return Records(df, values)


def check_iterator(logical: LogicalSource) -> None:
    """An error if the iterator cannot be read."""
    if logical.formulation == QL + "JSONPath":
        jsonpath.parse_path(logical.iterator or "$")
    elif logical.formulation == QL + "XPath":
        xpath.compile_path(logical.iterator or "/*", dict(logical.source.namespaces))


FORMULATIONS: dict[str, Callable] = {QL + "CSV": csv_records, QL + "JSONPath": json_records, QL + "XPath": xml_records, TABLE: table_records}
