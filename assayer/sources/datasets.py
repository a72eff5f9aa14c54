"""Evaluation samples from JSON lines, CSV and tables, and back."""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.functions.text import is_blank, utrim

SINGLE_TURN = (
    "sample_type string, user_input string, response string, retrieved_contexts array<string>, reference string, reference_contexts array<string>, "
    "retrieved_context_ids array<string>, reference_context_ids array<string>, rubrics array<array<string>>, metadata map<string,string>"
)
MULTI_TURN = (
    "messages array<struct<role:string,content:string,tool_call_id:string,tool_calls:array<struct<id:string,name:string,arguments:string>>>>, "
    "reference_tool_calls array<struct<id:string,name:string,arguments:string>>, reference_topics array<string>"
)
LISTS = ["reference_contexts", "retrieved_context_ids", "reference_context_ids"]


class DatasetError(ValueError):
    """What is wrong with a dataset, told on the driver."""


def read_jsonl(spark: SparkSession, path: str, columns: dict[str, str] | None = None) -> DataFrame:
    """Samples of a JSON lines file; broken lines fail. columns maps canonical names to those of the
    file; where both are there the renamed one wins."""
    schema = f"{SINGLE_TURN}, {MULTI_TURN}"
    for canonical, actual in (columns or {}).items():
        kind = next(f.split(" ", 1)[1] for f in _fields(schema) if f.split(" ", 1)[0] == canonical)
        schema += f", `{actual}` {kind}"
    df = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    for canonical, actual in (columns or {}).items():
        df = df.withColumn(canonical, F.coalesce(F.col(f"`{actual}`"), F.col(canonical))).drop(actual)
    df = df.withColumns({c: F.coalesce(F.col(c), F.array().cast("array<string>")) for c in LISTS})
    rubric = F.transform("rubrics", lambda r: F.struct(r[0].cast("long").alias("score"), r[1].alias("description")))
    return with_index(df.withColumn("rubrics", rubric))


def first_broken_line(spark: SparkSession, path: str) -> int | None:
    """The 1-based number, within its file, of the first line that is no JSON object; blank ones count
    as lines. Lines before it are counted where they are read."""
    at = ["_metadata.file_path", "_metadata.file_block_start"]
    lines = spark.read.text(path).select("value", F.col(at[0]).alias("file"), F.col(at[1]).alias("block"), F.monotonically_increasing_id().alias("n"))
    bad = lines.where(~is_blank(F.col("value")) & (F.try_parse_json("value").isNull() | ~F.startswith(utrim(F.col("value")), F.lit("{")))).agg(F.min(F.struct("file", "block", "n")).alias("b")).first()["b"]
    if bad is None:
        return None
    before = (F.col("file") == bad["file"]) & ((F.col("block") < bad["block"]) | (F.col("block") == bad["block"]) & (F.col("n") <= bad["n"]))
    return lines.where(before).count()


def checked_jsonl(spark: SparkSession, path: str, columns: dict[str, str] | None = None) -> DataFrame:
    """read_jsonl, with an error that tells the first broken line."""
    line = first_broken_line(spark, path)
    if line:
        raise DatasetError(f"line {line} is no JSON object")
    return read_jsonl(spark, path, columns)


def _fields(schema: str) -> list[str]:
    out, deep = [""], 0
    for c in schema:
        deep += (c == "<") - (c == ">")
        if c == "," and not deep:
            out.append("")
        else:
            out[-1] += c
    return [f.strip() for f in out]


def with_index(df: DataFrame) -> DataFrame:
    """Adds sample_index, ascending in file order; it may have gaps, so that no task sees all rows."""
    return df.withColumn("sample_index", F.monotonically_increasing_id())


def contexts_cell(c: Column) -> Column:
    """A JSON array, or texts between bars."""
    bars = F.filter(F.transform(F.split(c, r"\|"), utrim), lambda x: x != "")
    return F.when(F.startswith(utrim(c), F.lit("[")), F.from_json(utrim(c), "array<string>")).otherwise(bars)


def read_csv(spark: SparkSession, path: str, columns: dict[str, str] | None = None) -> DataFrame:
    """Single-turn samples of a CSV file with a header; metadata.<key> columns become the map."""
    df = spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).option("multiLine", True).option("escape", '"').csv(path)
    for canonical, actual in (columns or {}).items():
        df = df.drop(*({canonical} - {actual})).withColumnRenamed(actual, canonical)
    missing = [c for c in ("user_input", "response", "retrieved_contexts") if c not in df.columns]
    if missing:
        raise DatasetError(f"missing required column {missing[0]}")
    meta = [c for c in df.columns if c.startswith("metadata.")]
    pairs = [x for c in meta for x in (F.lit(c.removeprefix("metadata.")), F.col(f"`{c}`"))]
    metadata = F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull()) if pairs else F.create_map().cast("map<string,string>")
    reference = F.nullif(utrim(F.col("reference")), F.lit("")) if "reference" in df.columns else F.lit(None).cast("string")
    return with_index(df.select(F.lit("single_turn").alias("sample_type"), "user_input", "response", contexts_cell(F.col("retrieved_contexts")).alias("retrieved_contexts"), reference.alias("reference"), metadata.alias("metadata")))


def checked_csv(spark: SparkSession, path: str, columns: dict[str, str] | None = None) -> DataFrame:
    """read_csv, with an error that tells the row of the first blank required cell; the header is row 1."""
    df = read_csv(spark, path, columns)
    blank = {"user_input": is_blank(F.col("user_input")), "response": is_blank(F.col("response")), "retrieved_contexts": F.coalesce(F.size("retrieved_contexts") <= 0, F.lit(True))}
    field = F.coalesce(*[F.when(b, F.lit(c)) for c, b in blank.items()])
    bad = df.withColumn("_f", field).where("_f is not null").agg(F.min(F.struct("sample_index", "_f")).alias("b")).first()["b"]
    if bad:
        raise DatasetError(f"row {df.where(F.col('sample_index') < bad['sample_index']).count() + 2}: {bad['_f']} is blank")
    return df


def write_jsonl(df: DataFrame, path: str) -> None:
    """One object per line; nulls and empty optional lists are left out."""
    optional = [c for c in LISTS if c in df.columns]
    df = df.withColumns({c: F.when(F.size(c) > 0, F.col(c)) for c in optional})
    df.select(F.to_json(F.struct(*[c for c in df.columns if c != "sample_index"])).alias("value")).write.text(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Single-turn samples only; metadata keys are the union over all rows, sorted."""
    if "sample_type" in df.columns and not df.where("sample_type <> 'single_turn'").isEmpty():
        raise DatasetError("multi-turn samples cannot be written as CSV")
    keys = [r[0] for r in df.select(F.explode(F.map_keys("metadata"))).distinct().orderBy(F.col("col")).toLocalIterator()]
    cols = ["user_input", "response", F.to_json("retrieved_contexts").alias("retrieved_contexts"), "reference"]
    df.select(*cols, *[F.col("metadata")[k].alias(f"metadata.{k}") for k in keys]).write.option("header", True).option("escape", '"').csv(path)


def single_turn(df: DataFrame) -> DataFrame:
    return df.where("sample_type = 'single_turn'")


def issues(df: DataFrame, required: list[str] | None = None) -> DataFrame:
    """(sample_index, field, message) for blank inputs and answers, contexts that are all blank, and
    further required fields that are absent."""
    checks = {c: is_blank(F.col(c)) for c in ("user_input", "response")}
    checks["retrieved_contexts"] = ~F.coalesce(F.exists("retrieved_contexts", lambda c: ~is_blank(c)), F.lit(False))
    for c in required or []:
        kind = df.schema[c].dataType.typeName()
        checks.setdefault(c, is_blank(F.col(c)) if kind == "string" else F.coalesce(F.size(c) == 0, F.lit(True)))
    found = F.array(*[F.when(bad, F.struct(F.lit(c).alias("field"), F.lit(f"{c} must not be blank").alias("message"))) for c, bad in checks.items()])
    return df.select("sample_index", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("i")).select("sample_index", "i.*")


def validated(df: DataFrame) -> DataFrame:
    """df, if it has rows and none with an issue; else an error that names the first."""
    if df.isEmpty():
        raise DatasetError("the dataset is empty")
    first = issues(single_turn(df)).orderBy("sample_index", "field").first()
    if first:
        raise DatasetError(f"invalid sample {first['sample_index']}: {first['message']}")
    return df


class TableBackend:
    """Datasets by name, as tables of the session's catalog."""

    def __init__(self, spark: SparkSession, database: str = "default") -> None:
        self.spark, self.database = spark, database

    def save(self, name: str, df: DataFrame) -> None:
        df.write.mode("overwrite").saveAsTable(f"{self.database}.{name}")

    def load(self, name: str) -> DataFrame:
        if not self.spark.catalog.tableExists(f"{self.database}.{name}"):
            raise DatasetError(f"no dataset {name}")
        return self.spark.table(f"{self.database}.{name}")

    def list(self) -> list[str]:
        return sorted(t.name for t in self.spark.catalog.listTables(self.database) if not t.isTemporary)

    def delete(self, name: str) -> bool:
        there = self.spark.catalog.tableExists(f"{self.database}.{name}")
        self.spark.sql(f"DROP TABLE IF EXISTS {self.database}.{name}")
        return there


class ViewBackend(TableBackend):
    """The same over temporary views."""

    def __init__(self, spark: SparkSession) -> None:
        super().__init__(spark)
        self._names: dict[str, DataFrame] = {}

    def save(self, name: str, df: DataFrame) -> None:
        self._names[name] = df
        df.createOrReplaceTempView(name)

    def load(self, name: str) -> DataFrame:
        if name not in self._names:
            raise DatasetError(f"no dataset {name}")
        return self._names[name]

    def list(self) -> list[str]:
        return sorted(self._names)

    def delete(self, name: str) -> bool:
        self.spark.catalog.dropTempView(name)
        return self._names.pop(name, None) is not None


class FileBackend(TableBackend):
    """Datasets as folders of JSON lines below a path."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        super().__init__(spark)
        self.path = path.rstrip("/")

    def _fs(self):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), self.spark._jvm.org.apache.hadoop.fs.Path

    def save(self, name: str, df: DataFrame) -> None:
        self.delete(name)
        write_jsonl(df, f"{self.path}/{name}")

    def load(self, name: str) -> DataFrame:
        if name not in self.list():
            raise DatasetError(f"no dataset {name}")
        return read_jsonl(self.spark, f"{self.path}/{name}")

    def list(self) -> list[str]:
        fs, path = self._fs()
        return sorted(s.getPath().getName() for s in fs.listStatus(path(self.path))) if fs.exists(path(self.path)) else []

    def delete(self, name: str) -> bool:
        fs, path = self._fs()
        return fs.delete(path(f"{self.path}/{name}"), True)


class DatasetBuilder:
    """Single- and multi-turn samples in the order in which they are added, with metadata of the whole."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.parts, self.metadata = spark, [], {}

    def add(self, samples: DataFrame) -> DatasetBuilder:
        self.parts.append(samples)
        return self

    def add_single_turn(self, user_input: str, response: str, retrieved_contexts: list[str], reference: str | None = None, **metadata: str) -> DatasetBuilder:
        row = ("single_turn", user_input, response, list(retrieved_contexts), reference, metadata)
        return self.add(self.spark.createDataFrame([row], "sample_type string, user_input string, response string, retrieved_contexts array<string>, reference string, metadata map<string,string>"))

    def add_multi_turn(self, messages: list[tuple[str, str]], reference: str | None = None, **metadata: str) -> DatasetBuilder:
        turns = [(r, c, None, []) for r, c in messages]
        kind = "messages array<struct<role:string,content:string,tool_call_id:string,tool_calls:array<struct<id:string,name:string,arguments:string>>>>"
        return self.add(self.spark.createDataFrame([("multi_turn", turns, reference, metadata)], f"sample_type string, {kind}, reference string, metadata map<string,string>"))

    def with_metadata(self, key: str, value: str) -> DatasetBuilder:
        self.metadata[key] = value
        return self

    def build(self) -> tuple[DataFrame, dict[str, str]]:
        if not self.parts:
            raise DatasetError("the dataset is empty")
        out = self.parts[0].withColumn("_part", F.lit(0))
        for i, p in enumerate(self.parts[1:], 1):
            out = out.unionByName(p.withColumn("_part", F.lit(i)), allowMissingColumns=True)
        return with_index(out.drop("sample_index")).drop("_part"), dict(sorted(self.metadata.items()))


@dataclass(frozen=True)
class SheetConfig:
    """Where sheets would be; nothing here reaches a network."""

    folder: str
    credentials: str = ""

    def shown(self) -> dict[str, str]:
        return {"folder": self.folder, "credentials": "***" if self.credentials else ""}


class MemorySheets:
    """A transport of sheets as lists of rows."""

    def __init__(self) -> None:
        self.sheets: dict[str, list[list[str]]] = {}

    def write(self, name: str, rows: list[list[str]]) -> None:
        self.sheets[name] = rows

    def read(self, name: str) -> list[list[str]] | None:
        return self.sheets.get(name)

    def names(self) -> list[str]:
        return sorted(self.sheets)

    def delete(self, name: str) -> bool:
        return self.sheets.pop(name, None) is not None


class SheetBackend(TableBackend):
    """Datasets as sheets of a transport: a header with the sorted names, a cell per value, lists and maps
    as JSON. A sheet is small by nature; over ``most_rows`` rows saving is an error."""

    def __init__(self, spark: SparkSession, transport, config: SheetConfig, most_rows: int = 100_000) -> None:
        super().__init__(spark)
        self.transport, self.config, self.most_rows = transport, config, most_rows

    def _sheet(self, name: str) -> str:
        return f"{self.config.folder}/{name}.gsheet"

    def save(self, name: str, df: DataFrame) -> None:
        cols = sorted(c for c in df.columns if c != "sample_index")
        cells = [F.to_json(c) if df.schema[c].dataType.typeName() in ("array", "map", "struct") else F.col(c).cast("string") for c in cols]
        ordered = df.orderBy("sample_index") if "sample_index" in df.columns else df
        rows = ordered.select(*[c.alias(n) for c, n in zip(cells, cols, strict=True)]).limit(self.most_rows + 1).collect()
        if len(rows) > self.most_rows:
            raise DatasetError(f"a sheet holds at most {self.most_rows} rows")
        kinds = [df.schema[c].dataType.simpleString() for c in cols]
        self.transport.write(self._sheet(name), [cols, kinds, *[["" if v is None else v for v in r] for r in rows]])

    def load(self, name: str) -> DataFrame:
        rows = self.transport.read(self._sheet(name))
        if rows is None:
            raise DatasetError(f"no dataset {name}")
        cols, kinds = rows[0], rows[1]
        df = self.spark.createDataFrame([tuple(r) for r in rows[2:]] or [], ", ".join(f"`{c}` string" for c in cols))
        cell = lambda c: F.nullif(F.col(f"`{c}`"), F.lit(""))
        nested = ("array", "map", "struct")
        return with_index(df.select(*[(F.from_json(cell(c), k) if k.startswith(nested) else cell(c).cast(k)).alias(c) for c, k in zip(cols, kinds, strict=True)]))

    def list(self) -> list[str]:
        head, tail = self.config.folder + "/", ".gsheet"
        return [n.removeprefix(head).removesuffix(tail) for n in self.transport.names() if n.startswith(head)]

    def delete(self, name: str) -> bool:
        return self.transport.delete(self._sheet(name))


class DiskCache:
    """Bytes by key in a folder of the driver's machine, for tools; stages use cache tables."""

    def __init__(self, folder: str) -> None:
        self.folder = folder
        os.makedirs(folder, exist_ok=True)

    def _path(self, key: str) -> str:
        return os.path.join(self.folder, key.encode().hex() + ".json")

    def set(self, key: str, value: bytes) -> None:
        held = f"{self._path(key)}.{uuid.uuid4().hex}"
        with open(held, "w", encoding="utf-8") as f:
            json.dump({"key": key, "value": value.hex()}, f)
        os.replace(held, self._path(key))

    def get(self, key: str) -> bytes | None:
        try:
            with open(self._path(key), encoding="utf-8") as f:
                return bytes.fromhex(json.load(f)["value"])
        except FileNotFoundError:
            return None

    def has_key(self, key: str) -> bool:
        return os.path.exists(self._path(key))

    def delete(self, key: str) -> bool:
        there = self.has_key(key)
        if there:
            os.remove(self._path(key))
        return there

    def keys(self) -> list[str]:
        return sorted(bytes.fromhex(n.removesuffix(".json")).decode() for n in os.listdir(self.folder) if n.endswith(".json"))


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """A graph as lines of JSON, a node or an edge each, in order."""
    n = nodes.select(F.lit("node").alias("kind"), "ord", "id", "node_type", "props")
    e = edges.select(F.lit("edge").alias("kind"), "ord", "source_id", "target_id", "relationship", "props")
    n.unionByName(e, allowMissingColumns=True).select(F.to_json(F.struct("*")).alias("value")).write.text(path)


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    props = "props map<string,string>"
    df = spark.read.schema(f"kind string, ord long, id string, node_type string, source_id string, target_id string, relationship string, {props}").option("mode", "FAILFAST").json(path)
    return df.where("kind = 'node'").select("ord", "id", "node_type", "props"), df.where("kind = 'edge'").select("ord", "source_id", "target_id", "relationship", "props")
