"""Readers and writers with contracts: CSV, JSON, Parquet, paged text, and files found by their content."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from folioflow import scratch


def _split_fields(record: str) -> list[str]:
    """The cells of one record. Between two quoted pieces an empty one is a doubled quote; carriage returns count in quotes only."""
    pieces = record.split('"')
    fields, last = [""], len(pieces) - 1
    for k, piece in enumerate(pieces):
        if k % 2:
            fields[-1] += piece
        elif not piece and 0 < k < last:
            fields[-1] += '"'
        else:
            head, *more = piece.replace("\r", "").split(",")
            fields[-1] += head
            fields += more
    return fields


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """``(path, record, fields, closed)`` of CSV files of any size, each read in as many splits as Spark cuts it into.

    Whether a line begins within quotes depends on the number of quotes before it only: each split gives the number of its quotes
    and, for both states that it may begin in, of the records that begin in it; a running sum over the splits of a file tells its true state
    and first record, and a window within a split tells those of its lines. ``record`` counts from 0, blank ones too; the last one of a
    file isn't ``closed`` if a quote is left open.
    """
    lines = spark.read.text(path, lineSep="\n").select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("text")
    )
    lines = lines.withColumn("quotes", F.regexp_count("text", F.lit('"')).cast("long"))
    inside = W.partitionBy("path", "block").orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    lines = lines.withColumn("before", F.coalesce(F.sum("quotes").over(inside), F.lit(0)) % 2)
    blocks = lines.groupBy("path", "block").agg(F.sum("quotes").alias("quotes"), F.count_if(F.col("before") == 0).alias("even"), F.count_if(F.col("before") == 1).alias("odd"))
    earlier = W.partitionBy("path").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.withColumn("state", F.coalesce(F.sum("quotes").over(earlier), F.lit(0)) % 2)
    begun = F.when(F.col("state") == 0, F.col("even")).otherwise(F.col("odd"))
    blocks = blocks.withColumn("first", F.coalesce(F.sum(begun).over(earlier), F.lit(0))).select("path", "block", "state", "first")
    lines = lines.join(blocks, ["path", "block"]).withColumn("starts", ((F.col("before") + F.col("state")) % 2 == 0).cast("long"))
    upto = W.partitionBy("path", "block").orderBy("at").rowsBetween(W.unboundedPreceding, W.currentRow)
    lines = lines.withColumn("record", F.col("first") + F.sum("starts").over(upto) - 1)
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]), "\n")
    records = lines.groupBy("path", "record").agg(whole.alias("text"), (F.sum("quotes") % 2 == 0).alias("closed"))
    text = F.when(F.col("record") == 0, F.regexp_replace("text", "^\ufeff", "")).otherwise(F.col("text"))

    def split(values: pd.Series) -> pd.Series:
        return values.map(_split_fields)

    scratch.send_code(spark)
    return records.select("path", "record", F.pandas_udf(split, "array<string>")(text).alias("fields"), "closed")


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Strict: quotes, doubled quotes and line breaks in cells; blank rows are dropped, empty cells are null.

    A quote that is left open, a row of another width, a cell of another type, a header of other names or twice the same, and files without
    any row fail the read, with the file, the record (from 0) and the column of the first errors.
    """
    kinds = spark.createDataFrame([], schema).schema
    records = csv_records(spark, path)
    records = scratch.stage(records.filter(F.exists("fields", lambda x: F.trim(x) != "") | ~F.col("closed")), "csv")
    firsts = records.groupBy("path").agg(F.min(F.struct("record", "fields")).alias("m")).select("path", F.col("m.record").alias("header"), F.transform("m.fields", lambda x: F.trim(x)).alias("names"))
    cells = records.join(firsts, "path").filter(F.col("record") > F.col("header"))
    typed = [F.nullif(F.get("fields", k), F.lit("")).try_cast(f.dataType).alias(f.name) for k, f in enumerate(kinds)]
    cell = lambda k, f: (F.nullif(F.get("fields", k), F.lit("")).isNotNull()) & F.nullif(F.get("fields", k), F.lit("")).try_cast(f.dataType).isNull()
    wrong = F.coalesce(*(F.when(cell(k, f), F.lit(f"no {f.dataType.simpleString()} in {f.name}")) for k, f in enumerate(kinds)))
    problem = F.when(~F.col("closed"), "a quote is left open").when(F.size("fields") != len(kinds), F.concat(F.size("fields").cast("string"), F.lit(f" cells instead of {len(kinds)}"))).otherwise(wrong)
    header = F.when(F.size(F.array_distinct("names")) != F.size("names"), "a name twice").when(F.array_join("names", "\n") != "\n".join(kinds.names), "other names")
    errors = records.filter("NOT closed").select("path", "record", F.lit("a quote is left open").alias("problem")).unionByName(firsts.select("path", F.col("header").alias("record"), header.alias("problem")))
    errors = errors.unionByName(cells.select("path", "record", problem.alias("problem"))).filter("problem IS NOT NULL").distinct()
    found = errors.orderBy("path", "record", "problem").limit(5).collect()
    if found or not cells.limit(1).count():
        raise ValueError("; ".join(f"{r.path}, record {r.record}: {r.problem}" for r in found) or f"{path}: no rows")
    return cells.select(*typed)


def read_loose_csv(spark: SparkSession, path: str, integers: list[str]) -> DataFrame:
    """All text but the named columns, which are 0 where they are no number."""
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"')
    return rows.withColumns({c: F.coalesce(F.expr(f"try_cast(`{c}` AS INT)"), F.lit(0)) for c in integers})


def read_snapshot(spark: SparkSession, path: str, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of CSV files whose header has the required names, and ``(path, length, sha256, row_count)`` of the files; no rows are an error."""
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"').na.drop("all")
    rows = rows.toDF(*(c.strip().removeprefix("\ufeff").strip('"') for c in rows.columns))
    if missing := [c for c in required if c not in rows.columns]:
        raise ValueError(f"missing headers: {', '.join(missing)}")
    if not (n := rows.count()):
        raise ValueError("no data rows")
    return rows, spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"), F.lit(n).alias("row_count"))


#: Bytes of a JSON document at most.
JSON_BYTES = 10 * 1024 * 1024


def _once(pairs: list[tuple[str, object]]) -> dict:
    if len({k for k, _ in pairs}) < len(pairs):
        raise ValueError("duplicate key")
    return dict(pairs)


def _json_error(content: bytes) -> str | None:
    try:
        json.loads(content, object_pairs_hook=_once)
    except (ValueError, RecursionError) as e:
        return "duplicate key" if str(e) == "duplicate key" else "malformed"
    return None


def check_json(spark: SparkSession, path: str) -> DataFrame:
    """``(path, error)`` of JSON documents: too large, malformed, or a key twice in one object; null if sound.

    Links are followed by Spark's listing and can't be told from files.
    """
    files = spark.read.format("binaryFile").load(path)
    large = files.filter(F.col("length") > JSON_BYTES).select("path", F.lit("too large").alias("error"))

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"path": pdf["path"], "error": [_json_error(c) for c in pdf["content"]]})

    scratch.send_code(spark)
    return files.filter(F.col("length") <= JSON_BYTES).select("path", "content").mapInPandas(check, "path string, error string").unionByName(large)


def read_json_records(spark: SparkSession, path: str, field: str) -> DataFrame:
    """The records of an array field of JSON documents."""
    return spark.read.json(path, multiLine=True).select(F.inline(field))


def records_of(column, schema: str):
    """A JSON array as a relation: ``df.select(records_of("c", "id int, name string"))``."""
    return F.inline(F.from_json(column, f"array<struct<{schema}>>"))


def write_csv(rows: DataFrame, path: str, fields: list[str]) -> None:
    """Fields in the order given; arrays joined by a bar, structs as JSON, nulls empty."""
    kinds = dict(rows.dtypes)

    def cell(c):
        return F.array_join(c, "|") if kinds[c].startswith("array") else F.to_json(c) if kinds[c].startswith(("struct", "map")) else F.col(c).cast("string")

    rows.select(*(F.coalesce(cell(c), F.lit("")).alias(c) for c in fields)).write.csv(path, header=True, quote='"', escape='"', emptyValue="")


def write_summary(rows: DataFrame, path: str, title: str, order: list[str]) -> None:
    """A heading and a table in Markdown, as text; numbers to the right, rows in order, nulls blank."""
    number = ("int", "bigint", "smallint", "tinyint", "double", "float", "decimal")
    rule = [" ---: " if kind.startswith(number) else " --- " for _, kind in rows.dtypes]
    head = [f"# {title}", "", f"| {' | '.join(rows.columns)} |", f"|{'|'.join(rule)}|"]
    cells = (F.coalesce(F.replace(F.col(c).cast("string"), F.lit("|"), F.lit("\\|")), F.lit("")) for c in rows.columns)
    keys = F.struct(*order)
    body = rows.select(F.lit(len(head)).alias("part"), keys.alias("key"), F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))
    top = rows.sparkSession.createDataFrame(list(enumerate(head)), "part int, line string").select("part", F.lit(None).cast(body.schema["key"].dataType).alias("key"), "line")
    top.unionByName(body).orderBy("part", "key").select("line").write.text(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.json(path, ignoreNullFields=False)


def public_columns(rows: DataFrame, forbidden: list[str]) -> DataFrame:
    """Without the forbidden columns; a forbidden name that is left within a column is an error."""
    kept = rows.drop(*forbidden)
    if found := [p for p in paths(kept.schema) if p.rsplit(".", 1)[-1] in forbidden]:
        raise ValueError(f"forbidden fields: {', '.join(found)}")
    return kept


def paths(schema, before: str = "") -> list[str]:
    """All field paths of a schema."""
    from pyspark.sql import types as T

    if isinstance(schema, T.ArrayType):
        return paths(schema.elementType, before)
    if isinstance(schema, T.MapType):
        return paths(schema.valueType, before)
    if not isinstance(schema, T.StructType):
        return []
    return [p for f in schema for p in (f"{before}{f.name}", *paths(f.dataType, f"{before}{f.name}."))]


def resolve(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """``files(path, content)`` for ``manifest(name, sha256)``: by file name first, else by content."""
    known = files.select("path", F.element_at(F.split("path", "/"), -1).alias("file"), F.sha2("content", 256).alias("found"))
    hits = manifest.join(known, F.col("file") == F.col("name")).unionByName(manifest.join(known, F.col("found") == F.col("sha256")))
    best = hits.groupBy("name", "sha256").agg(F.min(F.struct((F.col("file") != F.col("name")).alias("other"), "path", "found")).alias("m"))
    return best.select("name", "m.path", (F.col("m.found") == F.col("sha256")).alias("verified"))


def read_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(page_id, line, text)`` of web pages, tags as line ends."""
    text = F.regexp_replace("html", "<[^>]+>", "\n")
    return scratch.table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.split(text, r"\n+")).alias("line", "text"))


def leaks(rows: DataFrame, pattern: str = r"(?i)(password|secret|api[_-]?key|bearer)\s*[=:]") -> DataFrame:
    """Rows whose JSON shows a secret."""
    return rows.filter(F.to_json(F.struct("*")).rlike(pattern))
