"""Record sources: JSONL, CSV, TSV, XML history pages, format detection.

Every reader returns the same shape: ``fields map<string,string>`` (the raw
record), ``parse_error`` (why the line is not a record, else null) and
arrival-order columns ``_file``, ``_block``, ``_pos`` so "first"/"last"
semantics (import limit, last write wins) do not depend on partitioning.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from encore.sources import fs

ORDER_COLS = ["_file", "_block", "_pos"]


def _with_order(df: DataFrame) -> DataFrame:
    return df.withColumn("_file", F.col("_metadata.file_path")).withColumn(
        "_block", F.col("_metadata.file_block_start")
    ).withColumn("_pos", F.monotonically_increasing_id())


def with_line_numbers(df: DataFrame) -> DataFrame:
    """1-based line numbers per file for line-per-record text sources.

    Rows of one split are contiguous in reading order, so the line is
    (lines in earlier splits of the file) + (position inside the split). Only
    the per-split summary -- one row per split -- goes through a window.
    """
    splits = df.groupBy("_file", "_block").agg(
        F.min("_pos").alias("_first"), F.count(F.lit(1)).alias("_n")
    )
    w = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    return df.join(splits, ["_file", "_block"]).withColumn(
        "_line", F.col("_before") + (F.col("_pos") - F.col("_first")) + 1
    ).drop("_first", "_n", "_before")


def parse_json_lines(text: DataFrame) -> DataFrame:
    """Lines (column ``value``) as ``fields`` and ``parse_error``, other columns kept; blank lines skipped."""
    fields = F.from_json("value", "map<string,string>")
    variant = F.try_parse_json("value")
    kind = F.schema_of_variant(variant)
    error = (
        F.when(fields.isNotNull(), F.lit(None).cast("string"))
        .when(variant.isNull(), F.lit("Invalid JSON"))
        .otherwise(F.concat(F.lit("Expected JSON object, got "), F.lower(F.split(kind, "<")[0])))
    )
    lines = text.filter(F.length(F.trim("value")) > 0)
    return lines.select(fields.alias("fields"), error.alias("parse_error"), *[c for c in text.columns if c != "value"])


def read_jsonl(spark: SparkSession, path: str | list[str], line_numbers: bool = True) -> DataFrame:
    """One JSON object per line; blank lines skipped; others flagged."""
    text = _with_order(spark.read.text(path))
    if line_numbers:
        text = with_line_numbers(text)
    return parse_json_lines(text).select("fields", "parse_error", *ORDER_COLS, *(["_line"] if line_numbers else []))


#: Name of the column of a cell beyond the header's.
BEYOND = "_cell_beyond"


def read_delimited(
    spark: SparkSession, path: str | list[str], sep: str = ",", encoding: str = "UTF-8", multiline: bool = True
) -> DataFrame:
    """CSV/TSV with a header row, quoted fields, any column order; all text.

    Each file has its own header; files with the same one are read together. ``_line`` is the
    record's number plus one for the header, so the line if no quoted cell holds a line break. A row
    that holds something beyond the header's cells gets a ``parse_error``; one with fewer cells lacks the last fields. ``multiline`` (line breaks inside quotes) reads a file in one task;
    without it large files are split.
    """
    paths = [path] if isinstance(path, str) else path
    headers: dict[str, list[str]] = {}
    for file in [f for p in paths for f in fs.files_in(spark, p)]:
        headers.setdefault(fs.first_line(spark, file, encoding), []).append(file)
    options = {"header": True, "sep": sep, "quote": '"', "escape": '"', "encoding": encoding, "multiLine": multiline}
    parts = [_delimited(spark, files, {k: str(v) for k, v in options.items()}) for files in headers.values()]
    if not parts:
        raise ValueError(f"no file at {path}")
    return reduce(DataFrame.unionByName, parts)


def _delimited(spark: SparkSession, files: list[str], options: dict[str, str]) -> DataFrame:
    """Files with one header."""
    names = spark.read.options(**options).csv(files[0]).columns
    # one more column than the header has: a cell there is one too many
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, BEYOND]])
    rows = spark.read.schema(schema).options(**options).csv(files)
    rows = with_line_numbers(_with_order(rows)).withColumn("_line", F.col("_line") + 1)
    pairs = [x for n in names for x in (F.lit(n), F.col(f"`{n}`"))]
    fields = F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull())
    error = F.when(F.col(BEYOND).isNotNull(), F.lit("more cells than the header has"))
    return rows.select(F.when(error.isNull(), fields).alias("fields"), error.alias("parse_error"), *ORDER_COLS, "_line")


def read_history_xml(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Landed history pages, one ``<track>`` element per play.

    Attributes arrive as ``_mbid``/``_uts``; an element with only an
    attribute (the empty ``<album mbid=..>``) has no ``_VALUE``.
    Values stay text: a title may look like a time or a number.
    """
    df = _with_order(spark.read.format("xml").option("rowTag", "track").option("inferSchema", False).load(path))

    def field(name: str, sub: str):
        if name not in df.columns:
            return F.lit(None).cast("string")
        dtype = df.schema[name].dataType
        if hasattr(dtype, "fieldNames"):
            return F.col(f"{name}.{sub}").cast("string") if sub in dtype.fieldNames() else F.lit(None).cast("string")
        return F.col(name).cast("string") if sub == "_VALUE" else F.lit(None).cast("string")

    entries = {
        "timestamp": field("date", "_uts"),
        "artist": field("artist", "_VALUE"),
        "artist_mbid": field("artist", "_mbid"),
        "album": field("album", "_VALUE"),
        "album_mbid": field("album", "_mbid"),
        "track": field("name", "_VALUE"),
        "track_mbid": field("mbid", "_VALUE"),
    }
    pairs = []
    for k, v in entries.items():
        pairs += [F.lit(k), v]
    fields = F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull() & (F.length(v) > 0))
    return df.select(fields.alias("fields"), F.lit(None).cast("string").alias("parse_error"), *ORDER_COLS)


def detect_format(first_line: str) -> str:
    """S3: ``{`` + valid JSON -> jsonl; a tab -> tsv; a comma -> csv; else jsonl. A tag opens a history page (xml)."""
    stripped = first_line.strip().removeprefix("\ufeff")
    if stripped.startswith("<"):
        return "xml"
    if stripped.startswith("{"):
        try:
            json.loads(stripped)
            return "jsonl"
        except ValueError:
            pass
    if "\t" in stripped:
        return "tsv"
    if "," in stripped:
        return "csv"
    return "jsonl"


#: Format by the end of a file's name; other files are told by their first line, as csv and tsv from each other.
EXTENSIONS = {".jsonl": "jsonl", ".ndjson": "jsonl", ".json": "jsonl", ".tsv": "tsv", ".xml": "xml"}


def format_of(spark: SparkSession, file: str) -> str:
    name = file.rsplit("/", 1)[-1].lower().removesuffix(".gz")
    found = next((f for end, f in EXTENSIONS.items() if name.endswith(end)), None)
    if found:
        return found
    told = detect_format(fs.first_line(spark, file))
    return "csv" if name.endswith(".csv") and told not in ("csv", "tsv") else told


def read_files(spark: SparkSession, files: list[str], fmt: str) -> DataFrame:
    """Record files of one format."""
    if fmt == "jsonl":
        return read_jsonl(spark, files)
    if fmt in ("csv", "tsv"):
        return read_delimited(spark, files, "," if fmt == "csv" else "\t")
    if fmt == "xml":
        return read_history_xml(spark, files).withColumn("_line", F.lit(None).cast("long"))
    raise ValueError(f"unknown record format: {fmt}")


def read_routed(spark: SparkSession, files: list[str]) -> DataFrame:
    """Record files of any formats, each read by its own; arrival order is by file name, whatever the format."""
    by_format: dict[str, list[str]] = {}
    for f in files:
        by_format.setdefault(format_of(spark, f), []).append(f)
    return reduce(DataFrame.unionByName, [read_files(spark, own, fmt) for fmt, own in sorted(by_format.items())])


def read_records(spark: SparkSession, path: str, fmt: str = "auto") -> DataFrame:
    """Read any supported record file, or folder of them; ``auto`` tells each file's format."""
    if fmt == "auto":
        return read_routed(spark, fs.files_in(spark, path))
    return read_files(spark, [path], fmt)


def flatten_struct(df: DataFrame, sep: str = "_") -> DataFrame:
    """S9 ``--flatten``: nested struct fields become ``parent_child`` columns."""

    def walk(schema, prefix, path):
        out = []
        for f in schema.fields:
            name = f"{prefix}{sep}{f.name}" if prefix else f.name
            ref = f"{path}.`{f.name}`" if path else f"`{f.name}`"
            if hasattr(f.dataType, "fields"):
                out += walk(f.dataType, name, ref)
            else:
                out.append(F.col(ref).alias(name))
        return out

    return df.select(*walk(df.schema, "", ""))
