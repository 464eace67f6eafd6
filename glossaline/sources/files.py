"""Text files in unknown encodings, JSON Lines, job folders, file manifests, encoding scans."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import fixed_values as V
from ..functions.encoding import first_mojibake_pattern, has_mojibake
from ..functions.redaction import redact_error, redact_secrets
from ..functions.text import is_blank, lines, strip
from ..operators.jobs import is_valid_event
from ..schemas import CHECKPOINTS, ERRORS, JOBS
from . import small_files

BOM = "﻿"


def decode_bytes(df: DataFrame, content: str = "content") -> DataFrame:
    """Replace a binary column by ``text`` and ``encoding_used``.

    Valid UTF-8 (nearly every file) is decoded natively; only the rest crosses into Python, for
    the codecs Spark lacks.
    """
    native = F.try_validate_utf8(F.col(content).cast("string"))
    # A byte order mark selects the first codec of the list, which removes it.
    encoding = F.when(F.startswith(native, F.lit(BOM)), "utf-8-sig").when(native.isNotNull(), "utf-8-sig")
    known = df.withColumn("text", F.when(F.startswith(native, F.lit(BOM)), F.substring(native, 2, 2**31 - 1)).otherwise(native))
    known = known.withColumn("encoding_used", encoding)
    valid = known.filter(F.col("text").isNotNull()).drop(content)
    odd = known.filter(F.col("text").isNull()).drop("text", "encoding_used")
    return valid.unionByName(_decode_odd(odd, content)).withColumn("text", universal_newlines(F.col("text")))


def _decode_odd(df: DataFrame, content: str) -> DataFrame:
    kept = [f for f in df.schema.fields if f.name != content]
    from pyspark.sql import types as T

    schema = T.StructType([*kept, T.StructField("text", T.StringType()), T.StructField("encoding_used", T.StringType())])
    codecs = V.READ_ENCODINGS

    def one(raw: bytes) -> tuple[str, str]:
        for codec in codecs:
            try:
                return raw.decode(codec), codec
            except UnicodeDecodeError:
                continue
        return raw.decode("utf-8", errors="replace"), "utf-8-replace"

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            decoded = [one(bytes(raw)) for raw in batch[content]]
            out = batch.drop(columns=[content])
            out["text"] = [d[0] for d in decoded]
            out["encoding_used"] = [d[1] for d in decoded]
            yield out

    return df.mapInPandas(run, schema)


def universal_newlines(text: Column) -> Column:
    return F.regexp_replace(text, r"\r\n?", "\n")


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """path, text, encoding_used of every file."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")
    return decode_bytes(raw)


def write_text(df: DataFrame, path: str, text: str = "text", mode: str = "errorifexists") -> None:
    """UTF-8 with ``\\n`` line ends; folders are created."""
    df.select(F.coalesce(text, F.lit("")).alias("value")).write.mode(mode).option("lineSep", "\n").text(path)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON Lines with blank and malformed lines skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def parse_jsonl(raw: DataFrame, schema: str, line: str = "value") -> DataFrame:
    """The same for lines already in a column; other columns are kept."""
    # A corrupt-record column tells a malformed line from one that only lacks fields.
    with_corrupt = f"{schema}, _corrupt STRING"
    parsed = raw.filter(~is_blank(F.col(line))).withColumn(
        "_r", F.from_json(line, with_corrupt, {"columnNameOfCorruptRecord": "_corrupt", "mode": "PERMISSIVE"})
    )
    good = parsed.filter(F.col("_r._corrupt").isNull())
    return good.select(*[c for c in raw.columns if c != line], "_r.*").drop("_corrupt")


def _text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]


def prepare_checkpoints(events: DataFrame) -> DataFrame:
    """Events as they are stored: known names only, missing texts empty, secrets masked."""
    out = events.filter(is_valid_event(F.col("event")))
    for name in _text_columns(events):
        if name in ("job_id", "event"):
            continue
        value = F.coalesce(name, F.lit(""))
        out = out.withColumn(name, redact_error(value) if name == "error_message" else redact_secrets(value))
    return out


def prepare_failed_items(errors: DataFrame) -> DataFrame:
    out = errors.withColumn("retry_count", F.greatest(F.coalesce("retry_count", F.lit(0)), F.lit(0))).withColumn(
        "source_length", F.coalesce("source_length", F.lit(0))
    )
    for name in _text_columns(errors):
        if name == "job_id":
            continue
        value = F.coalesce(name, F.lit(""))
        out = out.withColumn(name, redact_error(value) if name == "error_message" else redact_secrets(value))
    return out


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def read_checkpoints(spark: SparkSession, path: str) -> DataFrame:
    return read_jsonl(spark, path, CHECKPOINTS)


def read_errors(spark: SparkSession, path: str) -> DataFrame:
    return read_jsonl(spark, path, ERRORS)


def job_files(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """Every ``job.json`` under a folder: its path, the job's fields, and whether it is corrupt (no JSON, or without an id)."""
    read = small_files.read_files(spark, path, "job.json", partitions).select("path", F.col("content").cast("string").alias("value"))
    parsed = read.withColumn("_job", F.from_json("value", JOBS, {"mode": "PERMISSIVE"}))
    return parsed.select("path", "_job.*", F.col("_job.job_id").isNull().alias("is_corrupt"))


def read_jobs(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """All ``job.json`` files under a folder; corrupt ones drop out."""
    return job_files(spark, path, partitions).filter("not is_corrupt").drop("path", "is_corrupt")


def extension(path: Column) -> Column:
    """Lower-cased extension with its dot; names starting with their only dot have none."""
    name = F.regexp_extract(path, r"[^/\\]*$", 0)
    return F.lower(F.regexp_extract(name, r"^\.*[^.].*?(\.[^.]*)$", 1))


def path_reject_reason(path: Column) -> Column:
    """Null for a path that may be read."""
    plain = F.regexp_replace(path, r"^file:(?://)?", "")
    parts = F.split(plain, r"[/\\]")
    climbs = F.contains(plain, F.lit("..")) & F.array_contains(parts, "..")
    return (
        F.when(F.coalesce(path, F.lit("")) == "", "missing_path")
        .when(climbs | F.contains(plain, F.lit("..")), "path_traversal")
        .when(F.startswith(plain, F.lit("/etc")) | F.startswith(plain, F.lit("/sys")), "restricted_path")
    )


def manifest_rows(files: DataFrame, day: Column, direct_pdf: bool = False) -> DataFrame:
    """Validity, route and output name of files given as path, length.

    The route table is a literal map, not a join.
    """
    ext = extension(F.col("path"))
    routes = {e: r for e, (r, _) in V.FILE_ROUTES.items()}
    outputs = {e: o for e, (_, o) in V.FILE_ROUTES.items()}
    if direct_pdf:
        outputs[".pdf"] = ".pdf"

    def lookup(table: dict[str, str]) -> Column:
        return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[F.col("ext")]

    megabytes = F.col("length") / (1024 * 1024)
    with_ext = files.withColumn("ext", ext)
    reason = (
        F.when(path_reject_reason(F.col("path")).isNotNull(), path_reject_reason(F.col("path")))
        .when(~F.col("ext").isin(V.ALLOWED_EXTENSIONS), "unsupported_extension")
        .when(megabytes > V.MAX_FILE_MB, "file_too_large")
    )
    base = F.col("path").substr(F.lit(1), F.length("path") - F.length("ext"))
    name = F.concat(base, F.lit("_translated_"), F.date_format(day, "yyyyMMdd"), lookup(outputs))
    return with_ext.select(
        *files.columns, "ext", reason.alias("reject_reason"), (megabytes > V.WARN_FILE_MB).alias("is_large"),
        lookup(routes).alias("route"), name.alias("output_name"),
    )


def scan_folder(spark: SparkSession, path: str, day: Column) -> DataFrame:
    """Manifest of a folder; only file metadata is read, no content."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return manifest_rows(listed.select("path", "length", "modificationTime"), day)


def mojibake_lines(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Lines holding a mis-decoding pattern, with the first listed pattern found."""
    flat = texts.select(*keys, F.posexplode(lines(F.col(text))).alias("_i", "line"))
    hit = flat.filter(has_mojibake(F.col("line")))
    return hit.select(
        *keys, (F.col("_i") + 1).alias("line_no"), first_mojibake_pattern(F.col("line")).alias("pattern"),
        F.substring(strip(F.col("line")), 1, 100).alias("line"),
    ).filter(F.col("pattern").isNotNull())


def mojibake_report(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Issues per file and the first of them."""
    return mojibake_lines(texts, keys, text).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("issues"), F.min("line_no").alias("first_line"), F.min_by("pattern", "line_no").alias("first_pattern")
    )
