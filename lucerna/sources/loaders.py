"""Readers of record files. All files of a folder are read in parallel; order is kept by path."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lucerna.functions.text import code_hash, slug, text
from lucerna.operators.cleaning import first_wins, header_author, restricted
from lucerna.schema import RAW, RECORD, as_records

CODE_FILES = "*.{glsl,frag,glslfs,fs,fsh}"
HEADER = r"(?s)/\*[!*]?\s*(\{.*?\})\s*\*/"
ISF = "TITLE string, CREDIT string, DESCRIPTION string, CATEGORIES array<string>, INPUTS array<struct<NAME:string,TYPE:string>>"
SIDECAR = "shader_id string, name string, description string, author string, license string, likes int, viewed int, tags_raw array<string>"


def whole_files(spark: SparkSession, folder: str, glob: str, deep: bool = False) -> DataFrame:
    """(path, body) of every file; an empty body is kept."""
    return spark.read.text(folder, wholetext=True, pathGlobFilter=glob, recursiveFileLookup=deep).select(
        F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B"))).alias("path"), F.col("value").alias("body"))


def stem(path: str):
    return F.regexp_replace(F.regexp_replace(path, "^.*/", ""), r"(?<=.)\.[^.]*$", "")


def strip(c):
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def clean_dir(spark: SparkSession, folder: str) -> DataFrame:
    """One JSON record per file; files that are no JSON are left out."""
    return as_records(spark.read.schema(RECORD).option("multiLine", True).option("mode", "DROPMALFORMED").json(folder).filter("shader_id is not null"))


def raw_dir(spark: SparkSession, folder: str, source: str = "shadertoy") -> DataFrame:
    """Raw API or scraped JSON, one file a record, as records. Nulls become defaults."""
    raw = spark.read.schema(RAW).option("multiLine", True).option("mode", "DROPMALFORMED").json(folder).filter("info.id is not null")
    return as_records(raw.select(
        F.col("info.id").alias("shader_id"), "info.name", "info.username", "info.description", "info.likes", "info.viewed", F.col("info.tags").alias("tags_raw"),
        F.col("renderpass").alias("passes"), F.lit(source).alias("source"), F.concat(F.lit("https://www.shadertoy.com/view/"), "info.id").alias("source_url")))


def isf_dir(spark: SparkSession, folder: str) -> DataFrame:
    """``*.fs`` files with a JSON header; files without one are left out. An inputImage makes a record reference-only."""
    files = whole_files(spark, folder, "*.fs").withColumn("meta", F.from_json(F.regexp_extract("body", HEADER, 1), ISF))
    files = files.filter(F.col("body").rlike(HEADER) & F.try_parse_json(F.regexp_extract("body", HEADER, 1)).isNotNull())
    code = strip(F.regexp_replace("body", r"(?s)\A(.*?)" + HEADER.removeprefix("(?s)"), "$1"))
    outside = F.coalesce(F.exists("meta.INPUTS", lambda i: (i["NAME"] == "inputImage") | (i["TYPE"] == "inputImage")), F.lit(False))
    rows = files.withColumn("code_image", code).withColumn("outside", outside).withColumn("code_hash", F.substring(F.sha2("code_image", 256), 1, 12))
    return as_records(rows.select(
        F.concat(F.lit("isf_"), "code_hash").alias("shader_id"), F.coalesce(F.nullif(strip(text("meta.TITLE")), F.lit("")), stem("path")).alias("name"),
        F.coalesce(F.nullif(text("meta.CREDIT"), F.lit("")), F.lit("ISF")).alias("username"), F.lit("isf").alias("source"), F.col("meta.CATEGORIES").alias("tags_raw"),
        "code_image", "code_hash", F.col("outside").alias("has_external_assets"), (~F.col("outside")).alias("is_generator"), F.col("outside").alias("reference_only")))


def local_dir(spark: SparkSession, folder: str, accept_restricted: bool = False, deep: bool = True) -> DataFrame:
    """Shader files with optional ``<stem>.meta.json`` beside them. Blank files, and restricted ones, are left out."""
    files = whole_files(spark, folder, CODE_FILES, deep).filter(F.regexp_replace("body", r"\s+", "") != "")
    if not accept_restricted:
        files = files.filter(~restricted("body"))
    files = files.withColumn("key", F.regexp_replace("path", r"(?<=[^/])\.[^./]*$", "")).withColumn("inner", F.substring_index("path", folder.rstrip("/").rsplit("/", 1)[-1] + "/", -1))
    notes = whole_files(spark, folder, "*.meta.json", deep).select(F.regexp_replace("path", r"\.meta\.json$", "").alias("key"), F.from_json("body", SIDECAR).alias("m"))
    rows = files.join(notes, "key", "left")
    author = F.coalesce(F.nullif(F.col("m.author"), F.lit("")), F.nullif(header_author("body"), F.lit("")), F.lit("local"))
    about = F.trim(F.concat_ws("\n", F.nullif(F.col("m.description"), F.lit("")), F.when(text("m.license") != "", F.concat(F.lit("[license] "), "m.license"))))
    return as_records(rows.select(
        F.coalesce(F.nullif(F.col("m.shader_id"), F.lit("")), slug("inner")).alias("shader_id"), F.coalesce(F.nullif(F.col("m.name"), F.lit("")), F.initcap(F.replace(F.replace(stem("path"), F.lit("_"), F.lit(" ")), F.lit("-"), F.lit(" ")))).alias("name"),
        author.alias("username"), about.alias("description"), F.when(F.coalesce("m.likes", F.lit(0)) == 0, 100).otherwise(F.col("m.likes")).alias("likes"), F.col("m.viewed").alias("viewed"),
        F.col("m.tags_raw").alias("tags_raw"), F.lit("local").alias("source"), F.col("body").alias("code_image")))


def code_dir(spark: SparkSession, folder: str, glob: str = "*", deep: bool = True) -> DataFrame:
    """Raw JSON records or bare code in one folder; the first of equal code by path stays.

    A JSON file without an id or image code is taken as bare code, as the replaced system did. Bare code needs
    50 characters.
    """
    files = whole_files(spark, folder, glob, deep).withColumn("body", strip("body")).filter("body <> ''").withColumn("raw", F.from_json("body", RAW))
    image = strip(F.coalesce(F.get(F.filter("raw.renderpass", lambda p: F.lower(p["type"]) == "image"), F.lit(0))["code"], F.lit("")))
    rows = files.withColumn("image", image).withColumn("json", (strip(text("raw.info.id")) != "") & (F.col("image") != ""))
    rows = rows.filter(F.col("json") | (F.length("body") >= 50)).withColumn("code_image", F.when(F.col("json"), F.col("image")).otherwise(F.col("body")))
    rows = rows.withColumn("code_hash", F.substring(F.sha2("code_image", 256), 1, 12))
    rows = rows.select("path", F.when(F.col("json"), strip(F.col("raw.info.id"))).otherwise(F.concat(F.lit("twigl_"), "code_hash")).alias("shader_id"),
        F.when(F.col("json"), F.coalesce(F.nullif(strip(text("raw.info.name")), F.lit("")), F.col("raw.info.id"))).otherwise(stem("path")).alias("name"), F.when(F.col("json"), strip(text("raw.info.username"))).otherwise("").alias("username"),
        F.when(F.col("json"), F.col("raw.info.likes")).otherwise(0).alias("likes"), F.when(F.col("json"), F.col("raw.info.tags")).alias("tags_raw"), F.lit("shaders21k").alias("source"), "code_image", "code_hash")
    return as_records(first_wins(rows, ["code_hash"], ["path"]))


def union_sources(*sources: DataFrame) -> DataFrame:
    """All records in source order as ``src_ord``, so that first-wins steps stay defined."""
    out = None
    for i, s in enumerate(sources):
        s = s.withColumn("src_ord", F.lit(i))
        out = s if out is None else out.unionByName(s, allowMissingColumns=True)
    return out


def id_list(spark: SparkSession, path: str) -> DataFrame:
    """(id): the lines of a file without blanks and comments."""
    return spark.read.text(path).select(strip("value").alias("id")).filter("id <> '' and not startswith(id, '#')")


def extract_ids(texts: DataFrame, column: str = "text", host: str = r"https?://(?:www\.)?shadertoy\.com/view/") -> DataFrame:
    """``texts`` with ``ids``: those in addresses first, then bare lines of 6 or 7 letters or digits, each once."""
    urls = F.regexp_extract_all(text(column), F.lit(f"(?i){host}([A-Za-z0-9]{{6,7}})"), F.lit(1))
    lines = F.filter(F.transform(F.split(F.regexp_replace(text(column), r"\r\n|\r", "\n"), "\n"), strip), lambda x: x.rlike(r"^[\p{L}\p{N}]{6,7}$"))
    return texts.withColumn("ids", F.array_distinct(F.concat(urls, lines)))


def not_cached(ids: DataFrame, cached: DataFrame, key: str = "id") -> DataFrame:
    return ids.join(cached.select(key), key, "left_anti")


def save_records(records: DataFrame, path: str) -> None:
    """One JSON object a line, a folder by source; of equal shader_ids the last indexed stays."""
    one = records.groupBy("shader_id").agg(F.max_by(F.struct(*records.columns), "indexed_at").alias("r")).select("r.*")
    one.withColumn("_source", F.coalesce(F.nullif(text("source"), F.lit("")), F.lit("none"))).write.mode("overwrite").partitionBy("_source").json(path)


def hashed(records: DataFrame) -> DataFrame:
    return records.withColumn("code_hash", code_hash("code_image", "code_common"))
