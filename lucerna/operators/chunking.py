"""Parent and child chunks of records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lucerna.functions.functions_of_code import extract_functions
from lucerna.functions.text import text


def _joined(c: str, sep: str = ", "):
    return F.array_join(F.filter(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda t: t.isNotNull()), sep)


def document_text(code_chars: int = 1500):
    """The text of a record that is embedded: its labelled fields that are not empty, and the beginning of its code."""
    part = lambda label, c: F.when(c != "", F.concat(F.lit(label), c))
    return F.concat_ws("\n\n", F.concat(F.lit("Name: "), text("name")), part("Author: ", text("username")), part("Description: ", text("description")), part("Topics: ", _joined("tags_topic")), part("Raw tags: ", _joined("tags_raw")),
                       part("Code excerpt:\n", F.substring(text("code_image"), 1, code_chars)))


def text_chunks(records: DataFrame) -> DataFrame:
    """(chunk_id, parent_id, kind, title, text) of the kinds overview, algorithm and full_code."""
    line = lambda label, c: F.when(c != "", F.concat(F.lit(label + ": "), c))
    overview = F.concat_ws("\n", F.concat(F.lit("Name: "), text("name")), line("Author", text("username")), line("Description", text("description")), line("Topics", _joined("tags_topic")), line("Visual features", _joined("visual_features")))
    code = F.substring(text("code_image"), 1, 2000)
    kinds = F.array_compact(F.array(
        F.struct(F.lit("overview").alias("kind"), overview.alias("text")),
        F.when(text("algorithm_summary") != "", F.struct(F.lit("algorithm").alias("kind"), text("algorithm_summary").alias("text"))),
        F.when(F.regexp_replace(code, r"[\s\p{Z}]+", "") != "", F.struct(F.lit("full_code").alias("kind"), code.alias("text")))))
    return records.select(F.col("shader_id").alias("parent_id"), F.explode(kinds).alias("c")).select(
        F.concat_ws("::", "parent_id", "c.kind").alias("chunk_id"), "parent_id", F.col("c.kind").alias("kind"), F.col("c.kind").alias("title"), F.col("c.text").alias("text"))


def function_chunks(records: DataFrame, most: int = 1200) -> DataFrame:
    """Chunks of the kinds structure and function; the nth repeat of a function's name gets the suffix _n."""
    found = records.select(F.col("shader_id").alias("parent_id"), text("code_image").alias("code")).withColumn("functions", extract_functions("code"))
    builtins = F.array_compact(F.array(*[F.when(F.col("code").contains(b), F.lit(b)) for b in ("iTime", "iResolution", "iMouse", "iFrame")]))
    names = F.transform("functions", lambda f: f["name"])
    structure = F.concat_ws("\n", F.concat(F.lit("Entry: "), F.when(F.col("code").contains("mainImage"), "mainImage present").otherwise("unknown")),
                            F.concat(F.lit("Functions: "), F.when(F.size(names) > 0, F.array_join(names, ", ")).otherwise("none")), F.when(F.size(builtins) > 0, F.concat(F.lit("Builtins: "), F.array_join(builtins, ", "))))
    head = found.select(F.concat_ws("::", "parent_id", F.lit("structure")).alias("chunk_id"), "parent_id", F.lit("structure").alias("kind"), F.lit("structure").alias("title"), structure.alias("text"))
    numbered = F.transform("functions", lambda f, i: F.struct(f.alias("f"), F.size(F.filter(F.slice(names, 1, i), lambda n: n == f["name"])).alias("before")))
    each = found.select("parent_id", F.explode(F.when(F.size("functions") > 0, numbered)).alias("x"))
    body = F.when(F.length("x.f.body") > most, F.concat(F.substring("x.f.body", 1, most), F.lit("\n// ..."))).otherwise(F.col("x.f.body"))
    suffix = F.when(F.col("x.before") > 0, F.concat(F.lit("_"), F.col("x.before").cast("string"))).otherwise("")
    tail = each.select(F.concat(F.col("parent_id"), F.lit("::fn::"), F.col("x.f.name"), suffix).alias("chunk_id"), "parent_id", F.lit("function").alias("kind"), F.col("x.f.name").alias("title"),
                       F.concat(F.lit("Function "), F.col("x.f.signature"), F.lit("\n"), body).alias("text"))
    return head.unionByName(tail)


def chunks(records: DataFrame) -> DataFrame:
    """Every chunk of every record: overview, structure, algorithm, functions, full code."""
    return text_chunks(records).unionByName(function_chunks(records))
