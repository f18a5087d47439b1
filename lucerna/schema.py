"""Schemas of the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RECORD = (
    "shader_id string, name string, username string, description string, likes int, viewed int, tags_raw array<string>, "
    "passes array<struct<name:string,type:string,code:string,inputs:array<map<string,string>>,outputs:array<map<string,string>>>>, source string, code_image string, code_common string, code_hash string, "
    "tags_topic array<string>, categories array<string>, has_external_assets boolean, is_generator boolean, reference_only boolean, source_url string, license string, compile_ok boolean, render_ok boolean, "
    "quality_score double, algorithm_summary string, key_functions array<string>, visual_features array<string>, indexed_at string, embedding_dim int"
)
#: Raw records of the public API and of scraped pages.
RAW = (
    "info struct<id:string,name:string,username:string,description:string,likes:int,viewed:int,tags:array<string>>, "
    "renderpass array<struct<name:string,type:string,code:string,inputs:array<map<string,string>>,outputs:array<map<string,string>>>>"
)
DEFAULTS = {"string": "''", "int": "0", "double": "0.0D"}


def as_records(df: DataFrame) -> DataFrame:
    """``df`` with every record column: missing ones added, nulls replaced by '', 0, false, [] (is_generator: true)."""
    fields = df.sparkSession.createDataFrame([], RECORD).schema.fields
    out = []
    for f in fields:
        kind = f.dataType.simpleString()
        default = F.expr(DEFAULTS[kind]) if kind in DEFAULTS else F.lit(f.name == "is_generator") if kind == "boolean" else F.array().cast(f.dataType)
        out.append((F.coalesce(F.col(f.name).cast(f.dataType), default) if f.name in df.columns else default).alias(f.name))
    return df.select(*out)
