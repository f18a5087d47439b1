"""Tags, visual features, quality and distribution reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lucerna.functions.text import GAP, START, STOP, fast, line_count, text

#: What a topic shows in name, description, raw tags or code.
RULES = {
    "raymarching": rf"(?i){START}(?:raymarch|ray{GAP}*march|marching|ro{GAP}*\+{GAP}*rd{STOP}|t{GAP}*\+={GAP}*[a-zA-Z_])",
    "sdf": rf"{START}(?:sd[A-Z]|signed{GAP}*distance|distance{GAP}+function|smin|smax|opUnion|opSubtraction|opIntersection)",
    "noise": rf"(?i){START}(?:noise|snoise|cnoise|valueNoise|fbm|simplex|hash|fract{GAP}*\({GAP}*sin)",
    "fractal": rf"(?i){START}(?:mandelbrot|julia|fractal|mengersponge|sierpinski|IFS{STOP}|orbit{GAP}*trap|escape[-_ ]?time)",
    "post-processing": rf"(?i){START}(?:bloom|vignette|chromatic|aberration|tonemap|fxaa|blur|kernel|gamma{GAP}*correct|postpro|post-pro)",
    "lighting": rf"(?i){START}(?:diffuse|specular|phong|blinn|cook[-_ ]?torrance|pbr|reflect|refract|shadow|ambient{GAP}*occlusion|calcNormal|normalize{GAP}*\({GAP}*cross)",
    "animation": rf"{START}iTime{STOP}",
    "kaleidoscope": rf"(?i){START}kaleidoscop",
    "2d-pattern": rf"(?i){START}(?:kaleidoscop|(?:tile|tiling|truchet|checker|checkerboard|grid|voronoi|hex{GAP}*grid|polar{GAP}*coord){STOP})",
}
#: Letters that the words of each rule begin with.
FIRST = {"raymarching": "rmt", "sdf": "sdo", "noise": "nscvfh", "fractal": "mjfsioe", "post-processing": "bvcatfkgp", "lighting": "dspbcran", "animation": "i", "kaleidoscope": "k", "2d-pattern": "ktcgvhp"}
#: Hints of visual features.
VISUAL = {
    "glow": ("glow", "bloom", "neon"), "smooth": ("smoothstep", "smin", "smax"), "metallic": ("reflect", "fresnel", "specular"),
    "organic": ("fbm", "noise", "domain warp", "turbulence"), "geometric": ("sdbox", "sdsphere", "sdf", "kaleidoscope"), "volumetric": ("raymarch", "march", "density", "fog"),
}


def _list(c: str) -> Column:
    return F.coalesce(F.col(c), F.array().cast("array<string>"))


def rule_tags() -> Column:
    """Tags a record has, then those its text shows, in order; 'uncategorized' where there are none."""
    words = F.array_join(F.filter(_list("tags_raw"), lambda t: t.isNotNull()), " ")
    doc = F.concat_ws("\n", text("name"), text("description"), words, text("code_image"), text("code_common"))
    flagged = F.array_compact(F.array(*[F.when(doc.rlike(fast(p, FIRST[tag])), F.lit(tag)) for tag, p in RULES.items()]))
    tags = F.array_distinct(F.concat(F.filter(_list("tags_topic"), lambda t: t.isNotNull()), flagged))
    return F.when(F.size(tags) == 0, F.array(F.lit("uncategorized"))).otherwise(tags)


def visual_features() -> Column:
    hay = F.lower(F.concat(F.array_join(_list("tags_topic"), " "), F.lit(" "), text("code_image")))
    return F.array_compact(F.array(*[F.when(F.exists(F.array(*map(F.lit, hints)), lambda h: hay.contains(h)), F.lit(name)) for name, hints in VISUAL.items()]))


def has_entry(code: Column) -> Column:
    return (code.contains("mainImage") | code.contains("void main")) & (code.contains("fragColor") | code.contains("gl_FragColor"))


def quality() -> Column:
    """0..1 from compiling, rendering, structure, likes, tags, length and cleanness, four decimals.

    The weights sum to 1.10 and are capped. Nulls count as 0, false or empty.
    """
    code, likes, lines = text("code_image"), F.greatest(F.coalesce("likes", F.lit(0)), F.lit(0)), line_count("code_image")
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    own = F.size(F.filter(_list("key_functions"), lambda f: f.isNotNull() & (f != "mainImage")))
    score = (
        F.when(flag("compile_ok"), 0.40).otherwise(0.0) + F.when(flag("render_ok"), 0.15).otherwise(0.0)
        + F.when(has_entry(code) & (own >= 1), 0.10).when(has_entry(code), 0.05).otherwise(0.0)
        + 0.10 * F.least(F.log10(likes + F.lit(1.0)) / 5.0, F.lit(1.0))
        + 0.15 * F.least(F.size(_list("tags_topic")), F.lit(4)) / 4.0
        + F.when(lines.between(50, 500), 0.10).when(lines.between(20, 49) | lines.between(501, 800), 0.05).otherwise(0.0)
        + F.when(~flag("reference_only") & ~flag("has_external_assets"), 0.10).otherwise(0.0)
    )
    return F.round(F.least(score, F.lit(1.0)), 4)


def summary_text() -> Column:
    """One sentence on length, topics, technique and functions."""
    code = text("code_image")
    technique = F.when(code.rlike("(?i)march"), "ray marching").when(code.rlike(fast(rf"{START}sd[A-Z]", "s")), "distance fields").otherwise("screen space shading")
    names = F.slice(F.filter(_list("key_functions"), lambda f: f.isNotNull() & (f != "mainImage")), 1, 5)
    tags = F.array_join(F.filter(_list("tags_topic"), lambda t: t.isNotNull()), ", ")
    return F.concat(line_count("code_image").cast("string"), F.lit(" lines; topics: "), F.when(tags == "", "uncategorized").otherwise(tags), F.lit("; technique: "), technique,
                    F.lit("; functions: "), F.when(F.size(names) == 0, "none").otherwise(F.array_join(names, ", ")))


def topic_distribution(records: DataFrame) -> DataFrame:
    return records.select(F.explode(F.filter(_list("tags_topic"), lambda t: t.isNotNull())).alias("topic")).groupBy("topic").agg(F.count("*").alias("n"))


def histogram(scores: DataFrame, score: str) -> DataFrame:
    """Four quality bands with counts, empty bands included; null and NaN are in none."""
    bands = scores.sparkSession.createDataFrame([("<0.4",), ("<0.6",), ("<0.8",), (">=0.8",)], "band string")
    c = F.col(score)
    band = F.when(c < 0.4, "<0.4").when(c < 0.6, "<0.6").when(c < 0.8, "<0.8").otherwise(">=0.8")
    counted = scores.filter(c.isNotNull() & ~F.isnan(c)).groupBy(band.alias("band")).agg(F.count("*").alias("n"))
    return bands.join(F.broadcast(counted), "band", "left").select("band", F.coalesce("n", F.lit(0)).alias("n"))


def gini(counts: DataFrame, n: str = "n") -> DataFrame:
    """One row: the Gini coefficient of counts, 0 where there is nothing.

    Equal counts are counted first, so the running rank sees one row for each different count: of a total of t there
    are at most sqrt(2 t) of them, however many topics there are.
    """
    levels = counts.groupBy(F.col(n).cast("double").alias("x")).agg(F.count("*").alias("c"))
    before = F.sum("c").over(Window.orderBy("x")) - F.col("c")
    ranked = levels.withColumn("before", before)
    agg = ranked.agg(F.sum(F.col("x") * F.col("c") * (F.col("before") + (F.col("c") + 1) / 2)).alias("ix"), F.sum(F.col("x") * F.col("c")).alias("s"), F.sum("c").alias("k"))
    none = F.coalesce("s", F.lit(0.0)) == 0
    return agg.select(F.round(F.when(none, 0.0).otherwise(2 * F.col("ix") / (F.col("k") * F.col("s")) - (F.col("k") + 1) / F.col("k")), 6).alias("gini"))


def corpus_summary(records: DataFrame) -> DataFrame:
    """One row of counts, the mean quality and the largest topic's share of all topic mentions."""
    flag = lambda c, d=False: F.coalesce(F.col(c), F.lit(d))
    real = F.filter(_list("tags_topic"), lambda t: t.isNotNull() & (t != "uncategorized"))
    score = F.when(~F.isnan("quality_score"), F.col("quality_score"))
    base = records.agg(
        F.count("*").alias("n"), F.count_if(flag("compile_ok")).alias("compile_ok"), F.count_if(flag("render_ok")).alias("render_ok"),
        F.count_if(flag("is_generator", True)).alias("generators"), F.count_if(flag("reference_only")).alias("reference_only"),
        F.round(F.coalesce(F.avg(score), F.lit(0.0)), 6).alias("avg_quality"), F.count_if(F.size(real) >= 2).alias("multi_tag"))
    top = topic_distribution(records).agg(F.round(F.max("n") / F.sum("n"), 6).alias("top_share"))
    return base.crossJoin(F.broadcast(top))


def category_topics(records: DataFrame, topics: DataFrame) -> DataFrame:
    """(row_id, category, topic_key): categories by exact topic name, else by alias without letter case."""
    exact = topics.groupBy(F.col("topic_name").alias("category")).agg(F.min("topic_key").alias("by_name"))
    alias = topics.select(F.explode("aliases").alias("low"), "topic_key").groupBy(F.lower("low").alias("low")).agg(F.min("topic_key").alias("by_alias"))
    rows = records.select("row_id", F.explode(F.array_distinct(F.filter(_list("categories"), lambda c: c.isNotNull()))).alias("category"))
    return (rows.join(exact, "category", "left").withColumn("low", F.lower("category")).join(alias, "low", "left")
            .select("row_id", "category", F.coalesce("by_name", "by_alias", F.lit("")).alias("topic_key")))
