"""Rule checks of shader code, specification parsing and error classes, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lucerna.functions.text import GAP, START, STOP, count_of, fast, text, without_comments

#: The entry point, loosely and by its signature.
LOOSE = rf"{START}void{GAP}+mainImage{GAP}*\("
SIGNED = rf"{START}void{GAP}+mainImage{GAP}*\({GAP}*out{GAP}+vec4{GAP}+[\p{{L}}\p{{N}}_]+{GAP}*,{GAP}*(?:in{GAP}+)?vec2{GAP}+[\p{{L}}\p{{N}}_]+{GAP}*\)"
STRICT = SIGNED.replace(rf"(?:in{GAP}+)?", rf"in{GAP}+")
#: Fixed values: (rule, level, message) in the order of the report.
MESSAGES = {
    "GLSL000": ("error", "code is empty"), "GLSL001": ("error", "more than 20000 characters"), "GLSL002": ("warn", "more than 800 lines"), "GLSL010": ("error", "no mainImage"),
    "GLSL011": ("error", "mainImage has another signature"), "GLSL012": ("warn", "defines void main() too"), "GLSL020": ("error", "uses channels or samplers"), "GLSL021": ("warn", "uses a function WebGL 1 lacks"),
    "GLSL022": ("error", "declares an own uniform"), "GLSL030": ("error", "has a code fence"), "GLSL031": ("warn", "has a #version line"), "GLSL040": ("error", "braces don't pair"), "GLSL041": ("error", "parentheses don't pair"),
    "GLSL050": ("error", "endless loop without break"), "GLSL060": ("warn", "should move but has no iTime"), "GLSL061": ("warn", "should stand still but has iTime"),
}
UNIFORMS = ("iResolution", "iTime", "iTimeDelta", "iFrame", "iMouse", "iDate", "iSampleRate", "iFrameRate")


def violated(code, dynamic: Column | None = None) -> dict[str, Column]:
    """Rule id to condition, over the raw code, comments included."""
    c = text(code)
    filled = F.regexp_replace(c, r"[\s\p{Z}]+", "") != ""
    own = F.regexp_extract_all(c, F.lit(rf"(?m)^{GAP}*uniform{GAP}+[\p{{L}}\p{{N}}_]+{GAP}+([\p{{L}}\p{{N}}_]+)"), F.lit(1))
    lines = count_of(c, "\n") + 1
    rules = {
        "GLSL001": F.length(c) > 20000, "GLSL002": lines > 800, "GLSL010": ~c.rlike(fast(LOOSE, "v")), "GLSL011": c.rlike(fast(LOOSE, "v")) & ~c.rlike(fast(SIGNED, "v")),
        "GLSL012": c.rlike(fast(rf"{START}void{GAP}+main{GAP}*\({GAP}*(?:void)?{GAP}*\)", "v")),
        "GLSL020": c.rlike(fast(rf"{START}(?:iChannel[0-9]|sampler(?:2D|Cube|3D)|iChannelResolution|iChannelTime){STOP}", "is")),
        "GLSL021": c.rlike(fast(rf"{START}(?:round|roundEven|trunc|isnan|isinf|textureGather){GAP}*\(", "rti")),
        "GLSL022": F.exists(own, lambda u: ~u.isin(*UNIFORMS)), "GLSL030": c.rlike(rf"(?m)^{GAP}*```"), "GLSL031": c.rlike(rf"(?m)^{GAP}*#version{STOP}"),
        "GLSL040": count_of(c, "{") != count_of(c, "}"), "GLSL041": count_of(c, "(") != count_of(c, ")"),
        "GLSL050": c.rlike(fast(rf"{START}while{GAP}*\({GAP}*true{GAP}*\)", "w")) & ~c.contains("break"),
    }
    if dynamic is not None:
        rules["GLSL060"] = dynamic & ~c.contains("iTime")
        rules["GLSL061"] = ~dynamic & c.contains("iTime")
    return {"GLSL000": ~filled} | {k: filled & v for k, v in rules.items()}


def check(code, dynamic: Column | None = None) -> Column:
    """The violations of a code in order, as structs of rule_id, level and message; an empty code has one."""
    rows = [F.when(v, F.struct(F.lit(k).alias("rule_id"), F.lit(MESSAGES[k][0]).alias("level"), F.lit(MESSAGES[k][1]).alias("message"))) for k, v in violated(code, dynamic).items()]
    return F.array_compact(F.array(*rows))


def errors_of(violations: Column) -> Column:
    return F.filter(violations, lambda v: v["level"] == "error")


def convention(code) -> Column:
    """Share of five conventions kept by the code without comments."""
    c = without_comments(code)
    named = F.regexp_extract_all(c, F.lit(rf"{START}uniform{GAP}+([^\n]*)"), F.lit(1))
    allowed = F.forall(named, lambda n: n.rlike(rf"{START}(?:iResolution|iTime|iMouse){STOP}"))
    checks = (
        c.rlike(fast(STRICT, "v")), ~c.rlike(fast(rf"{START}(?:sampler2D|samplerCube|iChannel[0-9]){STOP}", "is")), allowed,
        ~c.rlike(fast(rf"{START}(?:round|roundEven|trunc|textureLod|texelFetch){GAP}*\(", "rt")),
        (count_of(c, "{") == count_of(c, "}")) & (count_of(c, "(") == count_of(c, ")")))
    return sum((F.when(x, 1).otherwise(0) for x in checks[1:]), F.when(checks[0], 1).otherwise(0)) / 5.0


#: Words of other shading languages and usual slips, with what is meant.
SLIPS = {"lenght": "length", "lentgh": "length", "lerp": "mix", "saturate": "clamp(x, 0.0, 1.0)", "Normalize": "normalize", "Length": "length", "frac": "fract"}


def validated(code) -> dict[str, Column]:
    """errors (no_entry, braces, parens, external, slip:word, signature) and warnings (no_assignment) of a code that is
    about to be compiled; comments don't count, but for the entry."""
    c = without_comments(code)
    errors = [
        F.when(~text(code).contains("mainImage"), F.lit("no_entry")), F.when(count_of(c, "{") != count_of(c, "}"), F.lit("braces")), F.when(count_of(c, "(") != count_of(c, ")"), F.lit("parens")),
        F.when(c.rlike(fast(rf"{START}(?:sampler2D|samplerCube|iChannel[0-9]){STOP}", "is")), F.lit("external")),
        *[F.when(c.rlike(fast(rf"{START}{bad}{STOP}", bad[0])), F.lit(f"slip:{bad}")) for bad in SLIPS], F.when(c.contains("mainImage") & ~c.rlike(fast(STRICT, "v")), F.lit("signature"))]
    body = F.substring(F.regexp_extract(c, fast(STRICT, "v") + r"([\s\S]*)", 1), 1, 4000)
    bare = c.rlike(fast(STRICT, "v")) & ~body.rlike(rf"[\p{{L}}\p{{N}}_]{GAP}*=")
    return {"errors": F.array_compact(F.array(*errors)), "warnings": F.when(bare, F.array(F.lit("no_assignment"))).otherwise(F.array().cast("array<string>"))}


def renderable(code) -> Column:
    """No channel and no sampler, so a frame can be drawn without assets."""
    return ~text(code).rlike(fast(rf"{START}(?:iChannel[0-9]|sampler(?:2D|Cube|3D)){STOP}", "is"))


def mock_compiles(code) -> Column:
    """An entry point and no vec3 that is given a vec4."""
    c = text(code)
    return c.rlike(fast(rf"{START}void{GAP}+main(?:Image)?{GAP}*\(", "v")) & ~c.rlike(fast(rf"{START}vec3{GAP}+[\p{{L}}\p{{N}}_]+{GAP}*={GAP}*vec4{GAP}*\(", "v"))


def missing(code, wanted: tuple[str, ...]) -> Column:
    return F.filter(F.array(*map(F.lit, wanted)), lambda w: ~text(code).contains(w))


def present(code, unwanted: tuple[str, ...]) -> Column:
    return F.filter(F.array(*map(F.lit, unwanted)), lambda w: text(code).contains(w))


#: Words that tell a wish's effect, palette and complexity; the first row that fits wins.
EFFECTS = {
    "raymarching": ("raymarch", "ray march", "光线步进", "ray-march"), "sdf": ("sdf", "signed distance", "符号距离"), "noise": ("noise", "噪声", "fbm", "perlin", "simplex"), "fractal": ("fractal", "分形", "mandelbrot", "julia"),
    "post-processing": ("post", "后处理", "bloom", "vignette", "blur"), "2d-pattern": ("pattern", "图案", "kaleidoscope", "万花筒", "checker"), "lighting": ("light", "光照", "phong", "shading"), "animation": ("anim", "动画", "时间", "动态"),
}
PALETTES = {"neon": ("neon", "霓虹"), "warm sunset": ("sunset", "warm", "暖色", "落日"), "monochrome": ("mono", "黑白", "单色"), "cool blue": ("cool", "blue", "蓝", "冷色"), "pastel": ("pastel", "粉彩"), "vibrant": ("vibrant", "鲜艳", "饱和")}
LEVELS = {"minimal": ("最简", "minimal", "最小"), "simple": ("简单", "simple", "basic"), "moderate": ("中等", "moderate", "适中"), "complex": ("复杂", "complex", "advanced")}
STILL = ("static", "静态", "不动")
#: Error texts by class, in order.
TIMEOUT = ("timeout", "timed out", "readtimeout", "connecttimeout")
LIMITED = ("rate limit", "ratelimit", "429", "too many requests", "tpm", "rpm")
REFUSED = ("api key", "api_key", "unauthorized", "401", "invalid_api_key", "未就绪", "未配置")
STORES = ("chromadb", "chroma", "could not connect to persistent client", "vector store", "vectorstore", "keyword store", "parent store", "retriever", "retrieval")


def _any(c: Column, words) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: c.contains(w))


def _first(c: Column, table: dict, default: str) -> Column:
    out = None
    for name, words in table.items():
        out = F.when(_any(c, words), name) if out is None else out.when(_any(c, words), name)
    return out.otherwise(default)


def spec(wish) -> dict[str, Column]:
    """effect, palette, complexity and dynamic of a wish in free words."""
    low = F.lower(text(wish))
    return {"effect": _first(low, EFFECTS, ""), "palette": _first(low, PALETTES, ""), "complexity": _first(low, LEVELS, "simple"), "dynamic": ~_any(low, STILL)}


def error_code(message) -> Column:
    """The service's code for an upstream error text; null and blank texts are no error and have null."""
    low = F.lower(text(message))
    return F.when(F.trim(low) == "", F.lit(None)).when(_any(low, TIMEOUT), 50401).when(_any(low, LIMITED), 42901).when(_any(low, REFUSED), 50301).when(_any(low, STORES), 50303).when(low.contains("connection"), 50301).otherwise(50001).cast("int")


def retrieval_error_code(message) -> Column:
    c = error_code(message)
    return F.when(c.isin(50001, 50401, 50301), 50303).otherwise(c)


def inferred_tags(names, builtins: Column | None = None) -> Column:
    """Technique tags that function names suggest, and animation where the builtins used have iTime."""
    own = F.coalesce(F.col(names), F.array().cast("array<string>"))
    joined = F.lower(F.array_join(F.filter(own, lambda n: n.isNotNull()), " "))
    moves = F.when(F.array_contains(builtins, "iTime"), F.lit("animation")) if builtins is not None else F.lit(None).cast("string")
    return F.array_compact(F.array(F.when(joined.contains("march"), F.lit("raymarching")), F.when(F.exists(own, lambda n: F.lower(n).startswith("sd")), F.lit("sdf")),
                                   F.when(_any(joined, ("noise", "fbm", "hash")), F.lit("noise")), F.when(_any(joined, ("normal", "light")), F.lit("lighting")), moves))
