"""Registered queries of the core and the DuckDB SQL that says the same over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lucerna.functions import text as tx
from lucerna.functions.current import current_rows
from lucerna.functions.functions_of_code import split_sections
from lucerna.operators import actions, analysis, chunking, cleaning, evaluation, messages, rules, search
from lucerna.plans.runtime import materialize, spread

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under ``name``, and the SQL that says the same."""
    if sql:
        ORACLES[name] = sql

    def keep(f):
        QUERIES[name] = f
        return f

    return keep


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def among(words) -> str:
    return "(" + ", ".join(map(quoted, words)) + ")"


def holds(column: str, words) -> str:
    return "(" + " or ".join(f"contains({column}, {quoted(w)})" for w in words) + ")"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def busy(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A table for CPU-heavy expressions: spread over all cores where the files alone give fewer tasks."""
    return spread(table(spark, d, name))


CODE = "coalesce(code_image, '')"
LINES = "(case when {0} = '' then 0 else length({0}) - length(replace({0}, chr(10), '')) + case when {0} like '%' || chr(10) then 0 else 1 end end)"
UNIX = "regexp_replace(coalesce(code_image, ''), '\\r\\n|\\r', chr(10), 'g')"
NOTNULL = "list_filter(coalesce({0}, []), lambda v: v is not null)"

# ---- cleaning ----

CLEANED = f"""
with a as (select *, coalesce(passes[1].code, '') <> '' as bp,
    list_filter(passes, lambda p: lower(p.type) = 'image') as im, list_filter(passes, lambda p: lower(p.type) = 'common') as co from shader_records),
b as (select *, case when bp then coalesce(im[-1].code, '') else coalesce(code_image, '') end as image, case when bp then coalesce(co[-1].code, '') else coalesce(code_common, '') end as common,
    coalesce(case when bp then len(list_filter(passes, lambda p: len(list_filter(coalesce(p.inputs, []), lambda i: lower(i['ctype']) in {among(cleaning.EXTERNAL)})) > 0)) > 0 else has_external_assets end, false) as external from a),
c as (select *, coalesce(nullif(coalesce(code_image, ''), ''), image) as code, coalesce(source in {among(cleaning.TRUSTED)}, false) as trusted from b),
d as (select *, case when image = '' then 'no_image' when external and coalesce(source, '') <> 'seed' then 'external' when coalesce(likes, 0) < 30 and not trusted then 'likes'
    when not length(code) between 200 and 12000 and not trusted then 'length' end as reason,
    sha256(code || chr(10) || '---' || chr(10) || coalesce(nullif(coalesce(code_common, ''), ''), common)) as new_hash from c),
e as (select row_id, reason, new_hash, case when reason is null then row_number() over (partition by reason is null, new_hash order by row_id) end as r from d),
f as (select row_id, new_hash, case when reason is not null then reason when r > 1 then 'duplicate' else 'kept' end as drop_reason from e)
"""
query("clean_drop_reasons", CLEANED + "select drop_reason, count(*) as n from f group by 1")(lambda s, d: cleaning.drop_reasons(table(s, d, "shader_records")))
query("clean_kept", CLEANED + "select row_id, new_hash as code_hash from f where drop_reason = 'kept'")(
    lambda s, d: cleaning.marks(table(s, d, "shader_records")).filter("drop_reason is null").select("row_id", F.col("new_hash").alias("code_hash")))


@query("dedupe_exact", "select doc_id, h as text_hash from (select doc_id, sha256(text) as h, row_number() over (partition by sha256(text) order by doc_id) as r from documents where text is not null) where r = 1")
def _(s, d):
    rows = table(s, d, "documents").filter("text is not null").select("doc_id", F.sha2("text", 256).alias("text_hash"))
    return cleaning.first_wins(rows, ["text_hash"], ["doc_id"])


@query("union_sources_dedupe", """
with a as (select row_id, lower(trim(source)) as source, sha256(coalesce(code_image, '') || chr(10) || '---' || chr(10) || coalesce(code_common, '')) as code_hash from shader_records where coalesce(code_image, '') <> ''),
b as (select *, list_position(['seed', 'local', 'isf', 'shaders21k', 'shadertoy', 'shadertoy_scraped'], source) as o from a)
select code_hash, source, row_id from (select *, row_number() over (partition by code_hash order by o, row_id) as r from b where o > 0) where r = 1""")
def _(s, d):
    place = F.array_position(F.array(*map(F.lit, ("seed", "local", "isf", "shaders21k", "shadertoy", "shadertoy_scraped"))), F.lower(F.trim("source")))
    rows = table(s, d, "shader_records").filter((tx.text("code_image") != "") & (place > 0))
    rows = rows.select("row_id", F.lower(F.trim("source")).alias("source"), place.alias("o"), tx.code_hash("code_image", "code_common").alias("code_hash"))
    return cleaning.first_wins(rows, ["code_hash"], ["o", "row_id"]).select("code_hash", "source", "row_id")


query("hash_check", f"""select row_id, code_hash is not null and lower(code_hash) = sha256({CODE} || chr(10) || '---' || chr(10) || coalesce(code_common, '')) as fresh from shader_records""")(
    lambda s, d: table(s, d, "shader_records").select("row_id", F.coalesce(F.lower("code_hash") == tx.code_hash("code_image", "code_common"), F.lit(False)).alias("fresh")))

query("license_filter", f"""select row_id, regexp_matches(array_to_string(string_split({UNIX}, chr(10))[1:30], chr(10)), {quoted(cleaning.RESTRICTED)}) as restricted from shader_records""")(
    lambda s, d: table(s, d, "shader_records").select("row_id", cleaning.restricted("code_image").alias("restricted")))

AUTHOR = r"(?i)//[ \t]*(?:Created[ \t]+by|Author:?[ \t]*|@author[ \t]+)([^\n]+)"
query("author_header", f"""select row_id, regexp_replace(trim(regexp_extract(array_to_string(string_split({UNIX}, chr(10))[1:20], chr(10)), {quoted(AUTHOR)}, 1)), '\\.+$', '') as author from shader_records""")(
    lambda s, d: table(s, d, "shader_records").select("row_id", cleaning.header_author("code_image").alias("author")))

query("topic_quota", f"""
with a as (select *, case when len(coalesce(tags_topic, [])) < 1 then 'uncategorized' when len(tags_topic) > 1 and tags_topic[1] = 'uncategorized' then tags_topic[2] else tags_topic[1] end as p0 from shader_records),
b as (select row_id, coalesce(p0, 'uncategorized') as primary_topic, coalesce(reference_only, false) as ref, case when quality_score::varchar <> 'nan' then quality_score end as q from a)
select row_id, primary_topic from (select *, row_number() over (partition by primary_topic order by ref desc, q desc nulls last, row_id) as r from b) where r <= 5""")(
    lambda s, d: cleaning.topic_quota(table(s, d, "shader_records"), 5).select("row_id", "primary_topic"))

@query("upsert_merge", """
with n as (select * from (select shader_id, name, source, row_number() over (partition by shader_id order by ingested_at desc nulls last, row_id desc) as r from shader_records where shader_id is not null) where r = 1),
o as (select distinct shader_id, name, source from parent_docs)
select shader_id, name, source, true as fresh from n union all select shader_id, name, source, false from o where shader_id is null or shader_id not in (select shader_id from n)""")
def _(s, d):
    new = current_rows(table(s, d, "shader_records"), "name", "source").withColumn("fresh", F.lit(True))
    old = table(s, d, "parent_docs").select("shader_id", "name", "source").distinct().withColumn("fresh", F.lit(False))
    return cleaning.upsert(old, new, "shader_id")


query("anti_cache", "select doc_id, parent_id from documents where parent_id is not null and parent_id not in (select shader_id from parent_docs where shader_id is not null)")(
    lambda s, d: table(s, d, "documents").filter("parent_id is not null").join(table(s, d, "parent_docs").select(F.col("shader_id").alias("parent_id")), "parent_id", "left_anti").select("doc_id", "parent_id"))

query("parent_lookup", "select doc_id, parent_id, name from documents join (select shader_id, max(name) as name from parent_docs group by 1) p on parent_id = shader_id")
QUERIES["parent_lookup"] = lambda s, d: table(s, d, "documents").select("doc_id", "parent_id").join(
    table(s, d, "parent_docs").groupBy(F.col("shader_id").alias("parent_id")).agg(F.max("name").alias("name")), "parent_id").select("doc_id", "parent_id", "name")


@query("reference_enrich", """
with r as (select shader_id, max(nullif(code_image, '')) as own from shader_records where shader_id is not null group by 1), p as (select shader_id, max(nullif(code_image, '')) as stored from parent_docs group by 1)
select doc_id, length(coalesce(own, stored, text, '')) as chars, own is null and stored is null as is_excerpt from documents left join r on r.shader_id = parent_id left join p on p.shader_id = parent_id""")
def _(s, d):
    code = F.max(F.nullif("code_image", F.lit("")))
    own = table(s, d, "shader_records").filter("shader_id is not null").groupBy(F.col("shader_id").alias("parent_id")).agg(code.alias("own"))
    stored = table(s, d, "parent_docs").groupBy(F.col("shader_id").alias("parent_id")).agg(code.alias("stored"))
    rows = table(s, d, "documents").select("doc_id", "parent_id", "text").join(own, "parent_id", "left").join(stored, "parent_id", "left")
    return rows.select("doc_id", F.length(F.coalesce("own", "stored", "text", F.lit(""))).cast("long").alias("chars"), (F.col("own").isNull() & F.col("stored").isNull()).alias("is_excerpt"))


# ---- tags, quality, reports ----

DOC = f"concat_ws(chr(10), coalesce(name, ''), coalesce(description, ''), array_to_string({NOTNULL.format('tags_raw')}, ' '), {CODE}, coalesce(code_common, ''))"
FLAGS = ", ".join(f"case when regexp_matches({DOC}, {quoted(p)}) then {quoted(t)} end" for t, p in analysis.RULES.items())
ORDERED = "list_reduce(list_prepend([]::varchar[], list_transform({0}, lambda t: [t])), lambda a, t: case when list_contains(a, t[1]) then a else list_concat(a, t) end)"
query("tag_rules", f"""
with a as (select row_id, list_concat({NOTNULL.format('tags_topic')}, list_filter([{FLAGS}], lambda t: t is not null)) as t from shader_records)
select row_id, case when len(t) = 0 then 'uncategorized' else array_to_string({ORDERED.format('t')}, ',') end as tags from a""")(
    lambda s, d: busy(s, d, "shader_records").select("row_id", F.array_join(analysis.rule_tags(), ",").alias("tags")))

query("topic_distribution", "select topic, count(*) as n from (select unnest(tags_topic) as topic from shader_records) where topic is not null group by 1")(
    lambda s, d: analysis.topic_distribution(table(s, d, "shader_records")))
query("source_distribution", "select coalesce(lower(trim(source)), '') as source, count(*) as n from shader_records group by 1")(
    lambda s, d: table(s, d, "shader_records").groupBy(F.coalesce(F.lower(F.trim("source")), F.lit("")).alias("source")).agg(F.count("*").alias("n")))

VISUAL = ", ".join(f"case when {holds('h', hints)} then {quoted(n)} end" for n, hints in analysis.VISUAL.items())
query("visual_features", f"""
with a as (select row_id, lower(array_to_string({NOTNULL.format('tags_topic')}, ' ') || ' ' || {CODE}) as h from shader_records)
select row_id, array_to_string(list_filter([{VISUAL}], lambda x: x is not null), ',') as features from a""")(
    lambda s, d: busy(s, d, "shader_records").select("row_id", F.array_join(analysis.visual_features(), ",").alias("features")))

ENTRY = f"(contains({CODE}, 'mainImage') or contains({CODE}, 'void main')) and (contains({CODE}, 'fragColor') or contains({CODE}, 'gl_FragColor'))"
SCORE = f"""(select *, {LINES.format('u')} as l, len(list_filter(coalesce(key_functions, []), lambda f: f is not null and f <> 'mainImage')) as k from (select *, {UNIX} as u from shader_records))"""
QUALITY = f"""round(least(case when coalesce(compile_ok, false) then 0.40::double else 0::double end + case when coalesce(render_ok, false) then 0.15::double else 0 end
    + case when {ENTRY} and k >= 1 then 0.10::double when {ENTRY} then 0.05::double else 0 end + 0.10::double * least(log10(greatest(coalesce(likes, 0), 0) + 1.0::double) / 5.0::double, 1.0::double)
    + 0.15::double * least(len(coalesce(tags_topic, [])), 4) / 4.0::double + case when l between 50 and 500 then 0.10::double when l between 20 and 49 or l between 501 and 800 then 0.05::double else 0 end
    + case when not coalesce(reference_only, false) and not coalesce(has_external_assets, false) then 0.10::double else 0 end, 1.0::double), 4)"""
query("quality_score", f"select row_id, {QUALITY} as score from {SCORE}")(lambda s, d: busy(s, d, "shader_records").select("row_id", analysis.quality().alias("score")))
query("quality_histogram", """select band, count(q) as n from (values ('<0.4'), ('<0.6'), ('<0.8'), ('>=0.8')) b(band) left join
    (select quality_score as q, case when quality_score < 0.4 then '<0.4' when quality_score < 0.6 then '<0.6' when quality_score < 0.8 then '<0.8' else '>=0.8' end as w from shader_records where quality_score is not null and quality_score::varchar <> 'nan') on w = band group by 1""")(
    lambda s, d: analysis.histogram(table(s, d, "shader_records"), "quality_score"))
query("algorithm_summary", f"""
select row_id, l || ' lines; topics: ' || case when t = '' then 'uncategorized' else t end || '; technique: ' || case when regexp_matches({CODE}, '(?i)march') then 'ray marching'
    when regexp_matches({CODE}, {quoted(tx.START + 'sd[A-Z]')}) then 'distance fields' else 'screen space shading' end || '; functions: ' || case when len(f) = 0 then 'none' else array_to_string(f, ', ') end as summary
from (select *, array_to_string({NOTNULL.format('tags_topic')}, ', ') as t, list_filter(coalesce(key_functions, []), lambda f: f is not null and f <> 'mainImage')[1:5] as f from {SCORE})""")(
    lambda s, d: busy(s, d, "shader_records").select("row_id", analysis.summary_text().alias("summary")))
query("corpus_summary", f"""
select count(*) as n, count_if(coalesce(compile_ok, false))::bigint as compile_ok, count_if(coalesce(render_ok, false))::bigint as render_ok, count_if(coalesce(is_generator, true))::bigint as generators, count_if(coalesce(reference_only, false))::bigint as reference_only,
    round(coalesce(avg(quality_score) filter (where quality_score::varchar <> 'nan'), 0), 6) as avg_quality,
    count_if(len(list_filter(coalesce(tags_topic, []), lambda t: t is not null and t <> 'uncategorized')) >= 2)::bigint as multi_tag,
    (select round(max(n) / sum(n), 6) from (select count(*) as n from (select unnest(tags_topic) as t from shader_records) where t is not null group by t)) as top_share from shader_records""")(
    lambda s, d: analysis.corpus_summary(table(s, d, "shader_records")))
query("topic_gini", """
with a as (select count(*)::double as x from (select unnest(tags_topic) as t from shader_records) where t is not null group by t), b as (select x, row_number() over (order by x) as i from a)
select round(coalesce(2 * sum(i * x) / (count(*) * sum(x)) - (count(*) + 1) / count(*), 0), 6) as gini from b""")(
    lambda s, d: analysis.gini(analysis.topic_distribution(table(s, d, "shader_records"))))
query("category_map", """
with a as (select distinct row_id, category from (select row_id, unnest(categories) as category from shader_records) where category is not null),
e as (select topic_name, min(topic_key) as k from topic_list group by 1), l as (select lower(al) as al, min(topic_key) as k from (select unnest(aliases) as al, topic_key from topic_list) group by 1)
select row_id, category, coalesce(e.k, l.k, '') as topic_key from a left join e on topic_name = category left join l on al = lower(category)""")(
    lambda s, d: analysis.category_topics(table(s, d, "shader_records"), table(s, d, "topic_list")))

# ---- chunks and text ----

TAGS, FEATURES = (f"array_to_string({NOTNULL.format(c)}, ', ')" for c in ("tags_topic", "visual_features"))
query("chunk_rows", f"""
with a as (select shader_id as p, 'overview' as kind, concat_ws(chr(10), 'Name: ' || coalesce(name, ''), case when coalesce(username, '') <> '' then 'Author: ' || username end, case when coalesce(description, '') <> '' then 'Description: ' || description end,
    case when {TAGS} <> '' then 'Topics: ' || {TAGS} end, case when {FEATURES} <> '' then 'Visual features: ' || {FEATURES} end) as text from shader_records
union all select shader_id, 'algorithm', algorithm_summary from shader_records where coalesce(algorithm_summary, '') <> ''
union all select shader_id, 'full_code', substr({CODE}, 1, 2000) from shader_records where regexp_replace(substr({CODE}, 1, 2000), '[\\s\\p{{Z}}]+', '', 'g') <> '')
select concat_ws('::', p, kind) as chunk_id, p as parent_id, kind, kind as title, text from a""")(
    lambda s, d: chunking.text_chunks(table(s, d, "shader_records")))
RAW_TAGS = f"array_to_string({NOTNULL.format('tags_raw')}, ', ')"
query("document_texts", f"""select row_id, concat_ws(chr(10) || chr(10), 'Name: ' || coalesce(name, ''), case when coalesce(username, '') <> '' then 'Author: ' || username end, case when coalesce(description, '') <> '' then 'Description: ' || description end,
    case when {TAGS} <> '' then 'Topics: ' || {TAGS} end, case when {RAW_TAGS} <> '' then 'Raw tags: ' || {RAW_TAGS} end, case when {CODE} <> '' then 'Code excerpt:' || chr(10) || substr({CODE}, 1, 1500) end) as text from shader_records""")(
    lambda s, d: table(s, d, "shader_records").select("row_id", chunking.document_text().alias("text")))
query("chunk_functions")(lambda s, d: chunking.function_chunks(busy(s, d, "shader_records")))
query("code_sections")(lambda s, d: table(s, d, "shader_records").filter("code_image is not null").select("row_id", F.explode(split_sections("code_image")).alias("title", "code")))
query("comment_strip", f"""select row_id, length(regexp_replace(regexp_replace({CODE}, '/\\*[\\s\\S]*?\\*/', '', 'g'), '//[^\\n]*', '', 'g')) as chars from shader_records""")(
    lambda s, d: table(s, d, "shader_records").select("row_id", F.length(tx.without_comments("code_image")).cast("long").alias("chars")))
query("line_counts", f"select row_id, {LINES.format('u')} as lines from (select row_id, {UNIX} as u from shader_records)")(
    lambda s, d: table(s, d, "shader_records").select("row_id", tx.line_count("code_image").cast("long").alias("lines")))
query("duplicate_suffix", """select doc_id, parent_id, coalesce(title, '') || case when r > 1 then '_' || (r - 1) else '' end as title
    from (select *, row_number() over (partition by parent_id, coalesce(title, '') order by doc_id) as r from documents where parent_id is not null)""")(
    lambda s, d: table(s, d, "documents").filter("parent_id is not null").withColumn("r", F.row_number().over(Window.partitionBy("parent_id", tx.text("title")).orderBy("doc_id"))).select(
        "doc_id", "parent_id", F.concat(tx.text("title"), F.when(F.col("r") > 1, F.concat(F.lit("_"), (F.col("r") - 1).cast("string"))).otherwise("")).alias("title")))
query("id_slug", """
with a as (select file_id, list_filter(list_transform(string_split(regexp_replace(file_path, '([^/])\\.[^./]*$', '\\1'), '/'), lambda p: lower(regexp_replace(regexp_replace(p, '[^a-zA-Z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'))), lambda p: p <> '') as p from repo_files where file_path is not null)
select file_id, 'local_' || case when len(p) = 0 then 'unnamed' else array_to_string(p, '_') end as slug from a""")(
    lambda s, d: table(s, d, "repo_files").filter("file_path is not null").select("file_id", tx.slug("file_path").alias("slug")))
query("extract_ids", "select row_id, regexp_extract(source_url, '/view/([A-Za-z0-9]{6,7})', 1) as id from shader_records where regexp_matches(source_url, '/view/[A-Za-z0-9]{6,7}')")(
    lambda s, d: table(s, d, "shader_records").filter(F.col("source_url").rlike("/view/[A-Za-z0-9]{6,7}")).select("row_id", F.regexp_extract("source_url", "/view/([A-Za-z0-9]{6,7})", 1).alias("id")))
query("request_keys", "select doc_id, sha1('chat|0.2|false|' || coalesce(kind, '') || chr(0) || coalesce(text, '')) as key from documents")(
    lambda s, d: table(s, d, "documents").select("doc_id", F.sha1(F.concat(F.lit("chat|0.2|false|"), tx.text("kind"), F.lit("\0"), tx.text("text"))).alias("key")))
query("brief_text", "select doc_id, case when length(t) > 80 then substr(t, 1, 80) || '...' else t end as brief from (select doc_id, replace(coalesce(text, ''), chr(10), ' ') as t from documents)")(
    lambda s, d: table(s, d, "documents").select("doc_id", tx.brief("text").alias("brief")))
query("flat_metadata", f"""select row_id, array_to_string({NOTNULL.format('tags_topic')}, ',') as tags, array_to_string({NOTNULL.format('key_functions')}, ',') as functions, length({CODE}) as code_chars from shader_records""")(
    lambda s, d: table(s, d, "shader_records").select("row_id", chunking._joined("tags_topic", ",").alias("tags"), chunking._joined("key_functions", ",").alias("functions"), F.length(tx.text("code_image")).cast("long").alias("code_chars")))

# ---- rules ----

PLAIN = f"regexp_replace({CODE}, '[\\s\\p{{Z}}]+', '', 'g') <> ''"


def counted(c: str, letter: str) -> str:
    return f"(length({c}) - length(replace({c}, {quoted(letter)}, '')))"


G, B, E = tx.GAP, tx.START, tx.STOP
WORDS = r"[\p{L}\p{N}_]+"
OWN = f"len(list_filter(regexp_extract_all(c, {quoted(f'(?m)^{G}*uniform{G}+{WORDS}{G}+({WORDS})')}, 1), lambda u: u not in {among(rules.UNIFORMS)})) > 0"
LINT = {
    "GLSL001": "length(c) > 20000", "GLSL002": f"{counted('c', chr(10))} + 1 > 800", "GLSL010": f"not regexp_matches(c, {quoted(rules.LOOSE)})", "GLSL011": f"regexp_matches(c, {quoted(rules.LOOSE)}) and not regexp_matches(c, {quoted(rules.SIGNED)})",
    "GLSL012": f"regexp_matches(c, {quoted(rf'{B}void{G}+main{G}*\({G}*(?:void)?{G}*\)')})", "GLSL020": f"regexp_matches(c, {quoted(rf'{B}(?:iChannel[0-9]|sampler(?:2D|Cube|3D)|iChannelResolution|iChannelTime){E}')})",
    "GLSL021": f"regexp_matches(c, {quoted(rf'{B}(?:round|roundEven|trunc|isnan|isinf|textureGather){G}*\(')})", "GLSL022": OWN, "GLSL030": f"regexp_matches(c, {quoted(f'(?m)^{G}*```')})", "GLSL031": f"regexp_matches(c, {quoted(f'(?m)^{G}*#version{E}')})",
    "GLSL040": f"{counted('c', '{')} <> {counted('c', '}')}", "GLSL041": f"{counted('c', '(')} <> {counted('c', ')')}", "GLSL050": f"regexp_matches(c, {quoted(rf'{B}while{G}*\({G}*true{G}*\)')}) and not contains(c, 'break')",
}
ROWS = ", ".join(f"case when full_ and {v} then '{k}' end" for k, v in LINT.items())
ERRORS = among(k for k, (level, _) in rules.MESSAGES.items() if level == "error")
@query("lint_rules", f"""
with a as (select row_id, {CODE} as c, {PLAIN} as full_ from shader_records), b as (select row_id, list_filter([case when not full_ then 'GLSL000' end, {ROWS}], lambda x: x is not null) as v from a)
select row_id, array_to_string(v, ',') as rules, len(list_filter(v, lambda x: x in {ERRORS})) as n_error, len(list_filter(v, lambda x: x in {ERRORS})) = 0 as passed from b""")
def _(s, d):
    v = busy(s, d, "shader_records").select("row_id", rules.check("code_image").alias("v"))
    n = F.size(rules.errors_of(F.col("v")))
    return v.select("row_id", F.array_join(F.transform("v", lambda x: x["rule_id"]), ",").alias("rules"), n.cast("long").alias("n_error"), (n == 0).alias("passed"))

STRIPPED = f"regexp_replace(regexp_replace({CODE}, '/\\*[\\s\\S]*?\\*/', '', 'g'), '//[^\\n]*', '', 'g')"
query("convention_score", f"""
with a as (select row_id, {STRIPPED} as c from shader_records)
select row_id, round((case when regexp_matches(c, {quoted(rules.STRICT)}) then 1 else 0 end + case when regexp_matches(c, {quoted(f'{B}(?:sampler2D|samplerCube|iChannel[0-9]){E}')}) then 0 else 1 end
    + case when len(list_filter(regexp_extract_all(c, {quoted(f'{B}uniform{G}+([^{chr(92)}n]*)')}, 1), lambda u: not regexp_matches(u, {quoted(f'{B}(?:iResolution|iTime|iMouse){E}')}))) = 0 then 1 else 0 end
    + case when regexp_matches(c, {quoted(rf'{B}(?:round|roundEven|trunc|textureLod|texelFetch){G}*\(')}) then 0 else 1 end
    + case when {counted('c', '{')} = {counted('c', '}')} and {counted('c', '(')} = {counted('c', ')')} then 1 else 0 end) / 5.0::double, 4) as score from a""")(
    lambda s, d: busy(s, d, "shader_records").select("row_id", F.round(rules.convention("code_image"), 4).alias("score")))
query("bracket_balance", f"select row_id, {counted('c', '{')} - {counted('c', '}')} as braces, {counted('c', '(')} - {counted('c', ')')} as parens from (select row_id, {STRIPPED} as c from shader_records)")(
    lambda s, d: busy(s, d, "shader_records").withColumn("c", tx.without_comments("code_image")).select("row_id", (tx.count_of(F.col("c"), "{") - tx.count_of(F.col("c"), "}")).cast("long").alias("braces"), (tx.count_of(F.col("c"), "(") - tx.count_of(F.col("c"), ")")).cast("long").alias("parens")))
query("render_support", f"""select row_id, not regexp_matches({CODE}, {quoted(f'{B}(?:iChannel[0-9]|sampler(?:2D|Cube|3D)){E}')}) as renders,
    regexp_matches({CODE}, {quoted(rf'{B}void{G}+main(?:Image)?{G}*\(')}) and not regexp_matches({CODE}, {quoted(rf'{B}vec3{G}+{WORDS}{G}*={G}*vec4{G}*\(')}) as compiles from shader_records""")(
    lambda s, d: busy(s, d, "shader_records").select("row_id", rules.renderable("code_image").alias("renders"), rules.mock_compiles("code_image").alias("compiles")))
MUST, MUST_NOT = ("mainImage", "fragColor", "iTime"), ("iChannel", "texture(")
query("contains_assert", f"""select row_id, array_to_string(list_filter({list(MUST)}, lambda w: not contains({CODE}, w)), ',') as missing, array_to_string(list_filter({list(MUST_NOT)}, lambda w: contains({CODE}, w)), ',') as forbidden from shader_records""")(
    lambda s, d: table(s, d, "shader_records").select("row_id", F.array_join(rules.missing("code_image", MUST), ",").alias("missing"), F.array_join(rules.present("code_image", MUST_NOT), ",").alias("forbidden")))


def first(column: str, rows: dict, default: str) -> str:
    return "case " + " ".join(f"when {holds(column, w)} then {quoted(k)}" for k, w in rows.items()) + f" else {quoted(default)} end"


query("spec_parse", f"""select row_id, {first('t', rules.EFFECTS, '')} as effect, {first('t', rules.PALETTES, '')} as palette, {first('t', rules.LEVELS, 'simple')} as complexity, not {holds('t', rules.STILL)} as dynamic
    from (select row_id, lower(coalesce(description, '')) as t from shader_records)""")(
    lambda s, d: table(s, d, "shader_records").select("row_id", *[c.alias(n) for n, c in rules.spec("description").items()]))
query("error_classify", f"""
with a as (select case_id, started_at, lower(coalesce(error, '')) as e from eval_cases), b as (select *, case when trim(e) = '' then null when {holds('e', rules.TIMEOUT)} then 50401 when {holds('e', rules.LIMITED)} then 42901 when {holds('e', rules.REFUSED)} then 50301
    when {holds('e', rules.STORES)} then 50303 when contains(e, 'connection') then 50301 else 50001 end as code from a)
select code, case when code in (50001, 50401, 50301) then 50303 else code end as retrieval_code, count(*) as n from b group by 1, 2""")(
    lambda s, d: table(s, d, "eval_cases").select(rules.error_code("error").alias("code"), rules.retrieval_error_code("error").alias("retrieval_code")).groupBy("code", "retrieval_code").agg(F.count("*").alias("n")))
query("infer_tags", """
with a as (select row_id, list_filter(coalesce(key_functions, []), lambda f: f is not null) as f, contains(coalesce(code_image, ''), 'iTime') as moves from shader_records), b as (select row_id, f, moves, lower(array_to_string(f, ' ')) as j from a)
select row_id, array_to_string(list_filter([case when contains(j, 'march') then 'raymarching' end, case when len(list_filter(f, lambda x: starts_with(lower(x), 'sd'))) > 0 then 'sdf' end,
    case when contains(j, 'noise') or contains(j, 'fbm') or contains(j, 'hash') then 'noise' end, case when contains(j, 'normal') or contains(j, 'light') then 'lighting' end, case when moves then 'animation' end], lambda x: x is not null), ',') as tags from b""")(
    lambda s, d: table(s, d, "shader_records").select("row_id", F.array_join(rules.inferred_tags("key_functions", actions.parsed("code_image")["builtins"]), ",").alias("tags")))

# ---- search ----

STOPS = among(tx.STOPWORDS)


def terms_sql(source: str, key: str, text: str) -> str:
    """(key, term) of every search term."""
    camel = "string_split_regex(lower(regexp_replace(regexp_replace(replace(w, '_', ' '), '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g')), ' +')"
    return f"""(select {key}, term from (select {key}, unnest(list_concat([lower(replace(w, '_', ''))], {camel})) as term from (select {key}, unnest(regexp_extract_all({text}, '[A-Za-z_][A-Za-z0-9_]*')) as w from {source}))
        where length(term) >= 2 and term not in {STOPS})"""


CHUNK_TEXT = "coalesce(title, '') || chr(10) || coalesce(text, '')"
INDEX = f"""tok as materialized (select doc_id as chunk_id, term from {terms_sql('documents', 'doc_id', CHUNK_TEXT)} t),
dl as (select chunk_id, count(*) as dl from tok group by 1), idx as materialized (select chunk_id, term, count(*) as tf from tok group by 1, 2),
raw as (select term, count(*) as df, ln((select count(*) from dl) - count(*) + 0.5::double) - ln(count(*) + 0.5::double) as raw from idx group by 1),
stats as (select term, df, case when raw < 0 then 0.25::double * (select avg(raw) from raw) else raw end as idf from raw)"""
KEYWORD = """qt as (select query_id, term, count(*) as qtf from {terms} x group by 1, 2),
sc as (select query_id, chunk_id, round(sum(qtf * idf * tf * 2.5::double / (tf + 1.5::double * (0.25::double + 0.75::double * dl / (select avg(dl) from dl)))), 9) as score
    from qt join idx using (term) join stats using (term) join dl using (chunk_id) group by 1, 2),
kw as materialized (select * from (select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from sc) where rank <= 20 and score > 0)"""
TITLES = "(select doc_id as query_id, coalesce(title, '') as q from documents where doc_id % 20 = 0)"
BM25 = f"with {INDEX}, {KEYWORD.format(terms=terms_sql(TITLES, 'query_id', 'q'))}"


def chunk_frame(s, d):
    return busy(s, d, "documents").select(F.col("doc_id").alias("chunk_id"), "parent_id", F.concat(tx.text("title"), F.lit("\n"), tx.text("text")).alias("text"))


def title_queries(s, d):
    """The stated query set: the titles of the documents whose id is divisible by 20."""
    return table(s, d, "documents").filter("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), tx.text("title").alias("text"))


def bm25_hits(s, d, k: int = 20):
    index = materialize(search.postings(chunk_frame(s, d)))
    return search.bm25(title_queries(s, d), index, search.term_stats(index), k)


query("token_counts", f"select doc_id, count(*) as n, count(distinct term) as n_distinct from {terms_sql('documents', 'doc_id', 'text')} t group by 1")(
    lambda s, d: table(s, d, "documents").select("doc_id", tx.search_terms("text").alias("t")).filter("size(t) > 0").select("doc_id", F.size("t").cast("long").alias("n"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct")))
query("term_df_idf", f"with {INDEX} select term, df, round(idf, 6) as idf from stats")(
    lambda s, d: search.term_stats(search.postings(chunk_frame(s, d))).select("term", "df", F.round("idf", 6).alias("idf")))
query("bm25_topk", BM25 + " select query_id, chunk_id, round(score, 6) as score, rank from kw")(
    lambda s, d: bm25_hits(s, d).select("query_id", "chunk_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank")))
query("minmax_per_query", BM25 + """ select query_id, chunk_id, round(case when h - l < 1e-9 then case when score > 0 then 1 else 0 end else (score - l) / (h - l) end, 6) as scaled
    from (select *, min(score) over (partition by query_id) as l, max(score) over (partition by query_id) as h from kw)""")(
    lambda s, d: bm25_hits(s, d).select("query_id", "chunk_id", F.round(search.minmax("score", "query_id"), 6).alias("scaled")))
@query("expected_recall", BM25 + """, g as (select query_id, list(distinct parent_id) as got from kw join documents on doc_id = chunk_id where parent_id is not null group by 1)
    select doc_id as query_id, case when got is not null and list_contains(got, parent_id) then 1.0::double else 0.0::double end as recall from documents left join g on query_id = doc_id where doc_id % 20 = 0 and parent_id is not null""")
def _(s, d):
    docs = table(s, d, "documents").filter("parent_id is not null").select("doc_id", "parent_id")
    got = bm25_hits(s, d).join(docs.withColumnRenamed("doc_id", "chunk_id"), "chunk_id").groupBy("query_id").agg(F.collect_set("parent_id").alias("got"))
    want = docs.filter("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), F.array("parent_id").alias("want"))
    return want.join(got, "query_id", "left").select("query_id", evaluation.recall(F.col("want"), F.coalesce("got", F.array().cast("array<string>"))).alias("recall"))

@query("rerank_overlap", BM25 + f""", qs as (select distinct query_id, term from qt), ds as (select distinct chunk_id, term from tok)
    select kw.query_id, kw.chunk_id, round(0.3::double * (select count(*) from qs join ds using (term) where qs.query_id = kw.query_id and ds.chunk_id = kw.chunk_id) / ((select count(*) from qs where qs.query_id = kw.query_id) + 1), 6) as bonus from kw""")
def _(s, d):
    hits = bm25_hits(s, d).join(title_queries(s, d).withColumnRenamed("text", "q"), "query_id").join(chunk_frame(s, d).select("chunk_id", "text"), "chunk_id")
    q = F.array_distinct(tx.search_terms("q"))
    return hits.select("query_id", "chunk_id", F.round(0.3 * F.size(F.array_intersect(q, F.array_distinct(tx.search_terms("text")))) / (F.size(q) + 1), 6).alias("bonus"))

KNN = """nn as materialized (select q.vec_id as query_id, v.vec_id as id, round(1 - list_cosine_similarity(q.embedding::double[], v.embedding::double[]), 9) as distance, q.label = v.label as same
    from embeddings q join embeddings v on q.vec_id <> v.vec_id where q.vec_id % 20 = 0)"""


def vectors(s, d):
    return table(s, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", F.col("label").alias("label"))


query("knn_cosine_topk", f"with {KNN} select query_id, id, round(distance, 6) as distance, rank from (select *, row_number() over (partition by query_id order by distance, id) as rank from nn) where rank <= 10")(
    lambda s, d: search.nearest(vectors(s, d).filter("id % 20 = 0").withColumnRenamed("id", "query_id"), vectors(s, d), 10).select("query_id", "id", F.round("distance", 6).alias("distance"), F.col("rank").cast("long").alias("rank")))
query("knn_filtered", f"with {KNN} select query_id, id, round(distance, 6) as distance, rank from (select *, row_number() over (partition by query_id order by distance, id) as rank from nn where same) where rank <= 5")(
    lambda s, d: search.nearest(vectors(s, d).filter("id % 20 = 0").withColumnRenamed("id", "query_id"), vectors(s, d), 5, same="label").select("query_id", "id", F.round("distance", 6).alias("distance"), F.col("rank").cast("long").alias("rank")))


def parent_frame(s, d):
    """parent_docs as the parent table: one row per shader_id, the latest indexed one."""
    quality = F.coalesce(F.when(~F.isnan("quality_score"), F.col("quality_score")), F.lit(0.0))
    doc = F.coalesce(F.nullif(tx.text("algorithm_summary"), F.lit("")), F.substring(tx.text("code_image"), 1, 600))
    row = F.struct(tx.text("indexed_at").alias("at"), quality.alias("quality"), tx.text("tags_topic").alias("tags"), doc.alias("doc_text"))
    one = table(s, d, "parent_docs").filter("shader_id is not null").groupBy(F.col("shader_id").alias("parent_id")).agg(F.max(row).alias("r"))
    return one.select("parent_id", F.filter(F.split("r.tags", ","), lambda t: t != "").alias("tags"), "r.quality", "r.doc_text")


def search_queries(s, d, parents=None):
    """Titles and vectors of the documents whose id is divisible by 20; wanted is the first tag of their own parent."""
    docs = table(s, d, "documents").filter("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), tx.text("title").alias("text"), "parent_id")
    own = (parents or parent_frame(s, d)).select("parent_id", F.slice("tags", 1, 1).alias("want_tags"))
    rows = docs.join(table(s, d, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding"), "query_id").join(own, "parent_id", "left")
    return rows.select("query_id", "text", "embedding", F.coalesce("want_tags", F.array().cast("array<string>")).alias("want_tags"))


HYBRID = f"""with pp as (select shader_id as parent_id, coalesce(indexed_at, '') as at_, coalesce(case when quality_score::varchar <> 'nan' then quality_score end, 0) as quality, coalesce(tags_topic, '') as tg,
    coalesce(nullif(coalesce(algorithm_summary, ''), ''), substr(coalesce(code_image, ''), 1, 600)) as doc_text from parent_docs where shader_id is not null),
par as materialized (select parent_id, list_filter(string_split(tg, ','), lambda t: t <> '') as tags, quality, doc_text from (select *, row_number() over (partition by parent_id order by at_ desc, quality desc, tg desc, doc_text desc) as r from pp) where r = 1),
que as materialized (select doc_id as query_id, coalesce(title, '') as q, coalesce(par.tags[1:1], []) as want from documents join embeddings on vec_id = doc_id left join par using (parent_id) where doc_id % 20 = 0 and trim(coalesce(title, '')) <> ''),
{INDEX}, {KEYWORD.format(terms=terms_sql('que', 'query_id', 'q'))}, {KNN},
vh as (select query_id, parent_id, greatest(0, max(case when distance = 0 then 0 else 1 - distance end)) as vec from (select *, row_number() over (partition by query_id order by distance, id) as r from nn where query_id in (select query_id from que))
    join documents on doc_id = id where r <= 20 and parent_id is not null group by 1, 2),
k0 as (select query_id, parent_id, max(score) as raw from kw join documents on doc_id = chunk_id where parent_id is not null group by 1, 2),
kh as (select query_id, parent_id, case when h - l < 1e-9 then case when raw > 0 then 1 else 0 end else (raw - l) / (h - l) end as bm25 from (select *, min(raw) over (partition by query_id) as l, max(raw) over (partition by query_id) as h from k0)),
mg as (select query_id, parent_id, coalesce(vec, 0) as vec, coalesce(bm25, 0) as bm25 from vh full join kh using (query_id, parent_id)),
fu as (select *, round(0.50::double * vec + 0.25::double * bm25 + 0.15::double * tag + 0.10::double * quality, 9) as fused from (select *, case when len(want) > 0 then len(list_intersect(want, tags)) / len(want) else 0 end as tag from mg join par using (parent_id) join que using (query_id))),
pl as materialized (select *, row_number() over (partition by query_id order by fused desc, parent_id) as place from fu),
qd as (select distinct query_id, term from qt), dd as materialized (select distinct parent_id, term from {terms_sql('(select parent_id, doc_text from par where parent_id in (select parent_id from pl))', 'parent_id', 'doc_text')} z),
ov as (select query_id, parent_id, count(*) as o from (select query_id, parent_id from pl where place <= 30) join qd using (query_id) join dd using (parent_id, term) group by 1, 2), qn as (select query_id, count(*) as n from qd group by 1),
r0 as (select pl.*, round(fused + 0.3::double * coalesce(o, 0) / (coalesce(n, 0) + 1), 9) as rr from pl left join ov using (query_id, parent_id) left join qn using (query_id) where place <= 30),
r1 as (select *, min(rr) over (partition by query_id) as l, max(rr) over (partition by query_id) as h from r0),
al as (select query_id, parent_id, round(0.3::double * fused + 0.7::double * case when h - l < 1e-9 then case when rr > 0 then 1 else 0 end else (rr - l) / (h - l) end, 9) as fused, vec, bm25, tag, quality from r1
    union all select query_id, parent_id, fused, vec, bm25, tag, quality from pl where place > 30)"""
@query("hybrid_search", HYBRID + """ select query_id, parent_id, round(fused, 4) as fused, round(vec, 4) as vec, round(bm25, 4) as bm25, round(tag, 4) as tag, round(quality, 4) as quality, rank
    from (select *, row_number() over (partition by query_id order by fused desc, parent_id) as rank from al where fused >= 0.15) where rank <= 5""")
def _(s, d):
    parents = materialize(parent_frame(s, d))
    return search.hybrid(materialize(search_queries(s, d, parents)), chunk_frame(s, d), vectors(s, d), parents).withColumn("rank", F.col("rank").cast("long"))

@query("retrieval_cases", HYBRID + """, top as (select query_id, round(fused, 4) as fused from (select *, row_number() over (partition by query_id order by fused desc, parent_id) as rank from al where fused >= 0.15) where rank <= 3),
g as (select query_id, len(want) = 0 as negative, coalesce(n, 0) as n, coalesce(good, 0) as good, coalesce(s, 0) as s from que left join (select query_id, count(*) as n, count_if(fused >= 0.15) as good, sum(fused) as s from top group by 1) using (query_id)),
r as (select query_id, negative, round(case when negative then case when n = 0 then 1 else 0 end when n > 0 then 0.5::double * good / n + 0.5::double * least(1, s / n) else 0 end + 1e-9::double, 6) as score from g)
select query_id, case when negative then 'Negative Rejection' else 'Retrieval Relevancy' end as metric, score, case when negative then 1 else 0.5 end::double as threshold, score >= case when negative then 1 else 0.5 end as success from r""")
def _(s, d):
    parents = materialize(parent_frame(s, d))
    queries = materialize(search_queries(s, d, parents))
    hits = search.hybrid(queries, chunk_frame(s, d), vectors(s, d), parents, top_k=3)
    cases = queries.filter(F.trim(tx.text("text")) != "").select("query_id", (F.size("want_tags") == 0).alias("negative"))
    return evaluation.retrieval_cases(cases, hits)


@query("legacy_search", f"""with {KNN}, pp as (select shader_id as parent_id, coalesce(indexed_at, '') as at_, coalesce(case when quality_score::varchar <> 'nan' then quality_score end, 0) as quality, coalesce(tags_topic, '') as tg,
    coalesce(nullif(coalesce(algorithm_summary, ''), ''), substr(coalesce(code_image, ''), 1, 600)) as doc_text from parent_docs where shader_id is not null),
par as (select parent_id, list_filter(string_split(tg, ','), lambda t: t <> '') as tags from (select *, row_number() over (partition by parent_id order by at_ desc, quality desc, tg desc, doc_text desc) as r from pp) where r = 1),
que as (select doc_id as query_id, coalesce(par.tags[1:1], []) as want from documents join embeddings on vec_id = doc_id left join par using (parent_id) where doc_id % 20 = 0)
select query_id, id, round(0.5::double * rel + 0.15::double * case when len(want) > 0 then len(list_intersect(want, coalesce(tags, []))) / len(want) else 0 end, 4) as fused, rank
from (select *, case when distance = 0 then 0 else 1 - distance end as rel, row_number() over (partition by query_id order by distance, id) as rank from nn) n join que using (query_id) join documents on doc_id = id left join par using (parent_id) where rank <= 5""")
def _(s, d):
    parents = materialize(parent_frame(s, d))
    queries = materialize(search_queries(s, d, parents))
    near = search.nearest(queries.select("query_id", "embedding"), vectors(s, d), 5)
    docs = table(s, d, "documents").select(F.col("doc_id").alias("id"), "parent_id").join(parents.select("parent_id", "tags"), "parent_id", "left")
    rows = near.join(queries.select("query_id", "want_tags"), "query_id").join(docs, "id").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))
    rel = F.when(F.col("distance") == 0, 0.0).otherwise(1.0 - F.col("distance"))
    return rows.select("query_id", "id", F.round(0.5 * rel + 0.15 * search.tag_match("want_tags", "tags"), 4).alias("fused"), F.col("rank").cast("long").alias("rank"))

query("keyword_retriever", """
with e as (select topic_key as id, topic_name as name, list_concat([topic_name], aliases) as keywords from topic_list), q as (select doc_id as query_id, lower(text) as q from documents where doc_id % 20 = 0 and trim(coalesce(text, '')) <> ''),
a as (select query_id, id, len(list_filter(keywords, lambda k: contains(q, lower(k)))) as kw, contains(q, string_split(lower(name), ' ')[1])::int as nm from q cross join e),
b as (select query_id, id, least(1, 0.35::double + 0.2::double * kw) as vec, least(1, (kw + nm) / 3.0::double) as bm25 from a), c as (select *, round(0.50::double * vec + 0.25::double * bm25 + 0.10::double * 0.5::double, 9) as fused from b)
select query_id, id, round(fused, 4) as fused, round(vec, 4) as vec, round(bm25, 4) as bm25, rank from (select *, row_number() over (partition by query_id order by fused desc, id) as rank from c) where rank <= 5 and fused >= 0.05""")(
    lambda s, d: search.keyword_retriever(table(s, d, "documents").filter("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), "text"),
        table(s, d, "topic_list").select(F.col("topic_key").alias("id"), F.col("topic_name").alias("name"), F.concat(F.array("topic_name"), "aliases").alias("keywords"), F.lit(0.5).alias("quality"))).withColumn("rank", F.col("rank").cast("long")))
query("best_chunk_per_parent", """select parent_id, kind, doc_id, n from (select parent_id, coalesce(kind, '') as kind, doc_id, length(coalesce(text, '')) as n, row_number() over (partition by parent_id, coalesce(kind, '') order by length(coalesce(text, '')) desc, doc_id) as r
    from documents where parent_id is not null) where r = 1""")(
    lambda s, d: table(s, d, "documents").filter("parent_id is not null").groupBy("parent_id", tx.text("kind").alias("kind")).agg(F.max(F.struct(F.length(tx.text("text")).alias("n"), (-F.col("doc_id")).alias("m"))).alias("b")).select(
        "parent_id", "kind", (-F.col("b.m")).alias("doc_id"), F.col("b.n").cast("long").alias("n")))

# ---- evaluation, messages ----

MET = "list_filter(coalesce(metrics, []), lambda m: m is not null)"
query("eval_report", f"""
with a as (select coalesce(task, '') as task, elapsed_ms, coalesce(ok, false) and len(list_filter({MET}, lambda m: not coalesce(m.success, false))) = 0 as passed,
    case when len({MET}) > 0 then list_sum(list_transform({MET}, lambda m: coalesce(m.score, 0))) / len({MET}) else 0 end as ms from eval_cases)
select task, count(*) as n_cases, count_if(passed)::bigint as n_passed, round(avg(passed::int), 6) as pass_rate, round(avg(ms), 6) as mean_score, round(coalesce(avg(elapsed_ms), 0), 4) as avg_latency_ms from a group by 1""")(
    lambda s, d: evaluation.report(table(s, d, "eval_cases")))
query("eval_by_metric", """select name, round(avg(score), 4) as mean, round(min(score), 4) as low, round(max(score), 4) as high, count(*) as n from (select unnest(metrics, recursive := true) from eval_cases) where name is not null and score is not null and score::varchar <> 'nan' group by 1""")(
    lambda s, d: evaluation.by_metric(table(s, d, "eval_cases")))
query("retrieval_relevancy", f"""
with a as (select case_id, started_at, elapsed_ms, list_transform({MET}, lambda m: coalesce(m.score, 0)) as s from eval_cases)
select case_id, round(case when len(s) > 0 then 0.5::double * len(list_filter(s, lambda x: x >= 0.5)) / len(s) + 0.5::double * least(1, list_sum(s) / len(s)) else 0 end + 1e-9::double, 6) as relevancy from a""")(
    lambda s, d: table(s, d, "eval_cases").select("case_id", F.round(evaluation.relevancy(F.transform(evaluation._metrics(), lambda m: F.coalesce(m["score"], F.lit(0.0))), 0.5) + 1e-9, 6).alias("relevancy")))
query("fix_loop_efficiency", """select event_id, round(case when k <= 0 then 0 else greatest(0, 1 - (k - 1) / 60.0::double) end, 6) as efficiency from (select event_id, coalesce(json_extract_string(props, '$.k')::int, 0) as k from events)""")(
    lambda s, d: table(s, d, "events").select("event_id", F.round(evaluation.fix_efficiency(F.get_json_object("props", "$.k").cast("int"), 60), 6).alias("efficiency")))
query("perf_gate", """
with a as (select coalesce(task, '') as task, avg((not coalesce(ok, false))::int) as f, coalesce(quantile_cont(elapsed_ms, 0.95), 0) as p from eval_cases group by 1)
select task, round(f, 6) as fail_ratio, round(p, 4) as p95, f <= 0.02 and p <= 5000 as ok from a""")(
    lambda s, d: evaluation.gate(table(s, d, "eval_cases")))
query("pass_gate", f"""
with a as (select coalesce(ok, false) and len(list_filter({MET}, lambda m: not coalesce(m.success, false))) = 0 as passed from eval_cases)
select count(*) as n_cases, round(coalesce(avg(passed::int), 0), 6) as pass_rate, coalesce(avg(passed::int), 0) >= 0.5 as ok from a""")(
    lambda s, d: evaluation.pass_gate(table(s, d, "eval_cases"), 0.5))
query("json_props", "select event_type, count(*) as n, sum(json_extract_string(props, '$.k')::bigint)::bigint as k from events group by 1")(
    lambda s, d: table(s, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.get_json_object("props", "$.k").cast("long")).alias("k")))
query("latest_messages", "select user_id, event_id from (select user_id, event_id, row_number() over (partition by user_id order by ts desc, event_id desc) as r from events) where r <= 5")(
    lambda s, d: messages.latest(table(s, d, "events"), "user_id", ["ts", "event_id"], 5).select("user_id", "event_id"))


def message_chain(s, d):
    """Events as messages: the parent is the user's previous event of the same type."""
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    return table(s, d, "events").select(F.col("event_id").alias("msg_id"), F.lag("event_id").over(w).alias("parent_id"), F.lead("event_id").over(w).alias("next_id"))


@query("lineage", """
with recursive m as materialized (select event_id as id, lag(event_id) over w as up, lead(event_id) over w as nx from events window w as (partition by user_id, event_type order by ts, event_id)),
l as (select id as start, 0 as hop, id from m where nx is null union all select l.start, l.hop + 1, m.up from l join m on m.id = l.id where m.up is not null and l.hop < 1024)
select start, hop, id as msg_id from l""")
def _(s, d):
    chain = materialize(message_chain(s, d))
    return messages.lineage(chain, chain.filter("next_id is null"))

query("running_budget", """select parent_id, doc_id, used from (select parent_id, doc_id, sum(length(coalesce(text, ''))) over (partition by parent_id order by doc_id rows unbounded preceding)::bigint as used from documents where parent_id is not null) where used <= 3600""")(
    lambda s, d: messages.running_budget(table(s, d, "documents").filter("parent_id is not null").withColumn("n", F.length(tx.text("text"))), "parent_id", ["doc_id"], "n", 3600).select("parent_id", "doc_id", "used"))
ROWSOF = "list_filter(list_transform(string_split(regexp_replace({0}, '\\r\\n|\\r', chr(10), 'g'), chr(10)), lambda x: regexp_replace(x, '^[ \\t]+|[ \\t]+$', '', 'g')), lambda x: x <> '')"
@query("row_retention", f"""
with r as (select shader_id, max(code_image) as a from shader_records where shader_id is not null and code_image is not null group by 1), p as (select shader_id, max(code_image) as b from parent_docs where code_image is not null group by 1),
x as (select shader_id, {ROWSOF.format('a')} as a, {ROWSOF.format('b')} as b from r join p using (shader_id))
select shader_id, round(case when len(a) > 0 then len(list_filter(a, lambda t: list_contains(b, t))) / len(a) else 0 end, 6) as kept from x""")
def _(s, d):
    a = table(s, d, "shader_records").filter("shader_id is not null and code_image is not null").groupBy("shader_id").agg(F.max("code_image").alias("code"))
    b = table(s, d, "parent_docs").filter("code_image is not null").groupBy("shader_id").agg(F.max("code_image").alias("code"))
    return evaluation.row_retention(a, b, "shader_id").select("shader_id", F.round("kept", 6).alias("kept"))

query("store_counts", "select 'parents' as store, count(distinct shader_id) as n from parent_docs union all select 'chunks', count(*) from documents union all select 'vectors', count(*) from embeddings union all select 'records', count(distinct shader_id) from shader_records")(
    lambda s, d: table(s, d, "parent_docs").agg(F.countDistinct("shader_id").alias("n")).select(F.lit("parents").alias("store"), "n").unionByName(
        table(s, d, "documents").agg(F.count("*").alias("n")).select(F.lit("chunks").alias("store"), "n")).unionByName(
        table(s, d, "embeddings").agg(F.count("*").alias("n")).select(F.lit("vectors").alias("store"), "n")).unionByName(
        table(s, d, "shader_records").agg(F.countDistinct("shader_id").alias("n")).select(F.lit("records").alias("store"), "n")))


# ---- agents without a model ----

G4 = tx.GAP
HEADS = quoted(actions.DEFINED)


def defined_sql(no: str) -> str:
    """Names of functions whose type is none of ``no``."""
    return f"list_filter(regexp_extract_all({CODE}, {HEADS}, 2), lambda n, i: regexp_extract_all({CODE}, {HEADS}, 1)[i] not in {no})"


query("parse_shader", f"""
select row_id, contains({CODE}, 'mainImage') as has_main, array_to_string({defined_sql(among(actions.NO_TYPES[:5]))}, ',') as functions, array_to_string(list_filter({list(actions.BUILTINS)}, lambda b: contains({CODE}, b)), ',') as builtins,
    array_to_string(regexp_extract_all({CODE}, {quoted(f'uniform{G4}+[a-zA-Z_][a-zA-Z0-9_]*{G4}+([a-zA-Z_][a-zA-Z0-9_]*){G4}*;')}, 1), ',') as uniforms, {LINES.format('u')} as lines from (select *, {UNIX} as u from shader_records)""")(
    lambda s, d: table(s, d, "shader_records").select("row_id", *[(F.array_join(c, ",") if n in ("builtins", "uniforms", "functions") else c.cast("long") if n == "lines" else c).alias(n) for n, c in actions.parsed("code_image").items()]))
query("fallback_techniques", f"""
with a as (select row_id, lower({CODE}) as c, list_filter(coalesce(key_functions, []), lambda f: f is not null) as f from shader_records), b as (select *, lower(array_to_string(f, ' ')) as n from a),
x as (select row_id, list_filter([case when contains(c, 'raymarch') or contains(n, 'ro') or contains(n, 'rd') then 'raymarching' end, case when len(list_filter(f, lambda t: starts_with(t, 'sd'))) > 0 then 'sdf' end,
    case when contains(n, 'noise') or contains(n, 'hash') then 'noise' end, case when contains(c, 'mandelbrot') or contains(c, 'fractal') then 'fractal' end], lambda t: t is not null) as t from b)
select row_id, case when len(t) = 0 then '2d-pattern' else array_to_string(t, ',') end as techniques from x""")(
    lambda s, d: table(s, d, "shader_records").select("row_id", F.array_join(actions.fallback_techniques("code_image", "key_functions"), ",").alias("techniques")))
query("constraints", r"""
with a as (select doc_id, coalesce(text, '') as t from documents)
select doc_id, array_to_string(list_concat(list_concat(list_transform(regexp_extract_all(t, '不要用([\x{4e00}-\x{9fa5}A-Za-z0-9 ]{2,30})', 1), lambda x: 'avoid ' || trim(x)), list_transform(regexp_extract_all(t, '<=?[ \t]*([0-9]+)[ \t]*行', 1), lambda x: '<= ' || x || ' lines')),
    case when contains(lower(t), 'no texture') or contains(t, '无纹理') or contains(t, '不要用纹理') then ['no external textures'] else [] end), ';') as constraints from a""")(
    lambda s, d: table(s, d, "documents").select("doc_id", F.array_join(actions.constraints("text"), ";").alias("constraints")))
SHOWN = " or ".join(f"(effect = {quoted(e)} and {holds('c', w)})" for e, w in actions.SHOWS.items())
query("self_critique", f"""
with a as (select row_id, coalesce(compile_ok, false)::int as ok, lower({CODE}) as c, lower(coalesce(description, '')) as t from shader_records),
b as (select row_id, ok, c, {first('t', rules.EFFECTS, '')} as effect, not {holds('t', rules.STILL)} as dynamic from a)
select row_id, round((ok + (dynamic and contains(c, 'itime'))::int + ({SHOWN})::int) / (1 + dynamic::int + (effect <> '')::int), 6) as score from b""")(
    lambda s, d: table(s, d, "shader_records").select("row_id", F.round(actions.critique(F.coalesce("compile_ok", F.lit(False)), "code_image", rules.spec("description")["effect"], rules.spec("description")["dynamic"]), 6).alias("score")))
NO_TYPES = among(actions.NO_TYPES)
KEYS = ORDERED.replace("{0}", f"list_filter({defined_sql(NO_TYPES)}, lambda n: n <> 'mainImage' and n not in {NO_TYPES})") + "[1:8]"
ANALYZED = f"(select * replace ({KEYS} as key_functions, coalesce(compile_ok, false) or ({ENTRY}) as compile_ok) from shader_records)"
query("analyze_records", f"""
select row_id, array_to_string(key_functions, ',') as functions, compile_ok, {QUALITY} as score, array_to_string(list_filter([{VISUAL}], lambda x: x is not null), ',') as features
from (select *, lower(array_to_string({NOTNULL.format('tags_topic')}, ' ') || ' ' || {CODE}) as h from {SCORE.replace('shader_records', ANALYZED)})""")(
    lambda s, d: actions.analyzed(busy(s, d, "shader_records")).select("row_id", F.array_join("key_functions", ",").alias("functions"), "compile_ok", F.col("quality_score").alias("score"), F.array_join("visual_features", ",").alias("features")))
SLIPPED = ", ".join(f"case when regexp_matches(c, {quoted(f'{B}{w}{E}')}) then 'slip:{w}' end" for w in rules.SLIPS)
query("validate_code", f"""
with a as (select row_id, {CODE} as raw, {STRIPPED} as c from shader_records),
b as (select row_id, raw, c, regexp_matches(c, {quoted(rules.STRICT)}) as sig, substr(regexp_extract(c, {quoted(rules.STRICT + '([' + chr(92) + 's' + chr(92) + 'S]*)')}, 1), 1, 4000) as body from a)
select row_id, array_to_string(list_filter([case when not contains(raw, 'mainImage') then 'no_entry' end, case when {counted('c', '{')} <> {counted('c', '}')} then 'braces' end, case when {counted('c', '(')} <> {counted('c', ')')} then 'parens' end,
    case when regexp_matches(c, {quoted(f'{B}(?:sampler2D|samplerCube|iChannel[0-9]){E}')}) then 'external' end, {SLIPPED}, case when contains(c, 'mainImage') and not sig then 'signature' end], lambda x: x is not null), ',') as errors,
    case when sig and not regexp_matches(body, {quoted(f'[{chr(92)}p{{L}}{chr(92)}p{{N}}_]{G}*=')}) then 'no_assignment' else '' end as warnings from b""")(
    lambda s, d: busy(s, d, "shader_records").select("row_id", *[F.array_join(c, ",").alias(n) for n, c in rules.validated("code_image").items()]))
BARE = r"regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g')"
FENCELESS = rf"case when starts_with({BARE}, '```') then regexp_replace(regexp_replace(regexp_replace({BARE}, '^```[a-zA-Z]*\s*', ''), '\s*```$', ''), '^\s+|\s+$', '', 'g') else {BARE} end"
query("reply_json", f"""
with a as (select doc_id, {FENCELESS} as t from documents), b as (select doc_id, t, strpos(t, '{{') as i, length(t) - strpos(reverse(t), '}}') + 1 as j from a)
select doc_id, case when starts_with(t, '{{') and ends_with(t, '}}') then t when i > 0 and contains(t, '}}') and i < j then substr(t, i, j - i + 1) else t end as json from b""")(
    lambda s, d: table(s, d, "documents").select("doc_id", actions.json_of("text").alias("json")))
EXPL = quoted(actions.EXPLAINED)
query("reply_parts", rf"""
with a as (select doc_id, {FENCELESS} as t from documents)
select doc_id, array_to_string(list_filter(list_transform(string_split(regexp_replace(regexp_extract(t, {EXPL}, 1), '^[ \t]+', '') || regexp_replace(regexp_extract(t, {EXPL}, 2), '\n[ \t]*//[ \t]?', chr(10), 'g'), chr(10)), lambda x: regexp_replace(x, '[ \t\r]+$', '')), lambda x: x <> ''), chr(10)) as explanation,
    length(regexp_replace(regexp_replace(t, {EXPL}, ''), '^\s+|\s+$', '', 'g')) as code_chars from a""")(
    lambda s, d: table(s, d, "documents").select("doc_id", actions.explanation("text").alias("explanation"), F.length(actions.code_of("text")).cast("long").alias("code_chars")))
query("messages_by_type", "select user_id, event_id from events where event_type = 'purchase'")(lambda s, d: messages.having(table(s, d, "events"), "event_type", "purchase").select("user_id", "event_id"))


query("section_prompts")(lambda s, d: table(s, d, "shader_records").filter("code_image is not null").select("row_id", actions.section_prompt(split_sections("code_image")).alias("prompt")))
WRAPPED = 15  # lines that the host puts before a code
@query("line_remap", f"""
with r as (select shader_id, max(length({CODE}) - length(replace({CODE}, chr(10), '')) + 1) as u from shader_records where shader_id is not null group by 1),
a as (select doc_id, coalesce(text, '') as t, coalesce(u, 1) as u from documents left join r on shader_id = parent_id where kind = 'compile_log'),
b as (select doc_id, u, string_split_regex(t, '\\b0\\([0-9]{{1,9}}\\)') as p, list_transform(regexp_extract_all(t, '\\b0\\(([0-9]{{1,9}})\\)', 1), lambda n: n::bigint) as n from a),
c as (select doc_id, u, p[1] || coalesce(list_aggregate(list_transform(n, lambda x, i: '0(' || case when x <= {WRAPPED} then x || '(prologue)' when x - {WRAPPED} <= u then x || '(user:' || (x - {WRAPPED}) || ')' else x || '(epilogue)' end || ')' || p[i + 1]), 'string_agg', ''), '') as t from b),
e as (select doc_id, u, string_split_regex(t, '\\b0:[0-9]{{1,9}}:') as p, list_transform(regexp_extract_all(t, '\\b0:([0-9]{{1,9}}):', 1), lambda n: n::bigint) as n from c)
select doc_id, p[1] || coalesce(list_aggregate(list_transform(n, lambda x, i: '0:' || case when x <= {WRAPPED} then x || '(prologue)' when x - {WRAPPED} <= u then x || '(user:' || (x - {WRAPPED}) || ')' else x || '(epilogue)' end || ':' || p[i + 1]), 'string_agg', ''), '') as log from e""")
def _(s, d):
    code = tx.text("code_image")
    lines = table(s, d, "shader_records").filter("shader_id is not null").groupBy(F.col("shader_id").alias("parent_id")).agg(F.max(tx.count_of(code, "\n") + 1).alias("lines"))
    logs = table(s, d, "documents").filter("kind = 'compile_log'").join(lines, "parent_id", "left")
    return logs.select("doc_id", actions.remapped("text", F.coalesce("lines", F.lit(1)), WRAPPED).alias("log"))


@query("prompt_references")
def _(s, d):
    """The prompt's references of every record: its latest five documents as blocks within the budget."""
    docs = table(s, d, "documents").filter("parent_id is not null").select("parent_id", "doc_id", "text")
    top = messages.latest(docs, "parent_id", ["doc_id"], 5).groupBy("parent_id").agg(F.sort_array(F.collect_list(F.struct("doc_id", "text")), asc=False).alias("b"))
    return top.select("parent_id", F.array_join(actions.prompt_blocks(F.transform("b", lambda x: x["text"])), "\n\n").alias("references"))


query("base_colour", f"""
with a as (select row_id, list_filter(list_transform(regexp_extract_all({CODE}, {quoted(actions.VEC3)}, 1), lambda v: list_transform(string_split(v, ','), lambda x: trim(regexp_replace(x, '[ \t\r\n\f]', '', 'g'))::double)),
    lambda p: len(list_filter(p, lambda x: x > 1)) = 0 and len(list_filter(p, lambda x: x > 0)) > 0) as f from shader_records)
select row_id, case when len(f) > 0 then f[-1][1] else 0.5::double end as r, case when len(f) > 0 then f[-1][2] else 0.5::double end as g, case when len(f) > 0 then f[-1][3] else 0.5::double end as b from a""")(
    lambda s, d: busy(s, d, "shader_records").select("row_id", actions.base_colour("code_image").alias("v")).select("row_id", *[F.col("v")[i].alias(c) for i, c in enumerate("rgb")]))
query("reference_context")(lambda s, d: table(s, d, "shader_records").select("row_id", actions.reference_context("tags_topic", "visual_features", "quality_score", "algorithm_summary", "code_image", names="key_functions").alias("context")))
query("masked_names", """select row_id, case when u = '' then '<unset>' when length(u) <= 4 then repeat('*', length(u)) else substr(u, 1, 4) || '******(len=' || length(u) || ')' end as shown from (select row_id, coalesce(username, '') as u from shader_records)""")(
    lambda s, d: table(s, d, "shader_records").select("row_id", actions.masked("username").alias("shown")))
query("call_stats", """
with a as (select coalesce(kind, '') as kind, sha1(coalesce(title, '')) as key, length(coalesce(title, '')) as i, length(coalesce(text, '')) as o from documents)
select kind, count(*) as calls, count(*) - count(distinct key) as cached, sum(i)::bigint as chars_in, sum(o)::bigint as chars_out from a group by 1""")(
    lambda s, d: actions.call_stats(table(s, d, "documents"), "title", "text", "kind"))
query("readiness", "select coalesce(source, '') as source, bool_and(coalesce(compile_ok = 1, false)) as ready from parent_docs group by 1")(
    lambda s, d: actions.readiness(table(s, d, "parent_docs"), "source", "compile_ok"))


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
