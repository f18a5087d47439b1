"""Hybrid retrieval for batches of queries: BM25 and cosine legs, fusion, reranking, threshold.

Every step carries ``query_id``; all queries run in one plan. Equal query texts are scored once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lucerna.functions.text import search_terms, text
from lucerna.plans.runtime import materialize


@dataclass(frozen=True)
class Weights:
    vector: float = 0.50
    keyword: float = 0.25
    tag: float = 0.15
    quality: float = 0.10
    recall: int = 20
    head: int = 30
    keep: float = 0.30
    overlap: float = 0.30
    least: float = 0.15


def postings(chunks: DataFrame, text_of: str = "text") -> DataFrame:
    """(chunk_id, term, tf, dl): term counts of chunks that have terms."""
    terms = chunks.select("chunk_id", search_terms(text_of).alias("terms")).withColumn("dl", F.size("terms")).filter("dl > 0")
    return terms.select("chunk_id", "dl", F.explode("terms").alias("term")).groupBy("chunk_id", "dl", "term").agg(F.count("*").alias("tf"))


def term_stats(index: DataFrame, epsilon: float = 0.25) -> DataFrame:
    """(term, df, idf): Okapi idf; a negative one is replaced by epsilon times the mean over all terms."""
    size = index.select("chunk_id").distinct().agg(F.count("*").alias("n"))
    raw = index.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(size)).select("term", "df", (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
    mean = raw.agg(F.avg("raw").alias("mean"))
    return raw.crossJoin(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, epsilon * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


def bm25(queries: DataFrame, index: DataFrame, stats: DataFrame, k: int, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(query_id, chunk_id, score, rank): the first ``k`` chunks of a query, then those above 0.

    ``queries`` has query_id and text; ties go to the smaller chunk_id.
    """
    texts = queries.select("query_id", text("text").alias("qtext"))
    terms = texts.select("qtext").distinct().select("qtext", F.explode(search_terms("qtext")).alias("term")).groupBy("qtext", "term").agg(F.count("*").alias("qtf"))
    length = index.select("chunk_id", "dl").distinct().agg(F.avg("dl").alias("avgdl"))
    weight = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    scored = (
        index.join(terms.join(stats.select("term", "idf"), "term"), "term").crossJoin(F.broadcast(length))
        .groupBy("qtext", "chunk_id").agg(F.sum(F.col("qtf") * weight).alias("score"))
        .withColumn("score", F.round("score", 9))
        .withColumn("rank", F.row_number().over(Window.partitionBy("qtext").orderBy(F.desc("score"), "chunk_id")))
        .filter((F.col("rank") <= k) & (F.col("score") > 0))
    )
    return texts.join(scored, "qtext").select("query_id", "chunk_id", "score", "rank")


def nearest(queries: DataFrame, vectors: DataFrame, k: int, same: str | None = None, block: int = 8192) -> DataFrame:
    """(query_id, id, distance, rank): exact cosine neighbours of every query among all vectors, itself left out.

    Queries and vectors are packed into blocks; each pair of blocks is a few matrix products that keep ``k``
    rows per query (and those equal to the last), and the final rank sees those of every block. ``same``: a column of
    both sides that must be equal; blocks are made within its values, so that others are never compared. Null values
    of it, and null and zero vectors, have no neighbours.
    """
    label = F.col(same) if same else F.lit(0)
    usable = lambda df, key: df.filter(F.col("embedding").isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("id"), label.alias("same"), "embedding")
    owned, asked = usable(vectors, "id"), usable(queries, "query_id")
    wide = owned.groupBy("same").agg(F.ceil(F.count("*") / block).cast("int").alias("wide"))
    long = max(1, -(-queries.count() // 1024))

    def packed(df: DataFrame, parts, by: str, ids: str, data: str) -> DataFrame:
        rows = df.withColumn(by, F.pmod(F.xxhash64("id"), parts).cast("int")).groupBy("same", by).agg(F.collect_list(F.struct("id", "embedding")).alias("r"))
        return rows.select("same", by, F.transform("r", lambda x: x["id"]).alias(ids), F.flatten(F.transform("r", lambda x: x["embedding"])).cast("array<double>").alias(data))

    left = packed(asked, F.lit(long), "qb", "qids", "qdata").join(wide, "same").select("same", "qids", "qdata", F.explode(F.sequence(F.lit(0), F.col("wide") - 1)).alias("vb"))
    right = packed(owned.join(wide, "same"), F.col("wide"), "vb", "vids", "vdata")

    def matrix(ids, data) -> tuple[np.ndarray, np.ndarray]:
        m = data.reshape(len(ids), -1)
        norm = np.sqrt((m * m).sum(1, keepdims=True))
        ok = norm[:, 0] > 0
        return ids[ok], m[ok] / norm[ok]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for qids, qdata, vids, vdata in zip(batch["qids"], batch["qdata"], batch["vids"], batch["vdata"]):
                (qid, q), (vid, v) = matrix(qids, qdata), matrix(vids, vdata)
                if not len(qid) or not len(vid):
                    continue
                for at in range(0, len(qid), 256):
                    ids, d = qid[at : at + 256], np.round(1.0 - q[at : at + 256] @ v.T, 9)
                    d[ids[:, None] == vid[None, :]] = np.inf
                    last = np.partition(d, k - 1, axis=1)[:, k - 1 : k] if d.shape[1] > k else np.full((len(d), 1), np.inf)
                    row, col = np.nonzero((d <= last) & np.isfinite(d))
                    yield pd.DataFrame({"query_id": ids[row], "id": vid[col], "distance": d[row, col]})

    near = left.join(right, ["same", "vb"]).select("qids", "qdata", "vids", "vdata").mapInPandas(run, "query_id long, id long, distance double")
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id")))
    return ranked.filter(F.col("rank") <= k)


def minmax(value: str, *by: str) -> Column:
    """Scaled to 0..1 within ``by``; without a range 1 for values above 0, else 0."""
    w = Window.partitionBy(*by)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return F.when(high - low < 1e-9, F.when(F.col(value) > 0, 1.0).otherwise(0.0)).otherwise((F.col(value) - low) / (high - low))


def tag_match(want: str, tags: str) -> Column:
    """Share of the wanted tags that are there, 0 where none is wanted."""
    wanted = F.array_distinct(want)
    return F.when(F.size(wanted) > 0, F.size(F.array_intersect(wanted, F.col(tags))) / F.size(wanted)).otherwise(0.0)


def fuse(vector_hits: DataFrame, keyword_hits: DataFrame, parents: DataFrame, queries: DataFrame, w: Weights) -> DataFrame:
    """Candidates by (query_id, parent_id) with vec, bm25, tag, quality and fused.

    Vector hits: (query_id, parent_id, rel), floored at 0 by parent. Keyword hits: (query_id, parent_id,
    score), scaled within the query. Parents unknown to ``parents`` are dropped.
    """
    vec = vector_hits.filter("parent_id is not null").groupBy("query_id", "parent_id").agg(F.greatest(F.lit(0.0), F.max("rel")).alias("vec"))
    raw = keyword_hits.filter("parent_id is not null").groupBy("query_id", "parent_id").agg(F.max("score").alias("raw"))
    key = raw.select("query_id", "parent_id", minmax("raw", "query_id").alias("bm25"))
    merged = vec.join(key, ["query_id", "parent_id"], "full_outer").select("query_id", "parent_id", F.coalesce("vec", F.lit(0.0)).alias("vec"), F.coalesce("bm25", F.lit(0.0)).alias("bm25"))
    rows = merged.join(parents, "parent_id").join(queries.select("query_id", "want_tags", "query_terms"), "query_id")
    rows = rows.withColumn("tag", tag_match("want_tags", "tags"))
    return rows.withColumn("fused", F.round(w.vector * F.col("vec") + w.keyword * F.col("bm25") + w.tag * F.col("tag") + w.quality * F.col("quality"), 9))


def rerank(candidates: DataFrame, w: Weights) -> DataFrame:
    """Blend the head of each query with term overlap: the first ``head`` by fused score, the rest untouched.

    ``candidates`` has query_terms and doc_terms, the distinct search terms of both texts.
    """
    order = Window.partitionBy("query_id").orderBy(F.desc("fused"), "parent_id")
    ranked = candidates.withColumn("head", F.row_number().over(order) <= w.head)
    scored = ranked.withColumn("rr", F.when(F.col("head"), F.round(F.col("fused") + w.overlap * F.size(F.array_intersect("query_terms", "doc_terms")) / (F.size("query_terms") + 1), 9)))
    blended = F.round(w.keep * F.col("fused") + (1 - w.keep) * minmax("rr", "query_id", "head"), 9)
    return scored.withColumn("fused", F.when(F.col("head"), blended).otherwise(F.col("fused"))).drop("rr", "head")


def hybrid(queries: DataFrame, chunks: DataFrame, vectors: DataFrame, parents: DataFrame, top_k: int = 5, w: Weights = Weights()) -> DataFrame:
    """(query_id, parent_id, fused, vec, bm25, tag, quality, rank): the best parents of every query.

    queries(query_id, text, want_tags, embedding), chunks(chunk_id, parent_id, text), vectors(id = chunk_id,
    embedding), parents(parent_id, tags, quality, doc_text). Blank queries give no row. A distance of exactly
    0 counts as no similarity, as the replaced system had it.
    """
    # each text is cut into terms once, not once for each pair
    queries = materialize(queries.filter(F.trim(text("text")) != "").withColumn("query_terms", F.array_distinct(search_terms("text"))))
    parents = parents.withColumn("doc_terms", F.array_distinct(search_terms("doc_text"))).drop("doc_text")
    of = chunks.select("chunk_id", "parent_id")
    near = nearest(queries.select("query_id", "embedding"), vectors, w.recall).withColumn("rel", F.when(F.col("distance") == 0, 0.0).otherwise(1.0 - F.col("distance")))
    near = materialize(near)
    vector_hits = near.select("query_id", F.col("id").alias("chunk_id"), "rel").join(of, "chunk_id")
    index = materialize(postings(chunks))
    keyword_hits = bm25(queries, index, term_stats(index), w.recall).join(of, "chunk_id")
    found = rerank(fuse(vector_hits, keyword_hits, parents, queries, w), w).filter(F.col("fused") >= w.least)
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("fused"), "parent_id"))).filter(F.col("rank") <= top_k)
    return found.select("query_id", "parent_id", *[F.round(c, 4).alias(c) for c in ("fused", "vec", "bm25", "tag", "quality")], "rank")


def keyword_retriever(queries: DataFrame, entries: DataFrame, top_k: int = 5, least: float = 0.05) -> DataFrame:
    """The deterministic retriever: entries(id, name, keywords, quality) scored by how many keywords a query has.

    ``entries`` is a small list that is broadcast; every query row meets it within its own task.
    """
    listed = F.broadcast(entries.agg(F.collect_list(F.struct("id", "name", "keywords", "quality")).alias("entries")))
    low = F.lower("text")
    rows = queries.filter(F.trim(text("text")) != "").crossJoin(listed).select("query_id", low.alias("q"), F.explode("entries").alias("e"))
    hits = F.size(F.filter("e.keywords", lambda k: F.col("q").contains(F.lower(k))))
    named = F.col("q").contains(F.split_part(F.lower("e.name"), F.lit(" "), F.lit(1))).cast("int")
    rows = rows.select("query_id", F.col("e.id").alias("id"), F.least(F.lit(1.0), F.lit(0.35) + 0.2 * hits).alias("vec"), F.least(F.lit(1.0), (hits + named) / 3.0).alias("bm25"), F.col("e.quality").alias("quality"))
    rows = rows.withColumn("fused", F.round(0.50 * F.col("vec") + 0.25 * F.col("bm25") + 0.10 * F.col("quality"), 9))
    best = rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("fused"), "id"))).filter((F.col("rank") <= top_k) & (F.col("fused") >= least))
    return best.select("query_id", "id", F.round("fused", 4).alias("fused"), F.round("vec", 4).alias("vec"), F.round("bm25", 4).alias("bm25"), "rank")
