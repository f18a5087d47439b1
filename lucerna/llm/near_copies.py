"""Problem 5: records whose code was derived from other records by small edits.

Fingerprint: ``BLOCKS * WIDTH`` min-hash symbols over all of a code's three-token shingles, split into ``BLOCKS``
blocks. Two fingerprints that differ in fewer symbols than there are blocks share a block, by the pigeonhole
principle; that covers similarities from about 0.86 on. Below, blocks of few symbols would keep the guarantee
but make candidates of all codes that share some common lines; with blocks of ``WIDTH`` symbols 2 in 1,000 of the
pairs at exactly 0.6 share none, 4 in 100,000 of those at 0.65, one in 20 million of those at 0.7. Codes that
share a block are verified by the Hamming distance of a bit of the first symbols of each block, then by the exact
similarity.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lucerna.functions.code_text import without_comments
from lucerna.plans.runtime import materialize, spread

BLOCKS, WIDTH = 128, 6
#: Longs of bits kept for the Hamming distance; each takes one bit of 64 blocks.
LONGS = 4
#: Differing bits of two fingerprints at similarity 0.6 are 51 on average; beyond this are 5 in 10 million.
FAR = 84
#: A block of more classes than this is dealt to several tasks.
HOT = 2000
#: Text bytes hashed at a time; bounds a task's memory.
CHUNK = 1 << 20
_U = np.uint64
_BASE, _MASK = 0x9E3779B97F4A7C15 | 1, (1 << 64) - 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_CLASS = np.zeros(256, np.uint8)  # 0 white space, 1 word, 2 other character, 3 its further bytes
_CLASS[:128] = [1 if chr(i).isalnum() or i == 95 else 0 if chr(i).isspace() else 2 for i in range(128)]
_CLASS[128:192], _CLASS[192:] = 3, 2
_WIDE_SPACE = re.compile(r"[^\S\x00-\x7f]")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, _U)
    out[0] = 1
    return np.cumprod(out, dtype=_U)


def shingle_sets(codes: list[str]) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each code's three-token sequences, comments taken out.

    Tokens are runs of ASCII letters, digits and underscores, and every other single character that is no
    white space. Whole batches are hashed at once by prefix sums of a polynomial over the UTF-8 bytes.
    """
    out: list[np.ndarray] = []
    batch: list[bytes] = []
    held = 0
    for code in codes:
        text = without_comments(code)
        if not text.isascii():
            text = _WIDE_SPACE.sub(" ", text)
        batch.append(text.encode("utf-8", "replace"))
        held += len(batch[-1])
        if held >= CHUNK:
            out += _hashed(batch)
            batch, held = [], 0
    return out + (_hashed(batch) if batch else [])


def _hashed(texts: list[bytes]) -> list[np.ndarray]:
    sizes = np.array([len(t) for t in texts])
    edges = np.concatenate(([0], np.cumsum(sizes)))
    data = np.frombuffer(b"".join(texts), np.uint8)
    none = [np.zeros(0, _U)] * len(texts)
    if len(data) < 3:
        return none
    kind = _CLASS[data]
    fresh = np.empty(len(data), bool)
    fresh[0] = True
    fresh[1:] = kind[1:] != kind[:-1]
    fresh[edges[:-1][sizes > 0]] = True
    start = ((kind == 1) & fresh) | (kind == 2)
    bound = np.flatnonzero(start | (kind == 0))
    ends = np.append(bound[1:], len(data))
    # a token of one text ends where the next text starts
    at = start[bound]
    starts, ends = bound[at], ends[at]
    text_of = np.searchsorted(edges, starts, "right") - 1
    ends = np.minimum(ends, edges[text_of + 1])
    with np.errstate(over="ignore"):
        sums = np.concatenate((np.zeros(1, _U), np.cumsum((data.astype(_U) + _U(1)) * _powers(_BASE, len(data)), dtype=_U)))
        token = _mixed((sums[ends] - sums[starts]) * _powers(_INVERSE, len(data))[starts])
        if len(token) < 3:
            return none
        triple = _mixed(token[:-2] * _U(0xD6E8FEB86659FD93) + _mixed(token[1:-1] + _U(0x632BE59BD9B4E019)) * _U(0xCA5A826395121157 | 1) + token[2:])
    triple = triple[text_of[:-2] == text_of[2:]]
    counts = np.maximum(np.bincount(text_of, minlength=len(texts)) - 2, 0)
    return [np.unique(x) for x in np.split(triple, np.cumsum(counts)[:-1])]


def _class(s: np.ndarray) -> str:
    """128 bits that name a shingle set."""
    with np.errstate(over="ignore"):
        x = _mixed(s + _U(len(s)))
        return f"{int(np.bitwise_xor.reduce(x)):016x}{int(np.add.reduce(_mixed(x + _U(_BASE)))):016x}"


def _fingerprints(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """BLOCKS block keys, and LONGS longs of bits, of each (not empty) set."""
    rng = np.random.default_rng(5)
    xors, factors = rng.integers(0, 1 << 32, BLOCKS * WIDTH, dtype=np.uint32), rng.integers(0, 1 << 32, BLOCKS * WIDTH, dtype=np.uint32) | np.uint32(1)
    x = (np.concatenate(sets) >> _U(24)).astype(np.uint32)
    offsets = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
    keys = np.empty((len(sets), BLOCKS), _U)
    bits = np.empty((len(sets), LONGS * 64), np.uint8)
    taken = LONGS * 64 // BLOCKS
    with np.errstate(over="ignore"):
        for block in range(BLOCKS):
            key = np.full(len(sets), block, _U)
            for w in range(WIDTH):
                k = block * WIDTH + w
                symbol = _mixed(np.minimum.reduceat((x ^ xors[k]) * factors[k], offsets).astype(_U))
                if w < taken:
                    bits[:, block * taken + w] = symbol & _U(1)
                key = _mixed(key * _U(_BASE) + symbol)
            keys[:, block] = key
    return keys.astype(np.int64), np.packbits(bits, axis=1).view(np.int64)


def signatures(codes: DataFrame) -> DataFrame:
    """(shader_id, class_id, code_key, blocks, bits): class_id is the same for equal shingle sets.

    Codes with fewer than three tokens have no row: they share no sequence with any other. Blocks and bits come
    with the first code of a class in each task only, so a group of copies, however large, is fingerprinted once
    for each task.
    """

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: set[str] = set()
        for batch in batches:
            for at in range(0, len(batch), 250):
                part = batch.iloc[at : at + 250]
                sets = shingle_sets(part["code_image"].tolist())
                full = [len(x) > 0 for x in sets]
                sets = [x for x in sets if len(x)]
                if not sets:
                    continue
                names = [_class(x) for x in sets]
                blocks: list = [None] * len(sets)
                bits: list = [None] * len(sets)
                new = [i for i, k in enumerate(names) if not (k in known or known.add(k))]
                if new:
                    for i, b, c in zip(new, *_fingerprints([sets[i] for i in new])):
                        blocks[i], bits[i] = b, c
                yield part.loc[full, ["shader_id", "code_key"]].assign(class_id=names, blocks=blocks, bits=bits)[["shader_id", "class_id", "code_key", "blocks", "bits"]]

    keyed = codes.select("shader_id", "code_image", F.xxhash64("code_image").alias("code_key"))
    return keyed.mapInPandas(sign, "shader_id string, class_id string, code_key long, blocks array<long>, bits array<long>")


def sharing(cells: DataFrame, hot: int = HOT) -> DataFrame:
    """Distinct (a, b), a < b, of the ``of`` values that share a block, from (block, of), repeated rows allowed.

    All rows are moved once, by block, and those alone in their block end there. In a block of more than ``hot``
    rows one side is dealt to as many tasks as it has parts of that size, and the other is copied to each of them.
    """
    shared = materialize(cells.withColumn("n", F.count("*").over(Window.partitionBy("block"))).filter("n > 1").select("block", "of", F.ceil(F.col("n") / hot).cast("int").alias("parts")))
    few, many = (shared.filter(c).dropDuplicates(["block", "of"]) for c in ("parts = 1", "parts > 1"))
    left = many.select("block", F.pmod(F.xxhash64("of"), F.col("parts")).cast("int").alias("part"), F.col("of").alias("a"))
    right = many.select("block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("of").alias("b"))
    own = few.select("block", F.col("of").alias("a")).join(few.select("block", F.col("of").alias("b")), "block").select("a", "b")
    dealt = left.join(right, ["block", "part"]).select("a", "b")
    return own.filter("a < b").unionByName(dealt.filter("a < b")).distinct()


def hamming(a: str, b: str) -> Column:
    """Differing bits of two fingerprints."""
    return sum(F.bit_count(F.col(a)[k].bitwiseXOR(F.col(b)[k])) for k in range(LONGS))


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Shared three-token sequences divided by those found in either code; 0 where neither has one."""
    texts = list(dict.fromkeys([*a, *b]))
    sets = dict(zip(texts, shingle_sets(texts)))
    out = []
    for x, y in zip(a, b):
        n = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
        out.append(n / max(1, len(sets[x]) + len(sets[y]) - n))
    return pd.Series(out)


def coded(records: DataFrame) -> DataFrame:
    return records.filter(F.col("shader_id").isNotNull() & F.col("code_image").isNotNull()).select("shader_id", "code_image")


def linked_classes(records: DataFrame, least: float = 0.6) -> tuple[DataFrame, DataFrame]:
    """(class_a, class_b, similarity) of classes at least ``least`` similar, and (class_id, shader_id) members.

    Equal shingle sets form one class first, so groups of copies, however large, meet the block join as one row.
    Fingerprints may differ in up to FAR bits: the exact similarity decides.
    """
    codes = spread(coded(records))
    signed = materialize(signatures(codes))
    members = signed.select("class_id", "shader_id").distinct()
    first = signed.filter("blocks is not null")
    one = first.groupBy("class_id").agg(F.min(F.struct("code_key", "bits")).alias("r"))
    prints = materialize(one.select("class_id", F.xxhash64("class_id").alias("of"), "r.*"))
    pairs = sharing(first.select(F.explode("blocks").alias("block"), F.xxhash64("class_id").alias("of")))
    side = lambda n: prints.select(F.col("of").alias(n), F.col("class_id").alias(f"class_{n}"), F.col("bits").alias(f"bits_{n}"), F.col("code_key").alias(f"key_{n}"))
    near = pairs.join(side("a"), "a").join(side("b"), "b").filter(hamming("bits_a", "bits_b") <= FAR).select("class_a", "class_b", "key_a", "key_b")
    near = materialize(near)
    wanted = materialize(near.select(F.explode(F.array("key_a", "key_b")).alias("code_key")).distinct())
    texts = coded(records).select(F.xxhash64("code_image").alias("code_key"), "code_image").join(wanted, "code_key", "left_semi")
    texts = materialize(texts.groupBy("code_key").agg(F.max("code_image").alias("code")))
    links = (
        near.join(texts.toDF("key_a", "code_a"), "key_a").join(texts.toDF("key_b", "code_b"), "key_b")
        .withColumn("similarity", similarity("code_a", "code_b"))
        .filter(F.col("similarity") >= least)
        .select("class_a", "class_b", "similarity")
    )
    return links, members


def found(records: DataFrame, least: float = 0.6) -> DataFrame:
    """p5_found: (shader_id_a, shader_id_b), a < b, of all pairs at least ``least`` similar.

    Rows with a null shader_id or null code, and codes of fewer than three tokens, give no pair. Copies are
    expanded into pairs here because the result asks for pairs; ``membership`` keeps them as classes.
    """
    links, members = linked_classes(records, least)
    a, b = members.toDF("class_a", "x"), members.toDF("class_b", "y")
    across = links.join(a, "class_a").join(b, "class_b").select(F.least("x", "y").alias("shader_id_a"), F.greatest("x", "y").alias("shader_id_b"))
    within = a.join(b.withColumnRenamed("class_b", "class_a"), "class_a").filter("x < y").select(F.col("x").alias("shader_id_a"), F.col("y").alias("shader_id_b"))
    return across.filter("shader_id_a < shader_id_b").unionByName(within).distinct()


def membership(records: DataFrame, least: float = 0.6) -> DataFrame:
    """(shader_id, class_id, copies, links): a record's class of equal shingle sets, its size, and to how many
    other classes it is linked. One row per record with code of three tokens or more."""
    links, members = linked_classes(records, least)
    degree = links.select(F.explode(F.array("class_a", "class_b")).alias("class_id")).groupBy("class_id").agg(F.count("*").alias("links"))
    sizes = members.groupBy("class_id").agg(F.count("*").alias("copies")).join(degree, "class_id", "left")
    return members.join(sizes, "class_id").select("shader_id", "class_id", "copies", F.coalesce("links", F.lit(0)).alias("links"))
