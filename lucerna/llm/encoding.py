"""Problem 7: encode a corpus with a public byte-level BPE vocabulary.

Each piece of the pre-tokenizer is merged with a priority queue of merge ranks over a doubly linked list of
symbols; queue entries whose symbols have changed since are skipped. Pieces seen before come from a
per-worker table of bounded size.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lucerna.plans.runtime import spread

#: Folder of the public vocabularies; a parameter of every operator here.
TOKENIZERS = "/opt/tokenizers"
#: Fixed value: the pre-tokenizer's pattern that belongs to the byte_bpe_50k vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
REMEMBERED = 1 << 18


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one piece: the pair of least rank, the leftmost of equals, is merged until none is left."""
    n = len(piece)
    if n == 1:
        return [ranks[piece]]
    end = list(range(1, n + 1))  # symbol i covers piece[i:end[i]]; 0 marks one that was merged away
    before = list(range(-1, n - 1))
    queue = [(rank, i, i + 2) for i in range(n - 1) if (rank := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(queue)
    while queue:
        _, i, stop = heapq.heappop(queue)
        j = end[i]
        if not j or j >= n or end[j] != stop:
            continue  # stale: one of the two symbols has changed
        end[i], end[j] = stop, 0
        if stop < n:
            before[stop] = i
            if (rank := ranks.get(piece[i : end[stop]])) is not None:
                heapq.heappush(queue, (rank, i, end[stop]))
        h = before[i]
        if h >= 0 and (rank := ranks.get(piece[h:stop])) is not None:
            heapq.heappush(queue, (rank, h, stop))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : end[i]]])
        i = end[i]
    return ids


class Encoder:
    """Encodes texts; strings that look like special tokens are plain text, null and '' give no ids."""

    _loaded: dict[str, Encoder] = {}

    def __init__(self, path: str):
        self.ranks = load_ranks(path)
        self.pieces = regex.compile(PATTERN)
        self.known: dict[str, list[int]] = {}

    @classmethod
    def of(cls, path: str) -> Encoder:
        """One per worker process and vocabulary."""
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        known, ids = self.known, []
        for piece in self.pieces.findall(text):
            got = known.get(piece)
            if got is None:
                got = merge(piece.encode("utf-8"), self.ranks)
                if len(known) >= REMEMBERED:
                    known.clear()
                if len(piece) <= 64:
                    known[piece] = got
            ids += got
        return ids


def vocabulary(name: str, folder: str) -> str:
    return str(Path(folder) / f"{name}.tiktoken")


def encode(documents: DataFrame, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """p7_ids: (doc_id, ids). Null and empty texts give an empty list; no row is lost, none is repeated."""
    path = vocabulary(name, folder)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder.of(path)
        for batch in batches:
            for at in range(0, len(batch), 1000):
                part = batch.iloc[at : at + 1000]
                yield pd.DataFrame({"doc_id": part["doc_id"], "ids": [encoder.encode(t) for t in part["text"]]})

    return spread(documents.select("doc_id", "text")).mapInPandas(run, "doc_id long, ids array<int>")


def token_counts(documents: DataFrame, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(doc_id, tokens): the length of each document in tokens, 0 for null and empty texts."""
    path = vocabulary(name, folder)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder.of(path)
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "tokens": [len(encoder.encode(t)) for t in batch["text"]]})

    return spread(documents.select("doc_id", "text")).mapInPandas(run, "doc_id long, tokens long")


def decode(encoded: DataFrame, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(doc_id, text): vocabulary strings joined; an empty or null list gives ''."""
    path = vocabulary(name, folder)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens = {i: t for t, i in Encoder.of(path).ranks.items()}
        for batch in batches:
            texts = [b"".join(tokens[i] for i in (ids if ids is not None else ())).decode("utf-8", "replace") for ids in batch["ids"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "text": texts})

    return encoded.select("doc_id", "ids").mapInPandas(run, "doc_id long, text string")


def round_trip(documents: DataFrame, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(doc_id, same): whether decoding the ids gives the text back; null counts as ''."""
    back = decode(encode(documents, name, folder), name, folder).withColumnRenamed("text", "back")
    texts = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return texts.join(back, "doc_id").select("doc_id", (F.col("text") == F.col("back")).alias("same"))
