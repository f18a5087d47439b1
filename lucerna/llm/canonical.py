"""Problem 1: map freely typed values to the entries of a reference list.

The entries, their aliases and the rotations of their words are paths of one trie. A Levenshtein automaton
of the typed value (one bit set of positions for each number of errors) walks the trie and returns every
entry within a distance that depends on the value's length.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lucerna.plans.runtime import materialize, salted_join, task_count

#: Letters of other scripts that look like Latin ones, and digits typed for letters.
LOOKALIKES = str.maketrans("аеорсухіѕјкмтнвԁԛԝһӏɡοαερνι", "aeopcyxisjkmthbdqwhlgoaepvi")
DIGITS = str.maketrans("0135", "oles")
#: Words people put around a topic that name no topic.
FILLERS = frozenset("the a an my wip shader shaders effect effects demo fx 2d 3d glsl test style example".split())
WORD = re.compile(r"[^\W_]+")
GONE = dict.fromkeys((0xAD, 0x200C, 0x200D, 0x2060, 0xFEFF, 0x34F))


def allowed(length: int) -> int:
    """Greatest edit distance for a value of this many letters."""
    return 0 if length <= 3 else 1 if length <= 5 else 2 if length <= 9 else 3


def folded(text: str) -> str:
    """NFKC, look-alike letters, no accents, no invisible marks, lower case."""
    text = unicodedata.normalize("NFKC", text).translate(GONE).replace("\u200b", " ").casefold().translate(LOOKALIKES)
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def words(text: str) -> list[str]:
    return [w.translate(DIGITS) if w not in FILLERS and not w.isdigit() and any(c.isalpha() for c in w) else w for w in WORD.findall(folded(text))]


class Trie:
    """Nodes are dicts of child nodes; key '' holds {topic_key: 1 if only with turned words, else 0} of the
    entries that end at a node. Turned words must match one edit closer."""

    def __init__(self, entries: Iterable[tuple[str, str]]):
        self.root: dict = {}
        for key, name in entries:
            parts = words(name)
            for i in range(max(1, len(parts))):
                node = self.root
                for c in "".join(parts[i:] + parts[:i]):
                    node = node.setdefault(c, {})
                ends = node.setdefault("", {})
                ends[key] = min(ends.get(key, 1), int(i > 0))

    def within(self, value: str, most: int) -> dict[str, int]:
        """Every topic_key with an entry at most ``most`` edits from ``value``, with its least distance."""
        n, found = len(value), {}
        at: dict[str, int] = {}
        for i, c in enumerate(value):
            at[c] = at.get(c, 0) | 1 << i
        accept = 1 << n
        # states[e]: positions reached with e errors
        start, reach = [], 0
        for e in range(most + 1):
            reach |= 1 << e
            start.append(reach & ((accept << 1) - 1))
        stack = [(self.root, start)]
        while stack:
            node, states = stack.pop()
            for c, child in node.items():
                if c == "":
                    for e, s in enumerate(states):
                        if s & accept:
                            for key, turned in child.items():
                                if e + turned <= max(most, 1):
                                    found[key] = min(e + turned, found.get(key, e + turned))
                            break
                    continue
                mask, nxt = at.get(c, 0), []
                for e, s in enumerate(states):
                    t = (s & mask) << 1
                    if e:
                        before = states[e - 1]
                        t |= before | before << 1 | nxt[e - 1] << 1
                    nxt.append(t & ((accept << 1) - 1))
                if any(nxt):
                    stack.append((child, nxt))
        return found

    def starting(self, prefix: str) -> set[str]:
        """Every topic_key with an entry that begins with ``prefix``."""
        node = self.root
        for c in prefix:
            node = node.get(c)
            if node is None:
                return set()
        keys, stack = set(), [node]
        while stack:
            for c, child in stack.pop().items():
                keys |= set(child) if c == "" else set()
                stack += [] if c == "" else [child]
        return keys


def meant(value: str, trie: Trie) -> str:
    """The topic_key meant by a typed value, '' if none or if two are equally near."""
    parts = words(value)
    core = [w for w in parts if w not in FILLERS]
    for form in dict.fromkeys(("".join(parts), "".join(core))):
        if not form:
            continue
        near = trie.within(form, allowed(len(form)))
        if near:
            best = min(near.values())
            keys = [k for k, d in near.items() if d == best]
            if len(keys) == 1:
                return keys[0]
    typed = value.strip()
    short = "".join(core)
    if typed.endswith(".") and not typed.endswith("..") and len(short) >= 5:
        keys = trie.starting(short)
        if len(keys) == 1:
            return next(iter(keys))
    return ""


def reference_entries(reference: DataFrame, key: str, name: str, aliases: str, most_entries: int = 100_000) -> list[tuple[str, str]]:
    """(key, name or alias) of the reference list; a list beyond ``most_entries`` names is refused."""
    rows = (
        reference.select(key, F.explode(F.concat(F.array(name), F.coalesce(F.col(aliases), F.array().cast("array<string>")))).alias("entry"))
        .filter(F.col("entry").isNotNull() & F.col(key).isNotNull())
        .limit(most_entries + 1)
        .collect()
    )
    if len(rows) > most_entries:
        raise ValueError(f"the reference list has more than {most_entries} names")
    return [(r[0], r[1]) for r in rows]


def map_values(values: DataFrame, reference: DataFrame, key: str = "topic_key", name: str = "topic_name", aliases: str = "aliases") -> DataFrame:
    """(raw_value, topic_key) for a DataFrame of distinct raw_value; topic_key is '' where nothing is meant.

    Null or blank values come out with ''. An empty reference list gives '' everywhere.
    """
    entries = reference_entries(reference, key, name, aliases)
    shared = values.sparkSession.sparkContext.broadcast(entries)

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trie = Trie(shared.value)
        for batch in batches:
            yield pd.DataFrame({"raw_value": batch["raw_value"], "topic_key": [meant(v, trie) if v else "" for v in batch["raw_value"]]})

    # matching is heavy on little data, so the rows are spread by number
    return values.select("raw_value").repartition(task_count(values.sparkSession)).mapInPandas(match, "raw_value string, topic_key string")


def typed_values(records: DataFrame, reference: DataFrame) -> DataFrame:
    """Distinct (shader_id, raw_value) of the three list columns that are no canonical name letter for letter.

    Null lists, null elements and elements of white space only give no row; so do rows without shader_id.
    """
    empty = F.array().cast("array<string>")
    lists = F.concat(*[F.coalesce(F.col(c), empty) for c in ("categories", "tags_raw", "tags_topic")])
    kept = F.filter(F.array_distinct(lists), lambda v: v.isNotNull() & ~v.rlike(r"^[\s\p{Z}\x{85}\x1c-\x1f]*$"))
    names = reference.filter(F.col("topic_name").isNotNull()).select(F.col("topic_name").alias("raw_value"))
    return (
        records.filter(F.col("shader_id").isNotNull())
        .select("shader_id", F.explode(kept).alias("raw_value"))
        .join(names, "raw_value", "left_anti")
        .select("shader_id", "raw_value")
        .distinct()
    )


def found(records: DataFrame, reference: DataFrame) -> DataFrame:
    """p1_found: (shader_id, raw_value, topic_key). Each distinct value is matched once and joined back salted."""
    typed = materialize(typed_values(records, reference))
    mapped = map_values(typed.select("raw_value").distinct(), reference)
    return salted_join(typed, mapped, "raw_value", "shader_id").select("shader_id", "raw_value", "topic_key")


def unmatched_report(records: DataFrame, reference: DataFrame) -> DataFrame:
    """(raw_value, records): values that mean no entry, with the number of shader_ids that have them."""
    return (
        found(records, reference).filter(F.col("topic_key") == "")
        .groupBy("raw_value").agg(F.count("*").alias("records"))
    )
