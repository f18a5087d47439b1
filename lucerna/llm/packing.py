"""Problem 8: put documents, measured in tokens, into containers of fixed capacity.

Items are dealt by hash into groups of bounded size; within a group bin completion fills the container of
the largest item left with undominated sets of further items and backtracks, pruned by the waste that the
incumbent leaves, until no fewer containers can do or ``STEPS`` fillings are looked at.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lucerna.llm.encoding import TOKENIZERS, token_counts
from lucerna.plans.runtime import materialize

CAPACITY = 4096
GROUP = 2000
#: Fillings looked at in a group before its incumbent is taken as it is.
STEPS = 3000


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Positions by container: items from large to small, each into the fullest container that takes it."""
    bins: list[list[int]] = []
    room: list[tuple[int, int]] = []  # (free space, container), sorted
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        at = bisect_left(room, (sizes[i], -1))
        if at < len(room):
            free, b = room.pop(at)
        else:
            free, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        if free > sizes[i]:
            insort(room, (free - sizes[i], b))
    return bins


def dominated(chosen: list[int], others: int, slack: int) -> bool:
    """Whether one of the ``others`` (a bit for each size left out) could replace some of the chosen sizes.

    A filling is dominated if a single larger item, or one as large as two or more of the chosen together, fits
    in their place: what it frees fits wherever that item would have gone.
    """
    one = two = 0  # sums of at least one, and of at least two of the chosen
    for size in chosen:
        two |= (two | one) << size
        one |= (one | 1) << size
    return bool(others & two) or any(others & ((one | 1) << k) for k in range(1, slack + 1))


def fillings(free: int, left: list[int], most_waste: int) -> Iterator[list[int] | None]:
    """Undominated sets of indices into the ascending sizes ``left`` that leave at most ``most_waste`` of ``free``.

    Those without waste come first, then the others; in each part larger items are taken first. The sums that the
    i smallest items can make are kept as bits, so the search never enters a branch without a filling. None
    stands for a dominated one that was skipped, so that the caller can count the work.
    """
    mask = (1 << (free + 1)) - 1
    sums = [1]
    for size in left:
        sums.append((sums[-1] | sums[-1] << size) & mask)
    for low, high in ((0, 0), (1, min(most_waste, free))):
        if low > high:
            return
        window = (1 << (high - low + 1)) - 1
        stack = [[len(left), free, (), 0]]  # items still open, room, chosen, last size tried
        while stack:
            frame = stack[-1]
            hi, room, chosen, last = frame
            if not last and low <= room <= high:
                taken = set(chosen)
                others = 0
                for size in {size for i, size in enumerate(left) if i not in taken}:
                    others |= 1 << size
                yield None if dominated([left[i] for i in chosen], others, room) else list(chosen)
            for i in range(min(hi, bisect_right(left, room)) - 1, -1, -1):
                rest = room - left[i]
                open_ = window if rest >= high else (1 << max(rest - low + 1, 0)) - 1
                if left[i] != last and (sums[i] >> max(rest - high, 0)) & open_:
                    frame[0], frame[3] = i, left[i]
                    stack.append([i, rest, (*chosen, i), 0])
                    break
            else:
                stack.pop()


def complete(sizes: list[int], capacity: int, steps: int = STEPS) -> tuple[list[list[int]], bool]:
    """Positions by container, and whether fewer containers are proven impossible. Sizes must be within 1..capacity.

    Best fit decreasing is the first incumbent. The search fills the container of the largest item left with one
    undominated filling after the other; a branch ends where the waste so far costs as many containers as the
    incumbent has. ``steps`` fillings are looked at in all, the only bound of the search; the incumbent stays if
    they run out.
    """
    best = best_fit(sizes, capacity)
    total = sum(sizes)
    floor = -(-total // capacity)
    order = sorted(range(len(sizes)), key=lambda i: (sizes[i], i))
    path: list[tuple[list[int], list[int], Iterator, int, int]] = []  # (items left, container, its fillings, largest, waste before)

    def enter(items: list[int], waste: int) -> None:
        largest, rest = items[-1], items[:-1]
        allowed = (len(best) - 1) * capacity - total - waste
        path.append((rest, [], fillings(capacity - sizes[largest], [sizes[i] for i in rest], allowed) if allowed >= 0 else iter(()), largest, waste))

    if len(best) > floor:
        enter(order, 0)
    while path and len(best) > floor and steps > 0:
        rest, _, more, largest, waste = path[-1]
        chosen = next(more, False)
        steps -= 1
        if chosen is False:
            path.pop()
        elif chosen is not None:
            taken = set(chosen)
            container = [largest, *(rest[k] for k in chosen)]
            left = [i for k, i in enumerate(rest) if k not in taken]
            waste += capacity - sum(sizes[i] for i in container)
            path[-1] = (rest, container, more, largest, path[-1][4])
            if waste > (len(best) - 1) * capacity - total:
                continue
            if left:
                enter(left, waste)
            else:
                best = [p[1] for p in path]
    return best, len(best) <= floor or not path


def packed(documents: DataFrame, capacity: int = CAPACITY, name: str = "byte_bpe_50k", folder: str = TOKENIZERS, group: int = GROUP) -> DataFrame:
    """(doc_id, piece, pieces, tokens, container, deal, proven): ``pack`` with the group of a packed piece and
    whether the group's number of containers is proven least; both null for pieces with a container of their own."""
    counts = materialize(token_counts(documents, name, folder))
    full = F.floor(F.col("tokens") / capacity)
    rest = F.col("tokens") % capacity
    n = F.greatest(F.ceil(F.col("tokens") / capacity), F.lit(1))
    parts = counts.withColumn("pieces", n.cast("int")).withColumn("piece", F.explode(F.sequence(F.lit(1), F.col("pieces"))))
    parts = parts.withColumn("tokens", F.when(F.col("piece") <= full, F.lit(capacity)).otherwise(rest).cast("long"))
    whole = parts.filter((F.col("tokens") == capacity) | (F.col("tokens") == 0)).withColumn(
        "container", F.when(F.col("tokens") > 0, F.concat_ws("-", F.lit("d"), "doc_id", "piece")))
    whole = whole.withColumn("deal", F.lit(None).cast("int")).withColumn("proven", F.lit(None).cast("boolean"))
    loose = parts.filter((F.col("tokens") > 0) & (F.col("tokens") < capacity))
    groups = max(1, -(-loose.count() // group))
    loose = loose.withColumn("deal", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(groups)).cast("int"))
    columns = ["doc_id", "piece", "pieces", "tokens", "container", "deal", "proven"]

    def fill(key: tuple, items: pd.DataFrame) -> pd.DataFrame:
        items = items.sort_values(["tokens", "doc_id", "piece"], ignore_index=True)  # the same at every run
        bins, proven = complete(items["tokens"].astype(int).tolist(), capacity)
        of = {i: k for k, members in enumerate(bins) for i in members}
        return items.assign(container=[f"g-{key[0]}-{of[i]}" for i in range(len(items))], proven=proven)[columns]

    filled = loose.groupBy("deal").applyInPandas(fill, "doc_id long, piece int, pieces int, tokens long, container string, deal int, proven boolean")
    return whole.select(*columns).unionByName(filled)


def pack(documents: DataFrame, **options) -> DataFrame:
    """(doc_id, piece, pieces, tokens, container): where each piece of a document lies.

    A document within the capacity is one piece; a longer one is split into full pieces, each a container of
    its own, and a rest that is packed. Null and empty texts have one piece of 0 tokens and no container.
    """
    return packed(documents, **options).drop("deal", "proven")


def found(documents: DataFrame, **options) -> DataFrame:
    """p8_found: (doc_id) of the documents that no single container holds."""
    return pack(documents, **options).filter("pieces > 1 and piece = 1").select("doc_id")


def containers(documents: DataFrame, **options) -> DataFrame:
    """(container, items, used) of every container."""
    return pack(documents, **options).filter("container is not null").groupBy("container").agg(F.count("*").alias("items"), F.sum("tokens").alias("used"))


def waste(documents: DataFrame, capacity: int = CAPACITY, **options) -> DataFrame:
    """One row (containers, tokens, least, waste, groups, proven): least is the bound below which no packing can
    go, proven the number of groups whose containers are proven to be as few as can be."""
    rows = packed(documents, capacity=capacity, **options).filter("container is not null")
    bins = rows.groupBy("container").agg(F.sum("tokens").alias("used"), F.max("deal").alias("deal"), F.bool_and("proven").alias("proven"))
    deals = bins.groupBy("deal").agg(F.count("*").alias("n"), F.sum("used").alias("used"), F.bool_and("proven").alias("proven"))
    total = deals.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("containers"), F.coalesce(F.sum("used"), F.lit(0)).alias("tokens"), F.count("deal").alias("groups"), F.count_if("proven").alias("proven"))
    return total.select("containers", "tokens", F.ceil(F.col("tokens") / capacity).alias("least"),
                        (1 - F.col("tokens") / F.greatest(F.col("containers") * capacity, F.lit(1))).alias("waste"), "groups", "proven")
