"""Problem 6: filling containers of fixed capacity with documents, by sum-of-squares packing.

Each document is placed into the fill level that keeps the sum of the squared numbers of partly filled containers per
level smallest; the numbers are kept in a level array.  A document goes in pieces only if it alone exceeds the capacity:
whole containers are cut off it, and what is left over is an item like any other.

Sum-of-squares packing is an online method: it takes items as they come.  Here a block's items are known beforehand and are
placed in descending order of size, which leaves less room unused; with ordered=False they are placed as they come.

Documents are dealt by hash to blocks of about BLOCK_ITEMS, each packed by one task with a level array of its own, so a
task's memory and time are bounded at any corpus size.  What a block leaves open is at most a few containers per level
in use, so blocks of this size cost well under one per cent of room (measured in the README).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import tokenizer

#: Items per block; a block is packed by one task.
BLOCK_ITEMS = 20_000
MAX_PARTITIONS = 8_192
#: Capacities that one call may name (they are a parameter list, held on the driver).
MAX_CAPACITIES = 1_000


def place(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container number of each item, in the order given; every size must lie in 1..capacity."""
    level = np.zeros(capacity + 1, np.int64)  # open containers of each fill; the last entry stays 0
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    where = np.empty(len(sizes), np.int64)
    used = 0
    for i, s in enumerate(sizes.tolist()):
        fits = np.flatnonzero(level[1 : capacity - s + 1]) + 1
        best = -1
        if len(fits):
            # Change of the sum of squares: one container leaves level h and one comes to level h + s; a full one leaves for good.
            change = 2 * (level[fits + s] - level[fits]) + 2
            change -= np.where(fits + s == capacity, 1, 0)
            k = int(change.argmin())
            if s == capacity or change[k] <= 2 * level[s] + 1:
                best = int(fits[k])
        if best < 0:
            container, used, best = used, used + 1, 0
        else:
            container = open_at[best].pop()
            level[best] -= 1
        if best + s < capacity:
            level[best + s] += 1
            open_at[best + s].append(container)
        where[i] = container
    return where


def pack(sizes: DataFrame, capacities: list[int], key: str = "doc_id", size: str = "n_tokens", items_about: int | None = None, ordered: bool = True) -> DataFrame:
    """Containers for items: (capacity_tokens, container_id, key, piece_no, token_start, n_tokens).

    One row per piece; an item that fits has one piece (piece_no 0).  Items of null or no size are left out by definition:
    they take no room.  Repeated rows are separate items.  An empty table gives no rows; other columns are not read.
    Within a block items are placed in descending order of size, equal sizes in order of key; with ordered=False in an order
    drawn at random from the block's number.  Rows are dealt to blocks by their key and their place in the input, so that a key that very many
    rows have is spread over the blocks.  items_about, the number of rows if it is known, saves counting them.
    """
    if not capacities or len(capacities) > MAX_CAPACITIES or min(capacities) < 1:
        raise ValueError(f"1 to {MAX_CAPACITIES} positive capacities are needed")
    items = sizes.select(F.col(key).alias("_key"), F.col(size).cast("long").alias("_size")).where(F.col(size) > 0)
    blocks = max(1, -(-(sizes.count() if items_about is None else items_about) // BLOCK_ITEMS))
    kind = sizes.schema[key].dataType.simpleString()
    cap = F.col("capacity_tokens")
    dealt = items.withColumn("_block", F.pmod(F.xxhash64("_key", F.monotonically_increasing_id()), F.lit(blocks))).withColumn(
        "capacity_tokens", F.explode(F.array(*[F.lit(int(c)) for c in sorted(set(capacities))]))
    )

    def run(of, rows):
        capacity, block = int(of[0]), int(of[1])
        rows = rows.sort_values(["_size", "_key"], ascending=[False, True], kind="stable")
        if not ordered:
            rows = rows.sample(frac=1, random_state=block)
        size_of = rows["_size"].to_numpy(np.int64)
        whole = np.where(size_of > capacity, size_of // capacity, 0)  # containers filled by one document alone
        rest = size_of - whole * capacity
        order = np.flatnonzero(rest)
        if ordered:
            order = order[np.argsort(-rest[order], kind="stable")]
        number = np.empty(len(rows), np.int64)
        number[order] = place(rest[order], capacity)
        base = int(number[order].max()) + 1 if len(order) else 0
        first = np.repeat(np.arange(len(rows)), whole)
        piece = np.arange(len(first)) - np.repeat(np.cumsum(whole) - whole, whole)
        own = pd.DataFrame({"i": first, "c": base + np.arange(len(first)), "piece_no": piece, "token_start": piece * capacity, "n_tokens": capacity})
        left = pd.DataFrame({"i": order, "c": number[order], "piece_no": whole[order], "token_start": whole[order] * capacity, "n_tokens": rest[order]})
        out = pd.concat([own, left], ignore_index=True)
        return pd.DataFrame(
            {
                "capacity_tokens": capacity,
                "container_id": (block << 32) + out["c"],
                key: rows["_key"].to_numpy()[out["i"].to_numpy(np.int64)],
                "piece_no": out["piece_no"],
                "token_start": out["token_start"],
                "n_tokens": out["n_tokens"],
            }
        )

    # As many partitions as there are groups, up to MAX_PARTITIONS: packing takes time, not bytes, so they are not merged.
    dealt = dealt.repartition(min(blocks * len(set(capacities)), MAX_PARTITIONS), cap, "_block")
    schema = f"capacity_tokens int, container_id bigint, {key} {kind}, piece_no int, token_start bigint, n_tokens bigint"
    return dealt.groupBy(cap, "_block").applyInPandas(run, schema)


def pack_documents(documents: DataFrame, limits: DataFrame, path: str | None = None) -> DataFrame:
    """pack() of documents by their size in tokens, for each capacity of the limits table (at most MAX_CAPACITIES rows)."""
    rows = limits.select("capacity_tokens").where("capacity_tokens > 0").distinct().limit(MAX_CAPACITIES + 1).collect()
    return pack(tokenizer.sizes(documents, path=path), [r[0] for r in rows], items_about=documents.count())


def fill(packed: DataFrame) -> DataFrame:
    """Per capacity: containers, the least possible number by volume, and the share of room used."""
    volume = F.sum("n_tokens")
    return packed.groupBy("capacity_tokens").agg(
        F.countDistinct("container_id").alias("containers"),
        F.ceil(volume / F.first("capacity_tokens")).alias("at_least"),
        (volume / (F.countDistinct("container_id") * F.first("capacity_tokens"))).alias("used_share"),
    )
