"""Filling fixed-capacity containers: vector bin packing with the dot-product heuristic.

An item has three demands: tokens, one segment, and loss-bearing tokens (the tokens of a reply outside quoted
lines; opening posts are prompts and bear no loss). A container limits all three at once. In each step the open
container takes the item that fits and has the largest dot product of its demands with what is left; it closes when
nothing fits. Items are dealt by hash into blocks of bounded size that are packed independently, so no task sees
more than a block whatever the number of items; only the last containers of a block are underfull.

Defined results: an item above the capacity is split into pieces of exactly the capacity and one remainder, which is
packed like an item; no other item is split. Empty texts are items of no tokens. An item whose loss alone exceeds
the loss limit gets a container of its own. Equal scores take the item first in hash order. Empty input gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.llm.tokens import TOKENIZER, token_counter

SCHEMA = "container long, doc_id long, piece int, pieces int, first_token int, tokens int, loss_tokens int"


def pack_block(demand: np.ndarray, limit: np.ndarray) -> list[list[int]]:
    """Containers as lists of item numbers. demand: items x dimensions, all at most limit or alone in a container."""
    d = demand / limit
    left = np.arange(len(d))
    out: list[list[int]] = []
    while len(left):
        room, own = np.ones(d.shape[1]), []
        v = d[left]
        free = np.ones(len(left), dtype=bool)
        fits = free & (v <= room + 1e-12).all(1)
        if not fits.any():
            own, fits = [0], fits
            free[0] = False
        while fits.any():
            score = np.where(fits, v @ np.maximum(room, 1e-9), -1.0)
            i = int(score.argmax())
            own.append(i)
            free[i] = False
            room = room - v[i]
            fits = fits & free & (v <= room + 1e-12).all(1)
        out.append(left[own].tolist())
        left = left[free]
    return out


def measured(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, tokens, loss_tokens) of documents(doc_id, parent_id, text)."""
    count = token_counter(tokenizer)
    quoted = F.col("text").rlike(r"(?m)^\s*>")
    own = F.when(quoted, F.regexp_replace("text", r"(?m)^\s*>.*$", ""))
    m = docs.select("doc_id", "parent_id", count("text").alias("tokens"), quoted.alias("quoted"), count(own).alias("own_tokens"))
    loss = F.when(F.col("parent_id").isNull(), 0).when(F.col("quoted"), F.least("own_tokens", "tokens")).otherwise(F.col("tokens"))
    return m.select("doc_id", "tokens", loss.cast("int").alias("loss_tokens"))


def packed(items: DataFrame, n_items: int, capacity: int = 1024, max_segments: int = 32, max_loss: int | None = None, block_items: int = 4096) -> DataFrame:
    """One row per piece: container, doc_id, piece, pieces, first_token, tokens, loss_tokens.

    n_items sizes the blocks; a block wastes at most the room of its last few containers. max_loss defaults to three
    quarters of the capacity: it keeps containers from being all reply or all prompt.
    """
    limit = np.array([capacity, max_segments, max_loss or capacity * 3 // 4], dtype=float)
    blocks = max(1, math.ceil(n_items / block_items))
    block: Column = F.pmod(F.xxhash64("doc_id"), F.lit(blocks))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        base = int(pdf["block"].iloc[0]) << 32
        pdf = pdf.sort_values("h", kind="stable")
        rows, small, n = [], [], 0
        for doc, tokens, loss in zip(pdf["doc_id"].tolist(), pdf["tokens"].tolist(), pdf["loss_tokens"].tolist(), strict=True):
            pieces = max(1, -(-tokens // capacity))
            for p in range(pieces):
                size = min(capacity, tokens - p * capacity)
                part = loss * (p + 1) // pieces - loss * p // pieces if pieces > 1 else loss
                row = (doc, p, pieces, p * capacity, size, min(part, size))
                if pieces > 1 and size == capacity:
                    rows.append((base + n, *row))
                    n += 1
                else:
                    small.append(row)
        if small:
            demand = np.array([(r[4], 1, r[5]) for r in small], dtype=float)
            for own in pack_block(demand, limit):
                rows += [(base + n, *small[i]) for i in own]
                n += 1
        return pd.DataFrame(rows, columns=["container", "doc_id", "piece", "pieces", "first_token", "tokens", "loss_tokens"])

    keyed = items.withColumn("block", block).withColumn("h", F.xxhash64("doc_id", F.lit(1)))
    return keyed.groupBy("block").applyInPandas(run, SCHEMA)


def packing_report(rows: DataFrame, capacity: int = 1024) -> DataFrame:
    """One row: containers, pieces, tokens, share of space unused, split documents, most segments."""
    per = rows.groupBy("container").agg(F.sum("tokens").alias("t"), F.count("*").alias("n"), F.count_if((F.col("pieces") > 1) & (F.col("piece") == 0)).alias("split"))
    return per.agg(
        F.count("*").alias("containers"), F.sum("n").alias("pieces"), F.sum("t").alias("tokens"),
        F.round(1 - F.sum("t") / (F.count("*") * capacity), 6).alias("unused_share"), F.sum("split").alias("split_documents"), F.max("n").alias("most_segments"),
    )
