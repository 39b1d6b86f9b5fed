"""Mixing sources to target weights with a low-discrepancy schedule.

Every source is a shuffled stream of its documents, repeated at most max_repeats times (each pass in another order)
and cut into blocks of equal tokens. The mixture has one slot a block. Slot m gets the golden-ratio point m phi mod 1;
the points, by their rank, are mapped through the cumulative block counts of the sources, so a source gets exactly as many
slots as it has blocks, and its k-th slot takes its k-th block. The schedule is even at every prefix. Nothing is kept on
the driver but three numbers: running token counts, point ranks and slot ranks come from the range-partitioned running
sum of the core library, and a rank finds its source by an equi-join on chunks of ranks.

A source contributes whole documents until its target is reached: it exceeds the target by less than one document, and
reaches it whenever max_repeats x its tokens suffice. Whether a target is met is read off the scheduled documents.

Defined results: sources without a target are left out (their tokens count for T); targets without documents are reported
as unmet; null or empty texts have no tokens but are scheduled; ties in the shuffle are broken by doc_id; without any
tokens nothing is scheduled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.operators.balanced import balanced_running
from flowloom.session import checkpointed

GOLDEN = 0.6180339887498949


def source_plan(items: DataFrame, targets: DataFrame, block_tokens: int = 4096) -> DataFrame:
    """Per target source: tokens, available (with repeats), target_tokens, take, blocks; T is the tokens of all items."""
    have = items.groupBy("source").agg(F.sum("tokens").cast("long").alias("tokens"), F.count("*").alias("docs"))
    total = have.agg(F.coalesce(F.sum("tokens"), F.lit(0))).scalar()
    p = targets.join(have, "source", "left").fillna(0, ["tokens", "docs"])
    p = p.withColumn("target_tokens", F.col("target_weight") * total).withColumn("available", F.col("max_repeats") * F.col("tokens"))
    p = p.withColumn("take", F.least(F.col("target_tokens"), F.col("available").cast("double")))
    return p.withColumn("blocks", F.ceil(F.ceil("take") / block_tokens).cast("long"))


def slots(plan: DataFrame, chunk: int = 4096) -> DataFrame:
    """(slot, source, block): every block of every source once, in golden-ratio order. plan: source, blocks."""
    spark = plan.sparkSession
    used = plan.where("blocks > 0").select("source", "blocks").withColumn("__all", F.lit(0))
    spans = balanced_running(used, ["__all"], ["source"], F.col("blocks"), out="hi").withColumn("lo", F.col("hi") - F.col("blocks"))
    need = plan.agg(F.sum("blocks")).first()[0] or 0
    points = spark.range(need).select(F.col("id").alias("slot"), (F.col("id") * F.lit(GOLDEN) % 1.0).alias("u"), F.lit(0).alias("__all"))
    ranked = balanced_running(points, ["__all"], ["u", "slot"], out="r").select("slot", (F.col("r") - 1).alias("r"))
    ranked = ranked.withColumn("chunk", F.floor(F.col("r") / chunk))
    spans = spans.select("source", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / chunk), F.floor((F.col("hi") - 1) / chunk))).alias("chunk"))
    # read several times by the ranks, so the first ranks are computed once; one short row a block
    mapped = checkpointed(ranked.join(spans, "chunk").where("r >= lo and r < hi").select("slot", "source"))
    return balanced_running(mapped, ["source"], ["slot"], out="rank").select("slot", "source", (F.col("rank") - 1).alias("block"))


def mixture(items: DataFrame, targets: DataFrame, block_tokens: int = 4096, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """The schedule (slot, source, block, repeat, doc_id, tokens) and the plan.

    items: doc_id, source, tokens; targets: source, target_weight, max_repeats, one row a source.
    """
    plan = checkpointed(source_plan(items, targets, block_tokens))
    kept = plan.where("take > 0").select("source", F.col("take").alias("__take"), F.ceil(F.col("take") / F.col("tokens")).cast("int").alias("__passes"))
    s = items.join(kept, "source").withColumn("repeat", F.explode(F.sequence(F.lit(0), F.col("__passes") - 1)))
    s = s.withColumn("h", F.xxhash64("doc_id", "repeat", F.lit(seed))).select("source", "repeat", "h", "doc_id", "tokens", "__take")
    s = balanced_running(s, ["source"], ["repeat", "h", "doc_id"], F.col("tokens").cast("long"), out="start", exclusive=True)
    s = s.where(F.col("start") < F.col("__take")).withColumn("block", F.floor(F.col("start") / block_tokens).cast("long"))
    return s.join(slots(plan), ["source", "block"]).select("slot", "source", "block", "repeat", "doc_id", "tokens"), plan


def mixture_report(schedule: DataFrame, plan: DataFrame) -> DataFrame:
    """Per source: target and actual shares, most uses of a document, and whether the scheduled documents reach the target.

    actual_share is of the scheduled tokens, share_of_total of T: where sources fall short, the first exceeds the second.
    """
    got = schedule.groupBy("source").agg(F.sum("tokens").cast("long").alias("__got"), F.max("repeat").alias("__r"))
    total = got.agg(F.sum("__got")).scalar()
    scheduled = F.coalesce("__got", F.lit(0).cast("long"))
    return plan.join(got, "source", "left").select(
        "source", "target_weight", F.col("tokens").alias("source_tokens"), scheduled.alias("scheduled_tokens"),
        F.round(scheduled / total, 6).alias("actual_share"), F.round(F.try_divide(scheduled * F.col("target_weight"), F.col("target_tokens")), 6).alias("share_of_total"),
        (F.coalesce("__r", F.lit(-1)) + 1).alias("uses"), "max_repeats", (scheduled >= F.col("target_tokens")).alias("met"),
    )
