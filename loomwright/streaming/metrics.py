"""Evaluation metrics as aggregates: over all rows, over sliding windows of samples, and over streams.

States are sums, so that a metric is one aggregation for all tasks together; streams keep the same sums.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources.tables import materialize

ETA = 1e-12


def _div(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a / F.when(b != 0, b))


def states(p: Column, y: Column, w: Column, eta: float = ETA) -> dict[str, Column]:
    """Per-row terms whose sums give every summable metric."""
    p, y, w = p.cast("double"), y.cast("double"), w.cast("double")
    c = F.greatest(F.lit(eta), F.least(F.lit(1 - eta), p))
    return {
        "cross_entropy": -w * (y * F.log2(c) + (1 - y) * F.log2(1 - c)), "weight": w, "pos": w * y, "neg": w * (1 - y),
        "pred": w * p, "square": w * (p - y) * (p - y), "absolute": w * F.abs(p - y), "n": F.lit(1).cast("bigint"),
    }


def finish(eta: float = ETA) -> dict[str, Column]:
    """Metrics from the sums of states."""
    s = {k: F.col(f"s_{k}") for k in ("cross_entropy", "weight", "pos", "neg", "pred", "square", "absolute", "n")}
    mean = F.greatest(F.lit(eta), F.least(F.lit(1 - eta), _div(s["pos"], s["weight"])))
    base = -(s["pos"] * F.log2(mean) + s["neg"] * F.log2(1 - mean))
    mse = _div(s["square"], s["weight"])
    return {
        "ne": _div(s["cross_entropy"], base), "logloss": _div(s["cross_entropy"], s["weight"]), "ctr": _div(s["pos"], s["weight"]),
        "calibration": _div(s["pred"], s["pos"]), "mse": mse, "rmse": F.sqrt(mse), "mae": _div(s["absolute"], s["weight"]), "examples": s["n"],
    }


def metrics(df: DataFrame, by: Sequence, p: str = "prediction", y: str = "label", w: str = "weight", names: Sequence[str] | None = None) -> DataFrame:
    """Metrics per group in one aggregation; works on streams as well, `by` then being windows."""
    terms = states(F.col(p), F.col(y), F.col(w))
    sums = df.groupBy(*by).agg(*[F.sum(t).alias(f"s_{k}") for k, t in terms.items()])
    done = finish()
    keys = [c for c in sums.columns if not c.startswith("s_")]
    return sums.select(*keys, *[done[n].alias(n) for n in (names or done)])


def window_metrics(df: DataFrame, task: str, batch: str, window_samples: int, p: str = "prediction", y: str = "label", w: str = "weight") -> DataFrame:
    """Metrics at each batch over the last whole batches that hold at most so many samples, and over all before.

    Rows become one row of sums per batch first; the window walks over those.
    """
    terms = states(F.col(p), F.col(y), F.col(w))
    per = df.groupBy(task, batch).agg(*[F.sum(t).alias(f"b_{k}") for k, t in terms.items()])
    life = W.partitionBy(task).orderBy(batch).rowsBetween(W.unboundedPreceding, W.currentRow)
    run = per.withColumns({f"l_{k}": F.sum(f"b_{k}").over(life) for k in terms})
    # what the window leaves out are the first batches, up to the last that begins before the window's samples do:
    # the one behind the last batch that ends there. Its running sums are subtracted.
    sums = F.struct(*[F.col(f"l_{k}").alias(k) for k in terms])
    in_order = W.partitionBy(task).orderBy(batch)
    run = run.withColumns({"_next": F.lead(sums).over(in_order), "_first": F.first(sums).over(life)})
    ended = W.partitionBy(task).orderBy("l_n").rangeBetween(W.unboundedPreceding, -(window_samples + 1))
    run = run.withColumn("_gone", F.coalesce(F.last("_next").over(ended), F.when(F.col("l_n") > window_samples, F.col("_first"))))
    run = run.withColumns({f"w_{k}": F.col(f"l_{k}") - F.coalesce(F.col("_gone").getField(k), F.lit(0)) for k in terms})
    out = run.select(task, batch, *[F.col(f"l_{k}").alias(f"s_{k}") for k in terms], *[f"w_{k}" for k in terms])
    done = finish()
    life_cols = [done[n].alias(f"lifetime_{n}") for n in done]
    step = out.select(task, batch, *life_cols, *[F.col(f"w_{k}").alias(f"s_{k}") for k in terms])
    return step.select(task, batch, *[f"lifetime_{n}" for n in done], *[done[n].alias(f"window_{n}") for n in done])


def auc(df: DataFrame, task: str, p: str = "prediction", y: str = "label", w: str = "weight", tie: Sequence[str] = ()) -> DataFrame:
    """Weighted area under the curve per task, by trapezoids in descending order of prediction; 0.5 if one class is missing.

    Ties go by the tie columns, as rows that tie make steps of their own. Rows are sorted over ranges, of
    about equal size whatever the predictions are, and written down; then come sums per range, and the order
    within each range, so that no task has a task's rows whole.
    """
    rows = df.select(F.col(task).alias("t"), F.col(p).cast("double").alias("p"), (F.col(w) * F.col(y)).cast("double").alias("tp"), (F.col(w) * (1 - F.col(y))).cast("double").alias("fp"), *tie)
    rows = materialize(rows.orderBy("t", F.desc("p"), *tie).withColumn("_b", F.spark_partition_id()), "auc-rows")
    per = rows.groupBy("t", "_b").agg(F.sum("tp").alias("btp"))
    after = W.partitionBy("t").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    above = per.select(F.col("t").alias("_t"), F.col("_b").alias("_bb"), F.coalesce(F.sum("btp").over(after), F.lit(0.0)).alias("above"))
    run = W.partitionBy("t", "_b").orderBy(F.desc("p"), *tie).rowsBetween(W.unboundedPreceding, W.currentRow)
    inside = rows.withColumn("_c", F.sum("tp").over(run))
    joined = inside.join(above, inside["t"].eqNullSafe(F.col("_t")) & (inside["_b"] == F.col("_bb")))
    area = joined.withColumn("area", F.col("fp") * (F.col("above") + F.col("_c") - F.col("tp") / 2))
    total = area.groupBy("t").agg(F.sum("area").alias("a"), F.sum("tp").alias("tp"), F.sum("fp").alias("fp"))
    value = F.when((F.col("tp") == 0) | (F.col("fp") == 0), F.lit(0.5)).otherwise(F.col("a") / F.when(F.col("tp") * F.col("fp") != 0, F.col("tp") * F.col("fp")))
    return total.select(F.col("t").alias(task), value.alias("auc"))


def multiclass_recall(scores, label, k: int) -> Column:
    """1.0 where the label's score is among the k greatest; ties count for the label."""
    s = F.col(scores) if isinstance(scores, str) else scores
    y = F.col(label) if isinstance(label, str) else label
    mine = F.get(s, y.cast("int"))
    return (F.size(F.filter(s, lambda x: x > mine)) < k).cast("double")


def throughput(df: DataFrame, ts: str, window: str, warmup: int = 0, order: str | None = None) -> DataFrame:
    """Examples and examples per second by time window, without the first `warmup` windows; works on streams without warm-up."""
    w = F.window(ts, window)
    counts = df.groupBy(w.alias("w")).agg(F.count(F.lit(1)).alias("examples"))
    seconds = F.unix_timestamp("w.end") - F.unix_timestamp("w.start")
    out = counts.select(F.col("w.start").alias("start"), "examples", (F.col("examples") / seconds).alias("per_second"))
    if warmup:
        out = out.withColumn("_i", F.row_number().over(W.orderBy("start"))).where(F.col("_i") > warmup).drop("_i")
    return out


def stream_metrics(stream: DataFrame, ts: str, window: str, delay: str, by: Sequence[str] = (), **columns) -> DataFrame:
    """Metrics of a stream by event-time window, late rows being dropped after the delay."""
    return metrics(stream.withWatermark(ts, delay), [F.window(ts, window).alias("window"), *by], **columns)


# --- id transformer -------------------------------------------------------------------------------


def first_come_slots(df: DataFrame, ident: str, order: Sequence[str], slots: int) -> DataFrame:
    """(ident, slot): ids in order of first appearance get slots 0, 1, ...; past the last slot null.

    First appearances are reduced on the map side; only the first `slots` of them are ranked.
    """
    first = df.groupBy(ident).agg(F.min(F.struct(*order)).alias("_first"))
    top = first.orderBy("_first", ident).limit(slots)
    numbered = top.withColumn("slot", F.row_number().over(W.orderBy("_first", ident)) - 1).select(ident, "slot")
    return first.select(ident).join(numbered, ident, "left")


def eviction_order(df: DataFrame, ident: str, time: str) -> DataFrame:
    """Ids in the order in which mixed LFU/LRU eviction drops them: least log2 of uses, then oldest use."""
    uses = df.groupBy(ident).agg(F.count(F.lit(1)).alias("uses"), F.max(time).alias("last"))
    scored = uses.withColumn("frequency", F.floor(F.log2("uses")).cast("int"))
    return scored.orderBy("frequency", "last", ident)


def stream_slots(stream: DataFrame, ident: str, slots: int, group: str):
    """A stream's ids to cache slots, with state per group: first come, then the mixed LFU/LRU rule evicts."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    def step(key, frames, state):
        held = {k: list(v) for k, v in zip(*state.get)} if state.exists else {}
        clock = max((v[2] for v in held.values()), default=0)
        # entries of the heap are dropped late: one counts only while it is its id's present rank
        rank = lambda i: (held[i][1].bit_length(), held[i][2], i)
        heap = [rank(i) for i in held]
        heapq.heapify(heap)
        for pdf in frames:
            out = []
            for i in pdf[ident].tolist():
                clock += 1
                if i in held:
                    held[i][1:] = [held[i][1] + 1, clock]
                elif len(held) < slots:
                    held[i] = [len(held), 1, clock]
                else:
                    while heap[0][2] not in held or heap[0] != rank(heap[0][2]):
                        heapq.heappop(heap)
                    gone = heapq.heappop(heap)[2]
                    held[i] = [held.pop(gone)[0], 1, clock]
                heapq.heappush(heap, rank(i))
                if len(heap) > 4 * slots + 64:
                    heap = [rank(k) for k in held]
                    heapq.heapify(heap)
                out.append(held[i][0])
            yield pd.DataFrame({group: key[0], ident: pdf[ident], "slot": out})
        state.update((list(held), [list(v) for v in held.values()]))

    return stream.groupBy(group).applyInPandasWithState(step, f"{group} string, {ident} long, slot long", "ids array<long>, facts array<array<long>>", "append", GroupStateTimeout.NoTimeout)
