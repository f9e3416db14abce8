"""Batches for training: padding, packing and jagged forms as columns."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rec import col


def pad_sequence(a, length: int | Column, pad=0) -> Column:
    """The list filled up or cut to a length."""
    a, n = col(a), F.lit(length) if isinstance(length, int) else length
    kept = F.slice(a, F.lit(1), n)
    return F.concat(kept, F.array_repeat(F.lit(pad), n - F.size(kept)))


def dense(columns: Sequence[str], presence: bool = False) -> Column:
    """Columns as one float array, nulls as 0; with presence, a second array of 0 and 1."""
    values = F.array(*[F.coalesce(F.col(c).cast("float"), F.lit(0.0).cast("float")) for c in columns])
    if not presence:
        return values
    return F.struct(values.alias("values"), F.array(*[F.col(c).isNotNull().cast("float") for c in columns]).alias("presence"))


def jagged(df: DataFrame, features: Sequence[str], batch: str, order: str) -> DataFrame:
    """Per batch and feature: values laid end to end, lengths and offsets."""
    out = []
    for f in features:
        gathered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(f).alias("v"))))
        values = F.flatten(F.transform(gathered, lambda s: s["v"]))
        lengths = F.transform(gathered, lambda s: F.size(s["v"]))
        out += [values.alias(f"{f}_values"), lengths.alias(f"{f}_lengths")]
    return df.groupBy(batch).agg(*out)


def offsets(lengths) -> Column:
    """0 and the running sums of lengths."""
    a = col(lengths)
    start = F.array(F.lit(0))
    return F.aggregate(a, start, lambda s, n: F.concat(s, F.array(F.element_at(s, -1) + n)))


def keyed_jagged(df: DataFrame, keys: Sequence[str], weights: dict[str, str] | None = None) -> DataFrame:
    """A map from key to id list, and one of weights."""
    ids = F.create_map(*[x for k in keys for x in (F.lit(k), F.col(k))])
    out = df.withColumn("kjt", ids)
    if weights:
        out = out.withColumn("kjt_weights", F.create_map(*[x for k, w in weights.items() for x in (F.lit(k), F.col(w))]))
    return out


def kjt_concat(*maps) -> Column:
    """Keys of all maps together; keys must differ."""
    return F.map_concat(*[col(m) for m in maps])


def kjt_permute(m, keys: Sequence[str]) -> Column:
    """The keys asked for, in their order, as a struct."""
    return F.struct(*[F.try_element_at(col(m), F.lit(k)).alias(k) for k in keys])


def kjt_lengths(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Total number of ids per key, and the running offsets."""
    totals = df.agg(*[F.coalesce(F.sum(F.greatest(F.size(k), F.lit(0))), F.lit(0)).alias(k) for k in keys])
    each = F.array(*[F.col(k) for k in keys])
    return totals.select(F.array(*[F.lit(k) for k in keys]).alias("keys"), each.alias("length_per_key"), offsets(each.cast("array<int>")).alias("offset_per_key"))


def to_padded_dense(a, length: int, pad=0.0) -> Column:
    return pad_sequence(a, length, pad)


def from_dense(a) -> Column:
    """A dense row as values without nulls."""
    return F.filter(col(a), lambda x: x.isNotNull())


def regroup(groups: Sequence[Sequence[str]]) -> list[Column]:
    """Embeddings of each group of keys laid end to end."""
    return [F.concat(*[F.col(k) for k in g]) for g in groups]


def position_weighted(ids, weights: Sequence[float]) -> Column:
    """For each id the weight of its place; places past the weights get null."""
    w = F.array(*[F.lit(float(x)) for x in weights])
    return F.transform(col(ids), lambda x, i: F.get(w, i))


def pooled_embeddings(df: DataFrame, key: str, ids: str, table: DataFrame, dim: int, mode: str = "sum") -> DataFrame:
    """Embedding bags: ids looked up in (id, embedding) rows, summed or averaged per row. Rows without ids get zeros."""
    places = df.select(key, F.explode(ids).alias("_id"))
    found = places.join(table, places["_id"] == table["id"])
    f = F.sum if mode == "sum" else F.avg
    agg = found.groupBy(key).agg(*[f(F.get("embedding", F.lit(i)).cast("double")).alias(f"_{i}") for i in range(dim)])
    out = df.select(key).join(agg, key, "left")
    return out.select(key, F.array(*[F.coalesce(F.col(f"_{i}"), F.lit(0.0)).cast("float") for i in range(dim)]).alias("pooled"))


def batches(df: DataFrame, n: int):
    """Numpy batches of at most n rows, streamed partition by partition to a consumer."""
    rows = []
    for r in df.toLocalIterator(prefetchPartitions=True):
        rows.append(r)
        if len(rows) == n:
            yield _columns(rows)
            rows = []
    if rows:
        yield _columns(rows)


def unbatch(spark: SparkSession, parts, schema: str) -> DataFrame:
    """Numpy batches as rows again."""
    rows = []
    for p in parts:
        rows += zip(*[p[c].tolist() for c in p])
    return spark.createDataFrame(rows, schema)


def _columns(rows) -> dict[str, np.ndarray]:
    return {c: np.array([r[c] for r in rows]) for c in rows[0].asDict()}
