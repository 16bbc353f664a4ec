"""Mixing sources to target weights by Poisson replication.

A source's repetition rate is its target share of all characters divided by
its present share. Every document gets a Poisson count with that mean, found
by inverting the distribution at a number hashed from the seed and the
document's id, so the draw is the same on every run and every layout. The
document is repeated that often and all copies are shuffled globally.
"""

from __future__ import annotations

from functools import lru_cache
from math import lgamma, log, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lessonloom.functions.ranks import unused
from lessonloom.llm.tasks import ship
from lessonloom.session import written


def unit(*parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of the MD5 of the joined parts."""
    digest = F.md5(F.concat_ws("|", *parts))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


@lru_cache(maxsize=4096)
def _cumulative(rate: float) -> np.ndarray:
    k = np.arange(int(rate + 20 * sqrt(rate) + 50))
    logs = -rate + k * log(rate) - np.array([lgamma(i + 1) for i in k])
    return np.cumsum(np.exp(logs))


def poisson_counts(u: np.ndarray, rates: np.ndarray) -> np.ndarray:
    """The smallest k with u < P(X <= k) for X ~ Poisson(rate); rate 0 gives 0."""
    out = np.zeros(len(u), dtype=np.int64)
    for rate in np.unique(rates):
        if rate > 0:
            at = rates == rate
            out[at] = np.searchsorted(_cumulative(float(rate)), u[at], side="right")
    return out


@F.pandas_udf(T.LongType())
def _drawn(u: pd.Series, rate: pd.Series) -> pd.Series:
    return pd.Series(poisson_counts(u.to_numpy(), rate.to_numpy()))


def source_rates(docs: DataFrame, weights: dict[str, float] | None, exponent: float, epochs: float, source: str, text: str) -> DataFrame:
    """``_source, _rate``: a row per source, sized by characters plus one per document.

    Target shares follow ``weights`` (sources not named in it get 0), or
    without weights the size to the power ``exponent``.
    """
    size = F.length(F.coalesce(F.col(text), F.lit(""))) + 1
    sizes = written(docs.groupBy(F.col(source).alias("_source")).agg(F.sum(size).alias("_size")), "sizes")
    if weights is None:
        aim: Column = F.pow("_size", F.lit(exponent))
    else:
        pairs = [F.lit(x) for pair in weights.items() for x in pair]
        named = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,double>")
        aim = F.coalesce(F.try_element_at(named, F.coalesce(F.col("_source").cast("string"), F.lit(""))).cast("double"), F.lit(0.0))
    total = sizes.agg(F.sum("_size"), F.sum(aim)).first()
    if not total[0] or not total[1]:
        return sizes.select("_source", F.lit(0.0).alias("_rate"))
    rate = aim / F.lit(float(total[1])) * F.lit(float(total[0]) * epochs) / F.col("_size")
    return sizes.select("_source", rate.alias("_rate"))


def mix(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    exponent: float = 0.5,
    epochs: float = 1.0,
    seed: int = 17,
    doc_id: str = "doc_id",
    source: str = "source",
    text: str = "text",
) -> DataFrame:
    """``docs`` with each row repeated by its draw, shuffled, and columns ``_copy``, ``_key``.

    The expected size is ``epochs`` times the present one. Rows with equal ids
    share their draw; null ids count as an id of their own, null sources as a
    source of their own. Columns named ``_copy`` or ``_key`` in ``docs`` are
    replaced. An empty table gives no rows. The rates are written first, so
    that Spark knows their size when it decides whether to broadcast them.
    """
    ship(docs.sparkSession)
    own = [c for c in docs.columns if c not in ("_copy", "_key")]
    of, rate, n = (unused(docs, c) for c in ("_source", "_rate", "_n"))
    rates = written(source_rates(docs, weights, exponent, epochs, source, text).toDF(of, rate), "rates")
    name = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    met = docs.select(*own).join(rates, F.col(source).eqNullSafe(F.col(of)))
    drawn = met.withColumn(n, _drawn(unit(F.lit(str(seed)), name), F.col(rate))).where(F.col(n) > 0)
    copies = drawn.select(*own, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1)).alias("_copy"))
    key = F.md5(F.concat_ws("|", F.lit(f"{seed}-order"), name, F.col("_copy").cast("string")))
    return copies.withColumn("_key", key).repartition("_key").sortWithinPartitions("_key")
