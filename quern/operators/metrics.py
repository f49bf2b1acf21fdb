"""Run metrics and ordered state over event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

EDGES = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)


def ema(rows: DataFrame, group: str, order: str, value: str, alpha: float = 0.1) -> DataFrame:
    """(group, ema, n): the final exponential average of each series; a series is folded whole."""
    series = rows.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(order, value))).alias("s"))
    first = F.element_at("s", 1)[value].cast("double")
    folded = F.aggregate(F.slice("s", 2, F.greatest(F.size("s") - 1, F.lit(0))), first, lambda a, x: F.lit(alpha) * x[value] + F.lit(1 - alpha) * a)
    return series.select(group, folded.alias("ema"), F.size("s").alias("n"))


def running(rows: DataFrame, group: str, order: list, value: str) -> DataFrame:
    """Add the running best (least) value and whether the row set it."""
    before = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("_b", F.min(value).over(before)).withColumn("best_so_far", F.least(value, F.coalesce("_b", value))).withColumn("is_best", F.col("_b").isNull() | (F.col(value) < F.col("_b"))).drop("_b")


def progress(rows: DataFrame, group: str, order: list, clock: Column) -> DataFrame:
    """Add done, percent and the microseconds since the row before and since the first."""
    w = Window.partitionBy(group).orderBy(*order)
    total = F.count(F.lit(1)).over(Window.partitionBy(group))
    return rows.withColumn("done", F.row_number().over(w)).withColumn("percent", F.col("done") * 100.0 / total).withColumn("step_us", clock - F.lag(clock).over(w)).withColumn("elapsed_us", clock - F.first(clock).over(w))


def latest(rows: DataFrame, group: str, order: list, n: int) -> DataFrame:
    """The last ``n`` rows of each group."""
    w = Window.partitionBy(group).orderBy(*order)
    return rows.withColumn("newest", F.row_number().over(w)).filter(F.col("newest") <= n)


def warm_up_rate(step: Column, width: int = 512, warm: int = 4000) -> Column:
    """d^-0.5 * min(s^-0.5, s * w^-1.5)."""
    s = F.greatest(step, F.lit(1)).cast("double")
    return F.lit(width**-0.5) * F.least(F.pow(s, F.lit(-0.5)), s * F.lit(warm**-1.5))


def window_count(rows: DataFrame, key: str, micros: str, seconds: int, limit: int) -> DataFrame:
    """Add the requests of the key in the window that ends with the row, and whether they pass the limit."""
    w = Window.partitionBy(key).orderBy(micros).rangeBetween(-seconds * 1_000_000, 0)
    return rows.withColumn("in_window", F.count(F.lit(1)).over(w)).withColumn("over_limit", F.col("in_window") > limit)


def admitted(rows: DataFrame, key: str, micros: str, order: str, seconds: int, limit: int) -> DataFrame:
    """Add admitted: exact sliding window in which refused requests don't count; a fold per key."""
    import pyarrow as pa

    of, at = rows.columns.index(key), rows.columns.index(micros)
    schema = T.StructType([*rows.schema.fields, T.StructField("admitted", T.BooleanType())])

    def run(batches):
        from collections import deque

        now, held, begun = None, deque(), False
        for batch in batches:
            out = []
            for k, t in zip(batch.column(of).to_pylist(), batch.column(at).to_pylist(), strict=True):
                if not begun or k != now:
                    now, held, begun = k, deque(), True
                while held and held[0] < t - seconds * 1_000_000:
                    held.popleft()
                out.append(len(held) < limit)
                if out[-1]:
                    held.append(t)
            yield pa.record_batch([*batch.columns, pa.array(out, pa.bool_())], names=[*batch.schema.names, "admitted"])

    return rows.repartition(key).sortWithinPartitions(key, micros, order).mapInArrow(run, schema)


def histogram(rows: DataFrame, value: Column, *by: str, edges=EDGES) -> DataFrame:
    """Cumulative counts at each edge and over all, by the given columns."""
    return rows.groupBy(*by).agg(*[F.count_if(value <= F.lit(e)).alias(f"le_{k}") for k, e in enumerate(edges)], F.count(F.lit(1)).alias("n"))


def loss_summary(rows: DataFrame, group: str, loss: str) -> DataFrame:
    """Count, least and sum of a loss, as the parts of mean, best and perplexity."""
    return rows.groupBy(group).agg(F.count(loss).alias("n"), F.min(loss).alias("best"), F.sum(F.col(loss).cast("decimal(20,6)")).alias("total"))


def perplexity(nll: Column, tokens: Column, cap: float = 50.0) -> Column:
    return F.exp(F.least(nll / F.greatest(tokens, F.lit(1)), F.lit(cap)))


def bits_per_byte(nll: Column, n_bytes: Column) -> Column:
    return nll / F.lit(0.6931471805599453) / F.greatest(n_bytes, F.lit(1))


def tiered(rows: DataFrame, tiers: DataFrame, key: str, limit: int = 60, seconds: int = 60) -> DataFrame:
    """Add limit and window_sec of the row's key from (key, limit, window_sec), else the given defaults."""
    told = tiers.select(F.col(key).alias("_key"), F.col("limit").alias("_limit"), F.col("window_sec").alias("_seconds"))
    met = rows.join(told, rows[key] == told["_key"], "left")
    return met.withColumn("limit", F.coalesce("_limit", F.lit(limit))).withColumn("window_sec", F.coalesce("_seconds", F.lit(seconds))).drop("_key", "_limit", "_seconds")


def stage_rates(rows: DataFrame, rule: str, stages: dict[str, tuple[str, ...]]) -> DataFrame:
    """(stage, docs_in, docs_out, rejected, reject_rate in percent): what each stage's rules took, in order.

    One aggregate of counts; the stages are rows of its single result.
    """
    counts = rows.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(rule).isin(*rules)).alias(f"r{k}") for k, rules in enumerate(stages.values())])
    told, before = [], F.col("n")
    for k, name in enumerate(stages):
        gone = F.col(f"r{k}")
        told.append(F.struct(F.lit(name).alias("stage"), before.alias("docs_in"), (before - gone).alias("docs_out"), gone.alias("rejected"), F.round(gone * 100.0 / F.greatest(before, F.lit(1)), 1).alias("reject_rate")))
        before = before - gone
    return counts.select(F.explode(F.array(*told)).alias("s")).select("s.*")


def append_records(rows: DataFrame, path: str) -> None:
    """Metric or event records as JSON lines, added to what is there; nothing is rewritten."""
    rows.write.mode("append").json(path)


def usage(docs: DataFrame, source: str = "source", text: str = "text") -> DataFrame:
    """Bytes and records by source, with a total row (null source)."""
    return docs.rollup(source).agg(F.sum(F.octet_length(text)).alias("used_bytes"), F.count(F.lit(1)).alias("records"))
