"""Sample rows for a set of ids. Values come from a hash of the id, so every run makes the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Fixed values of the sample data.
ORDER_STATUSES = ("created", "paid", "shipped", "refunded")
EVENT_TYPES = ("page_view", "click", "purchase", "logout")
MAX_AMOUNT_CENTS = 50_000


def id_range(spark: SparkSession, rows: int) -> DataFrame:
    return spark.range(1, rows + 1)


def draw(id_: Column, label: str, below: Column | int) -> Column:
    """A whole number in ``[0, below)`` from the id and a label."""
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(label), id_.cast("string"))), 1, 15)
    return F.conv(digits, 16, 10).cast("bigint") % (F.lit(below) if isinstance(below, int) else below)


def _pick(values: tuple[str, ...], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def seed_users(ids: DataFrame) -> DataFrame:
    """``(user_id, email, created_at)`` for ``ids(id)``."""
    start = F.lit("2026-01-01 00:00:00").cast("timestamp_ntz")
    return ids.select(
        F.col("id").alias("user_id"), F.concat(F.lit("user"), F.col("id").cast("string"), F.lit("@example.com")).alias("email"),
        (start + F.make_dt_interval(secs=draw(F.col("id"), "joined", 30 * 86_400).cast("decimal(18,6)"))).alias("created_at"))


def seed_orders(ids: DataFrame, users: int) -> DataFrame:
    """``(order_id, user_id, amount_usd, status, created_at, payload)`` with users 1 to ``users``."""
    start = F.lit("2026-01-01 00:00:00").cast("timestamp_ntz")
    amount = (draw(F.col("id"), "amount", MAX_AMOUNT_CENTS + 1).cast("decimal(12,2)") / 100).cast("decimal(10,2)")
    return ids.select(
        F.col("id").alias("order_id"), (draw(F.col("id"), "user", users) + 1).alias("user_id"),
        F.round(amount, 2).cast("decimal(10,2)").alias("amount_usd"),
        _pick(ORDER_STATUSES, draw(F.col("id"), "status", len(ORDER_STATUSES))).alias("status"),
        (start + F.make_dt_interval(secs=draw(F.col("id"), "ordered", 50 * 86_400).cast("decimal(18,6)"))).alias("created_at"),
        F.to_json(F.struct(F.lit("seed").alias("source"), draw(F.col("id"), "rand", 1_000_000).alias("rand"))).alias("payload"))


def seed_events(ids: DataFrame, users: int, source: str = "seed") -> DataFrame:
    """``(event_id, user_id, event_type, event_ts, payload)``; times spread over 50 days of two monthly partitions."""
    start = F.lit("2026-01-01 00:00:00").cast("timestamp_ntz")
    return ids.select(
        F.col("id").alias("event_id"), (draw(F.col("id"), "user", users) + 1).alias("user_id"),
        _pick(EVENT_TYPES, draw(F.col("id"), "type", len(EVENT_TYPES))).alias("event_type"),
        (start + F.make_dt_interval(secs=draw(F.col("id"), "at", 50 * 86_400).cast("decimal(18,6)"))).alias("event_ts"),
        F.to_json(F.struct(F.lit(source).alias("source"), draw(F.col("id"), "rand", 1_000_000).alias("rand"))).alias("payload"))
