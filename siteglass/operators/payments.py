"""Payment statistics, lists, and the batch form of the payment ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import id_bucket, running_total

# Event names of the payment provider and payment states.
CAPTURE_EVENTS = ("payment.captured", "payment.authorized")
FAILURE_EVENT = "payment.failed"
REFUND_EVENT = "refund.processed"
PENDING, CAPTURED, FAILED, REFUNDED = "pending", "captured", "failed", "refunded"
DEFAULT_ERROR = "Payment failed"
RECENT_PAYMENTS = 10


def payment_stats(payments: DataFrame, today: Column) -> DataFrame:
    """Counts per status, captured amount, and what was paid since ``today``."""
    status, amount = F.col("status"), F.col("amount_paise")
    captured = status == CAPTURED
    paid_today = captured & (F.col("paid_at") >= today)

    def amount_of(test: Column) -> Column:
        return F.coalesce(F.sum(F.when(test, amount)), F.lit(0))

    return payments.agg(
        F.count(F.lit(1)).alias("total_payments"),
        F.count_if(captured).alias("captured_payments"),
        amount_of(captured).alias("captured_paise"),
        F.count_if(status == PENDING).alias("pending_payments"),
        F.count_if(status == FAILED).alias("failed_payments"),
        F.count_if(paid_today).alias("today_payments"),
        amount_of(paid_today).alias("today_paise"),
    )


def filter_status(payments: DataFrame, status: str | None = None) -> DataFrame:
    """Payments of one status; ``None`` and ``all`` keep every payment."""
    return payments if status in (None, "all") else payments.where(F.col("status") == status)


def recent_payments(
    payments: DataFrame, k: int = RECENT_PAYMENTS, status: str | None = None
) -> DataFrame:
    rows = filter_status(payments, status)
    return rows.orderBy(F.col("created_at").desc(), F.col("payment_id").desc()).limit(k)


def payments_with_audit_url(payments: DataFrame, audits: DataFrame) -> DataFrame:
    """Payments with the URL of their audit, null where there is none."""
    urls = audits.select("audit_id", F.col("url").alias("audit_url"))
    return payments.join(urls, "audit_id", "left")


def event_kind(event: Column) -> Column:
    return (
        F.when(event.isin(*CAPTURE_EVENTS), CAPTURED)
        .when(event == FAILURE_EVENT, FAILED)
        .when(event == REFUND_EVENT, REFUNDED)
        .otherwise("other")
    )


def ledger_status(refund: Column, capture: Column, failure: Column) -> Column:
    """State after the last refund, from the largest sequence number of each kind."""
    after = lambda seq: seq > F.coalesce(refund, F.lit(-1))
    return (
        F.when(after(capture), CAPTURED)
        .when(after(failure), FAILED)
        .when(refund.isNotNull(), REFUNDED)
        .otherwise(PENDING)
    )


def payment_ledger(events: DataFrame, orders: DataFrame) -> DataFrame:
    """Final state of every order, from its events in ``seq`` order.

    A capture holds until a refund: later captures and failures before it change
    nothing. Orders without events are pending; events of unknown orders are
    ignored. ``seq`` is unique and not negative.
    """
    known = events.withColumn("kind", event_kind(F.col("event"))).join(
        orders.select("order_id").distinct(), "order_id", "left_semi"
    )
    # Number of refunds so far: captures hold inside one such stretch only.
    staged = running_total(
        known,
        ["order_id"],
        [id_bucket(F.col("seq"))],
        [F.col("seq")],
        (F.col("kind") == REFUNDED).cast("int"),
        "stretch",
    )
    captures = (
        staged.where(F.col("kind") == CAPTURED)
        .groupBy("order_id", "stretch")
        .agg(F.min("seq").alias("capture_seq"))
    )
    joined = staged.join(captures, ["order_id", "stretch"], "left")
    kind, seq = F.col("kind"), F.col("seq")
    before_capture = F.coalesce(seq < F.col("capture_seq"), F.lit(True))
    applied = (
        F.when(kind == CAPTURED, seq == F.col("capture_seq"))
        .when(kind == FAILED, before_capture)
        .otherwise(True)
    )
    live = joined.where(applied)
    paid = kind.isin(CAPTURED, FAILED)

    def latest(value: str, test: Column) -> Column:
        return F.max_by(value, F.when(test, seq)).alias(value)

    state = live.groupBy("order_id").agg(
        F.max_by(kind, F.when(kind != "other", seq)).alias("status"),
        *[
            latest(c, paid & F.col(c).isNotNull())
            for c in ("payment_id", "email", "contact", "method")
        ],
        latest("error_code", kind == FAILED),
        F.max_by(
            F.coalesce("error_description", F.lit(DEFAULT_ERROR)), F.when(kind == FAILED, seq)
        ).alias("error_description"),
        F.max(F.when(kind == CAPTURED, seq)).alias("paid_seq"),
        F.max_by("event", "seq").alias("last_event"),
    )
    return (
        orders.select("order_id")
        .distinct()
        .join(state, "order_id", "left")
        .withColumn("status", F.coalesce("status", F.lit(PENDING)))
    )


def checkout_confirm(confirmations: DataFrame) -> DataFrame:
    """Outcome of each checkout confirmation ``(seq, order_id, payment_id)``.

    The first order that brings a payment id owns it. Its repeats change nothing;
    the same payment id for another order is rejected.
    """
    pairs = confirmations.groupBy("payment_id", "order_id").agg(F.min("seq").alias("pair_seq"))
    owners = pairs.groupBy("payment_id").agg(
        F.min_by("order_id", "pair_seq").alias("owner"), F.min("pair_seq").alias("owner_seq")
    )
    return claim_outcomes(confirmations, owners)


def claim_outcomes(confirmations: DataFrame, owners: DataFrame) -> DataFrame:
    """Outcome of each confirmation, given ``(payment_id, owner, owner_seq)``."""
    outcome = (
        F.when(F.col("order_id") != F.col("owner"), "rejected")
        .when(F.col("seq") == F.col("owner_seq"), "recorded")
        .otherwise("repeated")
    )
    joined = confirmations.join(owners, "payment_id")
    return joined.select("seq", "order_id", "payment_id", outcome.alias("outcome"))
