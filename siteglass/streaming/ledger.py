"""The payment ledger and checkout confirmations as streams, whatever the order of arrival.

The stream's state is one set of events for each slice of an order's sequence numbers, and
each update sends out what the slice does to an order that reaches it open or captured. An
order's row is its slices applied one after the other. So an event that comes late changes
its own slice alone, a repeated one changes nothing, and a hot order is spread over slices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import payments as P
from .runs import latest, run_append, run_updates, work_folder

#: Sequence numbers in a slice: 2 to the power of this.
SLICE_BITS = 10
_PAYER = ("payment_id", "email", "contact", "method")
_EFFECT = (
    "struct<captured: boolean, status: string, payment_id: string, email: string, contact: string, "
    "method: string, failed: boolean, error_code: string, error_description: string, "
    "paid_seq: bigint, last_event: string>"
)


def _known(events: DataFrame, orders: DataFrame) -> DataFrame:
    """Events of known orders; orders are a table, read anew with each batch."""
    return events.join(orders.select("order_id").distinct(), "order_id", "left_semi")


def status_stream(events: DataFrame, orders: DataFrame) -> DataFrame:
    """Status per order, updated with every batch (output mode ``update``).

    The status depends only on the largest sequence number of each kind of event.
    """
    kind, seq = P.event_kind(F.col("event")), F.col("seq")
    last = {k: F.max(F.when(kind == k, seq)) for k in (P.REFUNDED, P.CAPTURED, P.FAILED)}
    grouped = _known(events, orders).groupBy("order_id").agg(
        *[c.alias(f"last_{k}") for k, c in last.items()]
    )
    status = P.ledger_status(
        F.col(f"last_{P.REFUNDED}"), F.col(f"last_{P.CAPTURED}"), F.col(f"last_{P.FAILED}")
    )
    return grouped.select("order_id", status.alias("status"))


def _effect(events: Column, captured: bool) -> Column:
    """What events in order do to an order that is captured before them, or open.

    Null fields are left as they were before.
    """
    nothing = F.from_json(F.lit('{"failed": false}'), _EFFECT)
    start = nothing.withField("captured", F.lit(captured))

    def step(state: Column, event: Column) -> Column:
        kind = P.event_kind(event["event"])
        paid = kind.isin(P.CAPTURED, P.FAILED)
        applies = paid & ~state["captured"]
        fails = applies & (kind == P.FAILED)
        own = lambda c: F.when(applies, F.coalesce(event[c], state[c])).otherwise(state[c])
        text = F.coalesce(event["error_description"], F.lit(P.DEFAULT_ERROR))
        changed = applies | (kind == P.REFUNDED)
        fields = {
            "captured": F.when(kind == P.CAPTURED, True).when(kind == P.REFUNDED, False).otherwise(state["captured"]),
            "status": F.when(changed, kind).otherwise(state["status"]),
            **{c: own(c) for c in _PAYER},
            "failed": state["failed"] | fails,
            "error_code": F.when(fails, event["error_code"]).otherwise(state["error_code"]),
            "error_description": F.when(fails, text).otherwise(state["error_description"]),
            "paid_seq": F.when(applies & (kind == P.CAPTURED), event["seq"]).otherwise(state["paid_seq"]),
            "last_event": F.when(paid & ~applies, state["last_event"]).otherwise(event["event"]),
        }
        return F.struct(*[c.alias(name) for name, c in fields.items()]).cast(_EFFECT)

    return F.aggregate(events, start, step)


def ledger_stream(events: DataFrame, orders: DataFrame) -> DataFrame:
    """Effects of each slice of an order (output mode ``update``); apply them by ``ledger_of``.

    A slice holds as many events at most as it has sequence numbers.
    """
    columns = ("seq", "event", *_PAYER, "error_code", "error_description")
    kept = F.collect_set(F.struct(*columns)).alias("events")
    part = F.shiftright("seq", SLICE_BITS).alias("slice")
    slices = _known(events, orders).groupBy("order_id", part).agg(kept)
    own = F.array_sort("events")
    settles = F.exists("events", lambda e: P.event_kind(e["event"]).isin(P.CAPTURED, P.REFUNDED))
    return slices.select(
        "order_id", "slice", settles.alias("settles"),
        _effect(own, False).alias("open"), _effect(own, True).alias("taken"),
    )


def ledger_of(slices: DataFrame, orders: DataFrame) -> DataFrame:
    """Ledger rows of all orders from the latest effects of their slices; quiet ones are pending.

    A slice with a capture or refund leaves the same state whatever was before it; so how a
    slice is reached is told by the last such slice before.
    """
    before = Window.partitionBy("order_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    leaves = F.when(F.col("settles"), F.col("open.captured"))
    captured = F.coalesce(F.last(leaves, ignorenulls=True).over(before), F.lit(False))
    applied = slices.select("order_id", "slice", F.when(captured, F.col("taken")).otherwise(F.col("open")).alias("e"))

    def last(name: str, given: Column) -> Column:
        return F.max_by(F.col(f"e.{name}"), F.when(given, F.col("slice"))).alias(name)

    plain = ("status", *_PAYER, "paid_seq", "last_event")
    state = applied.groupBy("order_id").agg(
        *[last(c, F.col(f"e.{c}").isNotNull()) for c in plain],
        *[last(c, F.col("e.failed")) for c in ("error_code", "error_description")],
    )
    known = orders.select("order_id").distinct()
    return known.join(state, "order_id", "left").withColumn("status", F.coalesce("status", F.lit(P.PENDING)))


def owner_stream(confirmations: DataFrame) -> DataFrame:
    """The first claim of each payment id: its order and sequence number (mode ``update``)."""
    first = [F.min_by("order_id", "seq").alias("owner"), F.min("seq").alias("owner_seq")]
    return confirmations.groupBy("payment_id").agg(*first)


def confirmation_stream(confirmations: DataFrame) -> DataFrame:
    """The order that owns each payment id: the one that brought it first."""
    return owner_stream(confirmations).select("payment_id", F.col("owner").alias("order_id"))


def run_status(spark: SparkSession, events: DataFrame, orders: DataFrame) -> DataFrame:
    folder = work_folder(spark, "status")
    return latest(run_updates(status_stream(events, orders), folder), ["order_id"])


def run_ledger(spark: SparkSession, events: DataFrame, orders: DataFrame) -> DataFrame:
    """Ledger of all orders after the stream is drained."""
    folder = work_folder(spark, "ledger")
    slices = latest(run_updates(ledger_stream(events, orders), folder), ["order_id", "slice"])
    return ledger_of(slices, orders)


def run_confirmations(spark: SparkSession, confirmations: DataFrame) -> DataFrame:
    updates = run_updates(confirmation_stream(confirmations), work_folder(spark, "confirm"))
    return latest(updates, ["payment_id"])


def run_outcomes(spark: SparkSession, confirmations: DataFrame) -> DataFrame:
    """Outcome of each confirmation after the stream is drained.

    Confirmations are appended as they come, claims are kept as state. An earlier claim that
    comes late changes the owner, and with it what the stored confirmations turn out to be.
    """
    owners = run_updates(owner_stream(confirmations), work_folder(spark, "owners"))
    events = run_append(confirmations.select("seq", "order_id", "payment_id"), work_folder(spark, "claims"))
    return P.claim_outcomes(events, latest(owners, ["payment_id"]))
