"""Payment events: exactly one effect for each delivery, the latest status by arrival, ledger posting; in batch and as a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from ..operators.ledger import settle

#: What each event makes of the payment and the order.
STATUS = {
    "processing": ("processing", "payment_processing"),
    "settled": ("settled", "paid"),
    "settled_underpaid": ("settled_underpaid", "pending_payment"),
    "settled_overpaid": ("settled_overpaid", "paid"),
    "expired": ("expired", "expired_payment"),
    "invalid": ("invalid", "pending_payment"),
}
POSTS = ["settled", "settled_overpaid"]


def _map(at: int) -> Column:
    return F.create_map(*[F.lit(x) for k, v in STATUS.items() for x in (k, v[at])])


def with_status(events: DataFrame) -> DataFrame:
    return events.withColumn("payment_status", _map(0)[F.col("type")]).withColumn("order_status", _map(1)[F.col("type")])


def deduplicated(events: DataFrame) -> DataFrame:
    """The first arrival of each delivery of an invoice."""
    w = Window.partitionBy("invoice_id", "delivery_id").orderBy("arrival_seq")
    return events.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def latest_status(events: DataFrame) -> DataFrame:
    """Per invoice the status by the last arrival, with no guard against late events, and whether it ever settled in any way."""
    e = with_status(deduplicated(events))
    last = F.max(F.struct("arrival_seq", "payment_status", "order_status"))
    return e.groupBy("invoice_id").agg(last.alias("x"), F.bool_or(F.col("type").startswith("settled")).alias("has_settled_at"), F.count("*").alias("n_events")).select("invoice_id", "x.payment_status", "x.order_status", "has_settled_at", "n_events")


def to_post(events: DataFrame, posted: DataFrame | None = None) -> DataFrame:
    """Invoices whose ledger rows are due: settled or overpaid, not posted yet; once each."""
    due = events.where(F.col("type").isin(POSTS)).select("invoice_id").distinct()
    return due if posted is None else due.join(posted.select("invoice_id"), "invoice_id", "left_anti")


def stream_deduplicated(events: DataFrame, time_col: str = "received_at", delay: str = "7 days") -> DataFrame:
    """As a stream: deliveries are remembered for the watermark's delay; a repeat that comes later counts anew (the batch form never forgets)."""
    return events.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(["invoice_id", "delivery_id"])


def windowed_counts(events: DataFrame, time_col: str, size: str, delay: str = "1 hour") -> DataFrame:
    """An extension: events by type in tumbling windows."""
    return events.withWatermark(time_col, delay).groupBy(F.window(time_col, size), "type").count()


def run_settlement(events: DataFrame, orders: DataFrame, ledger_path: str, checkpoint: str) -> StreamingQuery:
    """Posts each micro-batch's settled orders. A batch is one folder named by its number and overwritten when repeated, and orders of other batches' folders are skipped, so nothing is posted twice."""

    def post(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        due = to_post(batch).withColumnRenamed("invoice_id", "order_id")
        rows = orders.join(due, "order_id", "left_semi")
        try:
            posted = spark.read.option("basePath", ledger_path).parquet(ledger_path).where(F.col("batch") != number)
        except Exception as e:  # nothing posted yet
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            posted = None
        settle(rows, posted).write.mode("overwrite").parquet(f"{ledger_path}/batch={number}")

    return events.writeStream.foreachBatch(post).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
