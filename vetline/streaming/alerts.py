"""Closed-listing alerts.

``closed_alerts`` joins streamed re-fetched pages with a static snapshot of the
listing table.  ``closed_alert_stream`` joins them with the streamed moves
themselves: both sides are kept in the join's state as long as their
watermarks allow a match, so no snapshot has to be read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vetline import fixed
from vetline.operators.board import active


def closed_alerts(pages_stream: DataFrame, cards: DataFrame,
                  marker: str = fixed.CLOSED_MARKER) -> DataFrame:
    """Pages holding the closed marker are filtered before the join, so only
    candidates reach it."""
    closed = pages_stream.where(F.lower("html").contains(marker.lower())).select("url")
    live = cards.where(active("status") & F.col("url").isNotNull() & (F.col("url") != ""))
    return closed.join(live, "url", "inner")


def closed_alert_stream(pages: DataFrame, moves: DataFrame, keep: str = "30 days", late: str = "1 day",
                        marker: str = fixed.CLOSED_MARKER) -> DataFrame:
    """``ref_nr, url, status, moved_at, fetched_at`` for pages ``(url, html,
    fetched_at)`` that show the closed marker within ``keep`` after a move
    ``(ref_nr, url, status, moved_at)`` put the card in a visible column.

    Only url and time of closed pages and of moves to visible columns are kept
    in state, for ``keep`` plus the lateness ``late`` of either stream.  A page
    fetched before the move says nothing of it.  A card that left the visible
    columns since is told apart when the candidate is confirmed (B7)."""
    closed = (pages.where(F.lower("html").contains(marker.lower()) & (F.col("url") != ""))
              .select(F.col("url").alias("p_url"), "fetched_at").withWatermark("fetched_at", late))
    cards = (moves.where(active("status") & (F.col("url") != ""))
             .select("ref_nr", "url", "status", "moved_at").withWatermark("moved_at", late))
    within = (F.col("fetched_at") >= F.col("moved_at")) & (F.col("fetched_at") <= F.col("moved_at") + F.expr(f"INTERVAL {keep}"))
    return cards.join(closed, (F.col("url") == F.col("p_url")) & within).drop("p_url")


def start_alerts(alerts: DataFrame, out_path: str, checkpoint: str):
    """Append alerts to a file sink (exactly once) over all that is there, and stop."""
    return (alerts.writeStream.format("parquet").option("path", out_path).option("checkpointLocation", checkpoint)
            .outputMode("append").trigger(availableNow=True).start())
