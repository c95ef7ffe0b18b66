"""Apply board work to the listing table as one Spark job.

    python -m vetline.run_board --today 20260131 --db state/listing_db \\
        --events in/board_events --edits in/score_edits --confirmed in/expired \\
        --out out/board-20260131

Reads the listing table and, where given, Parquet tables of board events
``(ref_nr, event_id, ts, to_col, reason, comment)``, edited score responses
``(ref_nr, stem, content, ts)`` and confirmed expiries ``(ref_nr)``.  Writes the
next listing table, the refused moves, the sync counts, the checked edits and their
new score reports into a new folder; nothing is overwritten in place.
"""

from __future__ import annotations

import argparse
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vetline.operators import board as bd
from vetline.operators import listing_db as ldb
from vetline.session import prepare
from vetline.sources import files


def apply(db: DataFrame, today: str, events: DataFrame | None = None, edits: DataFrame | None = None,
          confirmed: DataFrame | None = None) -> dict[str, DataFrame]:
    """The next ``listing_db``; ``refused`` and ``counts`` with events, ``edits`` and ``reports`` with edits.
    Events come first, then edited scores, confirmed expiries, and expiry by date."""
    out: dict[str, DataFrame] = {}
    today_dmy = f"{today[6:8]}/{today[4:6]}/{today[:4]}"
    if events is not None:
        folded = bd.fold_events(events, ["ts", "event_id"])
        out["refused"] = bd.invalid_moves(events)
        out["counts"] = bd.sync_counts(db, folded)
        db = bd.sync(db, folded).drop("updated")
    if edits is not None:
        edited = bd.edit_score(edits, "content", "stem", today, ref_col="ref_nr")
        out["edits"] = edited.drop("result", "report")
        out["reports"] = edited.where("error is null").select("ref_nr", "new_stem", "report")
        scores = out["edits"].where("error is null").select("ref_nr", "fit_score", "ts")
        db = ldb.update_by_ref(db, scores, ["fit_score"], order_cols=["ts"]).drop("updated")
    if confirmed is not None:
        db = bd.confirm_expired(db, confirmed, today_dmy).drop("updated")
    out["listing_db"] = bd.expire_old(db, "date_published", today, today_dmy).drop("expired")
    return out


def main(argv=None) -> None:
    ap = argparse.ArgumentParser(prog="vetline.run_board")
    ap.add_argument("--today", required=True, help="yyyyMMdd")
    ap.add_argument("--db", required=True)
    ap.add_argument("--events")
    ap.add_argument("--edits")
    ap.add_argument("--confirmed")
    ap.add_argument("--out", required=True)
    a = ap.parse_args(argv)
    spark = SparkSession.builder.appName("vetline-board").getOrCreate()
    prepare(spark)
    tables = {k: spark.read.parquet(p) for k in ("events", "edits", "confirmed") if (p := getattr(a, k))}
    for name, df in apply(files.read_listing_db(spark, a.db), a.today, **tables).items():
        files.write_snapshot(df, os.path.join(a.out, name))


if __name__ == "__main__":
    main()
