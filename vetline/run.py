"""Run one profile of the funnel as a Spark job (G1).

    python -m vetline.run --profile full --today 20260131 \\
        --emails in/emails --links in/links --pages in/pages.parquet \\
        --extract in/extract.parquet --score in/score.parquet \\
        --seen state/seen --db state/listing_db --out out/run-20260131

Reads: ``*.eml`` messages (binaryFile), ``*.url`` shortcuts, crawled pages
``(url, html)``, model attempts ``(url, attempt, text)`` for both stages, the
seen list and the current listing table.  Writes a new snapshot folder under
``--out``: routed rows per stage (partitioned by outcome), the seen
additions, the new listing rows, the updated table for forced rescores, the
scoring reports, the quarantine and the listing documents; ``seen`` and
``listing_db`` there are the inputs of the next run.  Nothing is overwritten in place.

A seen list made by ``sources.seen.create`` grows where it lies: it is not read
whole nor copied, the run adds its new URLs under its number (``--run``, the
day if not given) once all else is written, and ``seen`` is left out of the
snapshot.  Several runs of a day need rising numbers; a run repeated with its
number compares with the list as it first met it and replaces its own additions.
"""

from __future__ import annotations

import argparse
import os

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from vetline.plans import profiles
from vetline.session import prepare
from vetline.sources import files
from vetline.sources import seen as seen_list


def _exists(spark: SparkSession, path: str | None) -> bool:
    if not path:
        return False
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def run_number(a) -> int:
    return int(a.today) if a.run is None else a.run


def build_inputs(spark: SparkSession, a) -> dict:
    inputs = {}
    if _exists(spark, a.emails):
        inputs["messages"] = files.read_messages(spark, a.emails)
    if _exists(spark, a.links):
        inputs["links"] = files.read_shortcuts(spark, a.links)
    if a.seen and seen_list.exists(spark, a.seen):
        inputs["seen"] = seen_list.SeenList(spark, a.seen, before=run_number(a))
    else:
        inputs["seen"] = (files.read_seen(spark, a.seen) if _exists(spark, a.seen)
                          else spark.createDataFrame([], "url string"))
    pages = spark.read.parquet(a.pages)
    inputs["pages"] = pages.select("url", "html", *[c for c in pages.columns if c == "crawled_at"])
    inputs["extract_attempts"] = spark.read.parquet(a.extract)
    inputs["score_attempts"] = spark.read.parquet(a.score)
    if _exists(spark, a.db):
        inputs["listing_db"] = files.read_listing_db(spark, a.db)
    if _exists(spark, a.stored):
        inputs["stored_names"] = spark.read.parquet(a.stored).select("name")
    return inputs


#: What each stage routes to.
STAGE_OUTCOMES = {
    "dedup": ("moved", "deleted", "skipped"),
    "extraction": ("closed", "pending", "lang_rejects", "lang_req_rejects", "accepted"),
    "scoring": ("closed", "pending", "disqualified", "rejected_role", "rejected_score", "accepted"),
}


def write_outputs(out: dict, folder: str) -> dict[str, dict[str, int]]:
    """Write all tables; gives the rows of each routed stage by outcome, counted
    while they were written, and stores them as ``counts``."""
    counts = {}

    def routed(stage: str, df) -> None:
        counts[stage] = files.write_routed(df, os.path.join(folder, stage), outcomes=STAGE_OUTCOMES[stage])

    routed("dedup", out["dedup"].select("name", "url", "outcome"))
    out["seen_additions"].write.mode("errorifexists").parquet(os.path.join(folder, "seen_additions"))
    routed("extraction", out["extraction"].select("url", "stem", "stage05_stem", F.col("stage05").alias("outcome")))
    routed("scoring", out["scoring"].select("url", "ref_nr", "final_stem", F.col("scored.fit_score").alias("fit_score"),
                                            "report", F.col("stage06").alias("outcome")))
    files.write_snapshot(out["new_rows"], os.path.join(folder, "new_rows"))
    files.write_snapshot(out["rescored_db"].drop("updated"), os.path.join(folder, "rescored_db"))
    files.write_snapshot(out["quarantine"].select("url", "name"), os.path.join(folder, "quarantine"))
    # the state the next run starts from, and the listing documents
    if "seen_next" in out:
        files.write_snapshot(out["seen_next"], os.path.join(folder, "seen"))
    files.write_snapshot(out["listing_db_next"], os.path.join(folder, "listing_db"))
    files.write_snapshot(out["documents"], os.path.join(folder, "documents"))
    rows = [(stage, outcome, n) for stage, by in counts.items() for outcome, n in by.items() if outcome]
    files.write_snapshot(out["dedup"].sparkSession.createDataFrame(rows, "stage string, outcome string, n long").coalesce(1),
                         os.path.join(folder, "counts"))
    return counts


def main(argv=None) -> None:
    ap = argparse.ArgumentParser(prog="vetline.run")
    ap.add_argument("--profile", choices=profiles.PROFILES, default="full")
    ap.add_argument("--today", required=True, help="yyyyMMdd")
    ap.add_argument("--force", action="store_true")
    ap.add_argument("--emails")
    ap.add_argument("--links")
    ap.add_argument("--pages", required=True)
    ap.add_argument("--extract", required=True)
    ap.add_argument("--score", required=True)
    ap.add_argument("--seen")
    ap.add_argument("--run", type=int, help="number of the run, for a bucketed seen list")
    ap.add_argument("--db")
    ap.add_argument("--keywords")
    ap.add_argument("--stored", help="Parquet table of names already stored")
    ap.add_argument("--out", required=True)
    a = ap.parse_args(argv)
    spark = SparkSession.builder.appName(f"vetline-{a.profile}").getOrCreate()
    prepare(spark)
    inputs = build_inputs(spark, a)
    kws = files.read_keywords(spark, a.keywords) if a.keywords else None
    out = profiles.run(inputs, profile=a.profile, today=a.today, force=a.force, keywords=kws)
    write_outputs(out, a.out)
    if isinstance(inputs["seen"], seen_list.SeenList):
        seen_list.add(spark, a.seen, spark.read.parquet(os.path.join(a.out, "seen_additions")), run_number(a))


if __name__ == "__main__":
    main()
