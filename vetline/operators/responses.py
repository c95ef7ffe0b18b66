"""Model-response assembly and attempt choice.

Responses arrive as rows: streamed chunks ``(resp_id, seq, line)`` and
attempts ``(listing, attempt, text)``.  A real scorer can be plugged in with
``mapInPandas`` producing the same rows; everything after that is columnar.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vetline import fixed
from vetline.functions import json_fields as jf

CHUNK_SCHEMA = "struct<message:struct<content:string>, done:boolean>"


def assemble_chunks(chunks: DataFrame, key: str = "resp_id", seq: str = "seq",
                    line: str = "line") -> DataFrame:
    """Concatenate ``message.content`` in ``seq`` order up to and including
    the first ``done`` chunk; unparsable lines add nothing (A11).

    Chunks after the first ``done`` are dropped by a keyed aggregate and join
    before the rest, one response, is put together."""
    parsed = chunks.select(
        key, F.col(seq).alias("_seq"),
        F.from_json(F.col(line), CHUNK_SCHEMA).alias("_c"))
    ends = (parsed.where(F.col("_c.done")).groupBy(F.col(key).alias("_k"))
                  .agg(F.min("_seq").alias("_end")))
    used = (parsed.join(ends, F.col(key) == F.col("_k"), "left")
                  .where(F.col("_end").isNull() | (F.col("_seq") <= F.col("_end"))))
    items = F.struct(F.col("_seq").alias("seq"), F.coalesce(F.col("_c.message.content"), F.lit("")).alias("content"))
    g = used.groupBy(key).agg(F.array_sort(F.collect_list(items)).alias("_a"))
    return g.select(key, F.size("_a").cast("long").alias("n_chunks"),
                    F.array_join(F.transform("_a", lambda x: x["content"]), "").alias("content"))


def pick_attempt(attempts: DataFrame, key: str, order_cols: list, text_col: str = "text",
                 max_attempts: int = fixed.SCORE_ATTEMPTS, stop_on_bad_json: bool = False
                 ) -> DataFrame:
    """First usable attempt per key among the first ``max_attempts``.

    Status per attempt: empty / no_json / bad_json / ok (X14).  Stage 05
    stops at a bad_json attempt (``stop_on_bad_json``), stage 06 retries it
    (Q14).  ``row_number() <= k`` is planned as a partial window group limit,
    so only k rows per key and task reach the shuffle."""
    w = Window.partitionBy(key).orderBy(*order_cols)
    first_k = (attempts.withColumn("attempt", F.row_number().over(w))
                       .where(F.col("attempt") <= max_attempts))
    st = first_k.select(key, "attempt", jf.parse_status(F.col(text_col)).alias("status"),
                        jf.parse_response(F.col(text_col)).alias("parsed"))
    ok_first = F.min(F.when(F.col("status") == "ok", F.col("attempt")))
    bad_first = F.min(F.when(F.col("status") == "bad_json", F.col("attempt")))
    g = st.groupBy(key).agg(
        ok_first.alias("_ok"), bad_first.alias("_bad"),
        F.min_by(F.col("parsed"), F.when(F.col("status") == "ok", F.col("attempt"))).alias("_v"),
        F.count(F.lit(1)).alias("n_attempts"))
    usable = F.col("_ok").isNotNull()
    if stop_on_bad_json:
        usable = usable & (F.col("_bad").isNull() | (F.col("_ok") < F.col("_bad")))
    return g.select(key, F.when(usable, F.col("_ok")).cast("int").alias("picked_attempt"),
                    F.when(usable, F.col("_v")).alias("response"), "n_attempts")
