"""A training corpus from documents: good pages, one of each group of near
copies, without benchmark passages or personal data, packed into sequences.

Each stage takes and (but for the last) returns the columns of documents, and
further columns as they are, whatever their names.  Rows
with a null id can't be told apart by id; they are judged by their texts like
all others, and of repeated rows of one id and text one stays.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vetline.llm import common as C
from vetline.llm import packing, pii, quality, simhash, tiling
from vetline.sources.tables import table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches 0.3."""
    rows = quality.feature_table(docs, carry=True)
    return quality.keep_good(rows, docs.columns, quality.fit(rows, table(spark, sf_dir, "labels")), threshold=0.3)


def _key(text_col: str = "text"):
    """A row by its id and text, where neither alone tells rows apart; null ids come last."""
    return F.struct(F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("i"), F.xxhash64(text_col).alias("h"), F.octet_length(text_col).alias("n"))


def _with_key(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with the key in a column whose name no other column has."""
    name = C.unused(docs, "_key")
    return docs.withColumn(name, _key()), name


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by SimHash: that with the smallest id,
    of rows with that id the one with the smallest text hash."""
    keyed, key = _with_key(docs)
    groups = simhash.near_duplicates(keyed, id_col=key, shingle=4, max_bits=4)
    chosen = groups.select(F.col("component_id").alias("_chosen")).distinct()
    # component_id is the smallest key of a group, so joining on it keeps one key a group
    kept = keyed.join(chosen, keyed[key].eqNullSafe(chosen["_chosen"]), "left_semi")
    twice = groups.groupBy(key).count().where("count > 1").select(key)
    if twice.isEmpty():
        return kept.drop(key)
    return kept.dropDuplicates([key]).drop(key)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    keyed, key = _with_key(docs)
    hit = (tiling.contaminated(keyed, table(spark, sf_dir, "benchmark"), id_col=key)
           .select(F.col(key).alias("_hit")).distinct())
    return keyed.join(hit, keyed[key].eqNullSafe(hit["_hit"]), "left_anti").drop(key)


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind in brackets."""
    keyed, key = _with_key(docs)
    spans = (pii.find(keyed, id_col=key).where(F.size("spans") > 0)
             .groupBy(F.col(key).alias("_found_key")).agg(F.first("spans").alias("_found")))
    joined = (keyed.join(spans, keyed[key].eqNullSafe(spans["_found_key"]), "left")
              .select(*[keyed[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(docs.columns)], spans["_found"].alias("found")))
    place, length = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else None
    names = docs.columns

    def mask(batches):
        for b in batches:
            columns = list(b.columns[:len(names)])
            found = b.column(len(names)).is_valid().to_pylist()
            if any(found):
                text, spans_of = columns[place].to_pylist(), b.column(len(names))
                for i in (i for i, f in enumerate(found) if f):
                    text[i] = pii.masked(text[i], spans_of[i].as_py())
                columns[place] = pa.array(text, columns[place].type)
                if length is not None:
                    counts = columns[length].to_pylist()
                    for i in (i for i, f in enumerate(found) if f):
                        counts[i] = len(text[i])
                    columns[length] = pa.array(counts, columns[length].type)
            yield pa.RecordBatch.from_arrays(columns, names)

    C.small_batches(spark)
    return joined.mapInArrow(mask, docs.schema)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in bins of 512 to 4096 words."""
    return packing.pack(packing.word_counts(docs))


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("personal_data", personal_data_stage),
    ("packing", packing_stage),
]
#: Hashing, learned scores and packing have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = C.materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
