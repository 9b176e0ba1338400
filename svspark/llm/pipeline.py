"""A corpus from raw documents to packed sequences; ``corpus_pipeline.py`` at the top of the repository offers the stages.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which ``run``
writes as Parquet in the shared folder and reads again as the next one's documents.  All but the last
return the columns of documents.  All stages accept nulls in any column, empty texts and tables, repeated rows and
extra columns; each operator's docstring says what such rows get.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from svspark.llm import toxicity
from svspark.llm.decontaminate import decontaminate
from svspark.llm.jaccard import ngram_jaccard
from svspark.llm.packing import best_fit
from svspark.llm.repeats import remove_repeats
from svspark.llm.store import Workspace, fresh, small, trim


def _without(docs: DataFrame, rejected: DataFrame, how: str = "left_anti") -> DataFrame:
    """The rows of docs whose id and text are not among rejected (doc_id, k2); with left_semi, those that are."""
    k2, gone_id, gone_k2 = (fresh(docs.columns, c) for c in ("_k2", "_gone_id", "_gone_k2"))
    marked = docs.withColumn(k2, F.xxhash64(F.coalesce("text", F.lit(""))))
    gone = small(rejected.select(F.col("doc_id").alias(gone_id), F.col("k2").alias(gone_k2)), rejected.count())
    return marked.join(gone, F.col("doc_id").eqNullSafe(F.col(gone_id)) & (F.col(k2) == F.col(gone_k2)), how).drop(k2)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject.

    Defined cases: a null or empty text has the score of no words; without both labels in ``labels`` nothing is learned and all or none are rejected; an empty table stays empty.
    """
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    trim()
    return toxicity.keep_clean(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents tied by links of 0.8 and more on five-word shingles, the one with the least doc_id; of equal rows one.

    Defined cases: of a component without any id the text with the least hash stays; texts without words all stay, repeated ones once; an empty table stays empty.
    """
    work = Workspace(spark, "copies")
    found = work.save(ngram_jaccard(docs, ngram=5, num=80, den=100), "components")
    kept = _without(docs, work.save(found.where("not is_first").select("doc_id", "k2").distinct(), "rejected"))
    repeated = work.save(found.where("is_first").groupBy("doc_id", "k2").count().where("count > 1").select("doc_id", "k2"), "repeated")
    if not repeated.limit(1).count():
        return kept
    key = fresh(docs.columns, "_key")
    again = _without(kept, repeated, "left_semi").withColumn(key, F.xxhash64(F.coalesce("text", F.lit(""))))
    return _without(kept, repeated).unionByName(again.dropDuplicates(["doc_id", key]).drop(key))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 50 words and more that an earlier document or place holds.

    Defined cases: a null text becomes an empty one; rows with equal id and text are one document; documents stay even if nothing of them is left.
    """
    named = {c: f"carried{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text", "n_chars")}
    rows = docs.select("doc_id", "text", *(F.col(c).alias(k) for c, k in named.items()))
    kept = remove_repeats(rows, window=50, keep_first=True, original=True, carry=list(named.values()))
    return kept.select(*(F.col(named[c]).alias(c) if c in named else F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Defined cases: null and empty texts hold none; an empty benchmark rejects nothing; rows with equal id and text are judged alike.
    """
    work = Workspace(spark, "benchmark")
    found = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(docs, work.save(found.where("contaminated").select("doc_id", "k2").distinct(), "rejected"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in bins of several capacities.

    Defined cases: null and wordless texts are one piece of no words; null ids stay; an empty table gives no rows.
    """
    return best_fit(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("decontamination", drop_benchmark),
    ("packing", pack_sequences),
]

#: SQL cannot express these stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; the last stage's rows."""
    work = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = work.save(stage(spark, docs, sf_dir), name)
    return docs
