"""A corpus from raw documents to packed sequences: toxicity, n-gram Jaccard join, substring dedup, benchmark decontamination, best-fit packing.

``STAGES`` lists (name, function), each function takes (spark, docs, sf_dir); ``run(spark, sf_dir)`` applies them to ``documents``. The stages are in ``svspark.llm.pipeline``.
"""

from svspark.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
