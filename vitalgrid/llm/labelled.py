"""The bounded sample of labelled documents that the classifiers are fitted on.

The bounds are parameters: documents of each class, and characters of a document. Documents of the smallest id hashes are
taken; of a longer text one piece, placed by hash. The held-out fold never takes part. Null labels and ids do not count,
repeated labels of a document count once by their minimum, and repeated documents once by the smallest text.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalgrid.llm.common import cut_lineage, fold


def training_labels(labels: DataFrame, label: str, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, label) of labelled documents outside the held-out fold."""
    rows = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull() & (fold(F.col(id_col)) != 0))
    return rows.groupBy(F.col(id_col).alias("doc_id")).agg(F.min(F.col(label).cast("int")).alias("label"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, max_chars: int, id_col: str = "doc_id",
                    text_col: str = "text") -> tuple[pd.DataFrame, dict[int, int]]:
    """At most `per_class` documents of each class, and the classes' sizes among all training rows."""
    known = cut_lineage(training_labels(labels, label, id_col), "labels")
    shares = {int(r["label"]): int(r["n"]) for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    chosen = None
    for c in shares:
        part = known.where(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        chosen = part if chosen is None else chosen.union(part)
    if chosen is None:
        return pd.DataFrame({"text": [], "label": []}), shares
    chosen = cut_lineage(chosen, "sample").withColumnRenamed("doc_id", "_chosen")
    plain = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    text = F.col("_text")
    room = F.greatest(F.length(text) - max_chars, F.lit(0))
    piece = F.substr(text, (F.pmod(F.xxhash64("_id"), room + 1) + 1).cast("int"), F.lit(max_chars))
    rows = plain.join(chosen, F.col("_id") == F.col("_chosen")).groupBy("_chosen", "label").agg(F.min(piece).alias("text"))
    return rows.toPandas().sort_values("_chosen", ignore_index=True), shares
