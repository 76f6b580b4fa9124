"""Settings of the toxicity classifier by cross-validation inside the rows that labels may be learned from.

    python -m inkwell.llm.toxicity_settings /root/testdata/sf0.1

Rows that are held out take no part. The others are four folds (crc32 of the key, modulo 5: 1 to 4); each setting is fitted on three
and judged on the fourth. The line with the smallest mean log loss is the setting to use; ties go to fewer features.
"""

from __future__ import annotations

import json
import math
import sys

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm import toxicity

GRID = [{"orders": orders, "min_z": min_z} for orders in ((2, 3, 4), (3, 4, 5), (4, 5, 6)) for min_z in (2.5, 3.5)]
FOLDS = (1, 2, 3, 4)


def fold(key: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(f"`{key}`").cast("string")) % 5, F.lit(0))


def judged(docs: DataFrame, labels: DataFrame, grid: list[dict] = GRID) -> list[dict]:
    """Each setting with its mean accuracy, recall of toxic rows, precision and log loss over the folds; the best first."""
    out = []
    for setting in grid:
        right = n = loss = both = found = toxic = 0
        for one in FOLDS:
            model = toxicity.fit(toxicity.sample(labels, docs, held_out=fold().isin(0, one)), **setting)
            asked = docs.filter(fold() == one).join(labels.filter("toxic is not null").select("doc_id", "toxic"), "doc_id")
            score, y = F.col("score"), (F.col("toxic") > 0).cast("int")
            sure = F.greatest(F.least(score, F.lit(1 - 1e-9)), F.lit(1e-9))
            r = toxicity.scored(asked, model).agg(
                F.count("*").alias("n"), F.count_if((score >= 0.5) == (y == 1)).alias("right"), F.sum(-F.when(y == 1, F.log(sure)).otherwise(F.log(1 - sure))).alias("loss"),
                F.count_if((score >= 0.5) & (y == 1)).alias("both"), F.count_if(score >= 0.5).alias("found"), F.count_if(y == 1).alias("toxic"),
            ).first()
            n, right, loss = n + r["n"], right + r["right"], loss + (r["loss"] or 0)
            both, found, toxic = both + r["both"], found + r["found"], toxic + r["toxic"]
        share = lambda a, b: round(a / b, 4) if b else math.nan
        out.append({**setting, "rows": n, "accuracy": share(right, n), "recall": share(both, toxic), "precision": share(both, found), "log_loss": share(loss, n)})
    return sorted(out, key=lambda r: (r["log_loss"], -r["min_z"]))


def main() -> None:
    from inkwell.session import build_session, table

    spark = build_session("settings", "local[8]", 8, "8g")
    spark.sparkContext.setLogLevel("ERROR")
    docs = table(spark, sys.argv[1], "documents").select("doc_id", "text")
    for line in judged(docs, table(spark, sys.argv[1], "labels").select("doc_id", "toxic")):
        print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
