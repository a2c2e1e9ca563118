"""Held-out figures of the README: python tests/llm/heldout.py FOLDER [CORES].

Labels and languages with crc32(doc_id) mod 5 = 0 are held out, all others are learnt from.
"""

import os
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from provara.llm import langid, quality, toxicity
from provara.session import ship, table


def main(folder: str, cores: str = "4") -> None:
    config = {"spark.ui.enabled": "false", "spark.checkpoint.dir": tempfile.mkdtemp(prefix="spark-", dir="/tmp"), "spark.driver.memory": "4g"}
    spark = SparkSession.builder.master(f"local[{cores}]").config(map=config).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    docs, labels = (table(spark, folder, name) for name in ("documents", "labels"))
    out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    for name, label, fit, score, told in (
        ("quality", "quality", quality.fit_quality, quality.score_quality, "keep"),
        ("toxicity", "toxic", toxicity.fit_toxicity, toxicity.score_toxicity, "toxic"),
    ):
        rated = labels.select("doc_id", F.col(label).alias("grade")).where("grade is not null")
        model = fit(docs, rated.where(~out))
        found = score(docs.join(rated.where(out), "doc_id"), model).select("grade", F.col(told).cast("int").alias("p"))
        c = {(r.grade, r.p): r.n for r in found.groupBy("grade", "p").agg(F.count(F.lit(1)).alias("n")).collect()}
        hit, n = c.get((1, 1), 0), sum(c.values())
        positives, said = hit + c.get((1, 0), 0), hit + c.get((0, 1), 0)
        print(f"{name}: held out {n}, positives {positives}, precision {hit / max(said, 1):.3f}, recall {hit / max(positives, 1):.3f}, accuracy {(hit + c.get((0, 0), 0)) / max(n, 1):.3f}")
    model = langid.fit_languages(docs.where(~out))
    got = langid.with_language(docs.where(out).where("lang is not null"), model)
    n, right = got.agg(F.count(F.lit(1)), F.count_if(F.col("lang") == F.col("lang_pred"))).first()
    print(f"language: held out {n}, accuracy {right / max(n, 1):.4f}")
    spark.stop()


if __name__ == "__main__":
    main(*sys.argv[1:])
