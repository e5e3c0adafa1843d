"""Executors need no copy of the package: every operator runs from another folder, with no path to the repository in the workers' environment."""

import os
import subprocess
import sys
from pathlib import Path

REPO = str(Path(__file__).resolve().parents[2])

SCRIPT = f"""
import sys
sys.path.insert(0, {REPO!r})
import numpy as np
from pyspark.sql import SparkSession, functions as F
import corpus_pipeline
from docmill.llm import langid, neighbours, queries, scoring
from docmill.operators import clean
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", sys.argv[1]).getOrCreate()
rows = [(i, ("the house window " if i % 2 else "das haus fenster ") * 9 + str(i), "en" if i % 2 else "de", "s", 9) for i in range(24)]
docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
docs.write.parquet(sys.argv[1] + "/in/documents.parquet")
rng = np.random.default_rng(1)
spark.createDataFrame([(i, rng.standard_normal(8).tolist()) for i in range(60)], "vec_id long, embedding array<float>").write.parquet(sys.argv[1] + "/in/embeddings.parquet")
spark.createDataFrame([(c, t, ("user", "assistant")[t % 2], f"turn {{t % 3}}.") for c in range(9) for t in range(5)], "conv_id long, turn long, role string, text string").write.parquet(sys.argv[1] + "/in/conversations.parquet")
made = queries.queries()
for name in sorted(made):
    assert made[name](spark, sys.argv[1] + "/in").count() > 0, name
    print(name, flush=True)
assert corpus_pipeline.run(spark, sys.argv[1] + "/in").count() > 0
assert clean.normalize_unicode(docs.withColumn("text", F.lit("\\ufb01n"))).first().text == "fin"
print("done")
"""


def test_every_operator_from_a_foreign_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"SPARK_LOCAL_IP": "127.0.0.1"}
    (tmp_path / "work").mkdir()
    ran = subprocess.run([sys.executable, "-c", SCRIPT, str(tmp_path / "work")], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert ran.stdout.endswith("done\n"), ran.stdout[-500:] + ran.stderr[-3000:]
