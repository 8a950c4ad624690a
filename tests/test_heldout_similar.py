from compare import SF
from pyspark.sql import functions as F

from siltstone.plans import audit as A


def test_instruction_or_answer_like_the_behaviour_notes(spark, tmp_path):
    words = lambda name, n: " ".join(f"{name}{k}" for k in range(n))
    notes, prompt = words("note", 22), words("ask", 22)
    half = words("note", 14)  # 12 of 20 trigrams: 0.6
    less = words("note", 12)  # 10 of 20: 0.5
    rows = [("r1", notes, "no"), ("r2", "do it", notes), ("r3", half, notes), ("r4", less, "no"), ("r5", prompt, "no"), ("r6", words("ask", 11), notes), ("r7", "do it", prompt), ("r8", half, None), ("r9", None, less)]
    made = spark.createDataFrame([(*r, 1) for r in rows], "id string, instruction string, answer string, batch int").withColumn("received_at", F.current_timestamp())
    accepted = spark.read.parquet(f"{SF}/{A.ACCEPTED}.parquet").limit(0)
    accepted.unionByName(made, allowMissingColumns=True).write.parquet(f"{tmp_path}/{A.ACCEPTED}.parquet")
    spark.createDataFrame([("e1", prompt, notes), ("e2", prompt, None), ("e3", None, "")], "id string, prompt string, expected_behavior_notes string").write.parquet(f"{tmp_path}/{A.HELDOUT}.parquet")
    got = sorted((r["id"], r["eval_id"], r["score"]) for r in A.heldout_similar(spark, str(tmp_path)).collect())
    assert got == sorted([("r1", "e1", 1.0), ("r2", "e1", 1.0), ("r3", "e1", 1.0), ("r5", "e1", 1.0), ("r5", "e2", 1.0), ("r6", "e1", 1.0), ("r6", "e1", 0.45), ("r6", "e2", 0.45), ("r8", "e1", 0.6)])
