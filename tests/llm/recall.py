"""python tests/llm/recall.py FOLDER...: of the true 20 nearest, what part op8 finds, and what part of the links and components op2 finds, by brute force."""

import sys
from pathlib import Path

import numpy as np

sys.path[:0] = [str(Path(__file__).parents[2])]


def main(folders: list[str]) -> None:
    from pyspark.sql import SparkSession

    from prismlake.llm.queries import QUERIES
    from prismlake.plans.shipping import ship

    conf = {"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false"}
    spark = SparkSession.builder.master("local[8]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    for folder in folders:
        t = spark.read.parquet(f"{folder}/embeddings.parquet").where("embedding is not null and vec_id is not null").toPandas()
        x, ids, label = np.stack(t.embedding).astype("f8"), t.vec_id.to_numpy(), t.label.to_numpy()
        got = QUERIES["op8_beam_nearest"](spark, folder).toPandas().groupby("query_id").score.apply(lambda s: np.sort(s)[::-1])
        right = total = 0
        for q, have in got.items():
            score = x[ids != q] @ x[np.flatnonzero(ids == q)[0]]
            want = np.sort(score)[::-1][:20]
            right += sum(have >= want[-1] - 1e-12)
            total += len(want)
        unit = x / np.sqrt((x * x).sum(1, keepdims=True))
        links = np.zeros(len(x), "i8")
        for lab in np.unique(label):
            own = np.flatnonzero(label == lab)
            for s in range(0, len(own), 1000):
                links[own[s : s + 1000]] = (unit[own[s : s + 1000]] @ unit[own].T >= 0.98).sum(1) - 1
        near = QUERIES["op2_near_vectors"](spark, folder).toPandas().set_index("vec_id").n_links.reindex(ids).to_numpy()
        print(f"{folder}: op8 {right / total:.4f} of {total} nearest; op2 {near.sum() // 2} of {links.sum() // 2} links, {(near == links).mean():.4f} of the counts equal")


if __name__ == "__main__":
    main(sys.argv[1:])
