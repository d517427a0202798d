"""Nearest reference person of each face."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from prismlake.functions.vector import MATCH, dot

#: Bytes of reference vectors that go along with each task, or make a block where there are more.
BLOCK = 64 << 20


def best_match(faces: DataFrame, people: DataFrame, key: str = "face", threshold: float = MATCH, block: int = BLOCK) -> DataFrame:
    """(key, person, similarity) of each face: the person of the most alike reference, null under the threshold.

    faces: key, embedding; people: person, photo, embedding. The first reference by (person, photo) wins ties; NaN
    is never a match. References of up to ``block`` bytes, which are measured, go to all tasks. More are cut into
    blocks of that size: each face meets each block in a task of its own part, and the best of the blocks' best wins.
    """
    refs = people.select("person", "photo", F.col("embedding").alias("__ref"))
    size = refs.agg(F.sum(F.size("__ref") * 8 + F.octet_length(F.concat_ws("", F.col("person").cast("string"), F.col("photo").cast("string"))) + 64)).first()[0] or 0
    if size <= block:
        scored = faces.join(F.broadcast(refs), F.lit(True), "left")
    else:
        blocks, parts = -(-size // block), max(8, int(faces.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(int(n) - 1)))
        refs = refs.withColumn("__block", F.pmod(F.xxhash64("person", "photo", "__ref"), F.lit(blocks)).cast("int")).withColumn("__part", every(parts))
        asked = faces.withColumn("__part", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")).withColumn("__block", every(blocks))
        scored = asked.join(refs, ["__block", "__part"], "left")
    scored = scored.withColumn("__s", dot(F.col("embedding"), F.col("__ref")))
    usable = F.when(~F.isnan("__s"), F.struct(-F.col("__s"), F.col("person"), F.col("photo")))
    top = scored.groupBy(key).agg(F.min(usable).alias("top"))
    similarity = -F.col("top.col1")
    return top.select(key, F.when(similarity >= threshold, F.col("top.person")).alias("person"), similarity.alias("similarity"))


def face_counts(matches: DataFrame, file: str = "file", order: str | None = None) -> DataFrame:
    """(file, people, unknown_faces, face_count): names of matched faces as a list, one for each face, by ``order`` or by name."""
    name = F.col("person") if order is None else F.when(F.col("person").isNotNull(), F.struct(F.col(order).alias("o"), "person"))
    people = F.array_sort(F.collect_list(name))
    people = people if order is None else F.transform(people, lambda x: x["person"])
    return matches.groupBy(file).agg(people.alias("people"), F.count_if(F.col("person").isNull()).alias("unknown_faces"), F.count("*").alias("face_count"))
