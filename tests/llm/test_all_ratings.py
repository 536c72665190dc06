import random

from quillspark.llm import readability


def test_all_ratings_reach_the_difficulties(spark):
    rng = random.Random(4)
    easy, hard = [[f"{kind}{i}" for i in range(30)] for kind in ("plain", "arcane")]
    docs = [(i, "the and of to in is " + " ".join(rng.choices(hard if i % 2 else easy, k=60))) for i in range(60)]
    labels = [(i, 1, 5 if i % 2 else 1) for i in range(60)]
    d, r = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, rater int, reading_level int")
    few, every = ({x.doc_id: round(x.difficulty, 6) for x in readability.reading_levels(d, r, rated=n).collect()} for n in (6, 1000))
    assert few == every and min(few[i] for i in range(1, 60, 2)) > max(few[i] for i in range(0, 60, 2))
