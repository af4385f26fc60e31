import collections
import random

import corpus_pipeline


def test_one_of_each_group_of_exact_copies_stays(spark):
    """Copies of texts of several lines, short or long, do not leave scraps of one-line chunks."""
    r = random.Random(10)
    rows = []
    for g in range(40):
        text = "\n".join(" ".join(f"w{r.randint(0, 9999)}" for _ in range(r.randint(1, 12))) for _ in range(r.choice([2, 3, 5, 12, 30])))
        rows += [(10 * g + k, text) for k in range(r.randint(2, 5))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    left = corpus_pipeline.without_repeated_lines(spark, docs, "")
    assert left.count() == len(rows)
    left = corpus_pipeline.without_near_copies(spark, left, "").collect()
    with_text = collections.Counter(x.doc_id for x in left if x.text)
    assert with_text == collections.Counter(range(0, 400, 10))
    assert {x.doc_id: x.text for x in left if x.text} == {d: t for d, t in rows if d % 10 == 0}
    assert len(left) == 41  # and one of the texts that became empty
