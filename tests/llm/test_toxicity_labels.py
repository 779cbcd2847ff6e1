"""Texts meet their labels the same way at every size."""

from barloom.llm import toxicity
from barloom.llm.frames import fold


def test_labels_meet_texts(spark):
    texts = spark.createDataFrame([(i, f"text {i}" if i % 9 else None) for i in range(200)] + [(7, "again 7"), (None, "no id")], "__id long, text string")
    train = spark.createDataFrame([(i, i % 2) for i in range(0, 260, 3)], "id long, label int").filter(fold("id", 4) != 2)
    got = toxicity.with_labels(texts, train, 4, 2)
    known = {r.id: r.label for r in train.collect()}
    order = lambda rows: sorted(rows, key=str)
    assert order([tuple(r) for r in got.collect()]) == order([(r.text, known.get(r["__id"])) for r in texts.collect()])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
