"""What the corpus operators leave with the driver."""

import pytest

from quarrykit.llm import common, components, near_dedup


def jobs(spark, name, work):
    """The result of ``work()`` and the number of Spark jobs it took."""
    spark.sparkContext.setJobGroup(name, name)
    try:
        out = work()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


def labels(links):
    return sorted((r["node"], r["label"]) for r in components.components(links).collect())


def test_written_tables_trim_the_driver(spark, monkeypatch):
    answers = []
    real = common.trim_driver
    monkeypatch.setattr(common, "trim_driver", lambda s: answers.append(real(s)))
    assert common.durable(spark.range(3), "three").count() == 3
    assert len(answers) == 1 and "Trim native heap" in answers[0]


def test_few_links_ask_for_no_hubs(spark, monkeypatch):
    links = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (3, 7)], "a long, b long")
    want = [(1, 1), (2, 1), (3, 1), (7, 1), (8, 8), (9, 8)]
    few, n = jobs(spark, "few", lambda: labels(links))
    monkeypatch.setattr(components, "HUB", 1)
    hubs, more = jobs(spark, "hubs", lambda: labels(links))
    assert few == hubs == want and n < more


@pytest.mark.parametrize("texts", [["one two three four five six", "other words that stand alone here"], [None, ""], []])
def test_no_candidates_end_early(spark, monkeypatch, texts):
    def never(*_):
        raise AssertionError("no pairs to look at")

    monkeypatch.setattr(near_dedup.Verifier, "alive", never)
    monkeypatch.setattr(near_dedup, "rare_mates", never)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted((r["doc_id"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(docs).collect()) == [(i, i, True) for i in range(len(texts))]
