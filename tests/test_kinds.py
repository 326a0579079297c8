"""Facts of one kind: the same as all facts filtered, with little work a row."""

from collections import Counter

from girder import catalogue
from girder.operators import shared
from girder.plans import survey
from girder.sources.projection import LOOKUPS

SF = "/root/testdata/sf0.001"


def test_one_kind_is_all_kinds_filtered(spark):
    t = catalogue.sample_facts(spark, SF).tables
    facts = lambda only: shared.load_facts(t["air_fact"], t["air_call_site"], t["air_hint"], t["air_function"], only)
    every = Counter(facts(None).select("kind", "symbol", "item_ix", "source", "evidence").collect())
    for kind in ("Logging", "BlockingCall", "BackgroundWorker"):
        got = Counter(facts(kind).select("kind", "symbol", "item_ix", "source", "evidence").collect())
        assert got and got == Counter({k: n for k, n in every.items() if k["kind"] == kind})


def test_choices_of_the_projection_are_look_ups(spark):
    """A choice of dozens of arms cost microseconds a row, several times a row."""
    plan = catalogue.queries()["query_logging"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("WHEN") < 58
    keys = spark.createDataFrame([(-3,), (-1,), (0,), (1,), (57,), (58,), (None,)], "k long")
    for choice, lookup in LOOKUPS.items():
        if choice.startswith("CASE k %"):
            assert keys.where(f"not (({choice}) <=> ({lookup}))").count() == 0


def test_repeated_rows_keep_their_order(spark):
    n = [("b", 1), ("c", survey.BLOCK), ("d", 2 * survey.BLOCK + 1), ("e", survey.BLOCK + 1)]
    got = survey.repeated(spark.createDataFrame(n, "symbol string, n long").orderBy("symbol"), "n").collect()
    assert [r[0] for r in got] == [s for s, k in n for _ in range(k)]
