"""The projection covers the whole of the star tables that it reads."""

import os

import pytest
from pyspark.sql import functions as F

from girder.sources.projection import StarFacts

DATA = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def facts(spark):
    return StarFacts(spark, DATA)


def test_every_order_that_meets_a_function_is_an_exception(facts):
    want = facts["orders"].join(facts["part"], F.col("o_orderkey") == F.col("p_partkey")).select("o_orderkey")
    got = facts["policy_exception"]
    assert sorted(r[0] for r in got.select("ix").collect()) == sorted(r[0] for r in want.collect())
    assert {r[0] for r in got.select("rule").distinct().collect()} == {"CX001", "FL", "DG003", "*", "RW001"}
    assert got.where("target not like '%:%'").count() > 0


def test_every_line_is_a_site_and_every_event_a_fact(facts):
    for table, made, key, of in (("lineitem", "air_call_site", "function", "l_partkey"), ("events", "air_fact", "symbol", "user_id")):
        fn = facts["air_function"].select((F.col("item_ix") / 8).alias("k"), "symbol")
        want = facts[table].join(fn, F.col(of) == F.col("k")).groupBy("symbol").count()
        assert dict(want.collect()) == dict(facts[made].groupBy(key).count().collect())


def test_every_site_is_an_action_some_in_functions_of_no_file(facts):
    """Actions stand at the call sites; some name a function that no file declares, or none."""
    places = ["item_ix", "path", "line_start"]
    by_place = lambda name: sorted(map(tuple, facts[name].groupBy(*places).count().collect()))
    assert by_place("air_truth_action") == by_place("air_call_site")
    own = facts["air_call_site"].select(*places, F.col("function").alias("own")).distinct()
    odd = facts["air_truth_action"].join(own, places).where("function is null or function <> own")
    assert odd.where("function is not null and function <> concat(own, '::inner')").count() == 0
    assert odd.where("function is null").count() > 0 and odd.where("function is not null").count() > 0


def test_joined_tables_are_written_once_when_stored(facts):
    written = []
    stored = facts.storing(lambda df, name: written.append(name) or df)
    for name in ("air_call_site", "air_match_arm", "air_literal", "air_truth_action", "air_function"):
        assert stored[name].columns == facts[name].columns
    assert sorted(written) == ["air_site", "part_file"]
