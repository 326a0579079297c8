"""What the driver holds: plans read a table once, jobs are planned a few at a time."""

from threading import Lock

from girder.operators.concepts import clusters
from girder.plans.policy import SAMPLE
from girder.plans.rules import Facts
from girder.scratch import at_once, materialize, together
from girder.sources.projection import StarFacts

SF = "/root/testdata/sf0.001"


def scans(df) -> int:
    return df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")


def test_cluster_plan_reads_members_not_their_joins(spark):
    x = Facts(StarFacts(spark, SF).storing(materialize), SAMPLE)
    found = clusters(*[x[t] for t in ("air_type", "air_field", "air_variant", "air_hint", "policy_concept", "air_conversion")])
    assert scans(found) <= 5  # 45 in the plan before: all joins before the members, several times
    assert found.count() > 0


def test_parts_of_the_same_columns_are_one_scan(spark):
    parts = [materialize(spark.range(i, i + 3).selectExpr("id", "cast(id as string) as s"), "part") for i in range(4)]
    odd = materialize(spark.createDataFrame([("x", 7)], "s string, id int"), "part")
    both = together(*parts, odd)
    assert scans(both) == 2 and len(both.parts) == 5
    want = sorted([(n, str(n)) for i in range(4) for n in range(i, i + 3)] + [(7, "x")])
    assert sorted(map(tuple, both.select("id", "s").collect())) == want


def test_few_jobs_at_a_time():
    from time import sleep

    lock, now, most = Lock(), [0], [0]

    def job(i):
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
        sleep(0.05)
        with lock:
            now[0] -= 1
        return i

    assert at_once([lambda i=i: job(i) for i in range(12)]) == list(range(12))
    assert most[0] <= 2
