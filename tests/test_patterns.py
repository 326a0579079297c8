"""Pattern dialects and text predicates against plain Python."""

import pytest
from pyspark.sql import functions as F

from girder.functions import patterns as P
from girder.functions import text as T

PATHS = ["a", "a::b", "b::a", "x::a::b", "ab", "a::bc", "domain", "p::domain::q", None]


def segments(x, p):
    if x is None:
        return None
    xs = x.split("::")
    if p == "*":
        return True
    front, back = p.startswith("*::"), p.endswith("::*")
    body = p[3 if front else 0 : len(p) - (3 if back else 0)]
    if not body or (front and back and len(p) < 6):
        return False
    bs = body.split("::")
    runs = [xs[i : i + len(bs)] == bs for i in range(len(xs) - len(bs) + 1)]
    if front and back:
        return any(runs)
    if front:
        return bool(runs) and runs[-1]
    if back:
        return bool(runs) and runs[0]
    return xs == bs


@pytest.mark.parametrize("pattern", ["*", "a::*", "*::b", "*::a::*", "*::domain::*", "a", "*::", "::*", "a::b", "*::a::b"])
def test_segment_globs(spark, pattern):
    df = spark.createDataFrame([(x,) for x in PATHS], "x string")
    got = {r["x"]: r["m"] for r in df.select("x", P.segments(F.col("x"), pattern).alias("m")).collect()}
    for x in PATHS:
        assert bool(got[x]) == bool(segments(x, pattern)), (x, pattern)


def test_name_globs_and_first_match(spark):
    df = spark.createDataFrame([("OrderManager",), ("manage",), ("x",)], "x string")
    rows = df.select("x", P.first_pattern(F.col("x"), ["*Manager", "man*", "*"], P.name_glob).alias("p"), P.any_pattern(F.col("x"), ["**"], P.name_glob).alias("n")).collect()
    assert [(r["x"], r["p"]) for r in rows] == [("OrderManager", "*Manager"), ("manage", "man*"), ("x", "*")]
    assert not any(r["n"] for r in rows)


def test_single_star_does_not_overlap(spark):
    df = spark.createDataFrame([("ab",), ("aab",), ("a",)], "x string")
    assert [r[0] for r in df.select(P.single_star(F.col("x"), "a*ab")).collect()] == [False, True, False]


@pytest.mark.parametrize(
    "text,error",
    [("Result<A, String>", "String"), ("Result<Map<K,V>, E<F,G>>", "E<F,G>"), ("Result<(A,B),::x::Err>", "x::Err"), ("Result<T>", None), ("Option<A>", None), ("std::result::Result<A,B>", "B"), (None, None)],
)
def test_result_error(spark, text, error):
    assert spark.createDataFrame([(text,)], "t string").select(T.result_error(F.col("t"))).first()[0] == error


def test_names(spark):
    df = spark.createDataFrame([("UserProfileDto", "email_address", "a::b::C", "&Option<&str>")], "n string, s string, y string, t string")
    r = df.select(
        T.stem(F.col("n")), T.concept_id(F.lit("EmailAddress")), T.snake_to_pascal(F.col("s")), T.short_name(F.col("y")), T.containing_module(F.col("y")),
        T.is_primitive(F.col("t")), T.mentions(F.lit("Vec<User>"), F.lit("User")), T.mentions(F.lit("UserDto"), F.lit("User")), T.snake_to_pascal(F.lit("a__b")),
    ).first()
    assert list(r) == ["UserProfile", "email-address", "EmailAddress", "C", "a::b", True, True, False, None]
