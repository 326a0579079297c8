"""Personal data: base shapes against plain patterns, discovery against plain loops over the same mentions."""

import random
import re
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from girder.llm import pii


def plain_base(text):
    """The contract's patterns as they stand."""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((0, m.start(), m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((1, m.start(), m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c not in " -"]
        total = sum(x if n % 2 == 0 else (2 * x if x < 5 else 2 * x - 9) for n, x in enumerate(d[::-1]))
        if 16 <= len(d) <= 19 and total % 10 == 0:
            out.append((2, m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= sum(c in "0123456789" for c in m[0]) <= 15:
            out.append((3, m.start(), m.end()))
    return out


@given(st.text(st.sampled_from("a.@%b-1259 +()é\n٣"), max_size=60))
@settings(max_examples=600, deadline=None)
def test_base_shapes(text):
    assert pii.base_spans(text) == plain_base(text)


@given(st.lists(st.sampled_from(["4000 0000 0000 0002", "378282246310005", "10.0.0.256", "1.2.3.4", "+1 (234) 567-8901", "a@b.co", "x@y", "@", ".", " ", "-", "+", "0" * 5000 + "1.2.3.4"]), max_size=12))
@settings(max_examples=200, deadline=None)
def test_base_shapes_run_together(parts):
    text = "".join(parts)
    if not re.search("[0-9]{4301}", text):  # plain int() refuses those
        assert pii.base_spans(text) == plain_base(text)
    else:
        pii.base_spans(text)


def plain_find(texts, support=3, least=0.5):
    """{row: spans} by loops: every run of words counted over all texts, the same scores in turn."""
    words = pii.Words()
    base = [pii.base_spans(t or "") for t in texts]
    found = [pii.mentions(t or "", words, b) for t, b in zip(texts, base)]
    total = Counter(int(h) for t in texts for a in pii.grams(pii.hashed(words, re.findall(r"\w+|[^\w\s]", t or ""))) for h in a)
    edges, seeds = defaultdict(Counter), set()
    for row in found:
        for m in row:
            if m["seed"]:
                seeds.add(m["value"])
            for side in ("left", "right"):
                for g in m[side]:
                    edges[side, g][m["value"]] += 1
    edges = {p: c for p, c in edges.items() if len(c) >= support and sum(c.values()) >= least * (total[p[1]] + 1)}
    score = {v: float(v in seeds) for c in edges.values() for v in c}
    while True:
        good = {}
        for p, c in edges.items():
            s = round(sum(n * score[v] for v, n in c.items()) / (total[p[1]] + 1), 4)
            if sum(score[v] for v in c) >= support and s >= least:
                good[p] = s
        new = {v: max([score[v], *(s for p, s in good.items() if v in edges[p])]) for v in score}
        if new == score:
            break
        score = new
    known = seeds | {v for v, s in score.items() if s >= least}
    return [b + sorted((4, m["start"], m["end"]) for m in row if not m["seed"] and m["value"] in known) for b, row in zip(base, found)]


def corpus(seed=1):
    r = random.Random(seed)
    vocab = ["of", "the", "and", *("".join(r.choice("abcdefgh") for _ in range(4)) for _ in range(80))]
    prose = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    texts = [prose(r.randint(5, 60)) for _ in range(60)]
    phone = lambda: f"+1 ({r.randint(200, 999)}) 555-{r.randint(1000, 9999)}"
    texts += [f"{prose(8)} Reach me by phone: {phone()} {prose(5)}" for _ in range(6)]
    texts += [f"{prose(8)} reach me by phone: {x}. {prose(5)}" for x in ("0171-2345678", "(030) 4455 667")]  # unseen shapes
    texts += [f"{prose(3)} member no. {x} of our club {prose(3)}" for x in ("AB-1234-99", "0171-2345678", "ZQ-7781-02", "(030) 4455 667", "+1 (222) 555-1234", "0171-2345678")]
    texts += [f"{prose(4)} the {x} {prose(4)}" for x in ("4441239807", "9807915762804490", phone(), "me@x.org", "10.1.2.3")]  # no pattern: the is everywhere
    copy = f"order 555-{r.randint(1000, 9999)} {prose(6)} call {phone()}"
    texts += [copy] * 8  # copies are one entity
    texts += [f"{prose(4)} 0171-2345678 {prose(2)}", "1 222 555 1234", None, "", "   ", "word " * 50_000 + "reach me by phone: 0999-123456"]
    return texts


def spans(df):
    out = defaultdict(list)
    for x in df.collect():
        out[x.doc_id].append([(pii.KINDS.index(s["kind"]), s["start"], s["end"]) for s in x.spans])
    return out


def test_discovery_against_plain_loops(spark):
    texts = corpus()
    df = spark.createDataFrame([(i, t, "s", 0) for i, t in enumerate(texts)], "doc_id long, text string, spans string, uid int").repartition(5)
    got, want = spans(pii.find(df)), plain_find(texts)
    assert {i: v[0] for i, v in got.items()} == dict(enumerate(want))
    said = {texts[i][s:e] for i, v in enumerate(want) for k, s, e in v if k == 4}
    assert {"0171-2345678", "(030) 4455 667", "0999-123456", "1 222 555 1234"} <= said
    assert not said & {"4441239807", "9807915762804490"} and not any("order" in texts[i] for i, v in enumerate(want) for k, *_ in v if k == 4)


@pytest.mark.parametrize("support,least", [(2, 0.3), (4, 0.7)])
def test_discovery_under_other_limits(spark, support, least):
    texts = corpus(3)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = spans(pii.find(df, support, least))
    assert {i: v[0] for i, v in got.items()} == dict(enumerate(plain_find(texts, support, least)))


def test_false_alarms_of_the_filter_change_nothing(spark):
    texts = corpus(5)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    each = pii.extract(df).selectExpr("explode(mentions) as m").select("m.*")
    few, many = ({(r.side, r.gram, r.score) for r in pii.discover(each, df, bits=b)[0].collect()} for b in (64, 1 << 20))
    assert few == many and few


def test_edges(spark):
    rows = [(None, "a@b.co"), (None, "a@b.co"), (1, None), (1, ""), (1, "10.0.0.1")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = spans(pii.find(df))
    assert got[None] == [[(0, 0, 6)]] * 2 and sorted(got[1]) == [[], [], [(1, 0, 8)]]
    assert pii.find(df.limit(0)).collect() == [] and len(pii.find(df.where("doc_id is not null and text is null")).collect()) == 1


def test_long_runs_take_linear_time():
    for text in ("a" * 300_000, "1" * 300_000, "a.-" * 100_000 + "@", "+" * 100_000, "1 " * 150_000, "1.1." * 50_000, "(" * 100_000 + "1"):
        base = pii.base_spans(text)
        pii.mentions(text, pii.Words(), base)
