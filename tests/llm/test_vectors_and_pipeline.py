"""The embedding operator against brute force, the contracted queries and the pipeline over a folder of tables."""

import math
import sys
from pathlib import Path

import duckdb
import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import brute
import corpus_pipeline

from girder.llm import embedding_dedup, queries

DATA = "/root/testdata/sf0.001"


def check(spark, vectors, tile=4096):
    df = spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0) for i, v in vectors], "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_duplicates(df).collect()}
    unit = []
    for _, v in vectors:
        ok = v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)
        unit.append(np.array(v) / np.linalg.norm(v) if ok else None)
    near = lambda i, j: unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and float(unit[i] @ unit[j]) >= 0.9
    comp = brute.components(len(vectors), near)
    for k, (i, _) in enumerate(vectors):
        links = sum(near(k, j) for j in range(len(vectors)) if j != k)
        root = min(vectors[j][0] for j in range(len(vectors)) if comp[j] == comp[k])
        assert got[i] == (links, root, i == root), i


def test_links_match_brute_force(spark):
    r = np.random.default_rng(0)
    out, base = [], r.normal(size=(30, 16))
    for i in range(150):
        v = base[i % 30] + r.normal(size=16) * r.choice([0.0, 0.1, 0.3, 0.45])
        out.append((i * 2, list(v * r.uniform(0.1, 1e3))))
    out += [(1001, None), (1003, []), (1005, [0.0] * 16), (1007, [float("nan")] * 16), (1009, [None] + [1.0] * 15), (1011, [1.0, 0.0]), (1013, [2.0, 0.1]), (1015, [float("inf")] * 16)]
    check(spark, out)


def test_hot_cells_are_tiled(spark, monkeypatch):
    r = np.random.default_rng(1)
    centre = r.normal(size=8)
    vectors = [(i, list(centre + r.normal(size=8) * 0.25)) for i in range(80)]
    plain = embedding_dedup.links
    monkeypatch.setattr(embedding_dedup, "links", lambda v, least: plain(v, least, tile=9))
    check(spark, vectors)


def tiled(monkeypatch, tile):
    plain = embedding_dedup.links
    monkeypatch.setattr(embedding_dedup, "links", lambda v, least: plain(v, least, tile=tile))
    monkeypatch.setattr(embedding_dedup, "ROOM", 0, raising=False)


def test_no_stage_writes_many_copies_of_the_table(spark, monkeypatch):
    """Disk is in proportion to the vectors, whatever the number of tiles."""
    tiled(monkeypatch, 50)
    x = np.random.default_rng(3).normal(size=(1500, 64)).astype(np.float32)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>")
    sc = spark.sparkContext
    none = sc._jvm.java.util.ArrayList()
    written = lambda: {(s.stageId(), s.attemptId()): s.shuffleWriteBytes() for s in map(stages().apply, range(stages().size()))}
    stages = lambda: sc._jsc.sc().statusStore().stageList(none, False, False, sc._gateway.new_array(sc._jvm.double, 0), none)
    before = written()
    assert embedding_dedup.near_duplicates(df).where("n_links = 0").count() == 1500
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    assert 0 < max(n for k, n in written().items() if k not in before) < 6 * x.nbytes


def test_a_cosine_of_nine_tenths_links(spark):
    """As in SQL, where 9 / sqrt(10 * 10) is 0.9; so do vectors whose squares overflow a double."""
    one, two = [1.0] * 10 + [0.0], [1.0] * 9 + [0.0, 1.0]
    for scale in (1.0, 2.0**700):
        rows = [(1, [v * scale for v in one]), (2, [v * scale for v in two])]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        assert sorted(map(tuple, embedding_dedup.near_duplicates(df).collect())) == [(1, 1, 1, True), (2, 1, 1, False)]


@pytest.mark.parametrize("tiles", [1, 2, 3, 6, 7])
def test_every_two_tiles_meet_once(spark, tiles):
    body = spark.range(tiles).selectExpr("id as uid", "3 as dim", "1L as copies", "cast('' as binary) as x", f"{tiles} as tiles", "cast(id as int) as t")
    met, most = [], 0
    for lo in range(0, tiles // 2 + 1, 2):
        groups = {}
        for r in embedding_dedup.dealt(body, lo, lo + 2).collect():
            groups.setdefault((r["round"], r["left"]), []).append((r["side"], r["uid"]))
        most = max(most, sum(map(len, groups.values())))
        met += [tuple(sorted(u for _, u in g)) for g in groups.values()]
    assert sorted(met) == sorted([(a,) for a in range(tiles)] + [(a, b) for a in range(tiles) for b in range(a + 1, tiles)])
    assert most <= 4 * tiles


@pytest.mark.parametrize("inner", [True, False])
def test_tiles_of_near_copies_match_brute_force(inner):
    """Crowds, whose products are settled in single precision, chains of links and lone vectors, in both precisions."""
    import pandas as pd

    r = np.random.default_rng(5)
    crowd = r.normal(size=(3, 48))[r.integers(0, 3, 900)] + r.normal(size=(900, 48)) * r.choice([0.01, 0.3, 0.33], 900)[:, None]
    turn = np.arange(300) * 0.4
    chain = np.c_[np.cos(turn) * np.exp(-turn / 99), np.sin(turn), turn / 9, np.zeros((300, 45))]
    x = r.permutation(np.r_[crowd, chain, r.normal(size=(400, 48))])
    x[::2] = x[::2].astype(np.float32)
    copies = r.integers(1, 4, len(x))
    rows = pd.DataFrame({"uid": np.arange(len(x)), "copies": copies, "x": [v.astype(np.float32 if k % 2 == 0 else np.float64).tobytes() for k, v in enumerate(x)]})
    half = len(x) if inner else 700
    one = embedding_dedup.Tile(rows[:half], 48)
    two = one if inner else embedding_dedup.Tile(rows[half:], 48)
    counts, root = embedding_dedup.met(one, two, 0.9)
    uid = one.uid if inner else np.r_[one.uid, two.uid]
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    if not inner:
        near[:half, :half] = near[half:, half:] = False
    assert np.array_equal(counts[np.argsort(uid)], near.astype(int) @ copies) and near.sum() > 100_000 * (1 + inner)
    comp = brute.components(len(x), lambda i, j: near[i, j])
    names = lambda c: [min(k for k in range(len(x)) if c[k] == c[i]) for i in range(0, len(x), 7)]
    assert names(uid[root][np.argsort(uid)]) == names(comp)


def test_empty_tiles(spark, monkeypatch):
    """Fewer vectors than tiles are dealt evenly by chance only."""
    tiled(monkeypatch, 1)
    r = np.random.default_rng(6)
    check(spark, [(i, list(r.normal(size=3))) for i in range(9)])


def test_null_and_repeated_keys(spark):
    """Rows of one key are copies or links of each other; a null key links, but names no component that has another."""
    near = [1.0, 0.1]
    rows = [(5, [1.0, 0.0]), (5, [1.0, 0.0]), (5, near), (None, [1.0, 0.0]), (None, near), (None, [0.0, 1.0]), (None, None), (9, [-0.0, 3.0]), (None, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, embedding_dedup.near_duplicates(df).collect()), key=str)
    want = [(5, 4, 5, True)] * 3 + [(None, 4, 5, False)] * 2 + [(None, 1, 9, False), (9, 1, 9, True), (None, 0, None, False), (None, 0, None, False)]
    assert got == sorted(want, key=str)


def test_empty_embeddings(spark):
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


CONTRACT = {
    "op1_mix_sources": ["doc_id", "size", "source_size", "target", "taken"],
    "op2_line_dedup": ["doc_id", "n_lines", "n_dropped", "kept_sha256"],
    "op3_language_id": ["doc_id", "held_out", "lang_pred", "score"],
    "op4_imatch": ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    "op5_suffix_dedup": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    "op6_embedding_dedup": ["vec_id", "n_links", "component_id", "kept"],
    "op7_simhash": ["doc_id", "fingerprint", "component_id"],
    "op8_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op9_secrets": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
    "op10_pack": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
    "op11_fill_in_middle": ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"],
    "op12_pii": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
    "op13_hard_negatives": ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"],
}


@pytest.mark.parametrize("name", CONTRACT)
def test_contracted_columns_and_rows(spark, name):
    df = queries.queries()[name](spark, DATA)
    assert df.columns == CONTRACT[name]
    rows = df.count()
    if name == "op10_pack":
        assert rows >= 200
    elif name not in ("op6_embedding_dedup", "op13_hard_negatives"):
        assert rows == 200


@pytest.mark.parametrize("name", queries.ORACLES)
def test_oracles(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = sorted(con.sql(queries.ORACLES[name]).fetchall())
    assert sorted(map(tuple, queries.queries()[name](spark, DATA).collect())) == want


def test_base_secrets_against_plain_patterns(spark):
    """The base spans of a table's texts by the contract's own patterns, scanned one by one."""
    import hashlib
    import re

    key = "(?:" + "|".join("".join(f"[{c}{c.upper()}]" for c in w) for w in ("password", "passwd", "secret", "token", "api")).replace("[aA][pP][iI]", "[aA][pP][iI]_?[kK][eE][yY]") + ")"
    patterns = [("assign", rf"{key}[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 1, 6), ("access", r"AKIA[A-Z0-9]+", 0, 20), ("hex", r"[0-9a-f]+", 0, 24)]
    got = {r["doc_id"]: r for r in queries.op9_secrets(spark, DATA).collect()}
    for r in spark.read.parquet(f"{DATA}/documents.parquet").collect():
        spans = []
        for k, (name, pattern, group, least) in enumerate(patterns):
            mine = [(m.start(), k, f"{name}:{m.start()}:{m.end()}") for m in re.finditer(pattern, r["text"] or "") if len(m.group(group)) >= least]
            assert got[r["doc_id"]][f"n_{name}"] == len(mine)
            spans += mine
        assert got[r["doc_id"]]["base_sha256"] == hashlib.sha256(",".join(x[2] for x in sorted(spans)).encode()).hexdigest()


def test_pipeline_stages_take_effect(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    stage = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "simhash near-dedup", "mixing", "packing"]
    clean = stage["toxicity"](spark, docs, DATA)
    assert clean.columns == docs.columns and 0 < clean.count() <= docs.count()
    lined = stage["line dedup"](spark, docs, DATA)
    want = brute.lines(list(text.items()))
    assert {r["doc_id"]: r["text"] for r in lined.collect()} == {i: v[2] for i, v in want.items()}
    once = stage["simhash near-dedup"](spark, docs, DATA)
    ids = sorted(text)
    fps = [brute.simhash(text[i]) for i in ids]
    comp = brute.components(len(ids), lambda a, b: bin(fps[a] ^ fps[b]).count("1") <= 4)
    assert sorted(r["doc_id"] for r in once.collect()) == [i for k, i in enumerate(ids) if comp[k] == k]
    mixed = stage["mixing"](spark, docs, DATA)
    taken = {r["doc_id"]: r["taken"] for r in queries.op1_mix_sources(spark, DATA).collect()}
    words: dict[int, int] = {}
    for r in mixed.collect():
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + len(brute.WORD.findall(r["text"]))
    assert mixed.columns == docs.columns and words == {i: n for i, n in taken.items() if n}


def test_pipeline_runs(spark):
    out = corpus_pipeline.run(spark, DATA)
    total = out.groupBy("sequence_id").sum("length").collect()
    assert total and max(r[1] for r in total) <= 4096


def test_base_personal_data_against_plain_patterns(spark):
    """The base spans of a table's texts by the contract's own patterns, scanned one by one."""
    import hashlib
    import re

    def base(text):
        out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
        out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
        for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
            d = [int(c) for c in m[0] if c.isdigit()][::-1]
            if 16 <= len(d) <= 19 and (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0:
                out.append(("card", *m.span()))
        return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]

    folder = DATA.replace("sf0.001", "sf0.01")
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    for r in queries.op12_pii(spark, folder).collect():
        want = ",".join(f"{k}:{s}:{e}" for k, s, e in base(texts[r["doc_id"]]))
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest() and r["spans"].startswith(want)
