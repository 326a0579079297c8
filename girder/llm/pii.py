"""Personal data: fixed shapes seed lexical patterns, and patterns that Spark finds reliable discover further identifiers."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, map_texts, materialize

#: Kinds in the order of their spans; ``context`` is what only its surroundings give away.
KINDS = ("email", "ip", "card", "phone", "context")

# fixed values: the base patterns. Runs are possessive and begin where a run begins, which finds the same matches in linear time.
_LOCAL, _DOMAIN = r"[A-Za-z0-9._%+-]", r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_EMAIL, _EMAIL_HERE = re.compile(rf"(?<!{_LOCAL}){_LOCAL}++@{_DOMAIN}"), re.compile(rf"{_LOCAL}++@{_DOMAIN}")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_DIGITS = re.compile(r"[0-9]")
#: A piece of an identifier: letters, digits and the marks inside names and numbers, with a digit or an at sign.
_MARK = r"@+.#/()_-"
_PIECE = re.compile(rf"(?<![\w{_MARK}])(?:[^\W0-9]|[+.#/()-])*+[0-9@][\w{_MARK}]*+")
#: Letters and digits that an identifier has at least, and digits among them unless it has an at sign.
LEAST_SIGNS, LEAST_DIGITS = 6, 4
#: Words and marks, the units of a context.
_TOKEN = re.compile(r"\w+|[^\w\s]")
#: Units either side of an identifier that a pattern may span.
REACH = 3
#: Words whose hashes a Python worker remembers.
WORD_CACHE = 500_000


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def _emails(text: str) -> Iterator[re.Match]:
    at = 0
    m = _EMAIL.search(text)
    while m:
        yield m
        at = m.end()  # the rest of a run that a match has used may begin the next one
        m = _EMAIL_HERE.match(text, at) or _EMAIL.search(text, at)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the fixed shapes, each kind leftmost and non-overlapping, failing matches dropped."""
    out = []
    if "@" in text:
        out += [(0, m.start(), m.end()) for m in _emails(text)]
    if not _DIGITS.search(text):
        return out
    if "." in text:
        out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_DIGITS.findall(m[0])) <= 15]
    return out


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Other strings that look like identifiers: pieces with a digit or an at sign, one space apart, clear of base spans."""
    taken: list[list[int]] = []
    for _, s, e in sorted(base, key=lambda x: x[1:]):
        if taken and s < taken[-1][1]:
            taken[-1][1] = max(e, taken[-1][1])
        else:
            taken.append([s, e])
    k = 0
    chains: list[list[int]] = []
    for m in _PIECE.finditer(text):
        s, e = m.span()
        while k < len(taken) and taken[k][1] <= s:
            k += 1
        if k < len(taken) and taken[k][0] < e:
            continue
        if chains and s == chains[-1][1] + 1 and text[s - 1] == " ":
            chains[-1][1] = e
        else:
            chains.append([s, e])
    out = []
    for s, e in chains:
        while s < e and text[s] in ".-/)#_" or s < e and text[s] == "(" and ")" not in text[s:e]:
            s += 1
        while s < e and text[e - 1] in ".-/(#+_" or s < e and text[e - 1] == ")" and "(" not in text[s:e]:
            e -= 1
        part = text[s:e]
        digits = len(_DIGITS.findall(part))
        if sum(c.isalnum() for c in part) >= LEAST_SIGNS and (digits >= LEAST_DIGITS or "@" in part):
            out.append((s, e))
    return out


class Words(dict):
    """Hash of each word, lower-cased and with its numbers made equal."""

    def __missing__(self, word: str) -> int:
        if len(self) > WORD_CACHE:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(re.sub(r"[0-9]+", "0", word.lower()).encode("utf-8", "surrogatepass"))
        return h


def grams(words: np.ndarray) -> list[np.ndarray]:
    """Hashes of all runs of 1 to REACH words; the k-th array holds those of k words by their first."""
    out, run = [], np.zeros(len(words), np.uint64)
    for k in range(1, REACH + 1):
        n = max(0, len(words) - k + 1)
        run = run[:n] * np.uint64(0x9E3779B97F4A7C15) + words[k - 1 : k - 1 + n] + np.uint64(k)
        h = (run ^ (run >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out.append((h ^ (h >> np.uint64(31))).view(np.int64))
    return out


def hashed(words: Words, tokens: list[str]) -> np.ndarray:
    return np.fromiter(map(words.__getitem__, tokens), np.uint64, len(tokens))


def mentions(text: str, words: Words, base: list[tuple[int, int, int]]) -> list[dict]:
    """Base entities (seed) and other candidates with the hash of their value and those of the words before (left) and after (right) them."""
    spans = [(s, e, True) for _, s, e in base] + [(s, e, False) for s, e in candidates(text, base)]
    if not spans:
        return []
    found = [m.span() for m in _TOKEN.finditer(text)]
    starts, ends = (np.array(x, np.int64) for x in zip(*found))
    runs = grams(hashed(words, [text[s:e] for s, e in found]))
    out = []
    for s, e, seed in spans:
        i, j = int(np.searchsorted(ends, s, "right")), int(np.searchsorted(starts, e, "left"))
        value = "".join(c for c in text[s:e].lower() if c.isalnum() or c == "@")
        out.append({
            "start": s, "end": e, "seed": seed, "value": xxhash.xxh64_intdigest(value.encode("utf-8", "surrogatepass")) - 2**63,
            "left": [int(runs[k][i - k - 1]) for k in range(REACH) if i > k],
            "right": [int(runs[k][j]) for k in range(REACH) if j + k < len(found)],
        })
    return out


def extract(docs: DataFrame) -> DataFrame:
    """(doc_id, base, mentions) of every whole text; one pass, no shuffle."""

    def make():
        words = Words()

        def f(texts: list) -> tuple[None, list]:
            base, every = [], []
            for text in texts:
                own = base_spans(text or "")
                base.append([{"kind": KINDS[k], "start": s, "end": e} for k, s, e in own])
                every.append(mentions(text or "", words, own))
            return None, [base, every]

        return f

    span = "array<struct<kind:string,start:bigint,end:bigint>>"
    return map_texts(docs, make, f"base {span}, mentions array<struct<start:bigint,end:bigint,seed:boolean,value:bigint,left:array<bigint>,right:array<bigint>>>")


def bloom(hashes: DataFrame, bits: int) -> np.ndarray:
    """A Bloom filter of ``bits`` bits, a power of two, over the column ``gram``: its 64-bit words are united by Spark, so at most bits / 64 rows reach the driver."""
    spots = F.array(F.col("gram").bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned("gram", 32).bitwiseAND(F.lit(bits - 1)))
    at = hashes.select(F.explode(spots).alias("at")).select(F.shiftright("at", 6).alias("word"), F.expr("shiftleft(1L, cast(at & 63 as int))").alias("bit"))
    rows = at.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[rows["word"].to_numpy()] = rows["bits"].to_numpy()
    return out.view(np.uint64)


def occurrences(docs: DataFrame, wanted: np.ndarray) -> DataFrame:
    """(gram, n): how often runs of words whose hash is in the filter ``wanted`` stand anywhere in ``docs``, followed or led by whatever."""
    shared, mask = docs.sparkSession.sparkContext.broadcast(wanted), np.int64(len(wanted) * 64 - 1)

    def has(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
        return (bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, bits = Words(), shared.value
        for batch in batches:
            kept = []
            for text in batch.column(0).to_pylist():
                if text:
                    for h in grams(hashed(words, _TOKEN.findall(text))):
                        h = h[has(bits, h & mask)]
                        kept.append(h[has(bits, (h.view(np.uint64) >> np.uint64(32)).view(np.int64) & mask)])
            gram, n = np.unique(np.concatenate(kept) if kept else np.zeros(0, np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(n.astype(np.int64))], ["gram", "n"])

    return docs.select("text").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def discover(found: DataFrame, docs: DataFrame, support: int = 3, least: float = 0.5, bits: int = 1 << 23) -> tuple[DataFrame, DataFrame]:
    """Reliable patterns (side, gram, score) and the values (value, score) they give away, from mentions (seed, value, left, right).

    A pattern is a run of up to three words before or after an identifier. Its
    score is the share of all its occurrences in the corpus, plus one, whose
    neighbour is an entity, an entity weighing its own score: 1 for a seed, else
    the best score of its patterns. Patterns count from ``support`` entities
    and ``least`` on; the two sides of the graph are scored in turn until
    nothing changes. Scores only rise, so the rounds end.

    Patterns too frequent to reach ``least`` even if all their neighbours were
    entities leave the graph first, so it has no hubs. Occurrences are counted
    over every text behind a Bloom filter of fixed size: its false alarms cost
    rows, never results.
    """
    sides = [F.transform(side, lambda g, k=k: F.struct(F.lit(k).alias("side"), g.alias("gram"))) for k, side in enumerate(("left", "right"))]
    edges = found.select("value", "seed", F.explode(F.concat(*sides)).alias("p")).select("p.side", "p.gram", "value", "seed")
    edges = materialize(edges.groupBy("side", "gram", "value").agg(F.count("*").alias("n"), F.max("seed").alias("seed")), "pii-edges")
    wide = edges.groupBy("side", "gram").agg(F.count("*").alias("entities"), F.sum("n").alias("filled")).where(F.col("entities") >= support)
    wide = materialize(wide, "pii-patterns")
    total = occurrences(docs, bloom(wide.select("gram"), bits))
    able = wide.join(total, "gram").where(F.col("filled") >= least * (F.col("n") + 1)).select("side", "gram", F.col("n").alias("total"))
    held = materialize(edges.join(able, ["side", "gram"]), "pii-graph")
    discard(edges, wide)
    values = materialize(held.groupBy("value").agg(F.max("seed").cast("double").alias("score")), "pii-values")
    before = None
    while True:
        scored = held.join(values.where("score > 0"), "value").groupBy("side", "gram", "total").agg(F.sum("score").alias("entities"), F.sum(F.col("n") * F.col("score")).alias("filled"))
        scored = scored.withColumn("score", F.round(F.col("filled") / (F.col("total") + 1), 4))
        patterns = materialize(scored.where((F.col("entities") >= support) & (F.col("score") >= least)).select("side", "gram", "score"), "pii-patterns")
        now = patterns.agg(F.count("*"), F.sum("score")).first()
        if now == before:
            return patterns, values.where(F.col("score") >= least)
        best = held.join(patterns, ["side", "gram"]).groupBy("value", "seed").agg(F.max("score").alias("found"))
        last, values = values, materialize(
            values.join(best.groupBy("value").agg(F.max("found").alias("found")), "value", "left").select("value", F.greatest("score", F.coalesce("found", F.lit(0.0))).alias("score")), "pii-values"
        )
        discard(last)
        before = now


def find(docs: DataFrame, support: int = 3, least: float = 0.5) -> DataFrame:
    """(doc_id, base, spans): arrays of (kind, start, end) in code points, end exclusive, by kind, then start.

    ``base`` are the fixed shapes; ``spans`` adds, as kind ``context``, strings
    with digits or an at sign that reliable contexts give away, wherever they
    stand, and those that say a base entity in other marks. A value that many documents repeat is one entity, so copies do not
    make a pattern reliable. Two passes over the whole texts and joins of hashes
    between; texts are not shuffled. Null or empty text has no spans; null
    doc_id and repeated rows come back as they are; an empty table gives no
    rows. Extra columns are ignored.
    """
    rows = materialize(extract(docs).withColumn("uid", F.monotonically_increasing_id()), "pii-mentions")
    each = rows.select("uid", F.explode("mentions").alias("m")).select("uid", "m.*")
    _, values = discover(each, docs, support, least)
    values = values.select("value").unionByName(each.where("seed").select("value")).distinct()
    kind = F.struct(F.lit(KINDS[-1]).alias("kind"), F.col("start"), F.col("end"))
    more = each.where("not seed").join(values, "value").groupBy("uid").agg(F.sort_array(F.collect_list(kind)).alias("more"))
    return rows.select("uid", "doc_id", "base").join(more, "uid", "left").select(
        "doc_id", "base", F.when(F.col("more").isNull(), F.col("base")).otherwise(F.concat("base", "more")).alias("spans")
    )
