"""Toxicity: a learned lexicon, Levenshtein automata over its trie, and context windows around the hits."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, discard, map_texts, materialize

WORDS = re.compile(r"\w+")
#: Words either side of a hit that its context score looks at.
WINDOW = 6
#: Words whose look-up each Python worker remembers.
WORD_CACHE = 500_000
OPENING, CLOSING = "\"“«„‹", "\"”»“›"
# fixed values: verbs that report another's words
REPORTING = frozenset([
    "said", "says", "wrote", "writes", "called", "quoted", "quotes", "reported", "claimed", "sagte", "schrieb", "nannte", "dit", "écrit", "appelé", "dijo", "escribió", "llamó",
])


def terms(text: str) -> set[str]:
    """A text's words, and their longer prefixes marked with ``*``."""
    found = set(WORDS.findall(text.lower()))
    return {w for w in found if len(w) > 2} | {w[:k] + "*" for w in found for k in (4, 5, 6) if len(w) > k}


#: Letters that a lexicon entry needs for its misspellings to be looked for.
FUZZY_LETTERS = 4


class Trie:
    """Lexicon trie; a Levenshtein automaton of a word runs along its branches together with it.

    Edits are insertions, deletions, substitutions and swaps of neighbours.
    Stems accept whatever follows them.
    """

    def __init__(self, entries: dict[str, float]):
        self.root: dict = {}
        # an entry one edit away keeps its first or its last half, unless the middle letters are swapped: words with none of these need no automaton
        fuzzy = [t for t in entries if len(t.rstrip("*")) >= FUZZY_LETTERS]
        self.heads, self.ends, self.tails = set(), set(), set()
        for t in fuzzy:
            bare, h = t.rstrip("*"), len(t.rstrip("*")) // 2
            self.heads |= {bare[:h], bare[: h - 1] + bare[h]}
            if t.endswith("*"):
                self.tails |= {(h + d, bare[h:]) for d in (-1, 0, 1)}  # where the second half may begin
            else:
                self.ends.add(bare[h:])
        self.head_sizes, self.end_sizes = sorted({len(x) for x in self.heads}), sorted({len(x) for x in self.ends})
        self.tail_places = sorted({(at, len(x)) for at, x in self.tails})
        for term, weight in entries.items():
            node = self.root
            for ch in term.rstrip("*"):
                node = node.setdefault(ch, {})
            node["stem" if term.endswith("*") else "word"] = (term, weight)
        self.fuzzy: dict = {}  # the key "" ends a word, "*" a stem
        for term in fuzzy:
            node = self.fuzzy
            for ch in term.rstrip("*"):
                node = node.setdefault(ch, {})
            node["*" * term.endswith("*")] = (term, entries[term])

    def exact(self, word: str) -> tuple[str, float] | None:
        """The word itself, else its longest stem."""
        node, stem = self.root, None
        for ch in word:
            node = node.get(ch)
            if node is None:
                return stem
            stem = node.get("stem", stem)
        return node.get("word", stem)

    def may_be_near(self, word: str) -> bool:
        return (
            any(word[:n] in self.heads for n in self.head_sizes)
            or any(word[-n:] in self.ends for n in self.end_sizes)
            or any((at, word[at : at + n]) in self.tails for at, n in self.tail_places)
        )

    def near(self, word: str, most: int = 1) -> tuple[str, float] | None:
        """The heaviest entry of FUZZY_LETTERS letters or more within ``most`` edits; of a stem, of some beginning of the word.

        States of the Levenshtein automaton are (letters read, edits spent); each runs with the trie node it has reached.
        With its edits spent, a state has one way on: the letters themselves.
        """
        best, n = None, len(word)

        def better(hit: tuple[str, float] | None) -> tuple[str, float] | None:
            return hit if hit and (best is None or hit[1] > best[1]) else best

        todo = [(self.fuzzy, 0, 0)]
        while todo:
            node, i, spent = todo.pop()
            best = better(node.get("*"))
            if spent == most:
                while i < n and (node := node.get(word[i])):
                    i += 1
                    best = better(node.get("*"))
                if i == n and node:
                    best = better(node.get(""))
                continue
            if n - i <= most - spent:
                best = better(node.get(""))
            ahead, after = word[i : i + 1], word[i + 1 : i + 2]
            if ahead:
                todo.append((node, i + 1, spent + 1))
                if ahead in node:
                    todo.append((node[ahead], i + 1, spent))
                if after and after != ahead and after in node and ahead in node[after]:
                    todo.append((node[after][ahead], i + 2, spent + 1))
            last = spent + 1 == most
            for ch, child in node.items():
                if not ch or ch == "*":
                    continue
                # with the last edit spent here, the next letter must be among the child's, unless a stem ends there
                if not last or (ahead or "") in child or "*" in child:
                    todo.append((child, i, spent + 1))
                if ahead and ch != ahead and (not last or after in child or "*" in child):
                    todo.append((child, i + 1, spent + 1))
        return best


@dataclass
class ToxicityModel:
    """``known``: words of unmarked labelled texts, which are no misspellings of an entry."""

    lexicon: dict[str, float]
    known: frozenset[str] = frozenset()
    weights: np.ndarray = field(default_factory=lambda: np.array([-3.0, *[0.0] * 8]))  # until fitted: nothing is toxic

    def __post_init__(self):
        self.trie, self.seen = Trie(self.lexicon), {}

    def look_up(self, word: str) -> tuple[str, float, bool] | None:
        """(entry, weight, misspelled) of a word, or None."""
        hit = self.trie.exact(word)
        if hit:
            return (*hit, False)
        if len(word) >= 4 and word not in self.known and self.trie.may_be_near(word):
            hit = self.trie.near(word)
            if hit:
                return (*hit, True)
        return None

    def features(self, text: str | None) -> list[float]:
        """Counts of hits by kind, by context, their density and the fullest window."""
        if not text or not self.lexicon:
            return [0.0] * 8
        low = text.lower()
        words = WORDS.findall(low)
        if len(self.seen) > WORD_CACHE:
            self.seen.clear()
        seen = self.seen
        for w in set(words):
            if w not in seen:
                seen[w] = self.look_up(w)
        at = [i for i, w in enumerate(words) if seen[w]]
        if not at:
            return [0.0] * 8
        quoted = self._quoted(low, words, at)
        plain = misspelt = told = weight = 0.0
        entries = set()
        for i, q in zip(at, quoted):
            entry, value, fuzzy = seen[words[i]]
            entries.add(entry)
            if q:
                told += 1
            elif fuzzy:
                misspelt += 1
            else:
                plain += 1
                weight += value
        fullest, lo = 0, 0
        for hi, i in enumerate(at):
            while at[lo] < i - 2 * WINDOW:
                lo += 1
            fullest = max(fullest, hi - lo + 1)
        return [
            math.log1p(plain), math.log1p(misspelt), math.log1p(told), min(1.0, 10 * plain / len(words)),
            math.log1p(fullest), math.log1p(len(entries)), math.log1p(weight), float(plain > 0),
        ]

    def _quoted(self, low: str, words: list[str], at: list[int]) -> list[bool]:
        """Whether each hit stands inside quotation marks, whatever their distance within a paragraph, or just after a reporting verb."""
        marks = any(c in low for c in OPENING)
        inside: set[int] = set()
        if marks:
            spans, wanted = [m.span() for m in WORDS.finditer(low)], set(at)
            open_at, j = -1, 0
            for pos, ch in enumerate(low):
                if ch == "\n":
                    open_at = -1  # a quotation ends with its paragraph
                if ch not in OPENING and ch not in CLOSING:
                    continue
                if open_at < 0:
                    open_at = pos
                else:
                    while j < len(spans) and spans[j][0] < pos:
                        if spans[j][0] > open_at and j in wanted:
                            inside.add(j)
                        j += 1
                    open_at = -1
        return [i in inside or any(w in REPORTING for w in words[max(0, i - WINDOW) : i]) for i in at]

    def score(self, text: str | None) -> float:
        z = float(self.weights[0] + np.dot(self.weights[1:], self.features(text)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def learn_lexicon(labelled: DataFrame, size: int = 500, least: int = 4, share: float = 0.01, purity: float = 0.8, words: int = 200_000) -> tuple[dict[str, float], frozenset[str]]:
    """Terms that mark label 1, and the words known from texts of label 0.

    A term is in ``least`` positive documents of the bounded sample and in
    ``share`` of them, and ``purity`` of its documents are positive; the ``size``
    best are kept. Known are up to ``words`` words of two or more negative
    documents, the most frequent first. Document counts are summed by Spark.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            tally: dict[int, Counter] = {0: Counter(), 1: Counter()}
            for text, y in zip(pdf["text"], pdf["toxic"]):
                if isinstance(text, str):
                    tally[int(y)].update(terms(text))
            for y, c in tally.items():
                yield pd.DataFrame({"term": list(c), "y": y, "n": list(c.values())})

    totals = {int(r["toxic"]): r["n"] for r in labelled.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    pos, neg = totals.get(1, 0), totals.get(0, 0)
    if not pos:
        return {}, frozenset()
    by = labelled.select("text", "toxic").mapInPandas(count, "term string, y int, n long").groupBy("term")
    by = materialize(by.agg(F.sum(F.expr("if(y = 1, n, 0)")).alias("p"), F.sum(F.expr("if(y = 0, n, 0)")).alias("q")), "terms")
    rate = F.log(((F.col("p") + 0.5) / (pos + 1)) / ((F.col("q") + 0.5) / (neg + 1)))
    best = by.where((F.col("p") >= max(least, int(pos * share))) & (F.col("p") >= purity * (F.col("p") + F.col("q"))))
    best = best.select("term", "p", rate.alias("weight")).where("weight > 1.5").orderBy(F.desc("p"), "term").limit(size)
    clean = by.where("q >= 2 and q > p and term not like '%*'").orderBy(F.desc("q"), "term").limit(words).select("term")
    return {r["term"]: float(r["weight"]) for r in best.collect()}, frozenset(clean.toArrow()["term"].to_pylist())


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 40) -> np.ndarray:
    """Newton steps with a ridge on all but the intercept."""
    x = np.c_[np.ones(len(x)), x]
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge * 10)
    penalty[0] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(h, x.T @ (y - p) - penalty * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


def labelled_texts(docs: DataFrame, labels: DataFrame, train_docs: int = 20_000) -> DataFrame:
    """(doc_id, text, toxic) of about ``train_docs`` labels (doc_id, toxic): the labels are drawn before they meet the texts, so that no text is shuffled for the others."""
    marks = labels.where("toxic in (0, 1) and doc_id is not null").select("doc_id", "toxic")
    marks = materialize(bounded_sample(marks, F.col("doc_id"), train_docs), "marks")
    return docs.select("doc_id", "text").join(marks, "doc_id")


def train(labelled: DataFrame, train_docs: int = 20_000) -> ToxicityModel:
    """Fit on about ``train_docs`` rows (doc_id, text, toxic) at most, chosen by hash; null labels do not count."""
    sample = labelled.where("toxic in (0, 1)").select("doc_id", "text", F.col("toxic").cast("int").alias("toxic"))
    held = materialize(sample, "labelled")
    sample = bounded_sample(held, F.col("doc_id"), train_docs)
    model = ToxicityModel(*learn_lexicon(sample))
    shared = sample.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            feats = [shared.value.features(t if isinstance(t, str) else None) for t in pdf["text"]]
            yield pd.DataFrame({"x": feats, "y": pdf["toxic"].astype(float)})

    rows = sample.select("text", "toxic").mapInPandas(run, "x array<double>, y double").toArrow()
    discard(held)
    if rows.num_rows:
        model.weights = fit_logistic(np.array(rows["x"].to_pylist()), rows["y"].to_numpy())
    return model


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """(doc_id, score) of every whole text, one pass without a shuffle; the broadcast model is bounded by the lexicon's size.

    Null and empty texts have no hits and get the score of such texts (the
    fitted intercept). Null ids and
    repeated rows come back as they are; an empty table gives no rows. Extra
    columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return map_texts(docs, lambda: lambda texts: (None, [[shared.value.score(t) for t in texts]]), "score double")


def without_toxic(docs: DataFrame, model: ToxicityModel, least: float = 0.5) -> DataFrame:
    """``docs`` without the rows whose text scores ``least`` or more; all columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def clean(text: pd.Series) -> pd.Series:
        return pd.Series([shared.value.score(t if isinstance(t, str) else None) < least for t in text], dtype=bool)

    return docs.where(clean("text"))
