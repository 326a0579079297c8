"""Fill-in-the-middle: seeded cuts of a text at token borders, found through run-length encoded character classes."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_texts

#: Marks of the three parts; none is a prefix or an end of another, so the first one found is the one written.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


class ClassRuns:
    """A text as maximal runs of ASCII letters and of all else, each with the units before it.

    A run of letters is one unit, anything else a unit a code point; ``units``
    is the text's count. Memory is a few numbers a run, not one a token.
    """

    def __init__(self, text: str):
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        low = codes | 0x20
        letter = (low >= ord("a")) & (low <= ord("z")) & (codes < 128)
        self.start = np.flatnonzero(np.r_[True, letter[1:] != letter[:-1]]) if len(codes) else np.zeros(0, np.int64)
        self.letter = letter[self.start]
        length = np.diff(np.r_[self.start, len(codes)])
        self.before = np.r_[0, np.cumsum(np.where(self.letter, 1, length))]
        self.chars, self.units = len(codes), int(self.before[-1])

    def offset(self, unit: int) -> int:
        """Code points before unit number ``unit``: a binary search for its run, then arithmetic."""
        if unit >= self.units:
            return self.chars
        run = int(np.searchsorted(self.before, unit, "right")) - 1
        inside = unit - int(self.before[run])  # always 0 in a run of letters
        return int(self.start[run]) + inside


def draws(doc_id: int | None, seed: str = "1") -> list[int]:
    """Four seeded 32-bit numbers of a document; a null id counts as the empty text."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]


def transform_text(text: str, doc_id: int | None, rate: int = 90, spm: int = 20) -> tuple[int, str, int | None, int | None, str]:
    """(n, form, prefix_chars, middle_chars, output) of one text."""
    runs = ClassRuns(text)
    h1, h2, h3, h4 = draws(doc_id)
    if not text or h3 % 100 >= rate or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return runs.units, "plain", None, None, text
    a, b = sorted(runs.offset(h % (runs.units + 1)) for h in (h1, h2))
    head, mid, tail = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm:
        return runs.units, "spm", a, b - a, f"{SUFFIX}{tail}{PREFIX}{head}{MIDDLE}{mid}"
    return runs.units, "psm", a, b - a, f"{PREFIX}{head}{SUFFIX}{tail}{MIDDLE}{mid}"


def fill_in_middle(docs: DataFrame, rate: int = 90, spm: int = 20) -> DataFrame:
    """(doc_id, n long, form, prefix_chars long, middle_chars long, output) of every whole text.

    Tokens are runs of ASCII letters and single other code points; ``n`` counts
    them. The two cuts, whether a text is transformed (``rate`` of 100) and in
    which order (``spm`` of 100 put the suffix first) hang on doc_id alone.
    Empty texts and texts that hold a mark stay plain. One pass without a
    shuffle. Null text is empty; a null doc_id draws as the empty text; repeated
    rows come back as they are; an empty table gives no rows; extra columns are
    ignored.
    """

    def make():
        def f(texts: list, ids: list) -> tuple[None, list]:
            rows = [transform_text(t or "", i, rate, spm) for t, i in zip(texts, ids)]
            return None, [list(c) for c in zip(*rows)]

        return f

    return map_texts(docs, make, "n long, form string, prefix_chars long, middle_chars long, output string", with_ids=True)


def restored(output: Column, form: Column) -> Column:
    """The exact text, rebuilt from what ``fill_in_middle`` wrote: the first mark found is the one written, as the parts hold none."""

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        body = F.substring(output, F.lit(len(first) + 1), F.char_length(output))
        one = F.substring_index(body, second, 1)
        rest = F.substring(body, F.char_length(one) + len(second) + 1, F.char_length(body))
        two = F.substring_index(rest, MIDDLE, 1)
        return one, two, F.substring(rest, F.char_length(two) + len(MIDDLE) + 1, F.char_length(rest))

    (p, s, m), (s2, p2, m2) = parts(PREFIX, SUFFIX), parts(SUFFIX, PREFIX)
    return F.when(form == "psm", F.concat(p, m, s)).when(form == "spm", F.concat(p2, m2, s2)).otherwise(output)
