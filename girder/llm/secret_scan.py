"""Secret scans: fixed credential shapes, and strings that a tokeniser's vocabulary cannot compress."""

from __future__ import annotations

import base64
import re

from pyspark.sql import DataFrame

from .common import map_texts

#: Kinds in the order that breaks ties of a span's start.
KINDS = ("assign", "access", "hex", "random")

# fixed values: the base patterns; letters of the key words in either case, ASCII only
_ASSIGN = re.compile(
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: Runs of 24 or more hex digits are whole maximal runs, so the short ones need not be visited.
_LONG_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")

#: Signs of a string that the token test takes: of one kind of letter alone, of mixed kinds, and of mixed kinds after a word that announces a secret.
LEAST_PLAIN, LEAST_MIXED, LEAST_TOLD = 16, 12, 8
_SIGNS = r"A-Za-z0-9+/_.=!@#$%^&*~-"
_RUN = re.compile(rf"[{_SIGNS}]{{8,}}")
_TOLD = re.compile(r"(?i)(?:pass|pwd|secret|token|key|auth|credential|login|pin|code)[A-Za-z_-]*[\"']?\x20*(?:[:=]|is|was)?\x20*[\"'`(<]?\Z")
_DIGEST = re.compile(r"(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128})\Z")
_UUID = re.compile(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}\Z")
#: Digests that name their algorithm, and addresses.
_KNOWN = re.compile(r"(?i)(?:sha[0-9]{1,3}|md5|blake[0-9a-z]*)[-:=_][A-Za-z0-9+/_=-]+\Z|[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+\Z")
_GROUP = re.compile(r"[A-Za-z0-9]+")

_encodings: dict[str, object] = {}


def encoding(path: str, pattern: str):
    """A tiktoken encoding from a file of base64 tokens and ranks, once a worker."""
    if path not in _encodings:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encodings[path] = tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed shapes, each kind leftmost and non-overlapping, failing matches dropped."""
    out = []
    if "=" in text or ":" in text:
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in _LONG_HEX.finditer(text)]
    return sorted(out)


def tokens(text: str, enc) -> int:
    return sum(len(enc.encode_ordinary(text[i : i + 4096])) for i in range(0, len(text), 4096))  # the encoder's time grows faster than its input


def kinds(text: str) -> int:
    """How many kinds of signs a string has: small letters, capitals inside, digits, other signs than marks."""
    inner = text[1:] if text[1:].islower() else text  # one capital in front makes a name
    return any(c.islower() for c in text) + any("A" <= c <= "Z" for c in inner) + any(c.isdigit() for c in text) + any(c in "!@#$%^&*~" for c in text)


def known(run: str) -> bool:
    """Digests, UUIDs and addresses."""
    return bool(_DIGEST.match(run) or _UUID.match(run) or _KNOWN.match(run))


def is_random(run: str, enc, least_ratio: float, told: bool = False) -> bool:
    """Whether a string has fewer characters a token than ``least_ratio``, in its groups of letters and digits and as a whole.

    Known digests (hex of a digest's length, or behind the algorithm's name),
    UUIDs, addresses and numbers are not secrets. Short strings must mix kinds
    of signs; the shortest, and the ones just above them with a lower ratio,
    must follow a word that announces a secret (``told``). Joined groups, as of
    names, versions and product keys, are tested by the letters they hold, so
    that marks and numbers between short words prove nothing.
    """
    if known(run) or not any(c.isalpha() for c in run):
        return False
    mixed, n = kinds(run), len(run)
    if n < (LEAST_PLAIN if mixed < 2 else LEAST_TOLD if told else LEAST_MIXED):
        return False
    groups = _GROUP.findall(run)
    if len(groups) > 1:
        if any(c in "!@#$%^&*~" for c in run):
            return mixed >= 3 and n / tokens(run, enc) < least_ratio
        named = [g for g in groups if not g.isdigit()]
        held = sum(map(len, named))
        even = len(groups) > 2 and len({len(g) for g in groups}) == 1 and len(groups[0]) > 3  # product keys
        if held < (LEAST_MIXED if even else LEAST_PLAIN) or held < 3 * len(named) or min(map(len, groups)) < 3 and mixed < 3:
            return False
        return held / sum(tokens(g, enc) for g in named) < least_ratio and (even or n / tokens(run, enc) < least_ratio)
    if run.isupper() and run.isalpha() and n / tokens(run.lower(), enc) >= least_ratio + 0.2:
        return False  # capitals alone are split finely whatever they say
    # rare words of one kind of letter come close to chance while they are short
    return n / tokens(run, enc) < least_ratio - (0.1 if mixed < 2 and n < 20 else 0)


def random_parts(text: str, lo: int, hi: int, enc, least_ratio: float) -> list[tuple[int, int]]:
    """The run itself without marks at its ends, if it is random, else its parts between dots, slashes, equals and signs that are."""
    while lo < hi and text[lo] in "._-/=+!@#$%^&*~":
        lo += 1
    while hi > lo and text[hi - 1] in "._-/!@#$%^&*~":
        hi -= 1
    while hi - lo > 2 and text[hi - 1] == "=" and text[hi - 2] in "._-/!@#$%^&*~":
        hi -= 1
    if hi - lo < LEAST_TOLD:
        return []
    plain = text[lo:hi]
    if known(plain):
        return []
    if plain.isalpha() and hi - lo < LEAST_PLAIN and kinds(plain) < 2:
        return []  # most words
    told = lambda a: bool(_TOLD.search(text, max(0, a - 40), a))
    if is_random(plain, enc, least_ratio, told(lo)):
        return [(lo, hi)]
    parts = [(lo + m.start(), lo + m.end()) for m in re.finditer(r"[^./=!@#$%^&*~]+", plain)]
    return [(a, b) for a, b in parts if (a, b) != (lo, hi) and b - a >= LEAST_TOLD and is_random(text[a:b], enc, least_ratio, told(a))]


def random_spans(text: str, enc, least_ratio: float, covered: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans of runs that the token test finds random, in what base spans leave uncovered."""
    out, k = [], 0
    spans = sorted((s, e) for s, _, e in covered)
    for m in _RUN.finditer(text):
        at, gaps = m.start(), []
        while k < len(spans) and spans[k][1] <= at:
            k += 1
        for s, e in spans[k:]:
            if s >= m.end():
                break
            gaps.append((at, s))
            at = max(at, e)
        for lo, hi in [*gaps, (at, m.end())]:
            if hi - lo >= LEAST_TOLD:
                out += [(a, 3, b) for a, b in random_parts(text, lo, hi, enc, least_ratio)]
    return out


def scan(docs: DataFrame, vocabulary_path: str, pattern: str, least_ratio: float = 1.9) -> DataFrame:
    """(doc_id, base, spans): arrays of (kind, start, end) in code points, end exclusive, by start, then kind.

    One pass over the text, no shuffle. Null or empty text has no spans; null
    doc_id and repeated rows come back as they are; an empty table gives no
    rows. Extra columns are ignored.
    """

    def make():
        enc = encoding(vocabulary_path, pattern)

        def f(texts: list) -> tuple[None, list]:
            base, every = [], []
            for text in texts:
                own = base_spans(text or "")
                more = sorted(own + random_spans(text or "", enc, least_ratio, own))
                base.append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in own])
                every.append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in more])
            return None, [base, every]

        return f

    span = "array<struct<kind:string,start:bigint,end:bigint>>"
    return map_texts(docs, make, f"base {span}, spans {span}")
