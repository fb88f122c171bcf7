"""Secret scans: fixed patterns, and the cost of guessing a value that stands where a credential would."""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections.abc import Iterator, Mapping
from functools import cache, lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from ._arrow import with_struct
from ._common import here, ship
from .token_counts import VOCABULARY, ranks

# The patterns of the base kinds, and how long a match has to be.
ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
HEX_LONG = re.compile(r"[0-9a-f]{16,}")  # runs can't be longer than they are: the same matches as HEX with 16 or more
KINDS = ("assign", "access", "hex", "guess")
#: Where a credential may stand, beyond the base pattern: after a name and : or =, or after "Bearer" and white space.
CONTEXT = re.compile(r"""(?:(?i:pass(?:word|wd|phrase|code)?|pwd|pin|secret|token|(?:api|access|private|auth)[_-]?key|bearer|credentials?|login)["']?[\x20\t]*[:=]|(?i:bearer)(?=[\x20\t]))[\x20\t]*["']?([^\s"',;]{8,})""", re.ASCII)
#: A value is reported if it takes 10 to this power guesses at least.
HARD = 12.0
# Passwords that guessers try first, by rank; they come before the ranked words of the vocabulary.
COMMON = ("password", "qwerty", "letmein", "welcome", "admin", "iloveyou", "dragon", "monkey", "football", "baseball", "master", "shadow", "sunshine", "princess", "superman", "batman", "trustno", "changeme", "secret", "login", "root", "guest", "default", "test", "user", "passwd", "hello", "freedom", "whatever")
# Characters that stand for letters; 1 may be two of them.
LEET = (str.maketrans("@431!05$7+|8", "aaeiiosstt" + "lb"), str.maketrans("@431!05$7+|8", "aaeliosstt" + "lb"))
# A keyboard's rows without and with shift; each row lies half a key to the right of the one above.
ROWS = (("1234567890-=", "!@#$%^&*()_+"), ("qwertyuiop[]", "QWERTYUIOP{}"), ("asdfghjkl;'", 'ASDFGHJKL:"'), ("zxcvbnm,./", "ZXCVBNM<>?"))
DATE = re.compile(r"(?:19|20)\d\d([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\2(?:19|20)\d\d")
YEAR = re.compile(r"(?:19|20)\d\d")
#: Characters of a word or of a repeated unit at most; the least number of a word, a walk and a sequence.
LONGEST, LEAST = 24, 3
#: log10 of the guesses which kind of piece comes next: word, word backwards, date, repeat, walk, sequence, characters.
KIND = math.log10(7)
DATES, YEARS, KEYS, TURN, SEQUENCES = math.log10(365 * 120), math.log10(120), math.log10(47), math.log10(5), math.log10(2 * 62)

# How values look that name something else: a time, a placeholder; and an address, a path or a reference in code, which is as hard to guess as its hardest part.
TIME = re.compile(r"\d{4}-?\d\d-?\d\d(?:[T_ ]?\d\d:?\d\d(?::?\d\d(?:[.,]\d+)?)?(?:Z|[+-]\d\d:?\d\d)?)?", re.ASCII)
PLACEHOLDER = re.compile(r"[$%]?[{(<\[]+\s*[\w.: -]+\s*[})>\]]+|\$\w+|%\w+%", re.ASCII)
NAMED = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*://\S+|[\w.+-]+@[\w-]+(?:\.[\w-]+)+|(?:~|\.{1,2}|[A-Za-z]:)?(?:[/\\][\w.+-]+){2,}[/\\]?|[A-Za-z_]\w*(?:(?:\.|::|->)[A-Za-z_]\w*)+[\[(]?\S*", re.ASCII)
PART = re.compile(r"[\w+]+")

PLACES = {key: (r, c) for r, both in enumerate(ROWS) for row in both for c, key in enumerate(row)}


def direction(a: str, b: str) -> tuple[int, int] | None:
    """The way from a key to a neighbour on the keyboard; None if they aren't neighbours."""
    p, q = PLACES.get(a), PLACES.get(b)
    step = (q[0] - p[0], q[1] - p[1]) if p and q else None
    return step if step in ((0, 1), (0, -1), (1, 0), (1, -1), (-1, 0), (-1, 1)) else None


@cache
def ranked_words(path: str) -> dict[str, int]:
    """Words by rank: COMMON, then the vocabulary's tokens that are words of LEAST letters or more, in the order in which it learned them."""
    out: dict[str, int] = {}
    for word in (*COMMON, *(t.decode("utf-8", "ignore").strip().lower() for t, _ in sorted(ranks(here(path)).items(), key=lambda x: x[1]))):
        if LEAST <= len(word) <= LONGEST and word.isalpha():
            out.setdefault(word, len(out) + 1)
    return out


def _alphabet(value: str) -> float:
    """log10 of the characters that a guesser tries at each place: those of the classes that the value has."""
    classes = {26 if c.islower() else 27 if c.isupper() else 10 if c.isdigit() else 33 if c.isascii() else 100 for c in value}
    return math.log10(sum(26 if k == 27 else k for k in classes))


def _case(part: str) -> float:
    """log10 of the ways to set capitals: none, first or all letters count little."""
    letters = [c for c in part if c.isalpha()]
    upper = sum(c.isupper() for c in letters)
    if not upper:
        return 0.0
    if upper == len(letters) or (upper == 1 and part[0].isupper()):
        return math.log10(2)
    return math.log10(sum(math.comb(len(letters), k) for k in range(1, min(upper, len(letters) - upper) + 1)) or 2)


def _words(value: str, words: Mapping[str, int]) -> Iterator[tuple[int, int, float]]:
    low = value.lower()
    forms = {low, *(low.translate(t) for t in LEET)}
    for form in forms:
        for text, way in ((form, 1), (form[::-1], -1)):
            for i in range(len(text) - LEAST + 1):
                for j in range(i + LEAST, min(len(text), i + LONGEST) + 1):
                    if rank := words.get(text[i:j]):
                        a, b = (i, j) if way == 1 else (len(text) - j, len(text) - i)
                        changed = sum(x != y for x, y in zip(form[a:b], low[a:b], strict=True))
                        yield a, b, math.log10(rank) + _case(value[a:b]) + changed * math.log10(2)


def _repeats(value: str, words: Mapping[str, int]) -> Iterator[tuple[int, int, float]]:
    for size in range(1, min(LONGEST, len(value) // 2) + 1):
        a = 0
        while a + size < len(value):
            m = 0
            while a + m + size < len(value) and value[a + m] == value[a + m + size]:
                m += 1
            for start in range(a, min(a + size, a + m + 1) if m >= size else a):
                if (times := (a + m + size - start) // size) >= 2:
                    yield start, start + size * times, guess_cost(value[start : start + size], words) + math.log10(times)
            a += m + 1


def _dates(value: str) -> Iterator[tuple[int, int, float]]:
    for i in range(len(value)):
        for pattern, cost in ((DATE, DATES), (YEAR, YEARS)):
            if m := pattern.match(value, i):
                yield i, m.end(), cost


class _Memo(dict):
    """Words that can key a cache."""

    __hash__ = object.__hash__  # type: ignore[assignment]
    __eq__ = object.__eq__  # type: ignore[assignment]


@lru_cache(maxsize=20_000)
def _cost(value: str, words: _Memo) -> float:
    ends: dict[int, list[tuple[int, float]]] = {}
    for found in (_words(value, words), _repeats(value, words), _dates(value)):
        for i, j, cost in found:
            ends.setdefault(j, []).append((i, cost))
    one = _alphabet(value)
    # the best split up to here; the best whose last piece is characters; and walks and sequences by length, short ones not yet pieces
    best, chars = [0.0], math.inf
    walks: dict[tuple[tuple[int, int] | None, bool], float] = {}
    runs: dict[tuple[int, int], float] = {}
    for j in range(1, len(value) + 1):
        chars = min(best[j - 1] + KIND, chars) + one
        step = direction(value[j - 2], value[j - 1]) if j > 1 else None
        grown: dict[tuple[tuple[int, int] | None, bool], float] = {}
        if step:
            grown[step, False] = best[j - 2] + KIND + KEYS + TURN
            for (way, _), cost in walks.items():
                now = cost + (0 if way == step else TURN)
                grown[step, True] = min(grown.get((step, True), math.inf), now)
        walks = grown
        by = ord(value[j - 1]) - ord(value[j - 2]) if j > 1 else 0
        going: dict[tuple[int, int], float] = {}
        if by in (1, -1) and value[j - 2].isalnum() and value[j - 1].isalnum():
            going[by, 2] = best[j - 2] + KIND + SEQUENCES
            if (by, 2) in runs or (by, 3) in runs:
                going[by, 3] = min(runs.get((by, 2), math.inf), runs.get((by, 3), math.inf))
        runs = going
        done = [cost for (_, long), cost in walks.items() if long] + [cost for (_, size), cost in runs.items() if size == 3]
        best.append(min([chars, *done, *(best[i] + KIND + cost for i, cost in ends.get(j, ()))]))
    return best[-1]


def guess_cost(value: str, words: Mapping[str, int] | None = None) -> float:
    """log10 of the guesses that the cheapest segmentation of value takes.

    Each piece costs KIND and what its kind takes: a ranked word (also backwards, with capitals, with characters for letters) its
    rank; a date or year their number; a repeat its unit's own cost and the times; a keyboard walk its first key and
    turns; a sequence of neighbouring letters or digits its start and way; other characters the alphabet's size each.
    words: rank by word, by default those of ranked_words(VOCABULARY).
    """
    if not isinstance(words, _Memo):
        words = _default(VOCABULARY) if words is None else _Memo(words)
    return _cost(value, words)


def value_cost(value: str, words: Mapping[str, int] | None = None) -> float:
    """guess_cost(), but 0 for times and placeholders, and for addresses, paths and references in code that of their hardest part."""
    if TIME.fullmatch(value) or PLACEHOLDER.fullmatch(value):
        return 0.0
    if NAMED.fullmatch(value):
        return max((guess_cost(p, words) for p in PART.findall(value)), default=0.0)
    return guess_cost(value, words)


@cache
def _default(path: str) -> _Memo:
    return _Memo(ranked_words(path))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) of the base matches, in order."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end()) for m in HEX_LONG.finditer(text)]
    return sorted(out)


def more_spans(text: str, base: list[tuple[int, int, int]], hard: float = HARD, path: str = VOCABULARY) -> list[tuple[int, int, int]]:
    """Values in credential contexts that are hard to guess and don't touch a base match."""
    if ":" not in text and "=" not in text and "earer" not in text and "EARER" not in text:
        return []
    taken = sorted((a, b) for a, _, b in base)
    reach: list[int] = []
    for _, b in taken:
        reach.append(max(b, reach[-1] if reach else 0))
    starts = [a for a, _ in taken]

    def free(a: int, b: int) -> bool:
        k = bisect_left(starts, b)
        return not k or reach[k - 1] <= a

    return [(m.start(1), 3, m.end(1)) for m in CONTEXT.finditer(text) if free(m.start(1), m.end(1)) and value_cost(m[1], _default(path)) >= hard]


def scan(text: str | None, path: str = VOCABULARY) -> dict:
    """The spans of a text, as op9 returns them; null counts as empty."""
    text = text or ""
    base = base_spans(text)
    said = lambda spans: ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)
    kinds = [k for _, k, _ in base]
    return {"n_assign": kinds.count(0), "n_access": kinds.count(1), "n_hex": kinds.count(2), "base_sha256": hashlib.sha256(said(base).encode()).hexdigest(), "spans": said(sorted(base + more_spans(text, base, path=path)))}


SCAN = pa.struct([("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())])


def secret_scan(df: DataFrame, text_col: str = "text", out_col: str = "secrets", path: str = VOCABULARY) -> DataFrame:
    """df with out_col: struct<n_assign, n_access, n_hex, base_sha256, spans> of each whole text.

    Spans are kind:start:end in code points, end exclusive, by start and then kind. path: a vocabulary file whose tokens
    are the ranked words. A null or empty text has no spans, a text of any length is scanned whole, an empty df stays
    empty. Rows are independent, so repeats get equal results; an out_col already there is replaced, other columns pass
    through, whatever their names.
    """
    ship(df.sparkSession, path)
    return with_struct(df, text_col, out_col, SCAN, lambda column: [scan(t, path) for t in column.to_pylist()])
