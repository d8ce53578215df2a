"""Secret scans: fixed patterns, and password guess cost in credential context.

The base patterns find assignments, access keys and long hexadecimal strings.
Besides, a value that prose names as a credential ("passphrase is ...",
"login: ...") counts as a secret if it would be hard to guess: a dynamic
program finds its cheapest segmentation into words, dates, repeats, keyboard
walks, runs and brute-force spans, and the guesses that this takes are held
against ``LEAST_GUESSES``. Ordinary words cost little, whatever stands before:
the dictionary is the whole words of a public tokenizer's vocabulary, whose ids
follow their frequency.
"""

from __future__ import annotations

import json
import math
import re
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
CONTEXT = re.compile(
    r"""(?<![A-Za-z])(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|(?:api|access|private|secret)[_\x20-]?key|auth|credentials?|login|bearer)["']?(?:\x20*(?:=>|->|[:=])\x20*|\x20(?:is|was)\x20)["']?([^\s"'<>,;]{6,})""",
    re.ASCII | re.IGNORECASE,
)
#: One of these is in every text that ASSIGN or CONTEXT can match (lower case).
_STEMS = (b"pass", b"pwd", b"secret", b"token", b"key", b"auth", b"credential", b"login", b"bearer")
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))

#: Decimal logarithm of the guesses from which a value in context is a secret.
LEAST_GUESSES = 8.0

# The rows of a keyboard.
ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm")

_PLAIN = str.maketrans("@4301!5$7", "aaeoiisst")
_AT = {c: (y, x) for y, row in enumerate(ROWS) for x, c in enumerate(row)}
_YEAR, _MONTH, _DAY = r"(?:19|20)\d\d", r"(?:0[1-9]|1[0-2])", r"(?:0[1-9]|[12]\d|3[01])"
#: Dates of each precision, and log10 of how many there are.
_DATES = (
    (re.compile(_YEAR, re.ASCII), 2.0), (re.compile(f"{_YEAR}[-/.]?{_MONTH}", re.ASCII), math.log10(100 * 12)),
    (re.compile(f"{_YEAR}[-/.]?{_MONTH}[-/.]?{_DAY}", re.ASCII), math.log10(100 * 365)), (re.compile(f"{_DAY}[-/.]?{_MONTH}[-/.]?{_YEAR}", re.ASCII), math.log10(100 * 365)),
)
#: What beginning one more segment multiplies the guesses by.
_JOINT = math.log10(4)
#: Shortest word, run and walk; longest stretch that a repeat repeats; longest run, walk and repeat.
_SHORTEST, _LONGEST_UNIT, _LONGEST = 3, 16, 256


@cache
def dictionary(path: str) -> tuple[dict[str, int], int]:
    """Rank of each whole word (three letters or more) of a tokenizer's vocabulary, by id, and the longest's length."""
    with open(path, encoding="utf-8") as file:
        vocabulary = json.load(file)["model"]["vocab"]
    whole = (t.removesuffix("</w>") for t, _ in sorted(vocabulary.items(), key=lambda x: x[1]) if t.endswith("</w>"))
    words = dict.fromkeys(w for w in whole if len(w) >= _SHORTEST and w.isascii() and w.isalpha())
    return {w: i + 1 for i, w in enumerate(words)}, max(map(len, words))


def _space(value: str) -> float:
    """log10 of the number of characters that brute force tries at each place."""
    size = 10 * any(c.isdigit() for c in value) + 26 * any(c.islower() for c in value) + 26 * any(c.isupper() for c in value) + 33 * any(not c.isalnum() for c in value) + 100 * (not value.isascii())
    return math.log10(max(size, 2))


def _word_cost(value: str, low: str, rank: dict[str, int]) -> float:
    """Cost of a whole stretch as one word, with capitals and signs for letters; infinite for no word."""
    best = math.inf
    for text, extra in ((low, 0.0), (low.translate(_PLAIN), 1.0)):
        if text in rank:
            upper = sum(c.isupper() for c in value)
            best = min(best, math.log10(rank[text] + 1) + extra + (math.log10(2) * min(upper, len(value) - upper + 1) if upper else 0.0))
    return best


def _step(kind: str, a: str, b: str) -> int | None:
    """What two neighbours of a run or of a keyboard walk have in common with the next two; none if they are no part of one."""
    if kind == "run":
        return ord(b) - ord(a) if abs(ord(b) - ord(a)) == 1 else None
    p, q = _AT.get(a), _AT.get(b)
    return 1 if p and q and a != b and abs(p[0] - q[0]) <= 1 and abs(p[1] - q[1]) <= 1 else None


def _line_cost(kind: str, n: int) -> float:
    return math.log10(26 * n) if kind == "run" else math.log10(40 * n) + n * math.log10(2) / 2


def guess_cost(value: str, path: str, enough: float = math.inf) -> float:
    """log10 of the guesses that the cheapest segmentation of ``value`` takes; 0 for an empty value.

    Segments, of any place and of any length up to 256: a word of the dictionary at ``path`` (its
    rank, and twice for each capital or small letter, whichever are fewer; ten
    times where signs stand for letters), a date, a run (abc, 321) or keyboard
    walk of three or more, a stretch of up to 16 characters that is repeated
    (what it costs as a word or by brute force, times the number of repeats),
    and brute force (of any length). Each further segment multiplies by four.
    Where the cost is known to be ``enough`` or more, a lower bound of at least
    that may be returned instead.
    """
    rank, longest = dictionary(path)
    n = len(value)
    low = value.lower() if len(value.lower()) == n else value
    char = _space(value)
    # where the run or walk that ends before place j began
    lines: dict[str, list[int]] = {}
    for kind in ("run", "walk"):
        began, last = [0] * (n + 1), None
        for j in range(1, n + 1):
            step = _step(kind, low[j - 2], low[j - 1]) if j > 1 else None
            began[j] = j - 1 if step is None else began[j - 1] if step == last else j - 2
            last = step
        lines[kind] = began
    # by period: how many characters before place j equal those a period earlier
    same = [[0] * (n + 1) for _ in range(min(_LONGEST_UNIT, n // 2) + 1)]
    for period in range(1, len(same)):
        for j in range(period + 1, n + 1):
            same[period][j] = same[period][j - 1] + 1 if low[j - 1] == low[j - 1 - period] else 0
    dates: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]  # by end: (start, cost)
    for i in range(n):
        for pattern, cost in _DATES:
            if m := pattern.match(low, i):
                dates[m.end()].append((i, cost))
    best = [0.0] + [math.inf] * n  # of all segmentations up to here
    brute = [math.inf] * (n + 1)  # of those that end in a brute-force span
    before = [-_JOINT] + [math.inf] * n  # best, less the joint that the first segment doesn't have
    for j in range(1, n + 1):
        brute[j] = min(brute[j - 1], before[j - 1] + _JOINT) + char
        found = brute[j]
        for i in range(max(0, j - longest), j - _SHORTEST + 1):
            found = min(found, before[i] + _JOINT + _word_cost(value[i:j], low[i:j], rank))
        for i, cost in dates[j]:
            found = min(found, before[i] + _JOINT + cost)
        for kind, began in lines.items():
            for i in range(max(began[j], j - _LONGEST), j - _SHORTEST + 1):
                found = min(found, before[i] + _JOINT + _line_cost(kind, j - i))
        for period in range(1, len(same)):
            most = min(same[period][j], _LONGEST - period) // period + 1
            if most > 1:
                unit = min(period * char, _word_cost(value[j - period : j], low[j - period : j], rank))
                found = min(found, _JOINT + unit + min(before[j - k * period] + math.log10(k) for k in range(2, most + 1)))
        best[j] = before[j] = found
        if j % _LONGEST == 0 and j < n and min(min(best[j - _LONGEST : j + 1]), brute[j]) >= enough:
            return enough  # no segmentation can begin its next segment for less
    return best[n]


def secret_spans(text: str, path: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start, then as kinds are listed; ``path``: see ``guess_cost``."""
    found = [("access", *m.span()) for m in ACCESS.finditer(text)] if "AKIA" in text else []
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    raw = text.encode("utf-8", "surrogatepass").translate(_LOWER)
    if any(s in raw for s in _STEMS):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
        base = list(found)
        for m in CONTEXT.finditer(text):
            lo, hi = m.span(1)
            while hi > lo and text[hi - 1] in ".:!?)":
                hi -= 1
            if hi - lo < 6 or any(s <= lo and hi <= e for _, s, e in base):
                continue
            if guess_cost(text[lo:hi], path, LEAST_GUESSES) >= LEAST_GUESSES:
                found.append(("guess", lo, hi))
    return sorted(found, key=lambda f: (f[1], KINDS.index(f[0])))


def redact(text: str, spans: list[tuple[str, int, int]], mark: str = "[secret]") -> str:
    """The text with every stretch that spans cover replaced by one ``mark``."""
    out, at = [], 0
    for _, lo, hi in spans:
        if lo >= at:
            out += [text[at:lo], mark]
        at = max(at, hi)
    return "".join(out) + text[at:]


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def find_secrets(text: Column, path: str) -> Column:
    """``array<struct<kind, start, end>>`` of a text column, sorted; null texts have none."""

    @F.arrow_udf("array<struct<kind: string, start: long, end: long>>")
    def spans(texts: pa.Array) -> pa.Array:
        return pa.array([[dict(zip(("kind", "start", "end"), s, strict=True)) for s in secret_spans(t, path)] if t else [] for t in texts.to_pylist()], _SPANS)

    return spans(text)


def redacted(text: Column, path: str, mark: str = "[secret]") -> Column:
    """The text column without its secrets; null stays null."""

    @F.arrow_udf("string")
    def clean(texts: pa.Array) -> pa.Array:
        C.give_back()
        return pa.array([t and redact(t, secret_spans(t, path), mark) for t in texts.to_pylist()], pa.string())

    return clean(text)


def scan_secrets(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, secrets``, a row for each row, whatever repeats; a null or empty text has no secrets, an empty table no rows.

    ``path``: the tokenizer file that holds the dictionary, on every executor. Other columns are not looked at.
    """
    C.session_batches(docs.sparkSession)
    rows = C.own(docs, doc_id=id_col, text=text_col)
    return rows.select("doc_id", find_secrets(F.col("text"), path).alias("secrets"))
