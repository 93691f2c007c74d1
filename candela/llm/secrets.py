"""Operator 3: secret scans, with a guess-cost estimate for values in credential contexts.

Base spans follow three fixed patterns. The method adds spans of kind ``guess``: the value of a
wider set of credential contexts, if the cheapest segmentation of the value into known words,
dates, repeats, keyboard walks and brute-force stretches still takes at least ``min_log10`` (log10)
guesses, and no base span covers it. Cost of a segmentation: the product of its parts' guesses
times the factorial of their number; the minimum is found by dynamic programming over end positions.

A value that is itself a keyword ("Authorization: Bearer ...", "password: secret: ...") is read as the next
context. Values of letters only are judged like others after : = and =>; after "is", "was" and a bare
"Bearer" they are taken for prose and skipped. A keyword may begin in a name (client_secret, dbPassword) and
go on by up to three parts (secret_id, token-for-ci); digits alone are then a count (token_count = 4096) and
skipped. Keywords inside a run of lower-case letters (dbpassword) are no contexts.

Words come from a short list of common passwords, then from a public vocabulary in the order of its merges. Positions are code
points, end exclusive. Defined cases: null and empty texts have no spans; base
spans stay whatever their cost; values longer than ``MAX_SEGMENT`` are segmented whole, only single
word, date and walk segments are bounded by it (repeats are not). Neither bound changes a verdict at
thresholds up to 8.6: a walk of more than ``MAX_SEGMENT`` keys costs that much by itself, 20 parts cost 18.
"""

from __future__ import annotations

import base64
import hashlib
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .tokens import vocabulary as vocabulary_path

# The base patterns and their least lengths.
ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}", re.ASCII)
HEX = re.compile(r"[0-9a-f]{16,}", re.ASCII)
MIN_ASSIGN = 12
KINDS = ("assign", "access", "hex", "guess")

# Contexts of the method. A keyword may follow _ or - (DB_PASSWORD) or begin a capital (dbPassword).
KEYWORD = r"(?i:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|auth(?:orization)?|bearer|api[_-]?key|access[_-]?key|private[_-]?key|login|pin)"
CONTEXT = re.compile(
    rf"""(?:(?<![A-Za-z0-9])|(?<=[a-z])(?=[A-Z]))(?:{KEYWORD}(?P<more>(?:[_-][A-Za-z0-9]+){{0,3}})["']?\x20*(?P<sep>:=|=>|[:=]|\b(?:is|was)\b)\x20*|(?i:bearer)\x20+)["']?(?P<value>[^\s"'<>|]{{4,}})""",
    re.ASCII,
)
WORD = re.compile(KEYWORD, re.ASCII)
HINT = re.compile(r"(?i:pass|pwd|secret|token|credential|auth|bearer|key|login|pin)", re.ASCII)

# Common words of passwords, most common first. Behind them come the words of a public vocabulary, in its order.
COMMON = (
    "password 123456 qwerty letmein welcome admin login master dragon monkey shadow sunshine princess football baseball "
    "iloveyou abc123 trustno1 superman batman hello freedom whatever secret test guest root user pass default changeme "
    "summer winter spring autumn love money soccer hockey michael jordan ashley charlie thomas robert daniel jessica "
    "andrew computer internet server system data token key the and for with that this have from you not are was all"
).split()
VOCABULARY = "byte_bpe_50k.tiktoken"


@lru_cache(maxsize=4)
def ranks(vocabulary: str | None = VOCABULARY) -> dict[str, int]:
    """Rank of each known word: the common ones, then the vocabulary's whole words (merges that begin a word) of three letters or
    more. Merges are listed from the most frequent on, so their order is a rank."""
    words = dict.fromkeys(COMMON)
    if vocabulary:
        with open(vocabulary_path(vocabulary), "rb") as f:
            for line in f:
                piece = base64.b64decode(line.split()[0])
                if piece[:1] == b" " and len(piece) > 3 and piece[1:].isalpha() and piece.isascii():
                    words.setdefault(piece[1:].decode().lower())
    return {w: i + 1 for i, w in enumerate(words)}


KEYBOARD = ("1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
LEET = str.maketrans("@4301!$5", "aaeoiiss")
MAX_SEGMENT = 24
#: Numbers of parts are told apart up to this one.
PARTS = 20
BLOCKS = range(2, 9)


def _near() -> set[tuple[str, str]]:
    out = set()
    for row in KEYBOARD:
        out |= {(a, b) for a, b in zip(row, row[1:])} | {(b, a) for a, b in zip(row, row[1:])}
    for up, down in zip(KEYBOARD, KEYBOARD[1:]):
        for i, c in enumerate(down):
            for j in (i, i + 1):
                if j < len(up):
                    out |= {(up[j], c), (c, up[j])}
    return out


NEAR = _near()
LOG = [0.0] + [math.log10(i) for i in range(1, 200)]
LOG_FACTORIAL = [math.log10(math.factorial(k)) for k in range(PARTS + 1)]


def _pool(c: str) -> int:
    return 10 if c.isdigit() else 26 if c.isalpha() else 33


def _date(s: str) -> bool:
    for order in (s, s[::-1]):
        if order is s and len(s) == 4:
            return 1900 <= int(s) <= 2050
    if len(s) not in (6, 8):
        return False
    for y, m, d in ((s[:-4], s[-4:-2], s[-2:]), (s[4:], s[2:4], s[:2]), (s[4:], s[:2], s[2:4])):
        if 1 <= int(m) <= 12 and 1 <= int(d) <= 31 and (len(y) == 2 or 1900 <= int(y) <= 2050):
            return True
    return False


@lru_cache(maxsize=20_000)
def _remembered(value: str) -> float:
    return _guess_log10(value)


def guess_log10(value: str) -> float:
    """log10 of the least number of guesses over all segmentations of ``value``. Long values are not remembered."""
    return _remembered(value) if len(value) <= 200 else _guess_log10(value)


def _guess_log10(value: str) -> float:
    """best[i] holds, for a number of parts up to PARTS (more count as that many in the factorial), the cheapest cost of the first i
    characters. Only positions that a later part can begin at are kept: the last MAX_SEGMENT and the starts of running repeats, so
    work is linear in the length and memory does not grow with it."""
    n = len(value)
    rank_of = ranks()
    low = value.lower()
    plain = low.translate(LEET)
    inf = float("inf")
    best = {0: [0.0] + [inf] * PARTS}
    brute = [inf] * (PARTS + 1)  # segmentations that end inside a brute-force stretch
    same = 1  # length of the run of equal characters that ends here
    again = dict.fromkeys(BLOCKS, 0)  # characters up to here that equal the one a block before
    for i in range(1, n + 1):
        c = value[i - 1]
        cost_1 = LOG[_pool(c)]
        same = same + 1 if i > 1 and c == value[i - 2] else 1
        last = best[i - 1]
        opened = [inf, *last[: PARTS - 1], min(last[PARTS - 1], last[PARTS])]
        brute = [min(x, y) + cost_1 for x, y in zip(brute, opened)]
        here = brute[:]
        parts: list[tuple[int, float]] = []
        for size in range(2, min(MAX_SEGMENT, i) + 1):
            a = i - size
            seg = low[a:i]
            rank = rank_of.get(seg) or rank_of.get(plain[a:i])
            if rank:
                upper = 0.0 if value[a:i] == seg else 0.7
                parts.append((a, math.log10(rank + 1) + upper + (0.5 if seg not in rank_of else 0.0)))
            if size in (4, 6, 8) and seg.isdigit() and seg.isascii() and _date(seg):
                parts.append((a, math.log10(150 if size == 4 else 55_000)))
            if size >= 3 and all((x, y) in NEAR for x, y in zip(seg, seg[1:])):
                parts.append((a, math.log10(47) + math.log10(2) * (size - 1)))
        if same >= 3:
            parts.append((i - same, cost_1 + math.log10(same)))
        for block in BLOCKS:  # a block repeated up to here, as often as it goes
            again[block] = again[block] + 1 if i > block and c == value[i - 1 - block] else 0
            if (times := again[block] // block + 1) >= 2:
                parts.append((i - block * times, sum(LOG[_pool(x)] for x in value[i - block : i]) + math.log10(times)))
        for a, cost in parts:
            for k, x in enumerate(best[a]):
                if x < inf:
                    to = min(k + 1, PARTS)
                    here[to] = min(here[to], x + cost)
        best[i] = here
        if i % 64 == 0:
            needed = {i - same, *range(max(0, i - MAX_SEGMENT), i + 1)}
            for block in BLOCKS:
                start = i - again[block] - block
                needed |= {x for x in range(start, start + block + 1) if x >= 0}
            best = {k: v for k, v in best.items() if k in needed}
    return max(0.0, min(c + LOG_FACTORIAL[k] for k, c in enumerate(best[n]) if c < inf)) if n else 0.0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base spans, sorted."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= MIN_ASSIGN]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def method_spans(text: str, base: list[tuple[int, int, int]], min_log10: float) -> list[tuple[int, int, int]]:
    """Values of credential contexts that take many guesses and that no base span covers."""
    out, at, led = [], 0, None
    if HINT.search(text):
        while m := CONTEXT.search(text, at):
            sep = m["sep"] or (led if m.start() == at else None)
            at, led, start = m.end(), None, m.start("value")
            value = m["value"].rstrip(".,;:!?)")
            if WORD.fullmatch(value.rstrip("=:")):
                at, led = start, sep
                continue
            if len(value) < 4 or any(s <= start and start + len(value) <= e for s, _, e in base):
                continue
            prose = sep in (None, "is", "was") and not any(c.isdigit() or not c.isalnum() for c in value)
            count = m["more"] and value.isdigit()
            if not prose and not count and guess_log10(value) >= min_log10:
                out.append((start, 3, start + len(value)))
    return out


def _render(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan_secrets(docs: DataFrame, min_log10: float = 8.0) -> DataFrame:
    """doc_id, counts by kind, spans, a digest of the base spans and the text with spans masked.

    ``weakest_log10`` is the least guess cost among the values of base assign spans and method spans.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                text = text or ""
                base = base_spans(text)
                every = sorted([*base, *method_spans(text, base, min_log10)])
                costs = [guess_log10(text[s:e]) for s, k, e in every if k == 3]
                costs += [guess_log10(m[1]) for s, k, e in base if k == 0 and (m := ASSIGN.match(text, s))]
                rows.append({
                    "doc_id": doc, **{f"n_{name}": sum(k == i for _, k, _ in every) for i, name in enumerate(KINDS)},
                    "base_sha256": hashlib.sha256(_render(base).encode()).hexdigest(), "spans": _render(every),
                    "weakest_log10": min(costs, default=None), "masked": _masked(text, every) if every else None})
            yield pa.RecordBatch.from_pylist(rows, schema=kind)

    kind = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string()), ("weakest_log10", pa.float64()), ("masked", pa.string())])
    out = docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, n_guess long, base_sha256 string, spans string, weakest_log10 double, masked string")
    return out


def _masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    out, at = [], 0
    for s, k, e in spans:
        if e > at:
            out += [text[at : max(s, at)], f"<{KINDS[k]}>"]
            at = e
    return "".join([*out, text[at:]])


def digests(docs: DataFrame) -> DataFrame:
    return scan_secrets(docs).drop("masked")
