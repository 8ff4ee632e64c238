"""Secret scan with multipart credential linking.

Base detectors (assign, access, hex) report on their own. Weaker parts do not: an identifier (a short or
temporary access key, a client or user assignment), a key-like token of 16 characters or more, an assignment too short
for the base kind (a key too) and an endpoint (URL or host with a domain) are found as intervals and reported
only when complementary parts meet in a scope: an identifier (or a base ``access`` span) and a key (or a base
``assign`` or ``hex`` span) within ``reach`` code points of each other and no blank line between them; what
lies within an identifier is its value and no key; an endpoint then joins a pair of which both parts are near to
it, and never stands alone. ``credentials`` lists the pairs with their endpoints. The interval join is a sweep over
the sorted parts of a document: each part looks at those that begin within its reach.

Positions are code points, ends exclusive. Edge cases: null text is empty; a text of any length is
scanned whole; equal texts give equal spans; empty tables give an empty result; null ids are kept;
further columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame

#: Fixed base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_WORDS = ("passw", "secret", "token", "apikey", "api_key")

KINDS = ("assign", "access", "hex", "identifier", "key", "endpoint")
#: Weak parts.
IDENTIFIER = re.compile(r"""\b(?:AKIA[A-Z0-9]{8,13}|ASIA[A-Z0-9]{8,})\b|(?:client|user|account|access)[_-]?(?:id|key[_-]?id|name)["']?\x20{0,4}[:=]\x20{0,4}["']?([A-Za-z0-9@._-]+)""", re.A | re.I)
KEY = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{16,}={0,2}(?![A-Za-z0-9+/_=-])", re.A)
ENDPOINT = re.compile(r"https?://[A-Za-z0-9.-]{4,253}(?::[0-9]{1,5})?(?:/[A-Za-z0-9._~/-]*)?|\b(?:host|endpoint|server)\x20{0,4}[:=]\x20{0,4}[\"']?[A-Za-z0-9.-]{4,253}", re.A | re.I)
IDENTIFIER_WORDS = ("akia", "asia", "client", "user", "account", "access")
BLANK_LINE = re.compile(r"\n[\x20\t]*\n")

SPANS_SCHEMA = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, credentials string"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base kinds, sorted."""
    low = text.lower()  # finds no less than the patterns do
    out = []
    if any(w in low for w in ASSIGN_WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def _key_like(token: str) -> bool:
    """Mixed enough to be drawn at random: three classes of characters and many different ones."""
    classes = sum(any(f(c) for c in token) for f in (str.islower, str.isupper, str.isdigit))
    return classes == 3 and len(set(token)) >= min(16, len(token) // 2)


def weak_parts(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    low = text.lower()
    if not any(w in low for w in IDENTIFIER_WORDS):
        return []  # without an identifier nothing is linked
    found = [(m.start(), 3, m.end()) for m in IDENTIFIER.finditer(text)]
    if found or any(s[1] == 1 for s in base):
        found += [(m.start(), 4, m.end()) for m in KEY.finditer(text) if _key_like(m[0])]
        if any(w in low for w in ASSIGN_WORDS):
            found += [(m.start(), 4, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) < 12]
        found += [(m.start(), 5, m.end()) for m in ENDPOINT.finditer(text)]
    return sorted(found)


def credentials(text: str, base: list[tuple[int, int, int]], reach: int = 400) -> tuple[list[tuple], list[tuple[int, int, int]]]:
    """The linked pairs of parts, base spans among them, and the weak parts to report.

    A pair is an identifier and a key within reach in one scope; it is given as (identifier, key) or, where endpoints
    are near to both, as (identifier, key, the first of these). Weak parts of pairs and all endpoints that are near to
    both parts of one pair are reported, unless a base span overlaps them."""
    weak = weak_parts(text, base)
    if not weak and not any(s[1] == 1 for s in base):
        return [], []
    ids, parts, end = [s for s in weak if s[1] == 3], [], 0
    for s in sorted(weak + base):
        while end < len(ids) and ids[end][2] <= s[0]:
            end += 1
        if s[1] in (1, 3, 5) or not (end < len(ids) and ids[end][0] <= s[0] and s[2] <= ids[end][2]):
            parts.append(s)
    breaks = [m.start() for m in BLANK_LINE.finditer(text)]
    scope = [bisect.bisect_right(breaks, s[0]) for s in parts]
    role = {0: "key", 1: "id", 2: "key", 3: "id", 4: "key", 5: "end"}
    pairs, ends = [], [set() for _ in parts]
    for i, a in enumerate(parts):  # the sweep
        j = i + 1
        while j < len(parts) and parts[j][0] - a[2] <= reach and scope[j] == scope[i]:
            x, y = role[a[1]], role[parts[j][1]]
            if {x, y} == {"id", "key"}:
                pairs.append((i, j) if x == "id" else (j, i))
            elif x == "end" != y:
                ends[j].add(i)
            elif y == "end" != x:
                ends[i].add(j)
            j += 1
    groups, weak = [], set()
    for i, k in sorted(pairs):
        both = ends[i] & ends[k]
        groups.append((parts[i], parts[k], parts[min(both)]) if both else (parts[i], parts[k]))
        weak.update((i, k), both)
    starts, furthest = [b[0] for b in base], [0]  # the furthest end of the base spans that begin before
    for b in base:
        furthest.append(max(furthest[-1], b[2]))
    free = lambda p: furthest[bisect.bisect_left(starts, p[2])] <= p[0]
    return groups, sorted(p for p in (parts[i] for i in weak) if p[1] > 2 and free(p))


def linked(text: str, base: list[tuple[int, int, int]], reach: int = 400) -> list[tuple[int, int, int]]:
    """Weak parts whose complement is in the same scope."""
    return credentials(text, base, reach)[1]


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find_secrets(docs: DataFrame, reach: int = 400) -> DataFrame:
    """Rows of SPANS_SCHEMA of ``docs`` (doc_id, text)."""

    def scan(batches):
        for batch in batches:
            out = []
            for text in batch.column(1):
                text = text.as_py() or ""
                base = base_spans(text)
                kinds = [s[1] for s in base]
                groups, weak = credentials(text, base, reach)
                every = sorted(base + weak)
                of_pairs = ",".join("+".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in g) for g in groups)
                out.append((kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(joined(base).encode()).hexdigest(), joined(every), of_pairs))
            cols = list(zip(*out)) if out else [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=[x.split()[0] for x in SPANS_SCHEMA.split(", ")])

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").mapInArrow(scan, SPANS_SCHEMA)
