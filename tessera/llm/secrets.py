"""Secret scans with multipart credential linking.

Base kinds (assign, access, hex) are found by pattern alone. A weak candidate (an account name, a key-like
token, an endpoint) is reported only if a complementary part lies in the same scope: the parts of a text are
intervals on its code points, and an interval join, which sweeps the parts once by position, matches each
weak part with parts that lie at most `scope` code points away.
A text is scanned within one task and never shuffled, so a hot source or a long text costs no more than its length.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: The patterns and least lengths of the base kinds, in the order in which ties are listed.
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
BASE = ("assign", "access", "hex")
ASSIGN_LEAST, ACCESS_LEAST = 6, 20

#: Weak kinds: an account or key name, a key-like token (32 characters or more, with a digit, a capital and a small letter), an endpoint.
IDENT = re.compile(r"""(?:user(?:_?name)?|login|account|client_?id|key_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@+/_.-]{3,})""", re.ASCII | re.IGNORECASE)
KEY = re.compile(r"[A-Za-z0-9+/_-]{32,}={0,2}")
#: What follows `://` in an endpoint; its scheme is looked for backwards from there.
PLACE = re.compile(r"[A-Za-z0-9._:@/?&%=-]+")
SCHEME = frozenset("abcdefghijklmnopqrstuvwxyz0123456789+.-")
WEAK = ("ident", "key", "endpoint")
KINDS = BASE + WEAK

#: Greatest distance in code points between complementary parts.
SCOPE = 200

#: Which parts make a weak one worth a report: of each group, one part at least.
IDENTIFIERS, SECRETS = ("access", "ident"), ("assign", "hex", "key")
COMPLEMENTS = {"ident": (SECRETS,), "key": (IDENTIFIERS,), "endpoint": (IDENTIFIERS, SECRETS)}

Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    """(start, end, kind) of the base kinds, by start, then kind as listed; the end is exclusive."""
    found: list[Span] = []
    if "=" in text or ":" in text:
        found += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(*m.span(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    found += [(*m.span(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def weak_spans(text: str) -> list[Span]:
    found: list[Span] = []
    if "=" in text or ":" in text:
        found += [(*m.span(), "ident") for m in IDENT.finditer(text)]
    if "://" in text:
        found += endpoints(text)
    for m in KEY.finditer(text):
        token = m[0]
        if any(c.isdigit() for c in token) and any("a" <= c <= "z" for c in token) and any("A" <= c <= "Z" for c in token):
            found.append((*m.span(), "key"))
    return found


def endpoints(text: str) -> list[Span]:
    """Leftmost scheme of small letters, digits, + . -, beginning with a letter, and what follows its colon. Each character is looked at once."""
    found, over, at = [], 0, text.find("://")
    while at >= 0:
        start, first = at, None
        while start > over and text[start - 1] in SCHEME:
            start -= 1
            if "a" <= text[start] <= "z":
                first = start
        place = PLACE.match(text, at + 3) if first is not None else None
        if place:
            found.append((first, place.end(), "endpoint"))
        over = place.end() if place else at + 1
        at = text.find("://", over)
    return found


def linked(weak: list[Span], parts: list[Span], scope: int = SCOPE) -> list[Span]:
    """The weak spans that have, for each group of complements, a part at most `scope` away that does not overlap them.

    An interval join: each group's parts are held by start with the greatest end so far, so one binary search
    on either side of a span finds its nearest complement without listing pairs.
    """
    index: dict[tuple[str, ...], tuple[list[int], list[int]]] = {}
    for group in {g for kinds in COMPLEMENTS.values() for g in kinds}:
        own = sorted((s, e) for s, e, kind in parts if kind in group)
        index[group] = [s for s, _ in own], sorted(e for _, e in own)

    def near(start: int, end: int, group: tuple[str, ...]) -> bool:
        starts, ends = index[group]
        after = bisect.bisect_left(starts, end)
        before = bisect.bisect_right(ends, start) - 1
        return after < len(starts) and starts[after] - end <= scope or before >= 0 and start - ends[before] <= scope

    return [s for s in weak if all(near(s[0], s[1], group) for group in COMPLEMENTS[s[2]])]


def scan(text: str, scope: int = SCOPE) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans: base ones and the linked weak ones that none of them overlaps."""
    base = base_spans(text)
    weak = weak_spans(text)
    if not weak:
        return base, base
    starts, ends = [b[0] for b in base], list(itertools.accumulate((b[1] for b in base), max))

    def free(span: Span) -> bool:
        """No base span begins before its end and ends after its start."""
        before = bisect.bisect_left(starts, span[1])
        return not before or ends[before - 1] <= span[0]

    added = [s for s in linked(weak, base + weak, scope) if free(s)]
    return base, sorted({*base, *added}, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def listed(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def redacted(text: str, spans: list[Span], mask: str = "<SECRET>") -> str:
    """The text with each span, or run of overlapping spans, replaced by the mask."""
    out, at, covered = [], 0, 0
    for start, end, _ in sorted(spans):
        if start >= covered:
            out += [text[at:start], mask]
        at = covered = max(covered, end)
    return "".join(out) + text[at:]


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """One row per row of docs: counts of the base kinds, a digest of the base spans, and all spans.

    A null text counts as empty and an empty text has no spans; a null id stays null. Repeated rows give repeated
    results, an empty table an empty result; columns other than the two named ones are not read.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {id_type}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [scan(t or "", scope) for t in batch.column(1).to_pylist()]
            counts = [[sum(kind == k for *_, k in base) for base, _ in found] for kind in BASE]
            digests = [hashlib.sha256(listed(base).encode()).hexdigest() for base, _ in found]
            columns = [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array([listed(every) for _, every in found], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def redact_secrets(docs: DataFrame, text_col: str = "text", scope: int = SCOPE, mask: str = "<SECRET>") -> DataFrame:
    """docs with every found span of text_col replaced by the mask; null texts stay null, other columns as they are."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t if t is None else redacted(t, scan(t, scope)[1], mask) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(texts, batch.schema.field(at).type), *batch.columns[at + 1 :]], schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
