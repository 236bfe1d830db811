"""Secret scans: plain patterns, and weak candidates linked by what stands near them.

Per text, the base patterns give spans that are secrets by themselves. A credential often has
several parts, an access identifier, a secret and an endpoint, of which each alone may be
anything. Weak parts (names of users or keys, words that look random, addresses) are therefore
only reported where parts of different kinds meet: an interval join by sorted starts links
parts whose distance within their scope (a paragraph) is at most `REACH`. It runs inside each
text, where the parts are sorted already, in time linear in the parts, so that nothing is
shuffled and a text with many parts makes no pairs.

Defined results: a null or empty text has no spans; equal texts get equal spans; offsets are
code points, ends exclusive. Columns besides `doc_id` and `text` are not read.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Sequence
from itertools import accumulate
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kartoteka.llm.memory import lean

REACH = 200  # code points between linked parts, at most

Span = tuple[str, int, int]

# Base kinds in their order, and their patterns.
BASE_KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ASSIGN_NAMES = ("passw", "secret", "token", "api")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_LONG_HEX = re.compile(r"[0-9a-f]{16,}")
_HEX_CLASS = bytes(ord("x") if c in b"0123456789abcdef" else ord(" ") for c in range(256))

# Weak parts: what they look like, and which kinds together make a credential.
_ADDRESS = re.compile(r"\b[a-z][a-z0-9+.-]{1,20}://[^\s\"'<>|]+|\b[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?::[0-9]{1,5})?\b", re.A | re.I)
_IDENTIFIER = re.compile(r"\b(?:user(?:name)?|login|account|client_?id|access_?key(?:_?id)?)[\"']?\x20*[:=]\x20*[\"']?[^\s\"',;]{3,}", re.A | re.I)
_IDENTIFIER_NAMES = ("user", "login", "account", "client", "access")
_RANDOM = re.compile(r"[A-Za-z0-9+/_=-]{20,}", re.A)
_SECRET, _IDENTITY, _PLACE = "secret", "identity", "endpoint"


def base_spans(text: str) -> list[Span]:
    """Spans of the base patterns by start, then by kind as listed."""
    found: list[tuple[int, int, Span]] = []
    lowered = text.lower()
    if any(name in lowered for name in _ASSIGN_NAMES):
        found += [(m.start(), 0, ("assign", *m.span())) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, ("access", *m.span())) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    # Runs of hex digits are looked for on bytes; only a text that has one is searched by pattern.
    if b"x" * 16 in text.encode().translate(_HEX_CLASS):
        found += [(m.start(), 2, ("hex", *m.span())) for m in _LONG_HEX.finditer(text)]
    return [span for *_, span in sorted(found)]


def _looks_random(word: str) -> bool:
    """Mixed classes of characters, and more bits per character than words have; of two classes only, more of both."""
    digits, lower, upper = (any(test(c) for c in word) for test in (str.isdigit, str.islower, str.isupper))
    if digits + lower + upper < 2:
        return False
    if not digits and sum(a.islower() != b.islower() for a, b in zip(word, word[1:]) if a.isalpha() and b.isalpha()) < 4:
        return False  # capitals at the beginning of words
    counts = Counter(word)
    bits = -sum(n / len(word) * log2(n / len(word)) for n in counts.values())
    return bits >= (3.5 if digits + lower + upper == 3 else 3.7)


def _parts(text: str, base: Sequence[Span]) -> list[tuple[int, int, str, bool]]:
    """(start, end, kind of part, weak) of everything that may be one part of a credential."""
    out = [(start, end, _IDENTITY if kind == "access" else _SECRET, False) for kind, start, end in base]
    starts, ends = [s for _, s, _ in base], list(accumulate((e for *_, e in base), max))

    def overlaps(start: int, end: int) -> bool:
        before = bisect_left(starts, end)
        return before > 0 and ends[before - 1] > start

    if "://" in text or "." in text and any(c.isdigit() for c in text):
        out += [(*m.span(), _PLACE, True) for m in _ADDRESS.finditer(text)]
    lowered = text.lower()
    if any(name in lowered for name in _IDENTIFIER_NAMES):
        out += [(*m.span(), _IDENTITY, True) for m in _IDENTIFIER.finditer(text) if not overlaps(*m.span())]
    out += [(*m.span(), _SECRET, True) for m in _RANDOM.finditer(text) if _looks_random(m[0]) and not overlaps(*m.span())]
    return sorted(out)


def _paragraphs(text: str) -> list[int]:
    return [m.end() for m in re.finditer(r"\n\s*\n", text)]


def linked_spans(text: str, base: Sequence[Span]) -> list[Span]:
    """Weak parts with a part of another kind within reach in their paragraph, one of the two a secret or identity.

    One sweep in the order of starts keeps, for each kind and scope, the part with the greatest end so
    far, one against it the part with the smallest start: nothing before or behind is nearer than these.
    """
    parts = _parts(text, base)
    if len({kind for _, _, kind, _ in parts}) < 2:
        return []
    borders = _paragraphs(text)
    scope = [bisect_left(borders, start + 1) for start, *_ in parts]
    last: dict[tuple[int, str], int] = {}
    hit = [False] * len(parts)
    needs = {_SECRET: (_IDENTITY, _PLACE), _IDENTITY: (_SECRET,), _PLACE: (_SECRET,)}
    for i, (start, end, kind, _) in enumerate(parts):
        for other in needs[kind]:
            j = last.get((scope[i], other))
            if j is not None and start - parts[j][1] <= REACH:
                hit[i] = True
        if (scope[i], kind) not in last or end > parts[last[scope[i], kind]][1]:
            last[scope[i], kind] = i
    after: dict[tuple[int, str], int] = {}
    for i in range(len(parts) - 1, -1, -1):
        start, end, kind, _ = parts[i]
        for other in needs[kind]:
            j = after.get((scope[i], other))
            if j is not None and parts[j][0] - end <= REACH:
                hit[i] = True
        after[scope[i], kind] = i
    return [(kind, start, end) for (start, end, kind, weak), found in zip(parts, hit, strict=True) if weak and found]


def find_secrets(text: str | None) -> tuple[list[Span], list[Span]]:
    """(base spans, spans added by linking) of one text."""
    base = base_spans(text or "")
    return base, linked_spans(text, base) if text else []


def _joined(spans: Sequence[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def _ordered(base: Sequence[Span], more: Sequence[Span]) -> list[Span]:
    kinds = (*BASE_KINDS, _SECRET, _IDENTITY, _PLACE)
    return sorted([*base, *more], key=lambda s: (s[1], kinds.index(s[0]), s[2]))


def scan_secrets(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, counts of base kinds, the digest of base spans, all spans, and the number of linked ones."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: list[list[int]] = [[], [], [], []]
            digests, joined = [], []
            for text in batch.column(1):
                base, more = find_secrets(text.as_py())
                for i, kind in enumerate(BASE_KINDS):
                    counts[i].append(sum(s[0] == kind for s in base))
                counts[3].append(len(more))
                digests.append(hashlib.sha256(_joined(base).encode()).hexdigest())
                joined.append(_joined(_ordered(base, more)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, pa.int64()) for c in counts[:3]], pa.array(digests, pa.string()), pa.array(joined, pa.string()), pa.array(counts[3], pa.int64())],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_linked"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        lean(run), f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_linked long")


def mask(text: str) -> str:
    """The text with every base or linked span replaced by its kind in brackets; where spans overlap, by the first one's."""
    out, at = [], 0
    for kind, start, end in _ordered(*find_secrets(text)):
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def mask_secrets(docs: DataFrame) -> DataFrame:
    """All rows and columns of `docs`, with secrets in `text` masked and `n_chars`, if there, counted anew."""
    where = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            masked = [None if t is None else mask(t) for t in (x.as_py() for x in batch.column(where))]
            columns = [pa.array(masked, pa.string()) if i == where else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    out = docs.mapInArrow(lean(run), docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out
