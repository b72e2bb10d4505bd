"""Secret scans: credential patterns, and weak parts that count only beside their complements."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, text_bytes

KINDS = ("assign", "access", "hex", "identifier", "secret", "endpoint")
#: Parts further apart than this many code points, or with a blank line between, do not belong together.
REACH = 300

ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
LONG_HEX = re.compile(r"[0-9a-f]{32,}")
IDENTIFIER = re.compile(r"(?<![A-Za-z0-9])[A-Z0-9]{16,32}(?![A-Za-z0-9])")
# '=' may stand before a secret (NAME=value, url parameters); after it, it is padding
SECRET = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}+={0,2}(?![A-Za-z0-9+/_=-])")
ADDRESS = re.compile(r"://[A-Za-z0-9.-]+(?::[0-9]+)?[^\s\"'<>]*")
_SCHEME = frozenset("abcdefghijklmnopqrstuvwxyz0123456789+.-")
BLANK = re.compile(r"\n[\x20\t\r]*\n")
KEYWORDS = ("passw", "secret", "token", "api")

_RUN = np.zeros(256, bool)
_RUN[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[ord("0") : ord("9") + 1] = True
_HEX = np.zeros(256, bool)
_HEX[[ord(c) for c in "0123456789abcdef"]] = True


def base_spans(text: str, dense: bool = True) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of the base patterns, leftmost and non-overlapping within a kind.

    ``dense`` false promises that the text has no run that 32 hex characters could lie in.
    """
    out = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 8]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    if dense:
        out += [(m.start(), m.end(), 2) for m in LONG_HEX.finditer(text)]  # maximal runs, so the same as filtering [0-9a-f]+
    return out


def _mixed(s: str) -> bool:
    """Upper case, lower case and digits all occur."""
    return any(c.isdigit() for c in s) and any("A" <= c <= "Z" for c in s) and any("a" <= c <= "z" for c in s)


def _endpoints(text: str) -> Iterator[tuple[int, int]]:
    """Spans of ``[a-z][a-z0-9+.-]*`` before an address, leftmost. Looking back from each ``://`` keeps
    long runs of letters linear."""
    at = 0
    while (k := text.find("://", at)) >= 0:
        start = k
        while start > at and text[start - 1] in _SCHEME:
            start -= 1
        while start < k and not "a" <= text[start] <= "z":
            start += 1
        m = ADDRESS.match(text, k)
        if m and start < k:
            yield start, m.end()
            at = m.end()
        else:
            at = k + 3


class _Parts:
    """Spans sorted by start, to ask for one near another span, however long single spans are."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.spans = sorted(spans)
        self.starts = [s for s, _ in self.spans]
        self.reach = list(accumulate((e for _, e in self.spans), max))  # furthest end up to each span

    def overlap(self, start: int, end: int) -> bool:
        i = bisect_left(self.starts, end) - 1
        return i >= 0 and self.reach[i] > start

    def near(self, start: int, end: int, breaks: list[int], inside: bool = False) -> bool:
        """Whether a span of these, other than this one, lies within reach and scope of [start, end);
        with ``inside`` one that overlaps it counts as well."""
        i = bisect_right(self.starts, end + REACH) - 1
        while i >= 0 and self.reach[i] >= start - REACH:
            s, e = self.spans[i]
            i -= 1
            apart = max(start - e, s - end)
            if (inside or apart >= 0) and apart <= REACH and bisect_right(breaks, min(s, start)) == bisect_right(breaks, max(s, start)):
                return True
        return False


def linked_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Weak parts that have their complements nearby, besides the ``base`` spans.

    An identifier (16 to 32 capitals and digits, both present) needs a secret in its scope, a secret
    (24 characters or more, however many, of mixed case with digits) an identifier, an endpoint both. Base spans
    serve as complements: access keys as identifiers, the other kinds as secrets. Parts in an endpoint
    are spans of their own and count as its complements.
    """
    taken = _Parts([(s, e) for s, e, _ in base])

    def free(start: int, end: int) -> bool:
        return not taken.overlap(start, end)

    weak_ids = [m.span() for m in IDENTIFIER.finditer(text) if free(*m.span()) and not m[0].isdigit() and not m[0].isalpha()]
    weak_secrets = [m.span() for m in SECRET.finditer(text) if _mixed(m[0]) and free(*m.span())]
    ids = _Parts(weak_ids + [(s, e) for s, e, k in base if k == 1])
    secrets = _Parts(weak_secrets + [(s, e) for s, e, k in base if k != 1])
    if not ids.spans or not secrets.spans:
        return []
    breaks = [m.end() for m in BLANK.finditer(text)]
    out = [(s, e, 3) for s, e in weak_ids if secrets.near(s, e, breaks)]
    out += [(s, e, 4) for s, e in weak_secrets if ids.near(s, e, breaks)]
    out += [
        (s, e, 5) for s, e in _endpoints(text) if ids.near(s, e, breaks, inside=True) and secrets.near(s, e, breaks, inside=True)
    ]
    return out


def _dense_rows(texts: pa.Array) -> np.ndarray:
    """Rows with a run of 16 or more key characters that has a digit, or of 32 or more hex characters."""
    raw, offsets = text_bytes(texts)
    out = np.zeros(len(texts), bool)
    for lut, least, digit in ((_RUN, 16, True), (_HEX, 32, False)):
        edge = np.diff(np.concatenate(([0], lut[raw].view(np.int8), [0])))
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        long = end - start >= least
        start, end = start[long], end[long]
        if digit and len(start):
            upto = np.concatenate(([0], np.cumsum(_DIGIT[raw], dtype=np.int64)))
            some = upto[end] > upto[start]
            start, end = start[some], end[some]
        if len(start):  # a run over a row's end is looked at for every row it touches
            a = np.searchsorted(offsets, start, "right") - 1
            b = np.searchsorted(offsets, end - 1, "right") - 1
            for i, j in zip(a.tolist(), b.tolist(), strict=True):
                out[i : j + 1] = True
    return out


SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, spans) per row: an array of (kind, start, end) in code points, by start, then kind.

    Each text is one row's work, so nothing is shuffled. Null text counts as empty.
    """
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    schema = T.StructType([rows.schema["doc_id"], T.StructField("spans", T.ArrayType(SPAN))])
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                dense = _dense_rows(b.column("text"))
                out = []
                for text, some in zip(b.column("text").to_pylist(), dense.tolist(), strict=True):
                    base = base_spans(text, some)
                    found = base + linked_spans(text, base) if some or any(k == 1 for *_, k in base) else base
                    found.sort(key=lambda x: (x[0], x[2]))
                    out.append([{"kind": KINDS[k], "start": s, "end": e} for s, e, k in found])
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.list_(span))], ["doc_id", "spans"])

    return rows.mapInArrow(run, schema)


BASE_KINDS = KINDS[:3]
