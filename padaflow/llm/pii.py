"""Personal data: patterns, and spans that a BiLSTM-CRF adds to them.

The tagger reads overlapping windows on a fixed grid over the whole text.  Each position takes its tag from
the one window in whose middle half it lies (or the first window), and runs of tags over window borders are
one span.  Decoding is constrained: only positions in a run of characters without white space that holds a
digit or an @, and single blanks between two such runs, may be tagged; all others are outside.  A window
that owns none of those positions can't tag anything, so it isn't run.  A span is added if it has the form
of its kind and meets no pattern span.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from padaflow.llm.common import arrow_map, grouped, small_batches
from padaflow.llm.kernels import runs
from padaflow.llm.tagger import KINDS, PAD, STRIDE, WINDOW, Tagger, classes, luhn, trained

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_domain = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: As given, but not tried from within a run of digits, where it fails as from the run's start.
_ip = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_card = re.compile(r"(?<![0-9])[0-9]([\x20-]?[0-9])+")
_phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
MARGIN = (WINDOW - STRIDE) // 2
Span = tuple[int, int, int]


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each @ so that long words cost nothing."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = _domain.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """(start, kind, end) of all patterns, sorted."""
    out = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    out += [(m.start(), 1, m.end()) for m in _ip.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split("."))]
    out += [(m.start(), 2, m.end()) for m in _card.finditer(text) if 14 <= len(d := digits(m.group())) <= 19 and luhn(d)]
    out += [(m.start(), 3, m.end()) for m in _phone.finditer(text) if 10 <= len(digits(m.group())) <= 15] if "+" in text else []
    return sorted(out)


_form = (
    re.compile(r"[^\s@]+@[^\s@.]+(\.[^\s@.]+)+"),
    re.compile(r"\d{1,3}(\.\d{1,3}){3}"),
    re.compile(r"\d([ ./-]?\d){12,18}"),
    re.compile(r"(\+|00)?\d{0,3}[ .-]?(\(\d{2,4}\)|\d{2,4})[ .-]\d{2,4}[ .-]?\d{3,6}"),
)


def has_form(text: str, kind: int) -> bool:
    """Does a decoded span look like its kind?  Looser than the patterns: letters of any script in an address, dots in a card, no + before a phone number."""
    if not _form[kind].fullmatch(text):
        return False
    if kind == 1:
        return all(int(p) <= 255 for p in text.split("."))
    return (kind != 2 or luhn(digits(text))) and (kind != 3 or 10 <= len(digits(text)) <= 15)


class Joined:
    """Texts as one array of code points with two line feeds after each, and the positions that may be tagged."""

    def __init__(self, all_texts: list[str]):
        text = "".join(t + "\n\n" for t in all_texts)
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        self.ids = classes(code)
        self.lengths = np.array([len(t) for t in all_texts], dtype=np.int64)
        self.starts = np.cumsum(self.lengths + 2) - self.lengths - 2
        space = (code <= 32) | (code == 0x85) | (code == 0xA0) | (code == 0x3000)
        first, last = runs(~space)
        marks = np.flatnonzero((code == 64) | ((code >= 48) & (code <= 57)))
        held = np.searchsorted(marks, last) > np.searchsorted(marks, first)
        first, last = first[held], last[held]
        edge = np.zeros(len(code) + 1, dtype=np.int8)
        edge[first] = 1
        edge[last] = -1
        self.open = np.cumsum(edge[:-1]).astype(bool)
        near = np.flatnonzero(first[1:] - last[:-1] == 1)
        self.open[last[near]] = True

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """The text and the start in it of each window that owns an open position."""
        at = np.flatnonzero(self.open)
        text = np.searchsorted(self.starts, at, side="right") - 1
        owner = np.maximum(0, (at - self.starts[text] - MARGIN) // STRIDE)
        wide = int(owner.max(initial=0)) + 1
        both = np.unique(text * wide + owner)
        return both // wide, both % wide * STRIDE


def decoded_tags(model: Tagger, texts: Joined, block: int = 1024) -> np.ndarray:
    """A tag for each code point of ``texts``."""
    out = np.zeros(len(texts.ids), dtype=np.int8)
    text, start = texts.windows()
    step = np.arange(WINDOW)
    for k in range(0, len(text), block):
        t, a = text[k : k + block, None], start[k : k + block, None]
        local = a + step
        inside = local < texts.lengths[t]
        at = np.where(inside, texts.starts[t] + local, 0)
        tags = model.decode(np.where(inside, texts.ids[at], PAD), inside & texts.open[at])
        own = inside & ((step >= MARGIN) | (a == 0)) & (step < WINDOW - MARGIN)
        out[at[own]] = tags[own]
    return out


def decoded_spans(model: Tagger, all_texts: list[str]) -> list[list[Span]]:
    """Spans of the tagger for each text: runs of tags of one kind, parted where a span begins."""
    texts = Joined(all_texts)
    tags = decoded_tags(model, texts)
    kind = (tags + 1) // 2
    before = np.concatenate([np.zeros(1, np.int8), kind[:-1]])
    begins = (kind > 0) & ((tags % 2 == 1) | (before != kind))
    first = np.flatnonzero(begins)
    ends = np.flatnonzero((kind == 0) | begins)
    last = np.append(ends, len(kind))[np.searchsorted(ends, first, side="right")]
    text = np.searchsorted(texts.starts, first, side="right") - 1
    out: list[list[Span]] = [[] for _ in all_texts]
    for i, a, b, k in zip(text.tolist(), (first - texts.starts[text]).tolist(), (last - texts.starts[text]).tolist(), (kind[first] - 1).tolist(), strict=True):
        out[i].append((a, k, b))
    return out


def all_spans(model: Tagger, all_texts: list[str]) -> tuple[list[list[Span]], list[list[Span]]]:
    """Pattern spans of each text, and those with what the tagger adds."""
    base = [base_spans(t) for t in all_texts]
    full = []
    decoded = [spans for a, b in grouped([len(t) for t in all_texts]) for spans in decoded_spans(model, all_texts[a:b])]
    for text, own, found in zip(all_texts, base, decoded, strict=True):
        extra = []
        for a, kind, b in found:
            while a < b and text[b - 1] in ".,;:!?) \n" and not (kind == 3 and text[b - 1] == ")"):
                b -= 1
            if has_form(text[a:b], kind) and not any(a < y and x < b for x, _, y in own) and not text[max(0, a - 1) : a].isalnum() and not text[b : b + 1].isalnum():
                extra.append((a, kind, b))
        full.append(sorted(own + extra))
    return base, full


def render(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _pii(model: Tagger):
    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            base, full = all_spans(model, [t or "" for t in batch.column("text").to_pylist()])
            counts = [pa.array([sum(s[1] == k for s in own) for own in base], pa.int64()) for k in range(len(KINDS))]
            spans = [[{"start": a, "end": b, "kind": KINDS[k]} for a, k, b in own] for own in full]
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
            digest = pa.array([hashlib.sha256(render(own).encode()).hexdigest() for own in base])
            return pa.record_batch([batch.column("doc_id"), *counts, digest, pa.array([render(own) for own in full]), pa.array(spans, kind)], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "found"])

        return step

    return make


def pii(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, found.

    The counts and base_sha256 are of the pattern spans; spans (kind:start:end, comma-joined) and found
    (structs) hold the added ones too.  Offsets are code points, ends exclusive.  Null text counts as empty;
    null and repeated doc_ids are kept; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    schema = "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, found array<struct<start:int,end:int,kind:string>>"
    return arrow_map(docs, _pii(trained()), schema)


def mask(text: str | None, spans: list[Span]) -> str | None:
    """Replace every span by its kind in angle brackets; of overlapping spans the first one's stays."""
    if not spans:
        return text
    out, done = [], 0
    for a, kind, b in spans:
        if a >= done:
            out += [text[done:a], f"<{KINDS[kind]}>"]
        done = max(done, b)
    return "".join([*out, text[done:]])


def masked(docs: DataFrame) -> DataFrame:
    """``docs`` with its personal data replaced in ``text``; all columns and rows stay, null text stays null."""
    small_batches(docs.sparkSession)
    model = trained()

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            own = batch.column("text").to_pylist()
            _, full = all_spans(model, [t or "" for t in own])
            at = batch.schema.get_field_index("text")
            return batch.set_column(at, "text", pa.array([mask(t, s) for t, s in zip(own, full, strict=True)], pa.string()))

        return step

    return arrow_map(docs, make, docs.schema)
