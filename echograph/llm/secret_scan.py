"""Secret scan with a trigram inverted index.

Each rule's regex gives a Boolean query over the trigrams that any match must hold. A task indexes
blocks of its documents (trigram to documents, ASCII letters folded), evaluates each query by
intersecting and uniting postings, and runs the regex over the whole text of the candidates only.
Rules without mandatory trigrams scan every text. Nothing shuffles.

Base kinds come first; further kinds add spans. A null text is empty, repeated rows get equal rows,
an empty table gives none. Spans that start together are told apart by the order of the kinds. A text of
any length is scanned whole, as a block of its own if need be. Other columns, whatever their names, are
not read, and ``redact`` returns them as they are.
"""

from __future__ import annotations

import hashlib
import re
import re._constants as sre
import re._parser as sre_parse
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echograph.llm.tokens import text_blocks

BLOCK_CHARS = 500_000

#: (kind, regex, group to measure, least length of the group). Python's (?i) would also let two
#: non-ASCII letters stand for k and s, hence (?a).
RULES = [
    ("assign", r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    ("slack", r"xox[baprs]-[A-Za-z0-9-]{10,}", 0, 15),
    ("google", r"AIza[A-Za-z0-9_-]{35}", 0, 39),
    ("stripe", r"[sr]k_live_[A-Za-z0-9]{16,}", 0, 24),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 29),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 27),
]
BASE = 3

#: Strings that a part of a pattern can be, at most; beyond that it is any string.
_MOST = 64

Query = tuple | None  # None: every document; ("tri", code), ("and", [...]), ("or", [...])


def _all(queries: list[Query]) -> Query:
    kept = list(dict.fromkeys(q for q in queries if q is not None))
    return None if not kept else kept[0] if len(kept) == 1 else ("and", tuple(kept))


def _any(queries: list[Query]) -> Query:
    kept = list(dict.fromkeys(queries))
    return None if None in kept or not kept else kept[0] if len(kept) == 1 else ("or", tuple(kept))


def _fold(text: str) -> bytes:
    return text.encode().lower()


def _holds(text: str) -> Query:
    raw = _fold(text)
    return _all([("tri", raw[i] << 16 | raw[i + 1] << 8 | raw[i + 2]) for i in range(len(raw) - 2)])


def _parse(items) -> tuple[set[str] | None, Query]:
    """The strings that a sequence can be (None: any) and what a match of it must hold."""
    run, query, exact = {""}, [], True
    for op, arg in items:
        strings, needs = _node(op, arg)
        if strings is not None and len(run) * len(strings) <= _MOST:
            run = {a + b for a in run for b in strings}
            continue
        exact = False
        query += [_any([_holds(s) for s in run]), needs if strings is None else None]
        run = strings if strings is not None else {""}
    query.append(_any([_holds(s) for s in run]))
    return (run if exact else None), _all(query)


def _node(op, arg) -> tuple[set[str] | None, Query]:
    if op is sre.LITERAL:
        return {chr(arg)}, None
    if op is sre.IN:
        chars: set[str] = set()
        for kind, value in arg:
            span = [value] if kind is sre.LITERAL else range(value[0], value[1] + 1) if kind is sre.RANGE else range(1 << 20)
            if len(span) + len(chars) > 8:
                return None, None
            chars.update(map(chr, span))
        return chars, None
    if op is sre.SUBPATTERN:
        return _parse(arg[3])
    if op is sre.BRANCH:
        parts = [_parse(p) for p in arg[1]]
        strings = None if any(s is None for s, _ in parts) else set().union(*(s for s, _ in parts))
        return (None if strings is None or len(strings) > _MOST else strings), _any([q for _, q in parts])
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
        low, high, inner = arg
        strings, needs = _parse(inner)
        if (low, high) == (0, 1) and strings is not None:
            return strings | {""}, None
        if low == high and strings is not None and len(strings) ** low <= _MOST:
            out = {""}
            for _ in range(low):
                out = {a + b for a in out for b in strings}
            return out, None
        return None, (needs if low else None)
    return None, None


def trigram_query(pattern: str) -> Query:
    """What any match of ``pattern`` must hold, over folded trigrams; None if nothing is mandatory."""
    return _parse(sre_parse.parse(pattern))[1]


class TrigramIndex:
    """Postings of a block: sorted (trigram, document) pairs."""

    def __init__(self, texts: list[str]):
        raw = [t.encode().lower() for t in texts]
        self.n = len(raw)
        data = np.frombuffer(b"".join(raw), np.uint8).astype(np.int64)
        owner = np.repeat(np.arange(self.n), [len(r) for r in raw])
        codes = data[:-2] << 16 | data[1:-1] << 8 | data[2:] if len(data) > 2 else np.zeros(0, np.int64)
        inside = owner[:-2] == owner[2:] if len(data) > 2 else np.zeros(0, bool)
        keys = np.sort((codes * self.n + owner[: len(codes)])[inside])
        self.keys = keys[np.diff(keys, prepend=-1) != 0]

    def find(self, query: Query) -> np.ndarray:
        """Document numbers, sorted."""
        if query is None:
            return np.arange(self.n)
        kind, arg = query
        if kind == "tri":
            a, b = np.searchsorted(self.keys, [arg * self.n, (arg + 1) * self.n])
            return self.keys[a:b] - arg * self.n
        if kind == "or":
            return np.unique(np.concatenate([self.find(q) for q in arg]))
        out = None
        for q in arg:
            found = self.find(q)
            out = found if out is None else np.intersect1d(out, found, assume_unique=True)
            if not len(out):
                break
        return out


_compiled: list[tuple[str, re.Pattern, int, int, Query]] = []


def _rules() -> list[tuple[str, re.Pattern, int, int, Query]]:
    if not _compiled:
        _compiled.extend((kind, re.compile(p), group, least, trigram_query(p)) for kind, p, group, least in RULES)
    return _compiled


def block_spans(texts: list[str]) -> list[list[tuple[int, int, int]]]:
    """Per text its (start, rule number, end), sorted by start, then rule."""
    index = TrigramIndex(texts)
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for number, (_, pattern, group, least, query) in enumerate(_rules()):
        for doc in index.find(query).tolist():
            for m in pattern.finditer(texts[doc]):
                if m.end(group) - m.start(group) >= least:
                    found[doc].append((m.start(), number, m.end()))
    for spans in found:
        spans.sort()
    return found


def _render(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{RULES[k][0]}:{a}:{b}" for a, k, b in spans)


_FOUND = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def _scan_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        for a, b in text_blocks(texts, BLOCK_CHARS):
            found = block_spans(texts[a:b])
            base = [[s for s in spans if s[1] < BASE] for spans in found]
            counts = [pa.array([sum(s[1] == k for s in spans) for spans in base], pa.int64()) for k in range(BASE)]
            sha = [hashlib.sha256(_render(spans).encode()).hexdigest() for spans in base]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(a, b - a), *counts, pa.array(sha), pa.array([_render(s) for s in found])],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )


def scan(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scan_rows, _FOUND)


def redact_text(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Each span, overlapping ones joined, becomes the first kind's name in brackets."""
    out, at = [], 0
    for a, k, b in spans:
        if a >= at:
            out += [text[at:a], f"[{RULES[k][0]}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def redact(docs: DataFrame) -> DataFrame:
    """All rows and columns of ``docs``, secrets in ``text`` replaced; null texts stay null."""
    columns, kinds = docs.columns, dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            plain = [t or "" for t in texts]
            for a, b in text_blocks(plain, BLOCK_CHARS):
                new = [t if not spans else redact_text(t, spans) for t, spans in zip(texts[a:b], block_spans(plain[a:b]))]
                part = batch.slice(a, b - a)
                yield part.set_column(columns.index("text"), "text", pa.array(new, batch.schema.field("text").type))

    out = docs.mapInArrow(run, docs.schema)
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.length("text").cast(kinds["n_chars"]))
    return out.select(*columns)


def op2_trigram_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
