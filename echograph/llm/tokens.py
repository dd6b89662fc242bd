"""Token ids of whole texts, through a cache of the units between spaces and newlines."""

from __future__ import annotations

import json
import os
import re
from array import array
from itertools import islice

import numpy as np
import pyarrow as pa

#: Whitespace other than spaces and newlines.
_ODD = re.compile(r"[^\S \n]").search
_NEWLINE = "\n"
#: Units that a worker keeps, about 230 bytes each.
CACHED_UNITS = 600_000
#: One run for the pre-tokenizer, in any Unicode version: letters, digits or marks, with a space before
#: them or not. The apostrophe may start a contraction.
_RUN = re.compile(r" ?(?:[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+|[0-9]+|[!\x22-&(-/:-@\[-`{-~]+)").fullmatch


def _kinds() -> np.ndarray:
    """Of each byte: white space, a letter or digit, a mark; 0 for the apostrophe and all others."""
    out = np.zeros(256, np.uint8)
    for b in range(0x21, 0x7F):
        out[b] = _WORD if chr(b).isalnum() else _MARK
    out[[0x20, 0x0A]], out[0x27] = _WHITE, 0
    return out


_WHITE, _WORD, _MARK = 1, 2, 4
_KINDS = _kinds()


def _byte_letters() -> dict[int, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable ones for themselves,
    the others numbered from 256."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in plain]
    return {b: 256 + n for n, b in enumerate(rest)}


#: Newlines stay: they part words here.
_LETTERS = {b: chr(c) for b, c in _byte_letters().items() if b != 0x0A}


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class UnitEncoder:
    """Byte-level BPE ids as little-endian uint32 bytes.

    The pre-tokenizer always cuts before a space that a visible character follows, around a newline
    between visible characters, and between ASCII letters or digits and marks other than the
    apostrophe, so a text's ids are the ids of these units joined. Units repeat far more than texts,
    and are looked up once for all texts of a call. At most ``limit`` units stay cached: frequent ones
    come early, so a full cache keeps what it has until its misses show that the texts have changed.
    """

    def __init__(self, path: str, limit: int = CACHED_UNITS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.limit = limit
        self.missed = 0
        parts = json.loads(self.tokenizer.to_str())
        plain = not parts["normalizer"] and not parts["post_processor"]
        before = parts["pre_tokenizer"] or {}
        by_units = plain and before.get("type") == "ByteLevel" and before["use_regex"] and not before["add_prefix_space"]
        self.added = [t["content"] for t in parts["added_tokens"] or []]
        newline = self._ids(_NEWLINE)
        self.newline = int(newline[0]) if by_units and len(newline) == 1 else None
        self.fixed = {_NEWLINE.encode(): newline.tobytes()}
        self.cache: dict[bytes, bytes] = dict(self.fixed)

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _learn(self, units: list[str]) -> dict[str, bytes]:
        """Ids of new units: runs straight through the model, which sees its byte letters; the rest
        from one text with a unit a line, where newline ids mark the cuts."""
        runs = [u for u in units if _RUN(u)]
        plain = [u for u in runs if u.isascii()]  # of their bytes only the space has another letter
        other = [u for u in runs if not u.isascii()]
        letters = _NEWLINE.join(plain).replace(" ", _LETTERS[0x20]).split(_NEWLINE)
        letters += _NEWLINE.join(other).encode().decode("latin-1").translate(_LETTERS).split(_NEWLINE)
        model = self.tokenizer.model.tokenize
        out = {u: array("I", [t.id for t in model(v)]).tobytes() for u, v in zip(plain + other, [v for v in letters if v])}
        units = [u for u in units if u not in out]
        if not units:
            return out
        ids = self._ids(_NEWLINE.join(units))
        cuts = (np.flatnonzero(ids == self.newline) * 4).tolist() + [4 * len(ids)]
        if len(cuts) != len(units):
            return out | {u: self._ids(u).tobytes() for u in units}
        data = ids.tobytes()
        return out | {unit: data[a:b] for unit, a, b in zip(units, [0, *(c + 4 for c in cuts)], cuts)}

    def _look_up(self, units: list[bytes]) -> list[bytes | None]:
        """Ids of distinct units; none for those with odd white space, which are never cached, so found
        again wherever they occur."""
        out = list(map(self.cache.get, units))
        at = [i for i, ids in enumerate(out) if ids is None]
        need = [units[i].decode() for i in at]
        odd = {u for u in need if _ODD(u)} if _ODD(_NEWLINE.join(need)) else set()
        have = self._learn([u for u in need if u not in odd])
        for i, unit in zip(at, need):
            out[i] = have.get(unit)
        new = {units[i]: out[i] for i in at if out[i] is not None}
        if len(self.cache) + len(new) <= self.limit:
            self.cache.update(new)
        else:
            self.cache.update(islice(new.items(), max(0, self.limit - len(self.cache))))
            self.missed += len(new)
            if self.missed > 8 * self.limit:
                self.cache, self.missed = dict(self.fixed), 0
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.newline is None:
            return [self._ids(t).tobytes() for t in texts]
        # Newlines part the texts, so white space at an end, too, has other white space next to it.
        data = "\n".join(["", *texts, ""]).encode()
        size = np.array([len(t) if t.isascii() else len(t.encode()) for t in texts], np.int64)
        edge = np.append(0, np.cumsum(size + 1))
        kind = _KINDS[np.frombuffer(data, np.uint8)]
        before, here = kind[:-1], kind[1:]
        whole = np.zeros(len(texts), bool)
        whole[np.searchsorted(edge, np.flatnonzero(before & here & _WHITE), "right") - 1] = True
        for token in self.added:
            whole |= np.fromiter((token in t for t in texts), bool, len(texts))
        if whole.any():
            rest = iter(self.encode([t for t, w in zip(texts, whole) if not w]))
            return [self._ids(t).tobytes() if w else next(rest) for t, w in zip(texts, whole)]
        start = np.ones(len(kind), bool)
        # White space starts a unit, as does what follows a newline; letters and marks part.
        start[1:] = (here == _WHITE) | (before | here == _WORD | _MARK)
        start[1:] |= np.frombuffer(data, np.uint8)[:-1] == 0x0A
        first = np.flatnonzero(start).astype(np.int32)
        offsets = pa.py_buffer(np.append(first, np.int32(len(data))))
        units = pa.Array.from_buffers(pa.binary(), len(first), [None, offsets, pa.py_buffer(data)]).dictionary_encode()
        row = units.indices.to_numpy()
        parting = np.searchsorted(first, edge)
        _, offsets, distinct = units.dictionary.buffers()
        ends, distinct = np.frombuffer(offsets, np.int32, len(units.dictionary) + 1).tolist(), distinct.to_pybytes()
        found = self._look_up([distinct[a:b] for a, b in zip(ends, ends[1:])])
        if None in found:
            unknown = np.array([ids is None for ids in found])
            whole[np.searchsorted(parting, np.flatnonzero(unknown[row]), "right") - 1] = True
            found = [ids or b"" for ids in found]
        ids = np.frombuffer(b"".join(found), "<u4")
        length = np.fromiter(map(len, found), np.int32, len(found)) // 4
        begin = np.cumsum(length, dtype=np.int32) - length
        n = length[row]
        n[parting] = 0
        end = np.cumsum(n, dtype=np.int64)
        at = np.arange(end[-1]) + np.repeat(begin[row] - (end - n), n)
        out, cut = ids[at].tobytes(), (4 * end[parting]).tolist()
        return [self._ids(t).tobytes() if w else out[a:b] for t, w, a, b in zip(texts, whole.tolist(), cut, cut[1:])]


_encoders: dict[str, UnitEncoder] = {}


def encoder(path: str, cached_units: int = CACHED_UNITS) -> UnitEncoder:
    """One encoder for each vocabulary and Python worker; a smaller cache than it has empties it."""
    have = _encoders.get(path)
    if have is None or len(have.cache) > cached_units:
        have = _encoders[path] = UnitEncoder(path, cached_units)
    have.limit = cached_units
    return have


def text_blocks(texts: list[str], max_chars: int):
    """(start, end) runs of rows of about max_chars characters, one row at least."""
    start = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > max_chars:
            yield start, i
            start, size = i, 0
        size += len(text) + 1
    if start < len(texts):
        yield start, len(texts)
