"""Token ids of whole texts with the tokenizers library, each distinct space-separated unit encoded once while it is held.

Byte-level pre-tokenisation never joins characters across a single space or line feed that stands before or behind other
text, so such a text's ids are those of its units in order. Texts with other white space, and tokenizers of other kinds,
are encoded as they are.
"""

from __future__ import annotations

import json
import struct
import sys
from array import array
from collections.abc import Iterable
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space besides the blank and the line feed, in any of the libraries' definitions.
_OTHER = [c for c in map(chr, range(0x3001)) if (c.isspace() or c in "\x00᠎​﻿") and c not in " \n"]
_ODD = "  |\n\n| \n| $|[" + "".join(f"\\x{{{ord(c):x}}}" for c in _OTHER) + "]"

#: The characters by which byte-level vocabularies write bytes: printable ones themselves, the others from U+0100 on.
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_LETTERS = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}

_PACK = [struct.Struct(f"<{n}I").pack for n in range(16)]


def _raw(ids: list[int]) -> bytes:
    a = array("I", ids)
    if sys.byteorder != "little":
        a.byteswap()
    return a.tobytes()


class UnitEncoder:
    def __init__(self, path: str, max_bytes: int = 64 << 20):
        from tokenizers import Tokenizer

        with open(path) as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        pre = spec.get("pre_tokenizer") or {}
        self.by_unit = (
            pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
            and not spec.get("normalizer") and not spec["model"].get("dropout")
        )
        special = {t["content"] for t in spec.get("added_tokens", [])}
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        #: Bytes that an id stands for (byte-level vocabularies write a character for each byte).
        self.n_bytes = np.zeros(max(vocab.values()) + 1, dtype=np.int64)
        for token, i in vocab.items():
            self.n_bytes[i] = len(token.encode()) if token in special else len(token)
        #: Bound of what the units held take, each with about 150 bytes of its own.
        self.max_bytes, self.held = max_bytes, 0
        self.units: dict[str, bytes] = {"": b""}

    def _plain(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [_raw(e.ids) for e in found]

    def _together(self, units: list[str]) -> Iterable[tuple[str, bytes]]:
        """Units that begin with a blank as one text, whose ids are cut where the units end."""
        raw = self._plain(["".join(units)])[0]
        ends = np.cumsum(self.n_bytes[np.frombuffer(raw, dtype="<u4")])
        cuts = (4 * (np.searchsorted(ends, np.cumsum([len(u.encode()) for u in units])) + 1)).tolist()
        return zip(units, [raw[a:b] for a, b in zip([0, *cuts], cuts, strict=False)], strict=True)

    def _learn(self, new: list[str]) -> None:
        """Encode new units. Letters behind at most one blank are one pre-token, which the model takes as it is; a comma or
        full stop behind a letter is always a token's start, so it is put behind the rest."""
        known, tokenize, rest = self.units, self.tokenizer.model.tokenize, []
        marks = {mark: self._plain([mark])[0] for mark in ",."}
        for u in new:
            ended = u[-1] in ",." and u[-2:-1].isalpha()
            base = u[:-1] if ended else u
            raw = known.get(base)
            if raw is None:
                blank = base[0] == " "
                letters = base[1:] if blank else base
                if not letters.isalpha():
                    rest.append(u)
                    continue
                if not letters.isascii():
                    letters = letters.encode().decode("latin-1").translate(_LETTERS)
                ids = [t.id for t in tokenize("\u0120" + letters if blank else letters)]
                raw = known[base] = _PACK[len(ids)](*ids) if len(ids) < len(_PACK) else _raw(ids)
            if ended:
                known[u] = raw + marks[u[-1]]
        spaced = [u for u in rest if u[0] == " " and len(u) > 1]
        other = [u for u in rest if u[0] != " " or len(u) == 1]
        known.update(zip(other, self._plain(other), strict=True))
        for a in range(0, len(spaced), 20_000):
            known.update(self._together(spaced[a : a + 20_000]))

    def _size(self, start: int) -> int:
        """What the units from a place on take."""
        units, ids = islice(self.units, start, None), islice(self.units.values(), start, None)
        return 150 * (len(self.units) - start) + sum(map(len, units)) + sum(map(len, ids))

    def _values(self, units: list[str]) -> list[bytes]:
        """The ids of distinct units."""
        if self.held > self.max_bytes:
            # units met first are the frequent ones
            self.units = dict(islice(self.units.items(), len(self.units) // 2)) | {"": b""}
            self.held = self._size(0)
        known = self.units
        values = list(map(known.get, units))  # one look at each unit
        if new := [i for i, raw in enumerate(values) if raw is None]:
            before = len(known)
            self._learn([units[i] for i in new])
            self.held += self._size(before)
            for i in new:
                values[i] = known[units[i]]
        return values

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers.

        Units are split off and made distinct by Arrow; the ids of a batch are gathered from its distinct units' ids."""
        col = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        if not self.by_unit or not len(col):
            return self._plain(col.to_pylist())
        odd = pc.match_substring_regex(col, _ODD).to_numpy(zero_copy_only=False).astype(bool)
        even = col.filter(pa.array(~odd))
        marked = pc.replace_substring(pc.replace_substring(even, " ", "\0 "), "\n", "\0\n\0")
        lists = pc.split_pattern(marked, "\0")
        units = lists.flatten().dictionary_encode()
        values = self._values(units.dictionary.to_numpy(zero_copy_only=False).tolist())
        sizes = np.fromiter(map(len, values), dtype="i4", count=len(values)) >> 2
        starts = np.concatenate(([0], np.cumsum(sizes)))
        codes = units.indices.to_numpy(zero_copy_only=False)
        counts = sizes[codes]
        before = np.concatenate(([0], np.cumsum(counts, dtype="i8")))
        source = np.arange(before[-1], dtype="i4")  # a batch has fewer than 2**31 ids
        source += np.repeat((starts[codes] - before[:-1]).astype("i4"), counts)
        raw = np.frombuffer(b"".join(values), dtype="<u4")[source].tobytes()
        ends = (4 * before[np.diff(lists.offsets.to_numpy()).cumsum()]).tolist()
        found = iter([raw[a:b] for a, b in zip([0, *ends], ends, strict=False)])
        plain = iter(self._plain(col.filter(pa.array(odd)).to_pylist()) if odd.any() else [])
        return [next(plain) if o else next(found) for o in odd.tolist()]


_ENCODERS: dict[str, UnitEncoder] = {}


def encoder(path: str) -> UnitEncoder:
    """One encoder for each file in a Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = UnitEncoder(path)
    return _ENCODERS[path]
