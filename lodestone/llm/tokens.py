"""Encoding whole texts with a public tokenizer, chunk by chunk.

The tokenizers of this kind drop white space and never join characters across
it, so the ids of a text are the ids of its pieces between spaces and newlines.
``CachedEncoder`` hashes all pieces of a chunk at once (64 bits) and looks them
up in a table of fixed size; only pieces that are not there go to the library,
each distinct one once, and the ids of whole texts are gathered by array
operations.  An encoder lives as long as its task, so that a worker holds no
memory for it in other stages.  A piece of plain letters, with punctuation behind it or not, is one word to the pre-tokenizer and
goes straight to the library's merge model; any other piece takes the library's
whole path.  Where a tokenizer's own settings do not allow that, every piece
does.  ``tests/llm`` compares the result with encoding whole texts.
"""

from __future__ import annotations

import json
import os
import re
import sys
from array import array

import numpy as np
import pyarrow as pa

from .shingles import PLAIN, by_bytes, hashed_runs, text_bytes

#: Letters whose lower case and normal form are themselves single letters.
_WORD = re.compile(r"([A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+)([!-/:-@\[-`{-~]*)")


def _byte_letters() -> dict[int, str]:
    """Byte-level pre-tokenization writes a byte that is no printable Latin-1
    character as the next code point from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


def _is_plain(tokenizer) -> bool:
    """Lower-cases, splits letter runs off and maps bytes: no more."""
    made = json.loads(tokenizer.to_str())
    kinds = lambda part, key: [x["type"] for x in (made.get(part) or {}).get(key, [])]
    split = (made.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0].get("pattern", {}).get("Regex", "")
    return (
        made["model"]["type"] == "BPE" and kinds("normalizer", "normalizers") == ["NFC", "Replace", "Lowercase"]
        and kinds("pre_tokenizer", "pretokenizers") == ["Split", "ByteLevel"] and r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+" in split
    )


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class CachedEncoder:
    """Texts to little-endian unsigned 32-bit ids, with an end id after each."""

    #: Slots of the table, ids kept for them, distinct words kept for the merge
    #: model, and bytes of text encoded at once.
    SLOTS, POOL, WORDS, CHUNK = 1 << 20, 4_000_000, 100_000, 1 << 18

    def __init__(self, path: str, end_id: int = 2) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self.plain = _is_plain(self.tokenizer)
        self.end = int(end_id).to_bytes(4, "little")
        self.words: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {"": b""}
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(self.SLOTS, np.uint64)
        self.first, self.many = np.zeros(self.SLOTS, np.int32), np.zeros(self.SLOTS, np.int32)
        self.pool, self.used = np.empty(1 << 16, np.uint32), 0

    def _keep(self, ids: np.ndarray) -> int:
        """Put ids behind those in the pool; where they begin."""
        at, self.used = self.used, self.used + len(ids)
        if self.used > len(self.pool):
            self.pool = np.concatenate([self.pool[:at], np.empty(max(len(self.pool), self.used - at), np.uint32)])
        self.pool[at : self.used] = ids
        return at

    def _whole(self, pieces: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def _ids(self, pieces: list[str]) -> list[bytes]:
        if not self.plain:
            return self._whole(pieces)
        if len(self.words) > self.WORDS:
            self.words.clear()
        if len(self.tails) > 10_000:
            self.tails = {"": b""}
        words, tails, letters, split = self.words, self.tails, self.letters, self.model.tokenize
        if sys.byteorder != "little" or array("I").itemsize != 4:
            raise RuntimeError("ids are little-endian 32-bit integers")
        parted = [m and (m[1].lower(), m[2]) for m in map(_WORD.fullmatch, pieces)]
        for word in {x[0] for x in parted if x and x[0] not in words}:
            shown = word if word.isascii() else word.encode().decode("latin-1").translate(letters)
            words[word] = array("I", [t.id for t in split(shown)]).tobytes()
        more = list({x[1] for x in parted if x and x[1] not in tails})
        tails.update(zip(more, self._whole(more), strict=True))
        rest = iter(self._whole([p for p, x in zip(pieces, parted, strict=True) if not x]))
        return [words[x[0]] + tails[x[1]] if x else next(rest) for x in parted]

    def _chunk(self, texts: pa.Array) -> list[bytes]:
        data, offsets = text_bytes(texts)
        hashes, begins, sizes = hashed_runs(data, offsets[:-1][offsets[:-1] < len(data)], *PLAIN)
        hashes |= np.uint64(1)  # no key is 0
        if self.used > self.POOL:
            self._clear()
        slot = (hashes >> np.uint64(44)).astype(np.int64) & (self.SLOTS - 1)  # a piece has two places
        other = np.flatnonzero(self.keys[slot] != hashes)
        slot[other] = (hashes[other] >> np.uint64(20)).astype(np.int64) & (self.SLOTS - 1)
        first, many = self.first[slot], self.many[slot]
        miss = other[self.keys[slot[other]] != hashes[other]]
        if len(miss):
            new, at, back = np.unique(hashes[miss], return_index=True, return_inverse=True)
            places = zip(begins[miss[at]].tolist(), sizes[miss[at]].tolist(), strict=True)
            whole = data.tobytes()
            raw = self._ids([whole[b : b + n].decode() for b, n in places])
            lengths = np.fromiter(map(len, raw), np.int64, len(raw)) // 4
            starts = self._keep(np.frombuffer(b"".join(raw), "<u4")) + np.cumsum(lengths) - lengths
            first[miss], many[miss] = starts[back], lengths[back]
            into = (new >> np.uint64(44)).astype(np.int64) & (self.SLOTS - 1)
            into = np.where(self.keys[into] == 0, into, slot[miss[at]])
            self.keys[into], self.first[into], self.many[into] = new, starts, lengths
        ends = np.cumsum(many, dtype=np.int64)
        ids = self.pool[np.repeat(first - (ends - many), many) + np.arange(ends[-1] if len(ends) else 0)].astype("<u4", copy=False).tobytes()
        cuts = np.concatenate([[0], ends])[np.searchsorted(begins, offsets)].tolist()
        return [ids[4 * a : 4 * b] + self.end for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def encode(self, texts: pa.Array | list[str | None]) -> list[bytes]:
        if not isinstance(texts, pa.Array):
            texts = pa.array(texts, pa.string())
        return [x for low, high in by_bytes(texts, self.CHUNK) for x in self._chunk(texts[low:high])]
