"""Fast exact encoding with a word-level tokenizer: pieces of words are encoded once per worker and then looked up.

Any tokenizer whose pre-tokenisation always breaks at ASCII white space and drops it may be used: a text's ids are then
its words' ids, one after the other. For the rules that word_bpe_49k.json declares (lower case; runs of letters, single
digits and runs of other signs are encoded apart), words of ASCII and Latin-1 letters are also cut into such runs and
lower-cased here, which makes far fewer different pieces. Words with an apostrophe, `<` or any other character go to the
tokenizer whole.
"""

from __future__ import annotations

import json
from pathlib import Path

import numpy as np

from . import kernels as K

#: Pieces that a worker remembers before it starts anew (about 250 bytes each).
CACHE_PIECES = 300_000

#: The declared rules under which cutting words into runs is exact.
RUN_RULES = {
    "normalizer": ["NFC", "Replace", "Lowercase"],
    "pattern": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",
}

LETTER, DIGIT, SIGN, WHOLE = 1, 2, 3, 4
_CLASS = np.full(256, SIGN, np.uint8)
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = LETTER
_CLASS[0x30:0x3A] = DIGIT
_ODD = np.zeros(256, bool)
_ODD[[*range(0x00, 0x09), *range(0x0E, 0x20), 0x7F, 0x27, 0x3C, *range(0x80, 0x100)]] = True


def byte_characters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if printable, else one from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


class WordEncoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.table = str.maketrans({chr(b): c for b, c in byte_characters().items()})
        d = json.loads(Path(path).read_text())
        pre = (d.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        self.runs = [x["type"] for x in (d.get("normalizer") or {}).get("normalizers", [])] == RUN_RULES["normalizer"] and pre[0].get("pattern", {}).get("Regex") == RUN_RULES["pattern"]
        self.reset()

    def reset(self) -> None:
        self.index: dict[int, int] = {}
        self.lens, self.at = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.ids, self.used, self.used_ids = np.zeros(1 << 14, np.uint32), 0, 0

    def _ids(self, piece: bytes, whole: bool) -> list[int]:
        if whole:
            return self.tokenizer.encode(piece.decode("utf-8", "replace"), add_special_tokens=False).ids
        return [t.id for t in self.model.tokenize(piece.decode("latin1").translate(self.table))]

    def _add(self, hashes: list[int], got: list[list[int]]) -> None:
        lens = np.fromiter(map(len, got), np.int64, len(got))
        flat = np.fromiter((x for g in got for x in g), np.uint32, int(lens.sum()))
        while self.used + len(lens) > len(self.lens):
            self.lens, self.at = np.concatenate([self.lens, np.zeros_like(self.lens)]), np.concatenate([self.at, np.zeros_like(self.at)])
        while self.used_ids + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.lens[self.used : self.used + len(lens)] = lens
        self.at[self.used : self.used + len(lens)] = self.used_ids + np.cumsum(lens) - lens
        self.ids[self.used_ids : self.used_ids + len(flat)] = flat
        self.index.update(zip(hashes, range(self.used, self.used + len(lens)), strict=True))
        self.used += len(lens)
        self.used_ids += len(flat)

    def _pieces(self, w: K.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(bytes with lower case applied, starts, ends, whether a piece is a whole word)."""
        buf = w.buf
        if not self.runs:
            return buf, w.starts, w.ends, np.ones(len(w), bool)
        odd = _ODD[buf]
        low = K.LOWER[buf]
        lead = np.flatnonzero(buf[:-1] == 0xC3)
        if len(lead):
            nxt = buf[lead + 1]
            good = (nxt >= 0x80) & (nxt <= 0xBF) & (nxt != 0x97) & (nxt != 0xB7)
            odd[lead[good]] = False
            odd[lead[good] + 1] = False
            up = lead[good & (nxt <= 0x9E)] + 1
            low[up] += 0x20
        cls = _CLASS[buf]
        bad = np.flatnonzero(odd & w.mask)
        whole_words = np.unique(np.searchsorted(w.starts, bad, "right") - 1) if len(bad) else np.zeros(0, np.int64)
        for s, e in zip(w.starts[whole_words].tolist(), w.ends[whole_words].tolist(), strict=True):
            cls[s:e] = WHOLE
            low[s:e] = buf[s:e]
        cls[~w.mask] = 0
        head = cls == DIGIT
        head[1:] |= cls[1:] != cls[:-1]
        head[w.starts] = True
        head &= w.mask
        starts = np.flatnonzero(head)
        tail = np.zeros(len(buf) + 1, bool)  # a piece ends where the next starts or its word ends
        tail[starts] = True
        tail[w.ends] = True
        cuts = np.flatnonzero(tail)
        ends = cuts[np.searchsorted(cuts, starts, "right")]
        return low, starts, ends, cls[starts] == WHOLE

    def rows(self, w: K.Words) -> tuple[np.ndarray, np.ndarray]:
        """(row of each piece in this encoder's table, start of each piece)."""
        if not len(w):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(self.index) > CACHE_PIECES:
            self.reset()
        low, starts, ends, whole = self._pieces(w)
        p = K.Words.__new__(K.Words)
        p.buf, p.mask, p.starts, p.ends = low, w.mask, starts, ends
        h = p.hashes()
        h[whole] ^= np.uint64(0x5DEECE66D)
        uniq, first, back = np.unique(h, return_index=True, return_inverse=True)
        keys = uniq.tolist()
        get = self.index.get
        rows = [get(k, -1) for k in keys]
        out = np.array(rows, np.int64)
        miss = np.flatnonzero(out < 0)
        if len(miss):
            data, used = low.tobytes(), self.used
            at = first[miss]
            self._add(uniq[miss].tolist(), [self._ids(data[a:b], x) for a, b, x in zip(starts[at].tolist(), ends[at].tolist(), whole[at].tolist(), strict=True)])
            out[miss] = used + np.arange(len(miss))
        return out[back], starts

    def lengths(self, w: K.Words, offs: np.ndarray) -> np.ndarray:
        """Tokens of each text of the block."""
        rows, starts = self.rows(w)
        sums = np.concatenate([[0], np.cumsum(self.lens[rows])])
        return np.diff(sums[np.searchsorted(starts, offs)])

    def encode(self, w: K.Words, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, offsets of the texts)."""
        rows, starts = self.rows(w)
        lens = self.lens[rows]
        ends = np.cumsum(lens)
        total = int(ends[-1]) if len(ends) else 0
        src = np.repeat(self.at[rows] - (ends - lens), lens) + np.arange(total)
        return self.ids[src], np.concatenate([[0], ends])[np.searchsorted(starts, offs)]


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder a worker process and file."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def held() -> bool:
    return bool(_encoders)


def forget() -> None:
    """A worker that goes on with tasks that don't encode needs no encoders."""
    _encoders.clear()


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
