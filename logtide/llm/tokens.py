"""Token ids of whole texts by a public tokenizer, piece by piece.

Both tokenizers used here cut a text into pre-tokens by a pattern before they
merge, and no pre-token of theirs crosses certain gaps: white space, and the
place between an ASCII letter or digit and the punctuation that ends its word.
A text is cut there into pieces; the ids of a piece depend on nothing but
itself and whether a space comes before it, so each distinct one is encoded
once. New pieces go to the library as few texts, with a separator between them
whose id tells where each one's ids end. Known pieces are held as sorted 64-bit
hashes that point into one pool of ids, so a batch is looked up, and its ids
gathered, by array operations. A text with unusual white space, with the
separator or with the string of a special token is encoded as a whole. Tests
compare with encoding whole texts.
"""

from __future__ import annotations

import os

import numpy as np

from . import common as C

#: Pieces that a worker remembers (about 30 bytes each).
MEMORY = 900_000
#: Bytes of text that a worker encodes at once.
BATCH = 2 << 20
#: Pieces that go to the library as one text.
_JOINED = 64

_SPACE = np.uint64(0x51ED270B9F1C2A35)
_TAIL = np.isin(np.arange(256), np.frombuffer(b".,!?;:", np.uint8))
_PLAIN = np.array([c < 128 and chr(c).isalnum() for c in range(256)])


def _odd_bytes(data: np.ndarray) -> np.ndarray:
    """Places of characters that Unicode or Python hold for white space, besides the space and the line feed."""
    low = (data < 32) & (data != 10)
    lead = np.flatnonzero((data == 0xC2) | ((data >= 0xE1) & (data <= 0xE3)))
    at = np.concatenate([data, np.zeros(2, np.uint8)])
    a, b, c = at[lead], at[lead + 1], at[lead + 2]
    wide = (a == 0xC2) & ((b == 0x85) | (b == 0xA0)) | (a == 0xE1) & (b == 0x9A) | (a == 0xE3) & (b == 0x80) & (c == 0x80)
    wide |= (a == 0xE2) & ((b == 0x80) & ((c <= 0x8B) | ((c >= 0xA8) & (c <= 0xAF))) | (b == 0x81) & (c == 0x9F))
    return np.concatenate([np.flatnonzero(low), lead[wide]])


def _tails(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where each word's closing punctuation begins; its end where there is none that can be cut off."""
    at = np.maximum.accumulate(np.where(_TAIL[data], -1, np.arange(len(data))))[ends - 1] + 1 if len(ends) else ends
    cut = (at > starts) & (at < ends)
    cut[cut] &= _PLAIN[data[at[cut] - 1]]
    return np.where(cut, at, ends)


class WordEncoder:
    """Encodes batches of texts.

    ``gap``: "space" for byte-level BPE, whose pre-tokens take a space along
    with what follows; "white" for tokenizers that drop white space.
    """

    def __init__(self, path: str, gap: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids must fit 16 bits")
        self.specials = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.spaced = {"space": True, "white": False}[gap]
        self.joint = "\n" if self.spaced else " \x01 "
        (self.joint_id,) = self.tokenizer.encode(self.joint, add_special_tokens=False).ids
        self._clear()

    def _clear(self) -> None:
        self.hashes = np.zeros(0, np.uint64)
        self.begins = np.zeros(0, np.int64)
        self.lengths = np.zeros(0, np.int64)
        self.used = np.zeros(0, bool)
        self.pool = np.zeros(1 << 16, np.uint16)
        self.filled = 0

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of whole texts, by the library alone."""
        return [np.array(e.ids, np.uint16) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _forget(self) -> None:
        """Keep the pieces used since the last time."""
        keep = np.flatnonzero(self.used)
        if 2 * len(keep) > MEMORY:
            keep = keep[:0]
        n = self.lengths[keep]
        take = np.repeat(self.begins[keep] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        pool = self.pool[take]
        self.hashes, self.lengths, self.begins, self.used = self.hashes[keep], n, np.cumsum(n) - n, np.zeros(len(keep), bool)
        self.pool, self.filled = np.concatenate([pool, np.zeros(1 << 16, np.uint16)]), len(pool)

    def _learn(self, hashes: np.ndarray, pieces: list[str]) -> None:
        """``pieces`` must hold neither the separator nor a special token's string."""
        joined = [self.joint.join([*pieces[i : i + _JOINED], ""]) for i in range(0, len(pieces), _JOINED)]
        flat = np.concatenate(self.encode(joined))
        joint = flat == self.joint_id
        n = np.diff(np.flatnonzero(joint), prepend=-1) - 1
        if len(n) != len(pieces):
            raise RuntimeError("pieces can't be told apart")
        flat = flat[~joint]
        while self.filled + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(len(self.pool), np.uint16)])
        self.pool[self.filled : self.filled + len(flat)] = flat
        at = np.searchsorted(self.hashes, hashes)
        self.begins = np.insert(self.begins, at, self.filled + np.cumsum(n) - n)
        self.lengths = np.insert(self.lengths, at, n)
        self.used = np.insert(self.used, at, True)
        self.hashes = np.insert(self.hashes, at, hashes)
        self.filled += len(flat)

    def _whole(self, data: np.ndarray, raw: bytes, offsets: np.ndarray) -> np.ndarray:
        """Which texts must be encoded as a whole."""
        slow = np.zeros(len(offsets) - 1, bool)
        places = [_odd_bytes(data) if self.spaced else np.flatnonzero(data == 1)]
        for string in self.specials:
            at, own = raw.find(string), []
            while at >= 0:
                own.append(at)
                at = raw.find(string, at + 1)
            places.append(np.array(own, np.int64))
        slow[np.searchsorted(offsets, np.concatenate(places), "right") - 1] = True
        return slow

    def flat(self, column) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a column of texts, one after the other, and the number of ids of each text; null is empty."""
        data, offsets = C.text_buffer(column)
        raw = data.tobytes()
        starts, ends, first = C.word_bounds(data, offsets)
        n_texts, n_words = len(offsets) - 1, np.diff(first)
        rows = np.repeat(np.arange(n_texts), n_words)
        slow = self._whole(data, raw, offsets)
        head = np.zeros(len(starts), bool)
        head[first[:-1][n_words > 0]] = True
        line = np.zeros(len(starts), bool)
        if self.spaced:
            # words must fill a text but for single gaps
            line = ~head & (data[np.maximum(starts - 1, 0)] == 10)
            gap = np.ones(len(starts), np.int64)
            gap[1:] = starts[1:] - ends[:-1]
            slow[rows[np.where(head, starts != offsets[:-1][rows], gap != 1)]] = True
            last = first[1:][n_words > 0] - 1
            slow[rows[last]] |= ends[last] != offsets[1:][rows[last]]
            slow[(n_words == 0) & (np.diff(offsets) > 0)] = True
        if slow.any():
            fast = ~slow[rows]
            rows, starts, ends, head, line = rows[fast], starts[fast], ends[fast], head[fast], line[fast]
        # pieces: the line feed before a word, the word's body, the punctuation behind it
        tail = _tails(data, starts, ends)
        more = tail < ends
        per = 1 + line.astype(np.int64) + more
        body = np.cumsum(per) - per + line
        lo, hi = np.zeros(per.sum(), np.int64), np.zeros(per.sum(), np.int64)
        spaced = np.zeros(len(lo), bool)
        lo[body], hi[body], spaced[body] = starts, tail, ~head & ~line & self.spaced
        lo[body[more] + 1], hi[body[more] + 1] = tail[more], ends[more]
        lo[body[line] - 1], hi[body[line] - 1] = starts[line] - 1, starts[line]
        hashes = C.word_hashes(data, lo, hi)
        hashes[spaced] = C.mix(hashes[spaced] ^ _SPACE)
        rows = np.repeat(rows, per)
        distinct, sample, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.hashes) + len(distinct) > MEMORY:
            self._forget()
        at = np.searchsorted(self.hashes, distinct)
        new = np.ones(len(distinct), bool)
        inside = at < len(self.hashes)
        new[inside] = self.hashes[at[inside]] != distinct[inside]
        if new.any():
            pick = sample[new]
            pieces = [raw[a:b].decode() if not s else " " + raw[a:b].decode() for a, b, s in zip(lo[pick].tolist(), hi[pick].tolist(), spaced[pick].tolist(), strict=True)]
            which = np.flatnonzero(new)
            if self.spaced and "\n" in pieces:  # the separator itself, known by its id
                k = pieces.index("\n")
                self._hold(distinct[which[k]])
                del pieces[k]
                which = np.delete(which, k)
            if pieces:
                self._learn(distinct[which], pieces)
            at = np.searchsorted(self.hashes, distinct)
        self.used[at] = True
        begin, n = self.begins[at][inverse], self.lengths[at][inverse]
        upto = np.cumsum(n)
        ids = self.pool[np.repeat(begin - (upto - n), n) + np.arange(upto[-1] if len(upto) else 0)]
        counts = np.bincount(rows, n, n_texts).astype(np.int64)
        if slow.any():
            parts = np.split(ids, np.cumsum(counts)[:-1])
            where = np.flatnonzero(slow).tolist()
            for i, own in zip(where, self.encode([raw[offsets[i] : offsets[i + 1]].decode() for i in where]), strict=True):
                parts[i], counts[i] = own, len(own)
            ids = np.concatenate(parts)
        return ids, counts

    def _hold(self, key: np.uint64) -> None:
        """Remember the separator as a piece."""
        at = int(np.searchsorted(self.hashes, key))
        if self.filled == len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(len(self.pool), np.uint16)])
        self.pool[self.filled] = self.joint_id
        self.begins, self.lengths = np.insert(self.begins, at, self.filled), np.insert(self.lengths, at, 1)
        self.used, self.hashes = np.insert(self.used, at, True), np.insert(self.hashes, at, key)
        self.filled += 1


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with ``end_id`` after each text."""
    return np.insert(ids, np.cumsum(counts), end_id), counts + 1


_encoders: dict[tuple[str, str], WordEncoder] = {}


def encoder(path: str, gap: str) -> WordEncoder:
    """This worker's encoder; kept between tasks."""
    if (path, gap) not in _encoders:
        _encoders[path, gap] = WordEncoder(path, gap)
    return _encoders[path, gap]
