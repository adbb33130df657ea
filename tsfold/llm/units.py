"""Token ids by distinct unit: cut texts where no token can reach over, encode each distinct unit once.

A tokenizer spends its time on words it has already met. Here a slice of texts
is cut with numpy at boundaries that are safe for the tokenizer at hand, equal
units are found by a 64-bit hash, and only units that are not remembered go to
the tokenizer. The ids of a text are the ids of its units, one after the other.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd

from tsfold.llm.common import mix, ranges, segment_sums

#: Units of more bytes than this are encoded without a look at the memory. It also keeps the
#: polynomial hash far below the lengths at which strings that defeat it exist.
LONG_UNIT = 256
_M = 0x9E3779B97F4A7C15 | 1
_M_INV = pow(_M, -1, 1 << 64)


_kept_powers: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n - 1) modulo 2**64; tables for slices of usual size are kept."""
    have = _kept_powers.get(base)
    if have is None or len(have) < n:
        out = np.full(max(n, 1 << 18), base, np.uint64)
        out[0] = 1
        have = np.multiply.accumulate(out)
        if len(have) <= 1 << 21:
            _kept_powers[base] = have
    return have[:n]


class Texts:
    """UTF-8 bytes of some texts after one another; ``starts`` and ``ends`` are the texts' bounds."""

    def __init__(self, texts: list[bytes]):
        lens = np.fromiter(map(len, texts), np.int64, len(texts))
        self.buf = np.frombuffer(b"".join(texts), np.uint8)
        self.ends = np.cumsum(lens)
        self.starts = self.ends - lens
        self.lens = lens


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_ALNUM = np.zeros(256, bool)
_ALNUM[list(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")] = True


def _after_wide_space(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character before each position is one of the white space characters above U+007F."""
    b1, b2 = buf[at - 1], buf[np.maximum(at - 2, 0)]
    b3 = buf[np.maximum(at - 3, 0)]
    two = (b2 == 0xC2) & ((b1 == 0x85) | (b1 == 0xA0))
    general = (b3 == 0xE2) & (b2 == 0x80) & ((b1 <= 0x8A) | (b1 == 0xA8) | (b1 == 0xA9) | (b1 == 0xAF))
    others = ((b3 == 0xE1) & (b2 == 0x9A) & (b1 == 0x80)) | ((b3 == 0xE2) & (b2 == 0x81) & (b1 == 0x9F)) \
        | ((b3 == 0xE3) & (b2 == 0x80) & (b1 == 0x80))
    return two | general | others


def cuts_before_space(t: Texts) -> np.ndarray:
    """Safe cuts for the byte-level tokenizers: before white space that follows another character,
    and before a full stop or comma that follows an ASCII letter or digit.

    No pre-token continues from another character into white space, and the
    look-ahead behind white space sees the next character inside its own unit.
    No pre-token holds both a letter or digit and a stop after it.
    """
    buf = t.buf
    if not len(buf):
        return np.zeros(0, np.int64)
    space = _SPACE[buf]
    cut = np.zeros(len(buf), bool)
    cut[1:] = space[1:] & ~space[:-1]
    wide = np.flatnonzero(cut[1:] & (buf[:-1] >= 0x80)) + 1
    cut[wide[_after_wide_space(buf, wide)]] = False
    cut[1:] |= ((buf[1:] == 46) | (buf[1:] == 44)) & _ALNUM[buf[:-1]]
    cut[t.starts[t.lens > 0]] = True
    return np.flatnonzero(cut)


class UnitCodes:
    """Token ids of texts through their distinct units.

    ``cut`` gives the sorted start positions of units (text starts included);
    ``encode`` maps a list of distinct units (bytes) to their ids: all ids after
    one another and the number of ids of each. At most ``max_units`` units are
    remembered, the longest unused go first; results do not depend on it.
    """

    def __init__(self, cut: Callable[[Texts], np.ndarray], encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]],
                 max_units: int = 400_000, dtype=np.uint16):
        self.cut, self.encode, self.max_units, self.dtype = cut, encode, max_units, dtype
        self.keys = np.zeros(0, np.uint64)
        self.starts = np.zeros(0, np.int64)
        self.lens = np.zeros(0, np.int64)
        self.stamp = np.zeros(0, np.int64)
        self.flat = np.zeros(0, dtype)
        self.round = 0

    def _distinct(self, t: Texts):
        """Start and length of each distinct unit, which of them each unit is, units of each text, keys."""
        at = self.cut(t)
        lens = np.diff(np.append(at, len(t.buf)))
        counts = np.searchsorted(at, t.ends) - np.searchsorted(at, t.starts)
        n = len(t.buf)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((t.buf.astype(np.uint64) + np.uint64(1)) * _powers(_M, n), out=sums[1:])
        keys = mix((sums[at + lens] - sums[at]) * _powers(_M_INV, n)[at] ^ (lens.astype(np.uint64) << np.uint64(48)))
        long = lens > LONG_UNIT
        if long.any():  # keys of their own, told from all others by the top bit
            keys &= np.uint64((1 << 63) - 1)
            keys[long] = np.uint64(1 << 63) + np.arange(int(long.sum()), dtype=np.uint64)
        else:
            keys &= np.uint64((1 << 63) - 1)
        which, keys = pd.factorize(keys)
        first = np.empty(len(keys), np.int64)
        first[which[::-1]] = np.arange(len(which) - 1, -1, -1)
        return at[first], lens[first], which, counts, keys

    def _codes(self, t: Texts, at: np.ndarray, lens: np.ndarray, keys: np.ndarray):
        """Start in ``flat`` and number of ids of each distinct unit."""
        self.round += 1
        slot = np.searchsorted(self.keys, keys)
        known = slot < len(self.keys)
        known[known] = self.keys[slot[known]] == keys[known]
        starts = np.zeros(len(keys), np.int64)
        sizes = np.zeros(len(keys), np.int64)
        starts[known], sizes[known] = self.starts[slot[known]], self.lens[slot[known]]
        self.stamp[slot[known]] = self.round
        new = np.flatnonzero(~known)
        if len(new):
            raw = t.buf.tobytes()
            flat, n = self.encode([raw[a:b] for a, b in zip(at[new].tolist(), (at[new] + lens[new]).tolist())])
            starts[new], sizes[new] = len(self.flat) + np.cumsum(n) - n, n
            self.flat = np.concatenate([self.flat, flat.astype(self.dtype)])
            keep = keys[new] < np.uint64(1 << 63)
            self.keys = np.concatenate([self.keys, keys[new][keep]])
            order = np.argsort(self.keys, kind="stable")
            self.keys = self.keys[order]
            self.starts = np.concatenate([self.starts, starts[new][keep]])[order]
            self.lens = np.concatenate([self.lens, n[keep]])[order]
            self.stamp = np.concatenate([self.stamp, np.full(int(keep.sum()), self.round)])[order]
        return starts, sizes

    def _forget(self) -> None:
        if len(self.keys) > self.max_units or len(self.flat) > 8 * self.max_units:
            keep = self.stamp > np.median(self.stamp) if len(self.keys) else np.zeros(0, bool)
            self.keys, self.starts, self.lens, self.stamp = (x[keep] for x in (self.keys, self.starts, self.lens, self.stamp))
            self.flat = self.flat[ranges(self.starts, self.lens)]
            self.starts = np.cumsum(self.lens) - self.lens

    def counts(self, texts: list[bytes]) -> np.ndarray:
        """Number of ids of each text."""
        t = Texts(texts)
        at, lens, which, counts, keys = self._distinct(t)
        _, sizes = self._codes(t, at, lens, keys)
        self._forget()
        return segment_sums(sizes[which], counts)

    def ids(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, text after text, and the number of ids of each text."""
        t = Texts(texts)
        at, lens, which, counts, keys = self._distinct(t)
        starts, sizes = self._codes(t, at, lens, keys)
        each = sizes[which]
        flat = self.flat[ranges(starts[which], each)]
        self._forget()
        return flat, segment_sums(each, counts)


def encode_with(tokenizer, separator: str, special: list[str], batch_bytes: int = 1 << 18) -> Callable:
    """Encoder of units for the ``tokenizers`` library.

    Units are joined by ``separator``, a special token of the tokenizer, into
    batches of about ``batch_bytes``: the library cuts a text at its special
    tokens before anything else, so each unit is encoded as if alone, and the
    separator's id shows where it ends. Units that hold a special string
    themselves are encoded one by one.
    """
    mark = tokenizer.token_to_id(separator)
    raw = [s.encode() for s in special]
    sep = separator.encode()

    def encode(units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        parts, sizes = [], np.zeros(len(units), np.int64)
        batch: list[int] = []
        held = 0

        def flush() -> None:
            nonlocal held
            if batch:
                joined = sep.join(units[i] for i in batch).decode()
                ids = np.array(tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.uint32)
                ends = np.append(np.flatnonzero(ids == mark), len(ids))
                sizes[batch] = np.diff(np.concatenate([[-1], ends])) - 1
                parts.append(ids[ids != mark])
                batch.clear()
                held = 0

        for i, u in enumerate(units):
            if b"<|" in u and any(s in u for s in raw) or len(u) > batch_bytes:
                flush()
                ids = tokenizer.encode_batch_fast([u.decode()], add_special_tokens=False)[0].ids
                parts.append(np.array(ids, np.uint32))
                sizes[i] = len(ids)
                continue
            batch.append(i)
            held += len(u)
            if held >= batch_bytes:
                flush()
        flush()
        return (np.concatenate(parts) if parts else np.zeros(0, np.uint32)), sizes

    return encode


def split_long(text: bytes, limit: int, cut: Callable[[Texts], np.ndarray], window: int = 1 << 14) -> list[bytes]:
    """Parts of a text of about ``limit`` bytes, cut at the first safe boundary behind it (no part is
    longer unless a stretch without a boundary is)."""
    parts, start = [], 0
    while len(text) - start > limit:
        at, stop = start + limit, -1
        while stop < 0 and at < len(text):
            t = Texts([text[at - 4:at + window]])
            found = cut(t)
            found = found[found >= 4]
            if len(found):
                stop = at - 4 + int(found[0])
            at += window - 4
        if stop < 0:
            break
        parts.append(text[start:stop])
        start = stop
    parts.append(text[start:])
    return parts
