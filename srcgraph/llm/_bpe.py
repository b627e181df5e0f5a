"""Byte-level BPE ids of whole texts: array-wise splitting, and merging only for pieces not seen before."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import tiktoken

from ._text import mix

LETTER, NUMBER, OTHER, SPACE = 0, 1, 2, 3
_BLANKS = {0x85, 0xA0, 0x1680, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, *range(9, 14), 32, *range(0x2000, 0x200B)}
_P, _SALT = 0x9E3779B97F4A7C15, np.uint64(0xA0761D6478BD642F)


def _kind(cp: int) -> int:
    if cp in _BLANKS:
        return SPACE
    c = unicodedata.category(chr(cp))[0]
    return LETTER if c == "L" else NUMBER if c == "N" else OTHER


def _read(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def _added(path: str) -> dict[bytes, int]:
    """Tokens that are found in a text before it is split into pieces, and their ids."""
    found = _read(path).get("added_tokens") or []
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in found):
        raise ValueError("added tokens that look at or take in their surroundings")
    return {t["content"].encode(): t["id"] for t in found}


def _merge_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ids of a tokenizer file whose ids follow the order of its merges."""
    model = _read(path)["model"]
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in plain}
    byte_of |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    vocab = model["vocab"]
    if [vocab["".join(m)] for m in merges] != list(range(256, 256 + len(merges))):
        raise ValueError("the ids of this vocabulary don't follow its merges")
    return {bytes(byte_of[c] for c in t): i for t, i in vocab.items() if i < 256 + len(merges)}


class Bpe:
    """ids(): the ids of many texts. Pieces are cached by a 64-bit hash up to ``cached`` pieces, then afresh, also within a text."""

    def __init__(self, path: str, cached: int = 500_000):
        ranks = _merge_ranks(path)
        self.added = _added(path)
        self.find_added = re.compile(b"|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True))) if self.added else None
        core = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.merge = core.encode_single_piece
        self.table = np.array([_kind(c) for c in range(0x3100)], np.uint8)
        self.far: dict[int, int] = {}
        self.cached, self.bits = cached, int(np.ceil(np.log2(cached * 1.6)))
        self.up = self.down = np.ones(1, np.uint64)
        self._reset()

    def _reset(self):
        self.keys, self.slots = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)
        self.count, self.used = 0, 0
        self.start, self.size, self.ids_ = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32), np.zeros(1 << 18, np.int32)

    def _powers(self, n: int):
        if len(self.up) < n:
            up, down = np.full(n, np.uint64(_P)), np.full(n, np.uint64(pow(_P, -1, 1 << 64)))
            up[0] = down[0] = 1
            self.up, self.down = np.multiply.accumulate(up), np.multiply.accumulate(down)
        return self.up[:n], self.down[:n]

    def _kinds(self, cps: np.ndarray) -> np.ndarray:
        kinds = self.table[np.minimum(cps, 0x30FF)]
        high = np.flatnonzero(cps > 0x30FF)
        if len(high):
            values, where = np.unique(cps[high], return_inverse=True)
            for v in values.tolist():
                if v not in self.far:
                    self.far[v] = _kind(v)
            kinds[high] = np.array([self.far[v] for v in values.tolist()], np.uint8)[where]
        return kinds

    def pieces(self, cps: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the pieces that the usual pattern of this vocabulary matches, row by row.

        Runs of one kind are pieces, with three repairs: a run of white space gives its last character to a
        piece of its own, or if that is a space to the next run; and an apostrophe alone before letters that
        begin with s t re ve m ll d takes these letters.
        """
        n, kinds = len(cps), self._kinds(cps)
        new = np.ones(n, bool)
        new[1:] = kinds[1:] != kinds[:-1]
        new[rows[rows < n]] = True
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], n)
        kind = kinds[starts]
        row_start = np.zeros(n + 1, bool)
        row_start[rows] = True
        has_next = ~row_start[ends]
        blank = (kind == SPACE) & has_next
        split = np.flatnonzero(blank)
        last = ends[split] - 1
        joins = cps[last] == 32
        starts = starts.copy()
        after = split + 1
        starts[after[joins]] -= 1
        ends = ends.copy()
        ends[split] -= 1
        extra = last[~joins]
        apostrophe = np.flatnonzero((kind == OTHER) & (ends - starts == 1) & has_next & (cps[np.minimum(starts, n - 1)] == 39))
        if len(apostrophe):
            following = apostrophe + 1
            ok = kind[following] == LETTER
            apostrophe, following = apostrophe[ok], following[ok]
            at = starts[following]
            one = cps[at]
            two = np.where(at + 1 < ends[following], cps[np.minimum(at + 1, n - 1)], 0)
            single = (one == 115) | (one == 116) | (one == 109) | (one == 100)
            double = ((one == 114) & (two == 101)) | ((one == 118) & (two == 101)) | ((one == 108) & (two == 108))
            take = np.where(single, 1, np.where(double, 2, 0))
            ends[apostrophe] += take
            starts[following] += take
        keep = ends > starts
        starts, ends = starts[keep], ends[keep]
        if len(extra):
            starts, ends = np.concatenate([starts, extra]), np.concatenate([ends, extra + 1])
            order = np.argsort(starts, kind="stable")
            starts, ends = starts[order], ends[order]
        return starts, ends

    def _find(self, h: np.ndarray) -> np.ndarray:
        mask, out = np.uint64((1 << self.bits) - 1), np.full(len(h), -1, np.int64)
        at, left = h & mask, None
        while True:
            k = self.keys[at]
            own = h if left is None else h[left]
            hit = k == own
            where = np.flatnonzero(hit) if left is None else left[hit]
            out[where] = self.slots[at[hit]]
            more = ~hit & (k != 0)
            if not more.any():
                return out
            left = np.flatnonzero(more) if left is None else left[more]
            at = (at[more] + np.uint64(1)) & mask

    def _insert(self, h: np.ndarray, slots: np.ndarray):
        mask = np.uint64((1 << self.bits) - 1)
        at = h & mask
        while len(h):
            free = self.keys[at] == 0
            self.keys[at[free]] = h[free]
            won = self.keys[at] == h
            self.slots[at[won]] = slots[won]
            h, slots, at = h[~won], slots[~won], (at[~won] + np.uint64(1)) & mask

    def _learn(self, text: str, h, starts, ends):
        fresh, first = np.unique(h, return_index=True)
        ids = [self.merge(text[a:b].encode()) for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
        sizes = np.fromiter(map(len, ids), np.int32, len(ids))
        flat = np.fromiter((x for y in ids for x in y), np.int32, int(sizes.sum()))
        while self.count + len(ids) > len(self.start):
            self.start, self.size = np.resize(self.start, 2 * len(self.start)), np.resize(self.size, 2 * len(self.size))
        while self.used + len(flat) > len(self.ids_):
            self.ids_ = np.resize(self.ids_, 2 * len(self.ids_))
        span = slice(self.count, self.count + len(ids))
        self.size[span], self.start[span] = sizes, self.used + np.cumsum(sizes) - sizes
        self.ids_[self.used : self.used + len(flat)] = flat
        self._insert(fresh, np.arange(self.count, self.count + len(ids), dtype=np.int32))
        self.count += len(ids)
        self.used += len(flat)

    def _lengths(self, text: str, h, starts, ends) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Sizes and ids of all pieces, in runs that hold no more distinct pieces than the cache does."""
        for a in range(0, len(h), self.cached):
            own = slice(a, a + self.cached)
            part, first, last = h[own], starts[own], ends[own]
            at = self._find(part)
            if (unknown := np.flatnonzero(at < 0)).size:
                if self.count + len(unknown) > self.cached:
                    self._reset()
                    unknown = np.arange(len(part))
                self._learn(text, part[unknown], first[unknown], last[unknown])
                at = self._find(part)
            size = self.size[at].astype(np.int64)
            stop = np.cumsum(size)
            yield size, self.ids_[np.repeat(self.start[at] - stop + size, size) + np.arange(stop[-1])]

    def ids(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and the offsets of the texts in them.

        Added tokens are taken out first, leftmost and longest, and what is between them are texts of their own.
        """
        raw = data.tobytes()
        if self.find_added is None or not (found := list(self.find_added.finditer(raw))):
            return self._plain_ids(data, off)
        rows = np.searchsorted(off, [m.start() for m in found], "right") - 1
        found = [(*m.span(), self.added[m.group()]) for m, r in zip(found, rows.tolist(), strict=True) if m.end() <= off[r + 1]]
        # runs of bytes between the tokens and the rows' ends; a token stands behind its run
        ends = np.concatenate([off[1:], [a for a, _, _ in found]]).astype(np.int64)
        order = np.argsort(ends, kind="stable")  # rows that end where a token begins come before it
        begins = np.concatenate([[0], ends[order][:-1]])
        after = {k: (b, i) for k, (_, b, i) in enumerate(found, len(off) - 1)}
        for place, k in enumerate(order[:-1].tolist(), 1):
            if k in after:
                begins[place] = after[k][0]
        kept = [data[a:b] for a, b in zip(begins.tolist(), ends[order].tolist(), strict=True)]
        flat, at = self._plain_ids(np.concatenate(kept), np.concatenate([[0], np.cumsum([len(k) for k in kept])]))
        out, size, total = [], [0], 0
        for place, k in enumerate(order.tolist()):
            own = flat[at[place] : at[place + 1]]
            out.append(own)
            total += len(own)
            if k in after:
                out.append(np.array([after[k][1]], flat.dtype))
                total += 1
            else:
                size.append(total)
        return np.concatenate(out), np.array(size, np.int64)

    def _plain_ids(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        text = data.tobytes().decode("utf-8", "replace")
        cps = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        if not len(cps):
            return np.zeros(0, np.int32), np.zeros(len(off), np.int64)
        heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        rows = heads[off]
        starts, ends = self.pieces(cps, rows)
        up, down = self._powers(len(cps) + 1)
        total = np.zeros(len(cps) + 1, np.uint64)
        np.cumsum(mix(cps.astype(np.uint64) + _SALT) * up[:-1], out=total[1:])
        h = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
        h[h == 0] = 1
        sizes, flat = zip(*self._lengths(text, h, starts, ends), strict=True)
        return np.concatenate(flat), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])[np.searchsorted(starts, rows, "left")]


_loaded: dict[str, Bpe] = {}


def bpe(path: str) -> Bpe:
    """The tokenizer of this worker process, kept from task to task."""
    if path not in _loaded:
        _loaded[path] = Bpe(path)
    return _loaded[path]
