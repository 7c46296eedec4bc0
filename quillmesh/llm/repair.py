"""Re-Pair grammar files of token ids: pairs become nonterminals, round by round; any document decodes alone.

A shard holds whole documents. Layout, all little-endian:

    8 bytes  b"QMREPAIR"
    6 int64  part, shard, documents, rules, symbols, bytes of a symbol (2, 3 or 4)
    int64[documents]      document ids (a null id is the smallest int64)
    int64[documents + 1]  places of the documents' first symbols
    int64[documents]      token counts
    uint32[rules, 2]      the pair that each rule stands for, ids or earlier rules
    uint32[rules]         expansion length of each rule
    uint16[symbols]       the low halves of the symbols; from BASE on symbols are rules
    uint8 or uint16       the high parts of the symbols, where a symbol has 3 or 4 bytes

Pairs never cross two documents, so a document's symbols expand to its tokens alone.
"""

from __future__ import annotations

import numpy as np

MAGIC = b"QMREPAIR"
#: Ids below are tokens; rule r is symbol BASE + r.
BASE = 50_400
NULL_ID = -(1 << 63)
_SLOT_BITS = 18


def _slot(keys: np.ndarray) -> np.ndarray:
    return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)


def _frequent(keys: np.ndarray, most: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that occur at least `least` times, as keys, the most frequent first; `most` at the most, one a slot. Counts
    are exact; pairs that share a slot with a more frequent one wait for another round. Then all frequent pairs."""
    ordered = np.sort(keys)
    starts = np.concatenate([[0], np.flatnonzero(ordered[1:] != ordered[:-1]) + 1])
    n = np.diff(np.append(starts, len(ordered)))
    pairs = ordered[starts[n >= least]] if len(ordered) else ordered
    n = n[n >= least]
    pairs, n = pairs[pairs >= 0], n[pairs >= 0]
    chosen = pairs[np.lexsort((pairs, -n))[:most]]
    chosen = chosen[np.sort(np.unique(_slot(chosen), return_index=True)[1])]
    return chosen, pairs


def compress(ids: np.ndarray, counts: np.ndarray, most: int = 16_384, least: int = 6):
    """Symbols, places of the documents' first symbols, rules and expansion lengths.

    ids: all documents' tokens, below BASE; counts: tokens of each. Rounds go on until no pair occurs `least` times (a rule
    takes 12 bytes, so that rarer pairs save nothing); each replaces up to `most` pairs, from left to right where they
    overlap.
    """
    seq = ids.astype(np.int64)
    if len(seq) and int(seq.max()) >= BASE:
        raise ValueError(f"ids must be below {BASE}")
    last = np.zeros(len(seq), bool)
    ends = np.cumsum(counts)
    last[ends[counts > 0] - 1] = True
    rules, lengths, n_rules = [np.zeros((0, 2), np.uint32)], np.zeros(0, np.uint32), 0
    held, symbol = np.full(1 << _SLOT_BITS, -2, np.int64), np.zeros(1 << _SLOT_BITS, np.int64)
    marked, new = None, 0
    while len(seq) > 1:
        keys = seq[:-1] << 32 | seq[1:]
        keys[last[:-1]] = -1
        at = np.arange(len(keys))
        if marked is not None:  # others are no more frequent than before: pairs of new symbols, and those that were frequent
            made = seq >= BASE + n_rules - new
            at = np.flatnonzero(made[:-1] | made[1:] | marked[_slot(keys)])
        pairs, frequent = _frequent(keys[at], most, least)
        if not len(pairs):
            break
        slots, new = _slot(pairs), len(pairs)
        marked = np.zeros(1 << _SLOT_BITS, bool)
        marked[_slot(frequent)] = True
        held[slots], symbol[slots] = pairs, BASE + n_rules + np.arange(len(pairs))
        both = np.stack([pairs >> 32, pairs & 0xFFFFFFFF], axis=1)
        size = np.ones(both.shape, np.uint32)
        size[both >= BASE] = lengths[both[both >= BASE] - BASE]
        lengths = np.concatenate([lengths, size.sum(axis=1, dtype=np.uint32)])
        rules.append(both.astype(np.uint32))
        n_rules += len(pairs)
        place = _slot(keys[at])
        same = held[place] == keys[at]
        hit, place = at[same], place[same]
        fresh = np.concatenate([[True], np.diff(hit) > 1])  # every second place of a run of overlapping pairs
        order = np.arange(len(hit))
        taken = (order - np.maximum.accumulate(np.where(fresh, order, 0))) % 2 == 0
        hit = hit[taken]
        seq[hit] = symbol[place[taken]]
        last[hit] = last[hit + 1]
        keep = np.ones(len(seq), bool)
        keep[hit + 1] = False
        seq, last = seq[keep], last[keep]
        held[slots] = -2
    starts = np.zeros(len(counts) + 1, np.int64)
    firsts = np.concatenate([[0], np.flatnonzero(last) + 1])
    starts[1:] = firsts[np.cumsum(counts > 0)]
    return seq, starts, np.concatenate(rules), lengths


def pack(part: int, shard: int, doc_ids: np.ndarray, ids: np.ndarray, counts: np.ndarray, **how) -> bytes:
    """The bytes of one shard file."""
    seq, starts, rules, lengths = compress(ids, counts, **how)
    top = int(seq.max()) if len(seq) else 0
    width = 2 if top < 1 << 16 else 3 if top < 1 << 24 else 4
    high = {2: b"", 3: (seq >> 16).astype(np.uint8).tobytes(), 4: (seq >> 16).astype(np.uint16).tobytes()}[width]
    head = np.array([part, shard, len(doc_ids), len(rules), len(seq), width], np.int64)
    return b"".join([MAGIC, *(x.tobytes() for x in (head, doc_ids.astype(np.int64), starts, counts.astype(np.int64), rules.astype(np.uint32), lengths.astype(np.uint32))), (seq & 0xFFFF).astype(np.uint16).tobytes(), high])


class Shard:
    """A shard file's bytes, opened for whole or random-access decoding."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a grammar shard")
        self.part, self.shard, docs, rules, symbols, width = np.frombuffer(data, np.int64, 6, 8).tolist()
        at = 56

        def take(kind, n):
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        self.doc_ids, self.starts, self.counts = take(np.int64, docs), take(np.int64, docs + 1), take(np.int64, docs)
        self.rules, self.lengths = take(np.uint32, 2 * rules).reshape(-1, 2), take(np.uint32, rules).astype(np.int64)
        self.symbols = take(np.uint16, symbols)
        if width > 2:
            self.symbols = self.symbols.astype(np.uint32) | take(np.uint8 if width == 3 else np.uint16, symbols).astype(np.uint32) << np.uint32(16)
        self._start = np.cumsum(self.lengths) - self.lengths
        self._full = np.empty(int(self.lengths.sum()), np.uint32)
        done = 0
        while done < rules:  # all rules whose parts are known yet
            inside = self.rules[done:].max(axis=1).astype(np.int64) >= BASE + done
            to = done + (int(np.argmax(inside)) if inside.any() else rules - done)
            ids, _ = self._expand(self.rules[done:to].ravel())
            self._full[self._start[done] : self._start[done] + len(ids)] = ids
            done = to

    def _expand(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        symbols = symbols.astype(np.int64)
        rule = symbols - BASE
        inner = rule >= 0
        size = np.where(inner, self.lengths[np.where(inner, rule, 0)], 1) if len(self.lengths) else np.ones(len(symbols), np.int64)
        ends = np.cumsum(size)
        out = np.repeat(symbols.astype(np.uint32), size)
        if inner.any():
            start = np.where(inner, self._start[np.where(inner, rule, 0)], 0)
            deep = np.repeat(inner, size)
            place = np.repeat(start - (ends - size), size)[deep] + np.flatnonzero(deep)
            out[deep] = self._full[place]
        return out, ends

    def all(self) -> np.ndarray:
        """All documents' tokens, one after another."""
        return self._expand(self.symbols)[0]

    def tokens(self, k: int, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Tokens [start, stop) of the k-th document, expanding only the symbols that cover them."""
        symbols = self.symbols[self.starts[k] : self.starts[k + 1]].astype(np.int64)
        stop = int(self.counts[k]) if stop is None else min(stop, int(self.counts[k]))
        rule = symbols - BASE
        size = np.where(rule >= 0, self.lengths[np.maximum(rule, 0)], 1) if len(self.lengths) else np.ones(len(symbols), np.int64)
        ends = np.cumsum(size)
        a, b = int(np.searchsorted(ends, start, side="right")), int(np.searchsorted(ends, stop, side="left")) + 1
        out, _ = self._expand(symbols[a:b])
        skipped = int(ends[a - 1]) if a else 0
        return out[start - skipped : max(start, stop) - skipped]
