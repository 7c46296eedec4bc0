"""Token ids of whole texts by a public tokenizer file, with a memo of words.

Words repeat far more than texts do, so each worker keeps the ids of words that it has met, and asks the library for new
ones, many to a call. That is exact only where a text's ids are those of its words one after another, so the file's own
rules decide:

- marked: byte-level BPE, whose pattern takes a space with what follows. No token crosses a single space between two other
  characters. A text with another space in it is encoded whole.
- dropped: white space parts tokens and is dropped, case is folded. Every run of white space parts words.
- any other file: every text is encoded whole.
"""

from __future__ import annotations

import json
import re
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from quillmesh.llm import common

#: The rules of the two kinds of files, as they stand in them.
_MARKED = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
_FOLDING = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: No word, or one with any kind of space at an end.
_LOOSE = r"(?s)^$|^[\t-\r\x1c-\x1f \x{85}\p{Z}]|[\t-\r\x1c-\x1f \x{85}\p{Z}]$"
#: ASCII letters in lower case and ASCII white space as a space; other bytes as they are.
_PLAIN = bytes(32 if 9 <= b <= 13 else b + 32 if 65 <= b <= 90 else b for b in range(256))
_BETWEEN = "\x01"  # parts words in calls to files that drop spaces; it has one id there
_CALL = 500  # words to a string of a call
#: A word that ends in marks after a letter: both kinds of files part them there.
_TAIL = r"([A-Za-zß-öø-ÿ])([.,;:!?|%$&*#]+)$"
#: Words of letters alone, or two of them with the end of a sentence and a line between: marked files part them there and nowhere else.
_LETTERS = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)(?:\.\n([A-Za-zÀ-ÖØ-öø-ÿ]+))?")
_LONGEST = 48  # characters of a word that is kept


def kind(rules: dict) -> str:
    """marked, dropped or whole, by a tokenizer file's rules."""
    normal, pre = rules.get("normalizer"), rules.get("pre_tokenizer") or {}
    if rules["model"]["type"] != "BPE" or rules["model"].get("dropout") or rules.get("post_processor") or any(t["lstrip"] or t["rstrip"] or t["normalized"] for t in rules["added_tokens"]):
        return "whole"
    if normal is None and pre == _MARKED:
        return "marked"
    first = (pre.get("pretokenizers") or [{}])[0]
    if normal and normal.get("normalizers") == _FOLDING and first.get("pattern") == {"Regex": _WORD_PATTERN} and first.get("behavior") == "Removed" and first.get("invert"):
        return "dropped"
    return "whole"


class WordMemo:
    """ids(texts) gives what Tokenizer.encode(text, add_special_tokens=False) gives for each text.

    path: a tokenizers JSON file with at most 65,536 ids. most: words kept, none above _LONGEST characters, so some 40 MB in
    all at the most; half of the places are for words that occur twice in one call of ids(). Others are encoded each time.
    """

    def __init__(self, path: str, most: int = 160_000):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok, self.most = Tokenizer.from_file(path), most
        if self.tok.get_vocab_size() > 65536:
            raise ValueError("a vocabulary of at most 65,536 ids is supported")
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        self.kind = kind(rules)
        if self.kind == "marked":
            self.opens = np.zeros(1 << 16, bool)
            self.opens[[i for t, i in rules["model"]["vocab"].items() if t.startswith("Ġ")]] = True
        elif self.kind == "dropped":
            between = self.tok.encode(f" {_BETWEEN} ", add_special_tokens=False).ids
            self.opens = np.zeros(1 << 16, bool)
            self.opens[between] = True
            self.kind = "dropped" if len(between) == 1 else "whole"
        self.tok.model._resize_cache(0)  # the memo replaces it
        self.added = [t["content"] for t in rules["added_tokens"]]
        self.direct = self.kind == "marked" and not any(re.fullmatch(r"[A-Za-zÀ-ÖØ-öø-ÿ.\n ]*", t) for t in self.added)
        self.place: dict[str, int] = {}
        self.starts, self.sizes, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.uint16)
        if self.kind == "dropped":  # between two spaces
            self._keep([""], np.array([True]), self.pool, np.zeros(1, np.int64))

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of these texts as they stand, and each text's number."""
        got = [np.array(e.ids, np.uint16) for at in range(0, len(texts), 512) for e in self.tok.encode_batch_fast(texts[at : at + 512], add_special_tokens=False)]
        return np.concatenate([np.zeros(0, np.uint16), *got]), np.fromiter(map(len, got), np.int64, len(got))

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of words that each follow a space, and each word's number.

        Ends of words are parted from their stems, which are looked up again.
        """
        both = pc.split_pattern(pc.replace_substring_regex(pa.array(words, pa.large_string()), _TAIL, r"\1 \2"), " ")
        parts, ends = both.flatten(), both.offsets.to_numpy()[1:]
        cut = np.diff(both.offsets.to_numpy()) > 1
        tail = parts.take(pa.array(ends[cut] - 1)).dictionary_encode()
        tails, tail_sizes = self._encode(tail.dictionary.to_pylist())
        stem = parts.take(pa.array(both.offsets.to_numpy()[:-1])).dictionary_encode()
        stems = _strings(stem.dictionary)
        at = np.fromiter(map(self.place.get, stems, repeat(-1)), np.int64, len(stems))
        new = np.flatnonzero(at < 0)
        ids, sizes = self._asked([stems[i] for i in new])
        store = np.concatenate([self.pool, ids, tails])
        starts, lengths = np.zeros(len(stems), np.int64), np.zeros(len(stems), np.int64)
        starts[at >= 0], lengths[at >= 0] = self.starts[at[at >= 0]], self.sizes[at[at >= 0]]
        starts[new], lengths[new] = len(self.pool) + np.cumsum(sizes) - sizes, sizes
        spans = np.zeros((2, len(words), 2), np.int64)
        code = stem.indices.to_numpy()
        spans[0, :, 0], spans[1, :, 0] = starts[code], lengths[code]
        code = tail.indices.to_numpy()
        spans[0, cut, 1], spans[1, cut, 1] = (len(store) - len(tails) + np.cumsum(tail_sizes) - tail_sizes)[code], tail_sizes[code]
        return store[_spans(spans[0].ravel(), spans[1].ravel())], spans[1].sum(1)

    def _asked(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """_words by the library: of letters by the file's model itself, as their parts are known, others by _called()."""
        shapes = list(map(_LETTERS.fullmatch, words)) if self.direct else []
        if not any(shapes):
            return self._called(words)
        direct = np.fromiter((m is not None for m in shapes), bool, len(shapes))
        parts = [x for m in shapes if m for x in ((" " + m[1],) if m[2] is None else (" " + m[1], m[2]))]
        tokenize, between = self.tok.model.tokenize, [t.id for x in (".", _BYTES[10]) for t in self.tok.model.tokenize(x)]
        flat: list[int] = []
        ends = []
        for x in "\0".join(parts).encode().decode("latin-1").translate(_BYTES).split(_BYTES[0]):
            if x[0] != _BYTES[32]:
                flat += between
            flat += [t.id for t in tokenize(x)]
            ends.append(len(flat))
        firsts = np.fromiter((x[0] == " " for x in parts), bool, len(parts))
        ends = np.array(ends)[np.append(firsts[1:], True)]  # of words, at the last of their parts
        ids, sizes = self._called([w for w, m in zip(words, shapes) if not m])
        every = np.zeros(len(words), np.int64)
        every[direct], every[~direct] = np.diff(ends, prepend=0), sizes
        store = np.concatenate([np.array(flat, np.uint16), ids])
        starts = np.zeros(len(words), np.int64)
        starts[direct] = np.cumsum(every[direct]) - every[direct]
        starts[~direct] = len(store) - len(ids) + np.cumsum(sizes) - sizes
        return store[_spans(starts, every)], every

    def _called(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """_words by the library's encoding: many words to a string, parted by their marks."""
        ids, sizes = [np.zeros(0, np.uint16)], [np.zeros(0, np.int64)]
        for at in range(0, len(words), _CALL):
            part = words[at : at + _CALL]
            one = self._encode([" " + " ".join(part) if self.kind == "marked" else f" {_BETWEEN} ".join(part)])[0]
            marks = np.flatnonzero(self.opens[one])
            if self.kind == "marked" and len(marks) == len(part) and marks[0] == 0:
                ids.append(one)
                sizes.append(np.diff(np.append(marks, len(one))))
            elif self.kind == "dropped" and len(marks) == len(part) - 1:
                keep = np.ones(len(one), bool)
                keep[marks] = False
                ids.append(one[keep])
                sizes.append(np.diff(np.concatenate([[-1], marks, [len(one)]])) - 1)
            else:  # a word holds the mark itself
                one, own = self._encode([" " + w for w in part])
                ids.append(one)
                sizes.append(own)
        return np.concatenate(ids), np.concatenate(sizes)

    def _keep(self, words: list[str], often: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        chosen = [i for i, w in enumerate(words) if len(w) <= _LONGEST]
        frequent = [i for i in chosen if often[i]]
        room = self.most - len(self.place)
        chosen = frequent[:room] + [i for i in chosen if not often[i]][: max(0, min(room - len(frequent), self.most // 2 - len(self.place) - len(frequent)))]
        if not chosen:
            return
        ends = np.cumsum(sizes)
        own = sizes[chosen]
        self.place.update(zip([words[i] for i in chosen], range(len(self.place), len(self.place) + len(chosen))))
        self.starts = np.concatenate([self.starts, len(self.pool) + np.cumsum(own) - own])
        self.sizes = np.concatenate([self.sizes, own.astype(np.int32)])
        self.pool = np.concatenate([self.pool, ids[_spans(ends[chosen] - own, own)]])

    def _parted(self, texts: pa.Array) -> tuple[pa.ListArray, str]:
        """The words of each text, and a pattern of those that can't be encoded alone."""
        if self.kind == "marked":
            return pc.split_pattern(texts, " "), _LOOSE
        ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = texts.buffers()[2].slice(int(ends[0]), int(ends[-1] - ends[0])).to_pybytes().translate(_PLAIN)
        plain = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer((ends - ends[0]).tobytes()), pa.py_buffer(data))
        return pc.split_pattern(plain, " "), "|".join(x.replace("|", r"\|") for x in self.added) or r"\A\z."

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids (uint16) one text after another, and each text's number of ids. Null counts as empty."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        n = len(texts)
        if self.kind == "whole" or not n:
            return self._encode(texts.to_pylist())
        lists, odd = self._parted(texts)
        bounds = lists.offsets.to_numpy().astype(np.int64)
        bounds -= bounds[0]
        coded = lists.flatten().dictionary_encode()
        codes, words = coded.indices.to_numpy().astype(np.int64), _strings(coded.dictionary)
        at = np.fromiter(map(self.place.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(at < 0)
        strange = np.zeros(len(words), bool)
        strange[new] = pc.match_substring_regex(coded.dictionary.take(pa.array(new)), odd).to_numpy(zero_copy_only=False)
        whole = np.zeros(n, bool)
        if strange.any():
            whole[np.repeat(np.arange(n), np.diff(bounds))[strange[codes]]] = True
            if self.kind == "marked":  # the only space-like end of a text of one word is no matter
                whole &= np.diff(bounds) > 1
            new = new[~strange[new]]
        often = np.bincount(codes, minlength=len(words))[new] > 1
        fresh = [words[i] for i in new]
        ids, sizes = self._words(fresh)
        store = [self.pool, ids]
        starts, lengths = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        known = at >= 0
        starts[known], lengths[known] = self.starts[at[known]], self.sizes[at[known]]
        starts[new], lengths[new] = len(self.pool) + np.cumsum(sizes) - sizes, sizes
        self._keep(fresh, often, ids, sizes)

        filled = np.diff(bounds)
        parts, counts = [], np.zeros(n, np.int64)  # what is encoded as it stands: first words, and texts with odd words
        if self.kind == "marked":
            first = np.flatnonzero(~whole)
            parts += [words[c] for c in codes[bounds[first]]]
        else:
            first = np.zeros(0, np.int64)
        parts += texts.take(pa.array(np.flatnonzero(whole))).to_pylist() if whole.any() else []
        own, own_sizes = self._encode(parts)
        base = sum(map(len, store))
        own_starts = base + np.cumsum(own_sizes) - own_sizes
        store = np.concatenate([*store, own])
        starts, lengths = starts[codes], lengths[codes]
        if len(parts):
            spot = np.concatenate([bounds[first], bounds[:-1][whole & (filled > 0)]])
            if whole.any():
                lengths[np.repeat(whole, filled)] = 0
            starts[spot], lengths[spot] = own_starts, own_sizes
        ends = np.concatenate([[0], np.cumsum(lengths)])
        counts = np.diff(ends[bounds])
        return store[_spans(starts, lengths)], counts


def _byte_letters() -> dict[int, str]:
    """The characters by which byte-level files write bytes: printing ones as they are, others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


_BYTES = _byte_letters()


def _strings(values: pa.Array) -> list[str]:
    return values.to_numpy(zero_copy_only=False).tolist()


def _spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All places of these spans, one after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


def memo(path: str, most: int = 160_000) -> WordMemo:
    """One memo for each worker process while it serves tasks of one stage, and so what they have met."""
    if ("memo", path, most) not in common.KEPT:
        common.KEPT["memo", path, most] = WordMemo(path, most)
    return common.KEPT["memo", path, most]


def installed(name: str) -> str:
    """The place of an installed public tokenizer file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
