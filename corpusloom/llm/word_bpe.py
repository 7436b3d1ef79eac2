"""Ids of a BPE tokenizer with word ends that lower-cases and drops white space, for many texts at once.

No pre-token of such a file spans white space, so a text falls apart at ASCII white space,
and between a word of letters and the marks after it, into units with ids of their own. Units
of a whole slice are grouped by their bytes; only those that a bounded memo lacks go to the
tokenizer. A word of letters is one pre-token; where the file's merges are in the order of
their ids, its ids come from a rank encoder over the same vocabulary, which gives the same
ids at a fraction of the time. Any other file's texts go to the tokenizer as they are.
"""

from __future__ import annotations

import json
import os
import unicodedata
from array import array

import numpy as np
import pyarrow as pa

from corpusloom.llm.slices import grouped, hashed, runs, spans_of
from corpusloom.llm.wordhash import lower_ascii, text_bytes

#: Fixed by the files that the units hold for: what is a pre-token, and the mark of a word's end.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"

_UNIT = np.ones(256, bool)
_UNIT[[0x20, *range(0x09, 0x0E)]] = False
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
#: Bytes that are no ASCII mark.
_CORE = np.zeros(256, bool)
_CORE[[*range(0x30, 0x3A), *range(0x80, 0x100)]] = True
_CORE |= _LETTER


def _falls_apart(spec: dict) -> bool:
    """Whether the file is of the kind described above."""
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    norms = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers") or []]
    model = spec["model"]
    split = steps[0]
    return (
        split.get("type") == "Split"
        and split.get("pattern") == {"Regex": PRE_TOKEN}
        and split.get("behavior") == "Removed"
        and split.get("invert") is True
        and norms == ["NFC", "Replace", "Lowercase"]
        and model.get("end_of_word_suffix") == WORD_END
        and not model.get("dropout")
        and all("<|" in t["content"] and not t["lstrip"] and not t["rstrip"] for t in spec.get("added_tokens", []))
    )


def _rank_encoder(spec: dict):
    """An encoder of ASCII words by ranks, a zero byte standing for the word's end; None if merges aren't ordered like their ids."""
    import tiktoken
    from tokenizers.pre_tokenizers import ByteLevel

    vocab = spec["model"]["vocab"]
    joined = [vocab.get("".join(m if isinstance(m, list) else m.split(" "))) for m in spec["model"]["merges"]]
    if None in joined or any(a >= b for a, b in zip(joined, joined[1:], strict=False)):
        return None
    # the letters that stand for bytes: printable ones for themselves, the others in order from 256 on
    alphabet = set(ByteLevel.alphabet())
    of_byte = {chr(b): b for b in range(256) if chr(b) in alphabet}
    of_byte |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if chr(b) not in alphabet)}
    ranks = {}
    for token, i in vocab.items():
        stem = token.removesuffix(WORD_END)
        ranks[bytes(of_byte[c] for c in stem) + b"\0" * (stem != token)] = i
    if len(ranks) != len(vocab):
        return None
    return tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})


def _latin(unit: str) -> str | None:
    """A word of Latin letters as the tokenizer's normalizer leaves it; None for any other unit."""
    low = unit.lower()
    if low.isalpha() and max(low) < "\u0250" and "\u0130" not in unit and unicodedata.is_normalized("NFC", unit):
        return low
    return None


class WordBpe:
    """Encodes with a tokenizers file. Two generations of at most ``memo`` units are held."""

    def __init__(self, path: str, memo: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = memo
        self.memo: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.apart = _falls_apart(spec)
        self.ranked = _rank_encoder(spec) if self.apart else None

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, units: list[bytes]) -> None:
        memo, older = self.memo, self.older
        memo.update((u, older[u]) for u in units if u in older)
        units = [u for u in units if u not in memo]
        if self.ranked is not None:
            encode = self.ranked.encode_ordinary
            held = []
            for u in units:
                word = u.decode()
                if not (u.isalpha() and u.islower()):  # of bytes: ASCII letters only
                    word = _latin(word)
                if word is None:
                    held.append(u)
                else:
                    memo[u] = array("I", encode(word + "\0")).tobytes()
            units = held
        for at in range(0, len(units), 10_000):
            part = units[at : at + 10_000]
            memo.update((u, i.tobytes()) for u, i in zip(part, self._ids([u.decode() for u in part]), strict=True))

    def _units(self, data: np.ndarray, offsets: np.ndarray, split: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts, ends, hashes) of all units; marks are split from a word's end if wished."""
        out: list[tuple] = []
        for a, b in runs(data, offsets, _UNIT):
            if not len(a):
                continue
            at, to = int(a[0]), int(b[-1])
            last = np.maximum.accumulate(np.where(_CORE[data[at:to]], np.arange(at, to), -1))
            cut = last[b - 1 - at] + 1
            end, before = data[np.maximum(cut - 1, 0)], data[np.maximum(cut - 2, 0)]
            # after an ASCII letter, or one of U+00C0 to U+00FF
            letter = _LETTER[end] | ((cut - a > 1) & (before == 0xC3) & (end != 0x97) & (end != 0xB7))
            marked = split & (cut > a) & (cut < b) & letter
            of = np.repeat(np.arange(len(a)), 1 + marked)
            second = np.zeros(len(of), bool)
            second[1:] = of[1:] == of[:-1]
            starts = np.where(second, cut[of], a[of])
            ends = np.where(marked[of] & ~second, cut[of], b[of])
            out.append((starts, ends, hashed(data, starts, ends)))
        if not out:
            none = np.zeros(0, np.int64)
            return none, none, np.zeros(0, np.uint64)
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets): the ids of all texts side by side and where each text's begin; null counts as empty."""
        if not self.apart:
            ids = self._ids([t or "" for t in column.to_pylist()])
            return np.concatenate([*ids, np.zeros(0, "<u4")]), np.concatenate([[0], np.cumsum([len(i) for i in ids], dtype=np.int64)])
        data, offsets = text_bytes(column)
        plain = b"<|" not in data.tobytes()  # else a capital could turn into part of a special token, or one be split
        if plain:
            data = lower_ascii(data)
        starts, ends, hashes = self._units(data, offsets, plain)
        first, group = grouped(data, starts, ends, hashes)
        raw = data.tobytes()
        units = [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
        new = [u for u in units if u not in self.memo]
        if len(self.memo) + len(new) > self.size:
            self.older, self.memo = self.memo, {}
            new = units
        self._learn(new)
        memo = self.memo
        found = [memo[u] for u in units]
        for u in new:
            if len(u) > 64:
                memo.pop(u, None)
        lengths = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat = np.frombuffer(b"".join(found), "<u4")
        begins = np.cumsum(lengths) - lengths
        counts = lengths[group]
        ids = flat[spans_of(counts, begins[group])]
        before = np.concatenate([[0], np.cumsum(counts)])
        return ids, before[np.searchsorted(starts, offsets, "left")]


_MODELS: dict[str, WordBpe] = {}


def word_model(path: str) -> WordBpe:
    """One model a worker."""
    if path not in _MODELS:
        _MODELS[path] = WordBpe(path)
    return _MODELS[path]
