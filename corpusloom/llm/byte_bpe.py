"""Ids of a byte-level BPE tokenizer with a memo of words.

No pre-token spans a space, or a single line break, between two characters that are no
white space, so the text falls apart there into pieces that the tokenizer encodes
independently; pieces seen before come from a bounded memo, new ones from the tokenizer.
A mark at the end of a letter is a pre-token of its own, so such pieces
are put together from the word and the mark. A word of letters is one pre-token; where the
file's merges are in the order of their ids, its ids come from a rank encoder over the
same file's vocabulary, which gives the same ids at a fraction of the time.
"""

from __future__ import annotations

import json
import os
import re
from array import array

from corpusloom.llm.wordhash import HELD

#: White space other than space and line break, and white space side by side.
_OTHER = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]
_DOUBLE = ["  ", "\n\n", " \n", "\n "]
_OTHER_ASCII = [c for c in _OTHER if c.isascii()]
_EDGE = (" ", "\n")
_CUT = re.compile(r"(?<=\S) (?=\S)")
_MARKS = ",.;:!?"


def _rank_encoder(path: str):
    """An encoder of single pre-tokens by ranks, if the file's merges are plain and ordered like their ids; else None."""
    import tiktoken
    from tokenizers.pre_tokenizers import ByteLevel

    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model = spec["model"]
    if model["type"] != "BPE" or spec.get("normalizer") or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
        return None
    vocab = model["vocab"]
    joined = [vocab.get("".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
    if None in joined or any(a >= b for a, b in zip(joined, joined[1:], strict=False)):
        return None
    # the letters that stand for bytes: printable ones for themselves, the others in order from 256 on
    alphabet = set(ByteLevel.alphabet())
    of_byte = {chr(b): b for b in range(256) if chr(b) in alphabet}
    rest = [b for b in range(256) if chr(b) not in alphabet]
    of_byte |= {chr(256 + k): b for k, b in enumerate(rest)}
    if set(of_byte) != alphabet:
        return None
    ranks = {bytes(of_byte[c] for c in token): i for token, i in vocab.items()}
    return tiktoken.Encoding("ranks", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})


class _Memo(dict):
    """Ids of pieces; one that is not there is encoded when it is asked for. Never more than ``size`` pieces, none longer than 64."""

    def __init__(self, size: int, tokenizer, ranked):
        super().__init__()
        self.size, self.tokenizer = size, tokenizer
        self.ranked = None if ranked is None else ranked.encode_ordinary
        self.mark = {m: self._encoded(m) for m in _MARKS}

    def _encoded(self, piece: str) -> bytes:
        return array("I", self.tokenizer.encode_batch_fast([piece], add_special_tokens=False)[0].ids).tobytes()

    def __missing__(self, piece: str) -> bytes:
        if (piece[1:] if piece[:1] == " " else piece).isalpha() and self.ranked is not None:
            ids = array("I", self.ranked(piece)).tobytes()
        elif piece[-1:] in self.mark and piece[-2:-1].isalpha() and "<|" not in piece:
            ids = self[piece[:-1]] + self.mark[piece[-1]]
        else:
            ids = self._encoded(piece)
        if len(piece) <= 64:
            if len(self) >= self.size:
                self.clear()
            self[piece] = ids
        return ids


class BpeModel:
    """Encodes with a tokenizers file. The memo never holds more than ``memo`` pieces."""

    def __init__(self, path: str, memo: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.memo = _Memo(memo, self.tokenizer, _rank_encoder(path))

    def _pieces(self, text: str) -> list[str]:
        """The text in pieces, those after a space with it."""
        if any(map(text.__contains__, _OTHER if not text.isascii() else _OTHER_ASCII)) or any(map(text.__contains__, _DOUBLE)) or text[:1] in _EDGE or text[-1:] in _EDGE:
            parts = _CUT.split(text)
            return [parts[0], *[" " + p for p in parts[1:]]]
        # a space goes with what follows it, a line break is a piece
        return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as unsigned 32-bit values in the machine's order."""
        get = self.memo.__getitem__
        return [b"".join(map(get, self._pieces(t) if "\0" not in t else [t])) for t in texts]


_MODELS: dict[str, BpeModel] = {}
# a tokenizer and a full memo are 100 MB and more
HELD.append(_MODELS)


def model_at(path: str) -> BpeModel:
    """One model a worker."""
    if path not in _MODELS:
        _MODELS[path] = BpeModel(path)
    return _MODELS[path]
