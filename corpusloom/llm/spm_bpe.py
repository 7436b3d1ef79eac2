"""SentencePiece encoding of merge-type models by backtracking, and decoding.

A segmentation is the model's own exactly when each token and each pair of adjacent tokens
survives being taken apart and merged again. So the encoder walks from left to right with
the longest vocabulary match at each position (all matches come from one Aho-Corasick
pass), checks it against the token before by re-merging the two, falls back to shorter
matches, and steps back over the last token when none fits; a bitfield holds positions
from which no way leads on, so no position is tried twice.

A text is taken word by word; no piece has a space other than at its start. The words of
a slice that no slice before had are encoded together, one step of each at a time, and
kept in a bounded memo, as ids and as the bytes that the ids decode to. Long words are
cut where no merge can cross (two characters that no piece has side by side).
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corpusloom.llm.wordhash import pieces

#: The mark that stands for a space in pieces, fixed by the library.
SPACE = "▁"


#: Texts that come out of the library otherwise if a model rewrites characters or spaces before it encodes.
_PROBES = ("\ufb01 \uff21\u00bd e\u0301", " a  b ", "A\tb\r\n c", "\u00a0x\u3000y\u200bz", "<s> \u2581q")


#: Words of up to so many characters are taken together; the failed positions of each are bits of one integer.
SHORT = 62
#: Bytes of text whose words are looked up together.
SLICE = 4 << 20


class PieceModel:
    """Pieces, ids and ranks of a merge-type model, read through the library; encoding is done here."""

    def __init__(self, path: str, memo: int = 250_000):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.memo_size = memo
        self.piece: dict[str, int] = {}
        self.raw: list[bytes] = []
        self.byte_id = [0] * 256
        self.rank: dict[str, float] = {}
        names: list[str] = []
        for i in range(model.get_piece_size()):
            name = model.id_to_piece(i)
            names.append(name)
            usual = not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
            if model.is_byte(i):
                value = int(name[3:-1], 16)
                self.byte_id[value] = i
                self.raw.append(bytes([value]))
            else:
                self.raw.append(name.replace(SPACE, " ").encode() if usual else (b" \xe2\x81\x87 " if model.is_unknown(i) else b""))
            if usual:
                self.piece[name] = i
                self.rank[name] = -model.get_score(i)
        self.names = names
        self.bigrams = {name[k : k + 2] for name in self.piece for k in range(len(name) - 1)}
        self.known = {c for c in self.piece if len(c) == 1}
        if {c for name in self.piece for c in name} - self.known:
            raise ValueError("the model has pieces with characters that are no pieces")
        if any(SPACE in name.lstrip(SPACE) for name in self.piece):
            raise ValueError("the model has pieces that go on after a space")
        # a token that its own text does not merge into never comes out of the model
        usable = {name: i for name, i in self.piece.items() if len(name) == 1 or self.merge(name) == [name]}
        self.size = np.array([len(name) for name in names])
        self.shorter = np.full(len(names), -1)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for name, i in usable.items():
            self.shorter[i] = next((usable[name[:k]] for k in range(len(name) - 1, 0, -1) if name[:k] in usable), -1)
            self.automaton.add_word(name, i)
        self.automaton.make_automaton()
        # pairs of tokens looked at so far, as sorted keys, and whether they are compatible
        self.pair_keys, self.pair_fits = np.zeros(0, np.int64), np.zeros(0, bool)
        # long words are cut before and after characters of these kinds where no piece has both sides
        self.cut = re.compile(r"[^\W\d_]+|.", re.DOTALL)
        self.lines = not any("\n" in name for name in self.piece)
        self.apart = next(c for c in map(chr, range(1, 1 << 16)) if c not in self.known)
        self.said = [str(i) for i in range(len(names))]
        self.words: dict[str, tuple[str, bytes]] = {}
        for probe in _PROBES:
            if self.encode(probe) != model.encode(probe):
                raise ValueError("the model rewrites texts before it encodes them, which is not done here")

    def merge(self, text: str) -> list[str]:
        """Merges adjacent symbols, the best-ranked first and the leftmost of equals, until none can be."""
        symbols = list(text)
        after = list(range(1, len(symbols) + 1))
        before = list(range(-1, len(symbols) - 1))
        rank = self.rank
        heap = [(rank[p], i, p) for i in range(len(symbols) - 1) if (p := symbols[i] + symbols[i + 1]) in rank]
        heapq.heapify(heap)
        while heap:
            _, i, joined = heapq.heappop(heap)
            j = after[i]
            if j >= len(symbols) or not symbols[i] or symbols[i] + symbols[j] != joined:
                continue
            symbols[i], symbols[j] = joined, ""
            after[i] = after[j]
            if after[i] < len(symbols):
                before[after[i]] = i
                if (p := joined + symbols[after[i]]) in rank:
                    heapq.heappush(heap, (rank[p], i, p))
            if (b := before[i]) >= 0 and (p := symbols[b] + joined) in rank:
                heapq.heappush(heap, (rank[p], b, p))
        return [s for s in symbols if s]

    def compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether the texts of two tokens, merged again, give the two; for many pairs at once."""
        keys = left << 32 | right
        at = np.searchsorted(self.pair_keys, keys)
        known = at < len(self.pair_keys)
        known[known] = self.pair_keys[at[known]] == keys[known]
        if not known.all():
            if len(self.pair_keys) > 4 * self.memo_size:
                self.pair_keys, self.pair_fits = self.pair_keys[:0], self.pair_fits[:0]
                return self.compatible(left, right)
            new = np.unique(keys[~known])
            fits = np.zeros(len(new), bool)
            for k, (i, j) in enumerate(zip((new >> 32).tolist(), (new & 0xFFFFFFFF).tolist(), strict=True)):
                a, b = self.names[i], self.names[j]
                # characters that no piece has side by side are never merged
                fits[k] = a[-1] + b[0] not in self.bigrams or self.merge(a + b) == [a, b]
            to = np.searchsorted(self.pair_keys, new)
            self.pair_keys, self.pair_fits = np.insert(self.pair_keys, to, new), np.insert(self.pair_fits, to, fits)
            at = np.searchsorted(self.pair_keys, keys)
        return self.pair_fits[at]

    def longest(self, text: str) -> np.ndarray:
        """The longest piece that starts at each position, by one pass of the automaton; -1 where none does."""
        found = np.fromiter(chain.from_iterable(self.automaton.iter(text)), np.int64).reshape(-1, 2)
        tokens = found[:, 1]
        best = np.full(len(text), -1)
        np.maximum.at(best, found[:, 0] - self.size[tokens] + 1, self.size[tokens] << 32 | tokens)
        return np.where(best < 0, -1, best & 0xFFFFFFFF)

    def backtrack(self, text: str) -> list[int]:
        """The model's tokens of a text of known characters, however long."""
        longest = self.longest(text).tolist()
        size, shorter, pairs = self.size, self.shorter, {}

        def fits(left: int, right: int) -> bool:
            if (left, right) not in pairs:
                pairs[left, right] = bool(self.compatible(np.array([left]), np.array([right]))[0])
            return pairs[left, right]

        open_ = bytearray(b"\xff" * (len(text) // 8 + 1))
        tokens: list[int] = []
        at, token = 0, longest[0]
        while at < len(text):
            while token >= 0:
                end = at + int(size[token])
                if open_[end >> 3] >> (end & 7) & 1 and (not tokens or fits(tokens[-1], token)):
                    break
                token = int(shorter[token])
            if token >= 0:
                tokens.append(token)
                at = end
                token = longest[at] if at < len(text) else -1
            else:
                open_[at >> 3] &= ~(1 << (at & 7)) & 255
                token = tokens.pop()
                at -= int(size[token])
        return tokens

    def backtrack_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The model's tokens of many short words of known characters, a row each, and their numbers: one step of every word at a time."""
        longest = self.longest(self.apart.join(words))
        length = np.array([len(w) for w in words])
        base = np.cumsum(length + 1) - length - 1
        tokens = np.full((len(words), int(length.max()) + 1), -1)
        depth, at = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        token = longest[base]
        open_ = np.full(len(words), np.iinfo(np.uint64).max, np.uint64)
        one = np.uint64(1)
        # tokens[:, 0] is no token: what stands before a word's first
        left = np.arange(len(words))
        while len(left):
            t, d, p = token[left], depth[left], at[left]
            some = t >= 0
            end = p + np.where(some, self.size[t], 0)
            fits = some & (open_[left] >> end.astype(np.uint64) & one).astype(bool)
            last = tokens[left, d]
            check = np.flatnonzero(fits & (last >= 0))
            fits[check] = self.compatible(last[check], t[check])
            go, back, other = left[fits], left[~some], left[some & ~fits]
            depth[go] += 1
            tokens[go, depth[go]] = t[fits]
            at[go] = end[fits]
            token[go] = longest[np.minimum(base[go] + at[go], len(longest) - 1)]
            token[other] = self.shorter[token[other]]
            open_[back] &= ~(one << at[back].astype(np.uint64))
            token[back] = tokens[back, depth[back]]
            depth[back] -= 1
            at[back] -= self.size[token[back]]
            left = left[at[left] < length[left]]
        return tokens[:, 1:], depth

    def _part(self, text: str) -> list[int]:
        """Ids of a text between cuts; characters that are no pieces become their bytes."""
        out: list[int] = []
        start = 0
        for k, c in enumerate(text):
            if c not in self.known:
                if k > start:
                    out += self.backtrack(text[start:k])
                out += [self.byte_id[b] for b in c.encode()]
                start = k + 1
        if start < len(text):
            out += self.backtrack(text[start:])
        return out

    def _word(self, word: str) -> list[int]:
        """Ids of a word of any length and any characters."""
        out: list[int] = []
        start = 0
        for found in self.cut.finditer(word, 1):
            k = found.start()
            if word[k - 1 : k + 1] not in self.bigrams:
                out += self._part(word[start:k])
                start = k
        return out + self._part(word[start:])

    def _learn(self, words: list[str]) -> None:
        """Ids of the words (see _words) in decimal, joined by commas, and the bytes that they decode to, into the memo."""
        said, raw = self.said, self.raw
        forms = [(w if w[:1] == "\n" else " " + w).replace(" ", SPACE) for w in words]
        # a line break that is no piece is its byte, and nothing merges across it
        lead = [self.lines and w[:1] == "\n" for w in forms]
        bodies = [f[1:] if b else f for f, b in zip(forms, lead, strict=True)]
        short = [bool(w) and len(w) <= SHORT and self.known.issuperset(w) for w in bodies]
        together = [w for w, s in zip(bodies, short, strict=True) if s]
        ids, counts = self.backtrack_words(together) if together else (np.zeros((0, 0), np.int64), np.zeros(0, np.int64))
        flat, ends = ids[np.arange(ids.shape[1]) < counts[:, None]].tolist(), np.cumsum(counts).tolist()
        breaks = [self.byte_id[10]]
        at = k = 0
        for word, body, first, is_short in zip(words, bodies, lead, short, strict=True):
            if is_short:
                own, at, k = flat[at : ends[k]], ends[k], k + 1
            else:
                own = self._word(body) if body else []
            if first:
                own = breaks + own
            self.words[word] = ",".join([said[i] for i in own]), b"".join([raw[i] for i in own])

    def _words(self, text: str) -> list[str]:
        """The text in words, each without the space before it; one that follows no space starts with a line break, which is in no piece."""
        text = text.replace(SPACE, " ")
        if self.lines and "\n" in text:
            if "  " in text or " \n" in text or text[0] in " \n" or text[-1] == " ":
                return [w[1:] if w[0] == " " else w for w in re.findall(" +[^ \n]*|\n[^ \n]*", " " + text)]
            return text.replace("\n", " \n").split(" ")
        if "  " in text or text[0] == " " or text[-1] == " ":
            return [w[1:] for w in re.findall(" +[^ ]*", " " + text)]
        return text.split(" ")

    def spoken(self, texts: list[str]) -> Iterator[tuple[str, bytes]]:
        """Of each text its ids in decimal, joined by commas, and the bytes of what they decode to."""
        split = [self._words(t) if t else [] for t in texts]
        used = set(chain.from_iterable(split))
        if len(self.words) > self.memo_size:
            self.words = {w: self.words[w] for w in used & self.words.keys()}
        new = list(used - self.words.keys())
        if new:
            self._learn(new)
        for words in split:
            if words:
                said, raw = zip(*map(self.words.__getitem__, words), strict=True)
                yield ",".join(said), self._decoded(b"".join(raw))
            else:
                yield "", b""

    def encode(self, text: str) -> list[int]:
        """Ids of the text."""
        said, _ = next(self.spoken([text]))
        return [int(i) for i in said.split(",")] if said else []

    @staticmethod
    def _decoded(data: bytes) -> bytes:
        # the first space is the model's own
        return (data[1:] if data[:1] == b" " else data).decode("utf-8", "replace").encode()

    def decode(self, ids: list[int]) -> str:
        """Text of the ids: pieces side by side, byte pieces as UTF-8, without the model's own first space."""
        return self._decoded(b"".join([self.raw[i] for i in ids])).decode()


_MODELS: dict[str, PieceModel] = {}


def model_at(path: str) -> PieceModel:
    """One model a worker."""
    if path not in _MODELS:
        _MODELS[path] = PieceModel(path)
    return _MODELS[path]


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per input row: id, n_tokens, ids_sha256, decoded_sha256, and with_ids the ids themselves.

    A null text counts as empty and has no tokens; a null id stays null; repeated rows give
    repeated results; other columns are ignored; an empty table gives no rows. Any length
    of text is encoded whole. A model that rewrites texts before encoding is refused.
    """
    schema = f"{id_col} long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_at(model_path)
        for batch in pieces(batches, 1, SLICE):
            counts, digests, decoded, lists = [], [], [], []
            for said, raw in model.spoken([t or "" for t in batch.column(1).to_pylist()]):
                counts.append(said.count(",") + 1 if said else 0)
                digests.append(hashlib.sha256(said.encode()).hexdigest())
                decoded.append(hashlib.sha256(raw).hexdigest())
                if with_ids:
                    lists.append([int(i) for i in said.split(",")] if said else [])
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())]
            names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns.append(pa.array(lists, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(docs[id_col].cast("long").alias(id_col), docs[text_col].alias("text")).mapInArrow(run, schema)
