"""Keywords of a document against a slow form of the method."""

import math
import random
import re
from difflib import SequenceMatcher

from corpusloom.functions import text as X
from corpusloom.operators import keywords


def slow_yake(text: str, longest: int = 3, most: int = 16, stop: frozenset[str] = frozenset(X.STOPWORDS), similar: float = 0.7) -> list[tuple[str, float]]:
    """The method word by word and phrase by phrase."""
    sentences = [re.findall(r"[^\W_][\w'’-]*", s) for s in re.split(r"(?<=[.!?])\s+|\n+", text) if s.strip()]
    sentences = [s for s in sentences if s]
    if not sentences:
        return []
    count: dict[str, int] = {}
    upper: dict[str, int] = {}
    capital: dict[str, int] = {}
    places: dict[str, list[int]] = {}
    left: dict[str, list[str]] = {}
    right: dict[str, list[str]] = {}
    for k, sentence in enumerate(sentences):
        for i, word in enumerate(sentence):
            w = word.lower()
            count[w] = count.get(w, 0) + 1
            upper[w] = upper.get(w, 0) + (word.isupper() and len(word) > 1)
            capital[w] = capital.get(w, 0) + (word[:1].isupper() and i > 0)
            places.setdefault(w, []).append(k)
            if i:
                left.setdefault(w, []).append(sentence[i - 1].lower())
            if i + 1 < len(sentence):
                right.setdefault(w, []).append(sentence[i + 1].lower())
    content = [n for w, n in count.items() if w not in stop] or [1]
    mean = sum(content) / len(content)
    spread = math.sqrt(sum((n - mean) ** 2 for n in content) / len(content))
    highest = max(count.values())
    score: dict[str, float] = {}
    for w, n in count.items():
        case = max(upper[w], capital[w]) / (1 + math.log(n))
        middle = sorted(places[w])[len(places[w]) // 2]
        position = math.log(math.log(3 + middle) + 1e-12)
        frequency = n / (mean + spread)
        spans = [len(set(side)) / len(side) for side in (left.get(w), right.get(w)) if side]
        related = 1 + sum(spans) * n / highest
        sentence_share = len(set(places[w])) / len(sentences)
        score[w] = related * position / (case + frequency / related + sentence_share / related)
    found: dict[str, list[float]] = {}
    for sentence in sentences:
        low = [w.lower() for w in sentence]
        for n in range(1, longest + 1):
            for i in range(len(low) - n + 1):
                gram = low[i : i + n]
                if gram[0] in stop or gram[-1] in stop or any(w.isdigit() for w in gram):
                    continue
                found.setdefault(" ".join(gram), []).append(1)
    ranked = []
    for gram, hits in found.items():
        values = [score[w] for w in gram.split(" ") if w not in stop]
        ranked.append((math.prod(values) / (len(hits) * (1 + sum(values))), gram))
    out: list[tuple[str, float]] = []
    for value, gram in sorted(ranked):
        if all(SequenceMatcher(None, gram, g).ratio() <= similar for g, _ in out):
            out.append((gram, value))
        if len(out) >= most:
            break
    return out


WORDS = ["Red", "red", "RED", "dogs", "dog", "the", "of", "12", "run", "running", "x-y", "d’e", "İstanbul", "ΟΔΟΣ", "½x", "٣", "A"]


def test_same_as_the_slow_form():
    rng = random.Random(1)
    texts = ["", "...", "1 2 3. 4 5", "x " * 300, "a" * 250 + " " + "a" * 240 + " b " + "a" * 230 + "b"]
    texts += ["".join(rng.choice(WORDS) + rng.choice([" ", " ", ". ", "\n", "! ", ", "]) for _ in range(rng.randint(0, 40))) for _ in range(300)]
    for text in texts:
        for most, longest, similar in ((16, 3, 0.7), (5, 2, 0.5), (3, 1, 0.9), (16, 4, 0.7)):
            assert keywords.yake(text, longest, most, similar=similar) == slow_yake(text, longest, most, similar=similar)


def test_few_phrases_are_matched_letter_by_letter(monkeypatch):
    taken = []
    ratio = SequenceMatcher.ratio
    monkeypatch.setattr(SequenceMatcher, "ratio", lambda self: taken.append(1) or ratio(self))
    rng = random.Random(2)
    text = " ".join("".join(rng.choices("abcdefghijklmnop", k=7)) for _ in range(300))
    found = keywords.yake(text)
    quick = len(taken)
    assert found == slow_yake(text)
    assert quick * 3 < len(taken) - quick
