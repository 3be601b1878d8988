"""Counts behind text scores, for one hypothesis and its references: n-grams for BLEU, overlaps for ROUGE."""

from __future__ import annotations

import re
import string
from collections import Counter
from collections.abc import Sequence

ORDER = 4
#: Punctuation that stands alone, and a full stop, comma or dash beside a digit, in the standard tokenisation.
SYMBOLS = re.compile(r"([\{-\~\[-\` -\&\(-\+\:-\@\/])")
NEAR_DIGITS = ((re.compile(r"([^0-9])([\.,])"), r"\1 \2 "), (re.compile(r"([\.,])([^0-9])"), r" \1 \2"), (re.compile(r"([0-9])(-)"), r"\1 \2 "))


def tokens(text: str, how: str = "13a", lowercase: bool = False) -> list[str]:
    """Words and punctuation: ``13a`` (Western), ``intl`` (by Unicode class), ``zh`` (each Han character), ``none``."""
    if lowercase:
        text = text.lower()
    if how == "13a":
        text = text.replace("<skipped>", "").replace("-\n", "").replace("\n", " ")
        for a, b in (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
            text = text.replace(a, b)
        text = SYMBOLS.sub(r" \1 ", f" {text} ")
        for pattern, to in NEAR_DIGITS:
            text = pattern.sub(to, text)
    elif how == "intl":
        import regex

        text = regex.sub(r"(\P{N})(\p{P})", r"\1 \2 ", text)
        text = regex.sub(r"(\p{P})(\P{N})", r" \1 \2", text)
        text = regex.sub(r"(\p{S})", r" \1 ", text)
    elif how == "zh":
        text = re.sub(r"([⺀-鿿豈-﫿＀-￯])", r" \1 ", text)
        return tokens(text, "13a")
    elif how != "none":
        raise ValueError(f"unknown tokenisation {how}")
    return text.split()


def ngrams(words: Sequence[str], n: int) -> Counter:
    return Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def bleu_counts(hypothesis: str, references: Sequence[str], how: str = "13a", lowercase: bool = False) -> tuple[list[int], list[int], int, int]:
    """Clipped matches and totals by order, the hypothesis' length and the closest reference's (the shorter of two)."""
    own, others = tokens(hypothesis, how, lowercase), [tokens(r, how, lowercase) for r in references]
    matches, totals = [], []
    for n in range(1, ORDER + 1):
        mine, most = ngrams(own, n), Counter()
        for o in others:
            most |= ngrams(o, n)
        matches.append((mine & most).total())
        totals.append(max(0, len(own) - n + 1))
    closest = min((len(o) for o in others), key=lambda size: (abs(size - len(own)), size), default=0)
    return matches, totals, len(own), closest


def words_of(text: str) -> list[str]:
    """Lower-case runs of ASCII letters and digits."""
    return re.findall(r"[a-z0-9]+", text.lower())


def _score(match: float, own: float, other: float) -> tuple[float, float, float]:
    p, r = (match / own if own else 0.0), (match / other if other else 0.0)
    return p, r, 2 * p * r / (p + r) if p + r else 0.0


def longest_common(a: Sequence[str], b: Sequence[str]) -> list[list[int]]:
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        row, last = table[i + 1], table[i]
        for j, y in enumerate(b):
            row[j + 1] = last[j] + 1 if x == y else max(last[j + 1], row[j])
    return table


def common_length(a: Sequence[str], b: Sequence[str]) -> int:
    """Length of a longest common subsequence, a row of the table in the bits of one number."""
    places: dict[str, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        hit = row & places.get(y, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def _common_places(a: Sequence[str], b: Sequence[str]) -> set[int]:
    """Places of ``a`` in a longest common subsequence."""
    table, i, j, out = longest_common(a, b), len(a), len(b), set()
    while i and j:
        if a[i - 1] == b[j - 1]:
            out.add(i - 1)
            i, j = i - 1, j - 1
        elif table[i][j - 1] > table[i - 1][j]:
            j -= 1
        else:
            i -= 1
    return out


def rouge(hypothesis: str, reference: str, kind: str) -> tuple[float, float, float]:
    """Precision, recall and F of ``rouge1`` to ``rouge9``, ``rougeL`` or ``rougeLsum`` (lines as sentences)."""
    if kind == "rougeL":
        a, b = words_of(reference), words_of(hypothesis)
        return _score(common_length(a, b), len(b), len(a))
    if kind == "rougeLsum":
        refs, hyps = ([w for s in t.split("\n") if (w := words_of(s))] for t in (reference, hypothesis))
        left, right, hits = Counter(x for s in refs for x in s), Counter(x for s in hyps for x in s), 0
        own, other = right.total(), left.total()
        for r in refs:
            union: set[int] = set()
            for h in hyps:
                union |= _common_places(r, h)
            for i in sorted(union):
                if left[r[i]] > 0 and right[r[i]] > 0:
                    left[r[i]] -= 1
                    right[r[i]] -= 1
                    hits += 1
        return _score(hits, own, other)
    n = re.fullmatch(r"rouge([1-9])", kind)
    if not n:
        raise ValueError(f"unknown kind {kind}")
    a, b = ngrams(words_of(reference), int(n[1])), ngrams(words_of(hypothesis), int(n[1]))
    return _score((a & b).total(), b.total(), a.total())


def best_rouge(hypothesis: str, references: Sequence[str], kind: str) -> tuple[float, float, float]:
    """That of the reference with the best F."""
    return max((rouge(hypothesis, r, kind) for r in references), key=lambda s: s[2], default=(0.0, 0.0, 0.0))


def plain_words(text: str) -> list[str]:
    """Distinct lower-case words without ASCII punctuation, in order."""
    return list(dict.fromkeys(text.lower().translate(str.maketrans("", "", string.punctuation)).split()))
