"""Numbers about the form of whole texts, one vectorised pass each."""

from __future__ import annotations

from collections import Counter
from operator import eq

import numpy as np

SHAPES = 16  # classes of bytes
_CLASS = np.full(256, 15, np.uint8)  # any other mark
for _lo, _hi, _c in ((97, 122, 0), (65, 90, 1), (48, 57, 2), (128, 255, 3)):
    _CLASS[_lo : _hi + 1] = _c
for _c, _marks in enumerate((b" ", b"\n\r", b"\t\x0b\x0c", b".", b",", b"!?", b"*#", b"$%&", b"|/\\", b"'\"-", b":;"), 4):
    _CLASS[list(_marks)] = _c

NAMES = [
    "bias", "log_bytes", "log_words", "empty", "lower", "upper", "digit", "other_bytes", "blank", "line", "stop", "comma", "shout", "star", "money", "bar",
    "quote", "colon", "mark", "word_length", "word_spread", "long_words", "short_words", "distinct", "top_word", "same_as_last", "alone", "capital_words",
    "shouted_words", "marked_words", "log_lines", "line_distinct", "words_a_line", "pair_distinct",
]


def text_features(text: str | None) -> np.ndarray:
    """NAMES, then shares of the pairs of byte classes; an empty text has zeros but for bias and empty."""
    out = np.zeros(len(NAMES) + SHAPES * SHAPES, np.float32)
    out[0] = 1
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        out[3] = 1
        return out
    c = _CLASS[np.frombuffer(raw, np.uint8)]
    n, share = len(words), np.bincount(c, minlength=SHAPES) / len(raw)
    sizes = np.fromiter(map(len, words), np.int64, n)
    counts, lower = Counter(words), raw.lower().split()
    distinct = len(set(lower))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    pairs = set(zip(lower, lower[1:]))
    capital = shouted = marked = alone = 0
    for w, k in counts.items():
        alone += k == 1
        if w[:1].isupper():
            capital += k
            shouted += k * (len(w) > 2 and w.isupper())
        if w[-1:] in b"*#$%&!|" or w[0] < 48:
            marked += k
    out[1], out[2] = np.log1p(len(raw)) / 10, np.log1p(n) / 10
    out[4:19] = [share[0], share[1], share[2], share[3], share[4], share[5], *(share[i] for i in range(7, SHAPES))]
    out[19:] = 0
    out[19:34] = [
        sizes.mean() / 10, min(sizes.std() / 10, 3), (sizes > 12).mean(), (sizes <= 3).mean(), distinct / n, max(counts.values()) / n,
        sum(map(eq, lower, lower[1:])) / n, alone / n, capital / n, shouted / n, marked / n, np.log1p(len(lines)) / 10, len(set(lines)) / max(1, len(lines)),
        np.log1p(n / max(1, len(lines))) / 10, len(pairs) / max(1, n - 1),
    ]
    if len(c) > 1:
        pair = np.bincount(c[:-1].astype(np.int64) * SHAPES + c[1:], minlength=SHAPES * SHAPES) / (len(c) - 1)
        out[len(NAMES) :] = np.sqrt(pair)
    return out
