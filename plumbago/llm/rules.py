"""Quality rules as a short-circuit cascade.

Base counts are taken for every text. The rules after them are ordered by a
sample: each rule's cost (seconds per text) and selectivity (share rejected)
are measured, and rules run by descending rejection per cost. A text that one
rule rejects is not shown to the rules after it. The verdict doesn't depend on
the order, only the work does.
"""

from __future__ import annotations

import time
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_text, tune

SYMBOLS = b"#*$%&|<>"
_NOT_SYMBOL = bytes(c for c in range(256) if c not in SYMBOLS)
_CONTINUED = bytes(range(0x80, 0xC0))
_BLANK = b" \t\n\x0b\x0c\r"


class Doc:
    """A text with the base counts; rules read what they need."""

    def __init__(self, text: bytes):
        self.text, self.words = text, text.split()
        self.n_words = len(self.words)
        self.n_symbols = len(text.translate(None, _NOT_SYMBOL))
        self.word_chars = len(text.translate(None, _CONTINUED + _BLANK))
        lines = [x for x in text.split(b"\n") if x.strip(_BLANK)]
        self.n_lines, self.n_dup_lines = len(lines), len(lines) - len(set(lines))
        self.n_repeat_words = repeat_words(self.words)


def repeat_words(words: list[bytes], width: int = 5) -> int:
    """Words in windows of `width` words found twice or more in the text; exact (no hashes)."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    names: dict[bytes, int] = {}
    ids = np.fromiter((names.setdefault(w, len(names)) for w in words), np.int64, len(words))
    key, size = ids[:n], len(names)
    for j in range(1, width):
        joined = key * size + ids[j : j + n]
        _, key = np.unique(joined, return_inverse=True)
    again = np.bincount(key)[key] > 1
    if not again.any():
        return 0
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(again)
    edge[:n][at] += 1
    edge[width : n + width][at] -= 1
    return int((np.cumsum(edge)[:-1] > 0).sum())


def base_failed(d: Doc) -> bool:
    return d.n_words < 10 or 100 * d.n_repeat_words > 20 * d.n_words


# Each rule is true for a text that it rejects.


def too_many_symbols(d: Doc) -> bool:
    return 10 * d.n_symbols > d.n_words


def odd_word_length(d: Doc) -> bool:
    return not 2 * d.n_words <= d.word_chars <= 20 * d.n_words


def repeated_lines(d: Doc) -> bool:
    return 10 * d.n_dup_lines > 3 * d.n_lines


_NOT_UPPER = bytes(c for c in range(256) if not 65 <= c <= 90)
_NOT_LOWER = bytes(c for c in range(256) if not 97 <= c <= 122)


def shouting(d: Doc) -> bool:
    return len(d.text.translate(None, _NOT_UPPER)) > len(d.text.translate(None, _NOT_LOWER))


def trailing_dots(d: Doc) -> bool:
    lines = [x for x in d.text.split(b"\n") if x.strip(_BLANK)]
    return 10 * sum(x.endswith(b"...") for x in lines) > 3 * len(lines)


RULES: list[Callable[[Doc], bool]] = [too_many_symbols, odd_word_length, repeated_lines, shouting, trailing_dots]


def order_rules(sample: list[bytes], rules: list[Callable[[Doc], bool]] = RULES) -> list[Callable[[Doc], bool]]:
    """Rules by share rejected per second of cost on the sample, best first (ties: as given)."""
    docs = [d for d in map(Doc, sample) if not base_failed(d)]
    score = []
    for k, rule in enumerate(rules):
        began = time.perf_counter()
        rejected = sum(map(rule, docs))
        cost = max(time.perf_counter() - began, 1e-9) / max(1, len(docs))
        score.append((-(rejected / max(1, len(docs))) / cost, k))
    return [rules[k] for _, k in sorted(score)]


def cascade(
    df: DataFrame, rules: list[Callable[[Doc], bool]] = RULES, *, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 500
) -> DataFrame:
    """One row per document: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    Words are `[^\\x20\\x09-\\x0D]+`; a null text has none and fails the base rule,
    as an empty one does. Repeated rows and null ids are answered each on their
    own. Whole texts are read, however long. Empty table: empty result. Other
    columns are ignored. `sample_rows` bounds the sample that orders the rules
    (rows of the first partitions; it decides no verdict).
    """
    tune(df.sparkSession)
    sample = [(r[0] or "").encode() for r in df.select(F.col(text_col).cast("string")).limit(sample_rows).collect()]
    ordered = order_rules(sample, rules)

    def run(texts):
        docs = [Doc(t) for t in texts]
        failed = [base_failed(d) for d in docs]
        out = {n: [getattr(d, n) for d in docs] for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
        return out | {"base_failed": failed, "kept": [not (f or any(rule(d) for rule in ordered)) for d, f in zip(docs, failed)]}

    made = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"
    return per_text(df, run, made, text=text_col, keep=[id_col])
