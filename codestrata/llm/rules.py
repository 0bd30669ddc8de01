"""Quality rules as a short-circuit cascade.

Method: on a bounded sample, spread by a hash, the cost of every rule and the documents it rejects are measured; the cascade asks first the rule that rejects most for its cost, then the one
that does among the documents still left, and so on, and stops at the first that rejects. The order changes the time, never the verdict: a document is kept only if no
rule rejects it. A rule computes what it needs when it is asked, so a rejected document costs none of the later rules' measures.

Rules: too few words or too many in repeated windows (base); symbols, repeated lines, length of words; lines that begin with a bullet or end in an ellipsis; words without a
letter; too few common words of the languages at hand; one pair of neighbouring words too frequent.

Texts are read as Arrow batches in Python, one document at a time, because the rules need sliding windows over words. Memory: one batch.

Edge cases: a null text is an empty one (no words, base_failed); ids may be null; repeated rows are judged one by one; very long texts
are read whole; an empty table gives no rows; other columns pass through, but one with the name of an output column (in any case of letters) is replaced.
"""

from __future__ import annotations

import time
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, as_text, quoted

WINDOW = 8
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\r\x0b\x0c"
BULLETS = ("-", "*", "\u2022")
ELLIPSES = ("...", "\u2026")
#: Common words of English, French, German and Spanish, as they stand in a text and at its beginnings.
STOP_WORDS = "the of and to in is that it for was on with as le la de et les des un une du en que qui dans der die das und ist von mit den zu ein eine nicht el los las y del se por con para una".split()
_STOP = frozenset(w.encode() for x in STOP_WORDS for w in (x, x.capitalize()))
#: Bytes that are no part of a letter; all beyond ASCII count as letters.
_OTHER = bytes(b for b in range(128) if not chr(b).isalpha())
#: Documents on which cost and selectivity of the rules are estimated, and how long they may be; the order changes the time alone.
SAMPLE_ROWS, SAMPLE_CHARS = 200, 20_000
OUTPUT = T.StructType([T.StructField(c, T.LongType()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] + [T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType()), T.StructField("failed_rule", T.StringType())])


class Document:
    """A text with its measures, each computed when first asked for."""

    def __init__(self, text: str):
        self.text, self._seen = text, {}

    def __getattr__(self, name):
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._seen:
            self._seen[name] = getattr(self, f"_{name}")()
        return self._seen[name]

    def _words(self) -> list[bytes]:
        return self.text.encode("utf-8", "surrogatepass").split()

    def _n_words(self) -> int:
        return len(self.words)

    def _word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, SPACES))

    def _n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    def _lines(self) -> list[str]:
        return [x for x in self.text.split("\n") if x.strip(SPACES)]

    def _n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    def _n_repeat_words(self) -> int:
        return repeat_words(self.words)

    def _n_bullets(self) -> int:
        return sum(x.lstrip(SPACES).startswith(BULLETS) for x in self.lines)

    def _n_ellipses(self) -> int:
        return sum(x.rstrip(SPACES).endswith(ELLIPSES) for x in self.lines)

    def _n_no_letter(self) -> int:
        return sum([not w.strip(_OTHER) for w in self.words])

    def _n_stop_words(self) -> int:
        return sum([w in _STOP for w in self.words])

    def _top_pair(self) -> int:
        """Occurrences of the most frequent pair of neighbouring words."""
        return max(Counter(zip(self.words, self.words[1:], strict=False)).values(), default=0)


def repeat_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in windows found twice or more, the first occurrence included. Exact: windows are compared by identity of words."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    if len(number) == len(words):
        return 0
    # Windows of 8 are pairs of windows of 4, which are pairs of pairs: each level renumbers the distinct pairs, so that no hash can collide.
    width = 1
    while width < window:
        step = min(width, window - width)
        pairs = ids[: len(ids) - step] * (int(ids.max()) + 1) + ids[step:]
        width += step
        if width == window:
            break
        ids = np.unique(pairs, return_inverse=True)[1]
    values, where, counts = np.unique(pairs, return_inverse=True, return_counts=True)
    if len(values) == len(pairs):
        return 0
    repeated = (counts > 1)[where]
    edge = np.zeros(len(words) + 1, np.int64)
    edge[:n] += repeated
    edge[window:] -= repeated
    return int((np.cumsum(edge[:-1]) > 0).sum())


def base_failed(d: Document) -> bool:
    return d.n_words < 20 or 100 * d.n_repeat_words > 30 * d.n_words


#: Rule -> does it reject? Integers only, so that SQL states the same.
RULES = {
    "base": base_failed,
    "symbols": lambda d: 100 * d.n_symbols > 10 * d.n_words,
    "dup_lines": lambda d: 100 * d.n_dup_lines > 30 * max(1, len(d.lines)),
    "word_length": lambda d: d.word_chars < 2 * d.n_words or d.word_chars > 20 * d.n_words,
    "bullets": lambda d: 100 * d.n_bullets > 90 * max(1, len(d.lines)),
    "ellipses": lambda d: 100 * d.n_ellipses > 30 * max(1, len(d.lines)),
    "letters": lambda d: 100 * d.n_no_letter > 20 * d.n_words,
    "stop_words": lambda d: d.n_stop_words < 2,
    "top_pair": lambda d: 100 * 2 * d.top_pair > 20 * d.n_words and d.top_pair > 2,
}


def cascade_order(texts: list[str], rules=RULES, clock=time.perf_counter) -> tuple[list[str], dict[str, tuple[float, float]]]:
    """Rules in the order of rejection per cost, each counted over what the rules before it leave; and (seconds a document, rejected share of all) of each.

    Ties keep the order of ``rules``.
    """
    cost, rejected = {}, {}
    for name, rejects in rules.items():
        began = clock()
        rejected[name] = {i for i, t in enumerate(texts) if rejects(Document(t))}
        cost[name] = (clock() - began) / max(1, len(texts))
    left, order = set(range(len(texts))), []
    while len(order) < len(rules):
        best = max((r for r in rules if r not in order), key=lambda r: len(rejected[r] & left) / max(cost[r], 1e-9))
        order.append(best)
        left -= rejected[best]
    return order, {r: (cost[r], len(rejected[r]) / max(1, len(texts))) for r in rules}


def apply_rules(docs: DataFrame, text_col: str = "text", order: list[str] | None = None, measures: bool = True) -> DataFrame:
    """``docs`` with the measures, base_failed, kept and failed_rule (the first that rejected, in the cascade's order).

    ``measures=False`` leaves out all but kept and failed_rule; then the cascade spares the costly rules.
    """
    if order is None:
        # Texts whose hash is below a share of the hashes, in which SAMPLE_ROWS are expected: at most twice as many rows come to the driver.
        share = min(1.0, SAMPLE_ROWS / max(1, docs.count()))
        texts = docs.select(F.col(quoted(text_col)).alias("t"))
        some = texts.where((F.length("t") <= SAMPLE_CHARS) & (F.xxhash64("t") <= min(2**63 - 1, int(share * 2**64) - 2**63)))
        sample = some.limit(2 * SAMPLE_ROWS).toPandas()["t"]
        order = cascade_order(as_text(sample))[0]
    fields = OUTPUT.fields if measures else [f for f in OUTPUT.fields if f.name in ("kept", "failed_rule")]

    def judge(text: str) -> list:
        d = Document(text)
        failed = next((r for r in order if RULES[r](d)), None)
        made = {"kept": failed is None, "failed_rule": failed}
        return [made[f.name] if f.name in made else base_failed(d) if f.name == "base_failed" else getattr(d, f.name) for f in fields]

    return append_columns(docs, text_col, fields, lambda texts: [list(x) for x in zip(*map(judge, texts))] if texts else [[] for _ in fields])
