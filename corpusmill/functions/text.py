"""Text normalisation, character grams and pattern scalars as column expressions.

All of them take null as the empty string.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters that Python's str.strip() and \s take for white space, as a Java class body.
WS = r"\s\p{Z}\x85\x1c-\x1f"
#: The same as code points.
WHITE = [*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Stands after a text that is too short for bigrams; no code point.
SHORT = 0x1FFFFF
#: Punctuation and particles that the question keys drop.  Fixed values.
SHORT_KEY = r"，。？！,.?!、的了吗呢吧啊"
LONG_KEY = r"，。？！,.?!、的了吗呢吧啊：:；;\-—_（）\(\)【】\[\]\"'“”‘’于在中为是有的"


def text(c: Column | str) -> Column:
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))


def strip(c: Column | str) -> Column:
    """X: str.strip() over all Unicode white space."""
    return F.regexp_replace(text(c), rf"^[{WS}]+|[{WS}]+$", "")


def norm_short(c: Column | str) -> Column:
    """Question key without white space, basic punctuation and particles."""
    return F.regexp_replace(text(c), f"[{WS}{SHORT_KEY}]", "")


def norm_long(c: Column | str) -> Column:
    """The stricter question key; it does not agree with norm_short on any text with the extra signs."""
    return F.regexp_replace(text(c), f"[{WS}{LONG_KEY}]", "")


def norm_space(c: Column | str) -> Column:
    """The text without any white space."""
    return F.regexp_replace(text(c), f"[{WS}]+", "")


@F.pandas_udf(T.StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFKC", x or ""))


def norm_word_key(c: Column | str) -> Column:
    """NFKC, only word characters, lower case.  Spark has no NFKC, so that step is an Arrow UDF."""
    return F.lower(F.regexp_replace(_nfkc(text(c)), r"(?U)\W+", ""))


def md5_key(c: Column | str) -> Column:
    """md5 of the stripped text."""
    return F.md5(strip(c).cast("binary"))


def digest(c: Column | str) -> Column:
    """64-bit digest; only equality matters."""
    return F.xxhash64(text(c))


def chars(c: Column | str) -> Column:
    return F.filter(F.split(text(c), ""), lambda x: x != "")


def _joined_runs(parts: Column, n: int, sep: str = "") -> Column:
    """Each n neighbours of an array joined, in order; none if there are fewer.

    Shifted slices are zipped pairwise.  Reading neighbours by index inside a lambda would
    evaluate the array once per element."""
    out, have, add = None, 0, lambda a, b: F.concat(a, F.lit(sep), b) if sep else F.concat(a, b)
    block, size = parts, 1
    while True:
        if n & size:
            if out is None:
                out, have = block, size
            else:
                m = F.greatest(F.size(out) - size, F.lit(0))
                out, have = F.zip_with(F.slice(out, F.lit(1), m), F.slice(block, F.lit(have + 1), m), add), have + size
        if have == n:
            return F.filter(out, lambda x: x.isNotNull())
        m = F.greatest(F.size(block) - size, F.lit(0))
        block, size = F.zip_with(F.slice(block, F.lit(1), m), F.slice(block, F.lit(size + 1), m), add), size * 2


def char_grams(c: Column | str, n: int) -> Column:
    """All runs of n characters in order."""
    return _joined_runs(chars(c), n)


def char_bigrams(c: Column | str) -> Column:
    """All character bigrams in order; none under two characters."""
    return char_grams(c, 2)


#: What texts under the gram size become, by the source of the texts.
GRAM_VARIANTS = {
    "space": (norm_space, 2, "singleton_or_empty"),
    "long": (norm_long, 3, "singleton"),
    "curated": (norm_long, 3, "singleton_or_empty"),
    "raw": (strip, 2, "sentinel"),
}


def bigram_set(c: Column | str, variant: str = "space") -> Column:
    """Distinct character bigrams after the variant's normalisation.

    space and curated give no grams for an empty text and the text itself for a short
    one; long gives the text itself, even the empty one; raw gives a sentinel."""
    norm, least, short = GRAM_VARIANTS[variant]
    t = norm(c)
    few = {"singleton": F.array(t), "singleton_or_empty": F.when(t == "", F.array().cast("array<string>")).otherwise(F.array(t)), "sentinel": F.array(F.lit("<s>"))}[short]
    return F.when(F.length(t) < least, few).otherwise(F.array_distinct(char_bigrams(t)))


def _class(signs: str) -> np.ndarray:
    """Which code points are neither white space nor signs of a Java class, as a table."""
    out = np.ones(0x110000, bool)
    out[WHITE] = False
    out[[ord(x) for x in re.sub(r"\\(.)", r"\1", signs)]] = False
    return out


def _pairs(t: np.ndarray) -> np.ndarray:
    """Distinct neighbours of two or more code points in order; 32 bits sort in half the time."""
    small = t.max() < 1 << 16
    x = np.sort(t[:-1] << np.uint32(16) | t[1:] if small else t[:-1].astype(np.int64) << 21 | t[1:])
    x = x[np.append(True, x[1:] != x[:-1])]
    return (x >> np.uint32(16)).astype(np.int64) << 21 | (x & np.uint32(0xFFFF)) if small else x


def _bigrams(points: np.ndarray, variants: tuple[str, ...], keep: dict[str, np.ndarray]) -> list[np.ndarray]:
    """bigram_set() of a text's code points by variant, as numbers in order: two code points, or SHORT where there are fewer."""
    out, done = [], {}
    for norm, least, short in (GRAM_VARIANTS[v] for v in variants):
        if norm not in done:
            if norm is strip:
                inner = np.flatnonzero(keep["space"][points])
                t = points[inner[0] : inner[-1] + 1] if len(inner) else points[:0]
            else:
                t = points[keep["space" if norm is norm_space else "long"][points]]
            done[norm] = t, _pairs(t) if len(t) > 1 else None
        t, pairs = done[norm]
        if len(t) >= least:
            out.append(pairs)
        elif short == "singleton_or_empty" and not len(t):
            out.append(np.zeros(0, np.int64))
        elif short == "sentinel":
            out.append(np.array([-1]))
        else:
            first, second = ([int(c) for c in t] + [SHORT, SHORT])[:2]
            out.append(np.array([first << 21 | second]))
    return out


def _by_bigrams(kind: str, of: Callable[[list[np.ndarray]], list], variants: tuple[str, ...], c: Column | str) -> Column:
    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        keep = {"space": _class(""), "long": _class(LONG_KEY)}
        for s in batches:
            for k in range(0, len(s), 500):
                rows = [of(_bigrams(np.frombuffer((x or "").encode("utf-32-le", "surrogatepass"), np.uint32), variants, keep)) for x in s.iloc[k : k + 500]]
                yield pd.DataFrame({v: pd.Series(y, dtype=object) for v, y in zip(variants, zip(*rows, strict=True), strict=True)})

    return run(text(c))


def bigram_codes(c: Column | str, variant: str = "space") -> Column:
    """bigram_set() as numbers, one for each different bigram; an array pass tells them in a tenth of the time."""
    return _by_bigrams(f"{variant} array<long>", lambda sets: sets, (variant,), c)[variant]


def bigram_sizes(c: Column | str) -> Column:
    """Struct of the sizes of bigram_set() by variant, from one pass."""
    return _by_bigrams(", ".join(f"{v} int" for v in GRAM_VARIANTS), lambda sets: [len(x) for x in sets], tuple(GRAM_VARIANTS), c)


def _minima(points: np.ndarray, n: int, window: int) -> np.ndarray:
    if len(points) < n + window - 1:
        return np.zeros(0, np.int64)
    h = np.zeros(len(points) - n + 1, np.uint64)
    for i in range(n):
        h = h * np.uint64(0x9E3779B97F4A7C15) + points[i : i + len(h)]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    step = 1
    while step < window:
        h, step = np.minimum(h[:-step], h[step:]), step * 2
    h = np.sort(h[np.append(True, h[1:] != h[:-1])])
    return h[np.append(True, h[1:] != h[:-1])].view(np.int64)


def gram_minima(c: Column | str, n: int, window: int) -> Column:
    """Distinct least hashes of n characters among each window (a power of two) of neighbours.

    A text that is contained in another has no least hash that the other lacks, if it is n + window - 1 long.  Some
    two of each window's hashes are kept."""

    @F.pandas_udf("array<bigint>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            for k in range(0, len(s), 500):
                yield pd.Series([_minima(np.frombuffer((x or "").encode("utf-32-le", "surrogatepass"), np.uint32), n, window) for x in s.iloc[k : k + 500]], dtype=object)

    return run(text(c))


def jaccard(a: Column, b: Column) -> Column:
    """Of two gram sets; 0 if either is empty."""
    common = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(common / (F.size(a) + F.size(b) - common))


def distinct2(c: Column | str) -> Column:
    """Distinct character bigrams over all of them; 0 under two characters."""
    t = text(c)
    return F.when(F.length(t) < 2, 0.0).otherwise(F.size(F.array_distinct(char_bigrams(t))) / (F.length(t) - 1))


def repetition_penalty(c: Column | str, n: int = 3, cap: float = 0.5) -> Column:
    """Twice the share of repeated n-grams of words and signs, times the cap, at most the cap."""
    tokens = F.regexp_extract_all(F.lower(text(c)), F.lit(r"(?U)(\w+|[^\w\s])"), F.lit(1))
    grams = _joined_runs(tokens, n, "\x01")
    count = F.size(grams)
    return F.when(count == 0, 0.0).otherwise(F.least(F.lit(cap), (count - F.size(F.array_distinct(grams))) * cap * 2 / count))


def form_score(question: Column | str, answer: Column | str, tokens: Column) -> Column:
    """0.4 information + 0.3 length + 0.2 completeness + 0.1 question length."""
    q, a = strip(question), strip(answer)
    info = F.least(F.greatest((distinct2(a) - 0.60) / 0.20, F.lit(0.0)), F.lit(1.0))
    length = F.when(tokens.between(150, 480), 1.0).when((tokens >= 80) & (tokens < 150), tokens / 150).when((tokens > 480) & (tokens <= 512), 1.0 - 0.4 * (tokens - 480) / 32).otherwise(0.4)
    ends = F.substr(a, F.length(a), F.lit(1)).isin(*"。！？…）]\"")
    paragraphs = F.size(F.filter(F.split(a, "\n"), lambda p: norm_space(p) != ""))
    complete = 0.6 * F.when(ends, 1.0).otherwise(0.0) + 0.4 * F.when(paragraphs >= 2, 1.0).otherwise(0.0)
    size = F.length(q)
    asked = F.when(size.between(8, 60), 1.0).when(size <= 100, 0.8).otherwise(0.5)
    return 0.4 * info + 0.3 * length + 0.2 * complete + 0.1 * asked


def split_sentences(c: Column | str) -> Column:
    """Stripped, non-empty sentences, each with its closing sign."""
    return F.filter(F.transform(F.split(text(c), "(?<=[。！？!?])"), strip), lambda s: s != "")


def split_clauses(c: Column | str) -> Column:
    return F.filter(F.transform(F.split(text(c), "(?<=[，、；;：:,])"), strip), lambda s: s != "")


def table_cell(c: Column | str) -> Column:
    """Text that stays within one cell of a Markdown table."""
    t = text(c)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\r\n", "\n"), ("\r", "\n")):
        t = F.replace(t, F.lit(a), F.lit(b))
    for sign in "\\|`*_[]":
        t = F.replace(t, F.lit(sign), F.lit(f"&#{ord(sign)};"))
    return F.replace(t, F.lit("\n"), F.lit("<br>"))
