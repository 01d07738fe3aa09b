"""Quality rules by repetition coverage: rolling hashes of several n-gram lengths, in numpy.

Words are runs of other than ASCII white space. For each n in `ngrams`, a window of n words that
occurs twice or more in its text marks its words; the share of the words' characters that are
marked is the coverage for n. Duplicated lines are measured likewise.
A null text has no words: it fails. An empty text fails. Very long texts are read whole. A share equal
to its limit passes. Repeated rows and rows with the same id are judged one by one. Empty table: no
rows. Extra columns stay; the filter's own column has a name that does not clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import WordHash, claim, free_name, raw, ship

#: n-gram length and the largest share of characters in repeated n-grams that is kept.
LIMITS = ((2, 0.95), (3, 0.85), (5, 0.20), (7, 0.20), (10, 0.20))
#: The largest share of characters in duplicated lines that is kept, and of symbols among characters: tables with bars have a ninth, symbol junk over a third.
LINE_LIMIT, SYMBOL_LIMIT = 0.30, 0.25
MIN_WORDS, BASE_N, BASE_PERCENT = 10, 5, 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
_SYMBOLS = bytes(b"#*$%&|<>")
_NOT_SYMBOLS = bytes(x for x in range(256) if x not in _SYMBOLS)
_SPACE = b" \t\n\v\f\r"
FIELDS = "struct<n_words:bigint,word_chars:bigint,n_symbols:bigint,n_dup_lines:bigint,n_repeat_words:bigint,covered:array<double>,dup_line_share:double>"
_hashes = WordHash()


def repeated(words: np.ndarray, n: int, rolled: np.ndarray) -> np.ndarray:
    """Marks the words in windows of n words that occur twice or more. rolled: the windows' rolling hashes."""
    marks = np.zeros(len(words), dtype=bool)
    if len(rolled) < 2:
        return marks
    order = np.argsort(rolled, kind="stable")
    s = rolled[order]
    same = s[1:] == s[:-1]
    if same.any():
        hit = np.zeros(len(s), dtype=bool)
        hit[1:] |= same
        hit[:-1] |= same
        edge = np.zeros(len(words) + 1, dtype=np.int64)
        at = order[hit]
        np.add.at(edge, at, 1)
        np.add.at(edge, at + n, -1)
        marks = np.cumsum(edge[:-1]) > 0
    return marks


def rolling(h: np.ndarray, lengths: tuple[int, ...]) -> dict[int, np.ndarray]:
    """Polynomial hashes modulo 2^64 of all windows of each length, each length built on the last."""
    out, now, n = {}, None, 0
    with np.errstate(over="ignore"):
        for want in sorted(lengths):
            if len(h) < want:
                out[want] = np.empty(0, dtype=np.uint64)
                continue
            while n < want:
                now = h.copy() if now is None else now[:-1] * _ODD + h[n:]
                n += 1
            out[want] = now ^ (now >> np.uint64(31))
    return out


def measure(text: bytes | None, lengths: tuple[int, ...]) -> tuple:
    if text is None:
        text = b""
    words = text.split()
    n = len(words)
    symbols = len(text.translate(None, _NOT_SYMBOLS))
    if not n:
        return 0, 0, symbols, 0, 0, [0.0] * len(lengths), 0.0
    if text.isascii():
        chars = np.fromiter(map(len, words), dtype=np.int64, count=n)
    else:
        chars = np.fromiter((len(w.decode()) for w in words), dtype=np.int64, count=n)
    total = int(chars.sum())
    claim("quality", _hashes)
    h = np.fromiter(map(_hashes.__getitem__, words), dtype=np.uint64, count=n)
    windows = rolling(h, (*lengths, BASE_N))
    covered, base = [], 0
    for k in lengths:
        marks = repeated(h, k, windows[k])
        covered.append(float(chars[marks].sum()) / total)
        if k == BASE_N:
            base = int(marks.sum())
    if BASE_N not in lengths:
        base = int(repeated(h, BASE_N, windows[BASE_N]).sum())
    lines, dup_chars = 0, 0
    if b"\n" in text:
        seen: set[bytes] = set()
        for line in text.split(b"\n"):
            if line in seen:
                lines += 1
                dup_chars += sum(len(w.decode()) for w in line.split())
            elif line.strip(_SPACE):
                seen.add(line)
    return n, total, symbols, lines, base, covered, dup_chars / total


def _measured(lengths: tuple[int, ...]):
    @F.arrow_udf(FIELDS)
    def repetition(texts: pa.Array) -> pa.Array:
        rows = [measure(x, lengths) for x in raw(texts)]
        cols = list(zip(*rows, strict=True)) if rows else [[] for _ in range(7)]
        kinds = [pa.int64()] * 5 + [pa.list_(pa.float64()), pa.float64()]
        names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered", "dup_line_share"]
        return pa.StructArray.from_arrays([pa.array(c, type=k) for c, k in zip(cols, kinds, strict=True)], names=names)

    return repetition


def quality_signals(docs: DataFrame, text: str = "text", out: str = "quality", limits=LIMITS, line_limit: float = LINE_LIMIT, symbol_limit: float = SYMBOL_LIMIT) -> DataFrame:
    """docs with one more column `out`: a struct of the counts, the coverage of each n, base_failed and kept."""
    ship(docs.sparkSession)
    lengths = tuple(n for n, _ in limits)
    m, q = free_name(docs, "_measured"), F.col(free_name(docs, "_measured"))
    over = F.lit(False)
    for i, (_, most) in enumerate(limits):
        over = over | (q["covered"][i] > most)
    over = over | (q["dup_line_share"] > line_limit) | (q["n_symbols"] > symbol_limit * q["word_chars"])
    failed = (q["n_words"] < MIN_WORDS) | (100 * q["n_repeat_words"] > BASE_PERCENT * q["n_words"])
    verdict = F.struct(*(q[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered", "dup_line_share")), failed.alias("base_failed"), (~failed & ~over).alias("kept"))
    return docs.withColumn(m, _measured(lengths)(F.col(text))).withColumn(out, verdict).drop(m)


def quality_filter(docs: DataFrame, text: str = "text", **limits) -> DataFrame:
    """The documents that the rules keep, with their own columns."""
    out = free_name(docs, "quality")
    return quality_signals(docs, text, out, **limits).filter(F.col(out)["kept"]).drop(out)
