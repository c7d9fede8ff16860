"""Quality rules: repetition coverage. Rolling hashes of several n-gram lengths, and the characters inside n-grams and lines that a text repeats."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_slices, thrifty, without
from .shingles import mix, powers

#: Lengths of n-grams, and the percentage of a text's word characters that n-grams of the length found before may cover.
LIMITS = {5: 15, 6: 14, 7: 13, 8: 12, 9: 11, 10: 10}
#: The percentage of word characters in lines found before.
LINE_LIMIT = 20
#: The base rules: least number of words, and percentage of words in repeated windows of BASE words.
LEAST_WORDS, BASE, BASE_LIMIT = 10, 5, 20
#: Bytes of a text that are hashed at a time.
PIECE = 2 << 20
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"

_random = np.random.default_rng(120_024)
_BYTES = _random.integers(0, 1 << 63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
#: Bases of the hash of a word's bytes (with its inverse modulo 2 ** 64) and of the rolling hash of words.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_ROLL = np.uint64(0xD6E8FEB86659FD93)
_SPACE = np.isin(np.arange(256), np.frombuffer(SPACES, np.uint8))
_SYMBOL = np.isin(np.arange(256), np.frombuffer(SYMBOLS, np.uint8))


def pieces(raw: np.ndarray, piece: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of raw of about so many bytes that end at white space, so that no word is cut; a longer word makes its range longer."""
    lo = 0
    while lo < len(raw):
        hi = lo + piece
        while hi < len(raw):
            space = np.flatnonzero(_SPACE[raw[hi : hi + 65536]])
            if len(space):
                hi += int(space[0])
                break
            hi += 65536
        hi = min(hi, len(raw))
        yield lo, hi
        lo = hi


def word_table(raw: np.ndarray, off: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, code points, hash) of each word of the texts raw[off[i]:off[i + 1]], a text of many pieces at a time."""
    edges, found = off[:-1], []
    for lo, hi in pieces(raw, piece):
        part = raw[lo:hi]
        word = ~_SPACE[part]
        edge = np.zeros(hi - lo + 1, bool)
        edge[0] = edge[-1] = True
        edge[edges[np.searchsorted(edges, lo) : np.searchsorted(edges, hi)] - lo] = True
        starts = np.flatnonzero(word & (edge[:-1] | ~np.append(False, word[:-1])))
        ends = np.flatnonzero(word & (edge[1:] | ~np.append(word[1:], False))) + 1
        total = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(_BYTES[part] * powers(_BASE, hi - lo), out=total[1:])
        points = np.append(0, np.cumsum((part & 0xC0) != 0x80))
        hashes = mix((total[ends] - total[starts]) * powers(_INVERSE, hi - lo)[starts] + (ends - starts).astype(np.uint64))
        found.append((starts + lo, points[ends] - points[starts], hashes))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def repeated(grams: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(in a group of equal grams of one text, not the first of its group) of each gram; grams come text by text."""
    order = np.argsort(grams, kind="stable")
    g, d = grams[order], doc[order]
    same = (g[1:] == g[:-1]) & (d[1:] == d[:-1])
    later, any_ = np.zeros(len(g), bool), np.zeros(len(g), bool)
    later[order[1:]] = same
    any_[order[1:]] = same
    any_[order[:-1]] |= same
    return any_, later


def covered(starts: np.ndarray, n: int, words: int) -> np.ndarray:
    """Which of so many words lie in windows of n words that begin at starts."""
    change = np.zeros(words + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + n, -1)
    return np.cumsum(change[:-1]) > 0


def ngram_coverage(hashes: np.ndarray, chars: np.ndarray, at: np.ndarray, lengths: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(words in repeated windows of BASE words, first ones included; row i: code points of words in n-grams of lengths[i] that were there before) of each text at[i]:at[i + 1].

    The hash of n + 1 words rolls on from that of n. From the second length on only windows are looked
    at whose shorter beginning is repeated, as a window of n + 1 words can't be without.
    """
    words, texts = len(hashes), len(at) - 1
    doc = np.repeat(np.arange(texts), np.diff(at))
    end = np.repeat(at[1:], np.diff(at))
    by_text = lambda x: np.diff(np.append(0, np.cumsum(x))[at])
    begin, rolling = np.arange(words), np.zeros(words, np.uint64)
    base, out, n = np.zeros(texts, np.int64), np.zeros((len(lengths), texts), np.int64), 0
    for want in sorted({BASE, *lengths}):
        while n < want:
            fits = begin + n < end[begin]
            begin, rolling = begin[fits], rolling[fits]
            rolling = rolling * _ROLL + hashes[begin + n]
            n += 1
        any_, later = repeated(mix(rolling), doc[begin])
        if n == BASE:
            base = by_text(covered(begin[any_], n, words))
        if n in lengths:
            out[lengths.index(n)] = by_text(np.where(covered(begin[later], n, words), chars, 0))
        begin, rolling = begin[any_], rolling[any_]
    return base, out


def line_repeats(text: bytes) -> tuple[int, int]:
    """(lines with a word that are equal to an earlier line, code points of their words)."""
    seen, n, chars = set(), 0, 0
    for line in text.split(b"\n"):
        if line in seen:
            n += 1
            chars += len(line.translate(None, SPACES).decode(errors="replace"))
        elif line.strip(SPACES):
            seen.add(line)
    return n, chars


def measure(docs: DataFrame, limits: dict[int, int] | None = None, line_limit: int = LINE_LIMIT) -> DataFrame:
    """docs less text with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, dup_line_chars (long), dup_chars (array, one entry a length of limits), base_failed and kept (boolean).

    word_chars: code points in words; n_repeat_words: words in windows of five that the text has twice or
    more; dup_line_chars and dup_chars: code points of words in lines, and in n-grams of each length,
    that the text had before (so not of first ones). A text fails the base with under LEAST_WORDS words or
    more than BASE_LIMIT % of words in repeated windows, and isn't kept then, nor where lines cover more
    than line_limit, or n-grams of a length more than its limit, in % of word_chars. Null and empty texts
    have no words and fail. Each row is measured alone, so ties, repeated rows and null ids change
    nothing; an empty table gives none. Windows are compared by 64-bit hashes of words. Columns of the
    names above are replaced.
    """
    limits = LIMITS if limits is None else limits
    lengths = tuple(sorted(limits))
    new = [("n_words", "long"), ("word_chars", "long"), ("n_symbols", "long"), ("n_dup_lines", "long"), ("n_repeat_words", "long"), ("dup_line_chars", "long"), ("dup_chars", "array<long>"), ("base_failed", "boolean"), ("kept", "boolean")]
    docs = without(docs, *[n for n, _ in new])
    at_text = docs.columns.index("text")
    names = [c for c in docs.columns if c != "text"] + [n for n, _ in new]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text"] + [f"{n} {t}" for n, t in new])
    most = np.array([limits[n] for n in lengths])[:, None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, raw, off in text_slices(b, at_text):
                starts, chars, hashes = word_table(raw, off)
                at = np.searchsorted(starts, off)
                words = np.diff(at)
                word_chars = np.diff(np.append(0, np.cumsum(chars))[at])
                symbols = np.diff(np.append(0, np.cumsum(_SYMBOL[raw]))[off])
                base, dup = ngram_coverage(hashes, chars, at, lengths)
                data = raw.tobytes()
                lines = np.array([line_repeats(data[off[i] : off[i + 1]]) for i in range(hi - lo)], np.int64).reshape(-1, 2)
                failed = (words < LEAST_WORDS) | (100 * base > BASE_LIMIT * words)
                kept = ~failed & (100 * lines[:, 1] <= line_limit * word_chars) & (100 * dup <= most * word_chars).all(axis=0)
                longs = [pa.array(x, pa.int64()) for x in (words, word_chars, symbols, lines[:, 0], base, lines[:, 1])]
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for i, c in enumerate(b.columns) if i != at_text), *longs, pa.array(list(dup.T), pa.list_(pa.int64())), pa.array(failed), pa.array(kept)], names=names)

    return docs.mapInArrow(thrifty(run), schema)


def op12_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, dup_line_chars and dup_chars_5 to dup_chars_10 of every document."""
    out = measure(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "dup_line_chars", *[F.col("dup_chars")[i].alias(f"dup_chars_{n}") for i, n in enumerate(sorted(LIMITS))])


def _window_sql(n: int) -> str:
    """Of each text the words in repeated windows of n words (first ones included), and the code points of words in windows that were there before."""
    return f"""g{n} AS (SELECT r, p, count(*) OVER (PARTITION BY r, g) AS times, row_number() OVER (PARTITION BY r, g ORDER BY p) AS nth
  FROM (SELECT r, p, array_to_string(ws[p:p + {n - 1}], ' ') AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - {n - 2})) AS p FROM docs))),
c{n} AS (SELECT r, sum(CASE WHEN any_ THEN 1 ELSE 0 END)::BIGINT AS words, sum(CASE WHEN later THEN chars ELSE 0 END)::BIGINT AS chars
  FROM (SELECT w.r, w.chars, bool_or(g.times > 1) OVER x AS any_, bool_or(g.nth > 1) OVER x AS later
        FROM words w LEFT JOIN g{n} g ON w.r = g.r AND w.p = g.p WINDOW x AS (PARTITION BY w.r ORDER BY w.p ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)) GROUP BY r)"""


#: Windows are compared by their words, lines by their text.
SQL = (
    r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
words AS (SELECT r, p, length(w) AS chars FROM (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS p FROM docs)),
sizes AS (SELECT r, sum(chars)::BIGINT AS word_chars FROM words GROUP BY r),
lines AS (SELECT r, length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g')) AS chars, row_number() OVER (PARTITION BY r, line ORDER BY p) AS nth
  FROM (SELECT r, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS p FROM docs)),
repeats AS (SELECT r, count(*) AS n, sum(chars)::BIGINT AS chars FROM lines WHERE chars > 0 AND nth > 1 GROUP BY r),
"""
    + ",\n".join(_window_sql(n) for n in sorted(LIMITS))
    + r""",
flat AS (SELECT d.r, d.doc_id, len(d.ws) AS n_words, coalesce(s.word_chars, 0) AS word_chars, length(regexp_replace(d.t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  coalesce(l.n, 0) AS n_dup_lines, coalesce(c5.words, 0) AS n_repeat_words, coalesce(l.chars, 0) AS dup_line_chars, """
    + ", ".join(f"coalesce(c{n}.chars, 0) AS dup_chars_{n}" for n in sorted(LIMITS))
    + "\n  FROM docs d LEFT JOIN sizes s ON d.r = s.r LEFT JOIN repeats l ON d.r = l.r "
    + " ".join(f"LEFT JOIN c{n} ON d.r = c{n}.r" for n in sorted(LIMITS))
    + f""")
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND 100 * dup_line_chars <= {LINE_LIMIT} * word_chars AND """
    + " AND ".join(f"100 * dup_chars_{n} <= {p} * word_chars" for n, p in sorted(LIMITS.items()))
    + " AS kept, dup_line_chars, "
    + ", ".join(f"dup_chars_{n}" for n in sorted(LIMITS))
    + f"""
FROM (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {BASE_LIMIT} * n_words AS base_failed FROM flat)
"""
)
