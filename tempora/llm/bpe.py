"""BPE encoding and decoding: a segment tree over adjacent pair ranks, whose root yields the leftmost lowest-rank merge."""

from __future__ import annotations

import hashlib
import json
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import table, text_slices, thrifty, without

NONE = 1 << 60
#: Encoded chunks (and words) that a Python worker remembers before it starts anew, and the longest remembered.
CACHE, LONGEST = 250_000, 48
#: Words of up to so many bytes are merged side by side, one tree a row; longer ones one by one.
WIDEST = 64
OUTPUTS = {"n_tokens": ("long", pa.int64()), "ids": ("array<int>", pa.list_(pa.int32())), "ids_sha256": ("string", pa.string()), "decoded": ("string", pa.string()), "decoded_sha256": ("string", pa.string())}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where printable, else the next from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    more = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(more)) for b in range(256)]


def merge_all(symbols: list[int], ranks: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """Symbols after all merges, lowest rank first, leftmost first among equals.

    Leaf i of the tree holds the rank of (symbol i, its right neighbour). A merge writes its result to
    the left symbol, takes the right one out of the chain and updates three leaves, each in logarithmic
    time; the root names the next merge until no pair is left.
    """
    n = len(symbols)
    if n < 2:
        return symbols
    width = 1 << (n - 2).bit_length() if n > 2 else 1
    tree = [NONE] * (2 * width)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    get = ranks.get
    for i in range(n - 1):
        if (x := get((symbols[i], symbols[i + 1]))) is not None:
            tree[width + i] = x[0]
    for i in range(width - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a <= b else b

    def put(i: int, rank: int) -> None:
        i += width
        tree[i] = rank
        i >>= 1
        while i:
            a, b = tree[2 * i], tree[2 * i + 1]
            best = a if a <= b else b
            if tree[i] == best:
                return
            tree[i] = best
            i >>= 1

    while (low := tree[1]) < NONE:
        i = 1
        while i < width:
            i *= 2
            if tree[i] != low:  # the left child wins ties
                i += 1
        i -= width
        j = after[i]
        symbols[i] = ranks[symbols[i], symbols[j]][1]
        after[i] = k = after[j]
        if j < n - 1:
            put(j, NONE)
        symbols[j] = -1
        if k < n:
            before[k] = i
            x = get((symbols[i], symbols[k]))
            put(i, x[0] if x else NONE)
        else:
            put(i, NONE)
        if (h := before[i]) >= 0:
            x = get((symbols[h], symbols[i]))
            put(h, x[0] if x else NONE)
    return [s for s in symbols if s >= 0]


class Bpe:
    """Lower-casing word BPE with word ends, as its JSON file states it."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        model = data["model"]
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.tokens = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.end = model["end_of_word_suffix"]
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for r, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks.setdefault((vocab[a], vocab[b]), (r, vocab[a + b]))
        pairs = np.array([(a << 32 | b, r, new) for (a, b), (r, new) in self.ranks.items()], dtype=np.int64)
        pairs = pairs[np.argsort(pairs[:, 0])]
        self.pairs, self.rank_of = pairs[:, 0].copy(), pairs[:, 1].copy()
        self.made = np.zeros(len(model["merges"]), np.int64)
        self.made[pairs[:, 1]] = pairs[:, 2]
        letters = byte_letters()
        self.inner = [vocab[c] for c in letters]
        self.last = [vocab[c + self.end] for c in letters]
        self.inner_ids, self.last_ids = np.array(self.inner), np.array(self.last)
        words = next(p["pattern"]["Regex"] for p in data["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(words.replace(r"[^\s", r"[^\p{White_Space}"))
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.spaces = regex.compile(r"\p{White_Space}+")
        self.odd = regex.compile("[\x1c-\x1f]")  # str.split() takes these as white space, Unicode doesn't
        self.chunks: dict[str, bytes] = {}
        self.known: dict[str, bytes] = {}

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of the pairs (a, b); NONE where there is no such merge."""
        key = (a << 32) | b
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.rank_of[at], NONE)

    def merge_rows(self, words: list[bytes]) -> list[bytes]:
        """merge_all for many short words at once: row w of every array is the tree and the chain of word w."""
        size = np.array([len(w) for w in words])
        n, rows = int(size.max()), len(words)
        width = 1 << (n - 1).bit_length()
        every, col = np.arange(rows), np.arange(width)
        inside = col < size[:, None]
        raw = np.zeros((rows, width), np.uint8)
        raw[inside] = np.frombuffer(b"".join(words), np.uint8)
        sym = self.inner_ids[raw]
        sym[every, size - 1] = self.last_ids[raw[every, size - 1]]
        sym[~inside] = -1
        tree = np.full((rows, 2 * width), NONE)
        pair = col[:-1] + 1 < size[:, None]
        leaf = np.full((rows, width - 1), NONE)
        leaf[pair] = self.pair_ranks(sym[:, :-1][pair], sym[:, 1:][pair])
        tree[:, width : 2 * width - 1] = leaf
        level = width >> 1
        while level:
            tree[:, level : 2 * level] = tree[:, 2 * level : 4 * level].reshape(rows, level, 2).min(axis=2)
            level >>= 1
        after, before = np.tile(col + 1, (rows, 1)), np.tile(col - 1, (rows, 1))
        depth = width.bit_length() - 1

        def put(r: np.ndarray, at: np.ndarray, rank: np.ndarray | int) -> None:
            at = at + width
            tree[r, at] = rank
            for _ in range(depth):
                at >>= 1
                tree[r, at] = np.minimum(tree[r, 2 * at], tree[r, 2 * at + 1])

        r = np.flatnonzero(tree[:, 1] < NONE)
        while len(r):
            low = tree[r, 1]
            i = np.ones(len(r), np.int64)
            for _ in range(depth):
                i *= 2
                i += tree[r, i] != low  # the left child wins ties
            i -= width
            j = after[r, i]
            k = after[r, j]
            new = self.made[low]
            sym[r, i], sym[r, j], after[r, i] = new, -1, k
            more = k < size[r]
            rank = np.full(len(r), NONE)
            rm, km = r[more], k[more]
            before[rm, km] = i[more]
            rank[more] = self.pair_ranks(new[more], sym[rm, km])
            put(r, j, NONE)
            put(r, i, rank)
            h = before[r, i]
            has = h >= 0
            put(r[has], h[has], self.pair_ranks(sym[r[has], h[has]], new[has]))
            r = r[tree[r, 1] < NONE]
        left = sym >= 0
        ids, ends = sym[left].astype("<u4").tobytes(), np.cumsum(left.sum(axis=1) * 4).tolist()
        return [ids[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def learn(self, words: set[str]) -> None:
        """Puts the ids of words into the cache."""
        by: dict[int, list[tuple[str, bytes]]] = {}
        for w in words:
            raw = w.encode()
            by.setdefault((len(raw) - 1).bit_length(), []).append((w, raw))
        for bits, group in by.items():
            if 1 << bits > WIDEST:
                for w, raw in group:
                    merged = merge_all([*map(self.inner.__getitem__, raw[:-1]), self.last[raw[-1]]], self.ranks)
                    self.known[w] = array("I", merged).tobytes()
            else:
                for at in range(0, len(group), 1 << 14):
                    part = group[at : at + (1 << 14)]
                    self.known.update(zip([w for w, _ in part], self.merge_rows([x for _, x in part]), strict=True))

    def split(self, chunk: str) -> list[str]:
        """The words of a text without white space."""
        low = chunk.lower() if chunk.isascii() else unicodedata.normalize("NFC", chunk).replace("Σ", "σ").lower()  # each letter by itself: no final sigma
        if low.isalpha():
            return [low]
        if low[-1] in ".,!?;:" and low[:-1].isalpha():
            return [low[:-1], low[-1]]
        return self.words.findall(low)

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        if len(self.chunks) > CACHE:
            self.chunks.clear()
            self.known.clear()
        parts = []  # per text: lists of chunks, and special ids
        for t in texts:
            own: list = []
            for x in self.specials.split(t) if "<|" in t else (t,):
                if x in self.special:
                    own.append(array("I", [self.special[x]]).tobytes())
                else:
                    own.append([c for c in self.spaces.split(x) if c] if self.odd.search(x) else x.split())
            parts.append(own)
        chunks = set(chain.from_iterable(x for own in parts for x in own if isinstance(x, list)))
        split = {c: self.split(c) for c in chunks if c not in self.chunks}
        self.learn({w for ws in split.values() for w in ws if w not in self.known})
        known = self.known
        self.chunks.update((c, known[ws[0]] if len(ws) == 1 else b"".join([known[w] for w in ws])) for c, ws in split.items())
        get = self.chunks.__getitem__
        out = [b"".join([x if isinstance(x, bytes) else b"".join(map(get, x)) for x in own]) for own in parts]
        for c in [c for c in split if len(c) > LONGEST]:
            del self.chunks[c]
            for w in split[c]:
                if len(w) > LONGEST:
                    known.pop(w, None)
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: bytes) -> str:
        """Tokens joined by single spaces, special ones and word ends included: the file states no decoder."""
        return " ".join(map(self.tokens.__getitem__, memoryview(ids).cast("I")))


@lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    return Bpe(path)


def encode_decode(docs: DataFrame, path: str | None = None, outputs: tuple[str, ...] = ("n_tokens", "ids", "decoded")) -> DataFrame:
    """docs with the wanted of n_tokens, ids, ids_sha256, decoded and decoded_sha256 of each whole text.

    ids_sha256 is over the ids as little-endian unsigned 32-bit integers, decoded_sha256 over the
    decoded text in UTF-8, both lowercase hex. Null and empty texts have no ids and decode to ''.
    Texts and words of any length are encoded whole. Columns of those names are replaced, others stay.
    Executors read path from their own installation.
    """
    path = path or default_path()
    docs = without(docs, *outputs)
    at, names = docs.columns.index("text"), [*docs.columns, *outputs]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema] + [f"{o} {OUTPUTS[o][0]}" for o in outputs])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, sha = load(path), lambda b: hashlib.sha256(b).hexdigest()
        for b in batches:
            for lo, hi, raw, off in text_slices(b, at):
                data, got = raw.tobytes(), {o: [] for o in outputs}
                for ids in bpe.encode_all([data[off[i] : off[i + 1]].decode() for i in range(hi - lo)]):
                    text = bpe.decode(ids) if "decoded" in got or "decoded_sha256" in got else ""
                    for o, out in got.items():
                        out.append(len(ids) // 4 if o == "n_tokens" else memoryview(ids).cast("i").tolist() if o == "ids" else sha(ids) if o == "ids_sha256" else text if o == "decoded" else sha(text.encode()))
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in b.columns), *(pa.array(v, OUTPUTS[o][1]) for o, v in got.items())], names=names)

    return docs.mapInArrow(thrifty(run), schema)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document, in the manner of encode_decode."""
    return encode_decode(table(spark, sf_dir, "documents").select("doc_id", "text"), outputs=("n_tokens", "ids_sha256", "decoded_sha256")).drop("text")
