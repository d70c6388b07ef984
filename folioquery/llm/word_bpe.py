"""Word-level BPE with word ends: encoding by batched merge rounds in numpy, and decoding.

Words that a task hasn't met are merged together: the symbols of all of them lie in one flat array; each
round looks all neighbouring pairs up by binary search over the sorted pair keys, finds each word's lowest
rank, and merges that pair wherever it stands in the word, from left to right.
"""

from __future__ import annotations

import json
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import WordTable, byte_characters
from .common import held, quoted, small_batches

#: Fixed value: the vocabulary's published word pattern.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NEVER = np.iinfo(np.int64).max


def merge_words(words: list[np.ndarray], keys: np.ndarray, ranks: np.ndarray, merged: np.ndarray) -> list[np.ndarray]:
    """Symbols of words after all merges. keys: left << 32 | right, ascending, with each pair's rank and product."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    symbol = np.concatenate(words).astype(np.int64)
    owner = np.repeat(np.arange(len(words)), size)
    open_ = np.ones(len(words), bool)
    done_symbol, done_owner = [], []
    while len(symbol):
        pair = (symbol[:-1] << 32) | symbol[1:]
        at = np.minimum(np.searchsorted(keys, pair), len(keys) - 1)
        rank = np.where((keys[at] == pair) & (owner[:-1] == owner[1:]), ranks[at], NEVER)
        low = np.full(len(words), NEVER)
        np.minimum.at(low, owner[:-1], rank)
        open_ = low < NEVER
        stay = ~open_[owner]
        if stay.any():
            done_symbol.append(symbol[stay])
            done_owner.append(owner[stay])
            keep = ~stay
            symbol, owner = symbol[keep], owner[keep]
            if not len(symbol):
                break
            old = np.flatnonzero(keep)
            rank, at = np.where(np.diff(old) == 1, rank[old[:-1]], NEVER), at[old[:-1]]
        hit = (rank == low[owner[:-1]]) & (rank < NEVER)
        # of hits that overlap, as in "aaa", every second one counts, from the left
        starts = np.flatnonzero(hit & ~np.r_[False, hit[:-1]])
        if hit.any():
            place = np.arange(len(hit))
            first = starts[np.cumsum(np.isin(place, starts, assume_unique=True)) - 1] if len(starts) else place
            hit &= (place - first) % 2 == 0
        where = np.flatnonzero(hit)
        symbol[where] = merged[at[where]]
        left = np.ones(len(symbol), bool)
        left[where + 1] = False
        symbol, owner = symbol[left], owner[left]
    if not done_symbol:
        return [np.zeros(0, np.uint32) for _ in words]
    symbol, owner = np.concatenate(done_symbol), np.concatenate(done_owner)
    order = np.argsort(owner, kind="stable")
    return np.split(symbol[order].astype(np.uint32), np.cumsum(np.bincount(owner, minlength=len(words)))[:-1])


class WordBpe:
    """Encodes and decodes as the tokenizers library does with the same file, without truncation or padding."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        vocabulary = told["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in told["added_tokens"]}
        self.end = told["model"]["end_of_word_suffix"]
        self.token = {i: t for t, i in (vocabulary | self.special).items()}
        pairs = [(vocabulary[a], vocabulary[b], vocabulary[a + b]) for a, b in (m if isinstance(m, list) else m.split(" ") for m in told["model"]["merges"])]
        left, right, product = np.array(pairs, np.int64).T
        key = (left << 32) | right
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks, self.products = key[order], np.arange(len(key))[order], product[order]
        shown = byte_characters()
        self.inner = np.array([vocabulary[shown[b]] for b in range(256)], np.int64)
        self.last = np.array([vocabulary[shown[b] + self.end] for b in range(256)], np.int64)
        self.find = regex.compile(WORDS).findall
        self.split = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(self.special, key=len, reverse=True)) + ")").split if self.special else lambda text: [text]
        self.spaces = regex.compile(r"\s+").split
        self.table = WordTable(self.ids_of_chunks)

    def symbols(self, word: str) -> np.ndarray:
        raw = np.frombuffer(word.encode(), np.uint8)
        return np.append(self.inner[raw[:-1]], self.last[raw[-1]])

    def ids_of_chunks(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks between white space, as bytes of u32; the words of all of them are merged at once."""
        words = [self.find(chunk) for chunk in chunks]
        flat = list(dict.fromkeys(w for x in words for w in x))
        merged = merge_words([self.symbols(w) for w in flat], self.keys, self.ranks, self.products) if flat else []
        ids = {w: x.tobytes() for w, x in zip(flat, merged, strict=True)}
        return [b"".join([ids[w] for w in x]) for x in words]

    def chunks(self, text: str) -> list[str]:
        text = text if text.isascii() else unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return [x for x in self.spaces(text.lower()) if x]

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of every text. Words that are new in the batch are merged in one go."""
        parts = [self.split(text) if any(s in text for s in self.special) else [text] for text in texts]
        chunks = [[p if p in self.special else self.chunks(p) for p in x] for x in parts]
        found = iter(self.table.gather_all([p for x in chunks for p in x if isinstance(p, list)]))
        return [np.concatenate([np.array([self.special[p]], np.uint32) if isinstance(p, str) else next(found) for p in x]) for x in chunks]

    def decode(self, ids: np.ndarray) -> str:
        """The vocabulary file names no decoder, so tokens are joined with spaces; unknown ids are skipped."""
        return " ".join([t for t in map(self.token.get, ids.tolist()) if t is not None])


#: Characters of text that are encoded together.
TOGETHER = 4 << 20


def bpe(path: str) -> WordBpe:
    return held(path, lambda: WordBpe(path))


def groups(sizes: list[int], most: int) -> list[tuple[int, int]]:
    """Runs of rows with at most `most` characters in all, or one row."""
    runs, start, total = [], 0, 0
    for k, n in enumerate(sizes):
        if total and total + n > most:
            runs.append((start, k))
            start, total = k, 0
        total += n
    return [*runs, (start, len(sizes))] if sizes else []


def encode_documents(docs: DataFrame, tokenizer: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, ids binary (u32) and decoded text of every row.

    A null text is the empty text: no ids, decoded empty. Repeated rows and null numbers are kept; other
    columns are not used. An empty table gives no rows.
    """

    def run(batches):
        own = bpe(tokenizer)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in groups([len(t) for t in texts], TOGETHER):
                ids = own.encode_batch(texts[a:b])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary()), pa.array([own.decode(x) for x in ids], pa.string())],
                    names=["doc_id", "ids", "decoded"],
                )

    texts = small_batches(docs).select(F.col(quoted(id_column)).cast("long").alias("doc_id"), F.coalesce(F.col(quoted(text_column)), F.lit("")).alias("text"))
    return texts.mapInArrow(run, "doc_id long, ids binary, decoded string")


def digests(encoded: DataFrame) -> DataFrame:
    return encoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )
