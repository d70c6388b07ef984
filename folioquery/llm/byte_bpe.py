"""Byte-level BPE ids of whole texts, from the tokenizers library, in Arrow batches.

A text is cut at spaces, where the vocabulary's own pattern always cuts it; the library's model encodes
every distinct word of a text, and words that come again are gathered from a table of a worker. Texts with runs of
mixed white space are cut by the pattern itself. Texts that hold a special token, or a character whose
class may differ between regular-expression engines, go to the library whole.
"""

from __future__ import annotations

from array import array

import numpy as np

#: Fixed value: the published piece pattern of this vocabulary family.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters that every engine puts in the same class; any other sends the text to the library whole.
PLAIN = "\t\n\r -~¡-ɏΆ-ώЁ-џ‐-‧‰-⁞₠-₵ぁ-ゖァ-ヺ一-龥가-힣"
#: Fixed value: marks that often end a word; such words are cut without the pattern.
STOPS = (".", ",", ";", ":", "!", "?")
#: Distinct words that a worker remembers; of pieces of them a quarter.
MEMORY = 500_000
#: Places in which a word that came once leaves a mark, a byte each.
SEEN = 1 << 22


def byte_characters() -> dict[int, str]:
    """The character that stands for each byte: itself if printable, else the next free one from 256."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


#: White space next to white space: such texts are cut by the pattern. SHORT: all that a text without tabs and returns can have.
RUNS = [a + b for a in " \n\t\r" for b in " \n\t\r"]
SHORT = [a + b for a in " \n" for b in " \n"]


class Numbers(dict):
    """Numbers keys as they are first asked for; fresh lists those not yet learnt."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, key: str) -> int:
        self.fresh.append(key)
        self[key] = n = len(self)
        return n


class WordTable:
    """Ids of words in one flat array, as words turn up.

    The first `memory` words stay; they hold nearly all frequent ones. Later ones are looked up anew with every text.
    """

    def __init__(self, ids_of, memory: int | None = None):
        """ids_of: a function from words to their ids, each as the bytes of u32 numbers."""
        self.ids_of, self.memory = ids_of, memory or MEMORY
        self.index = Numbers()
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.start, self.length = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def learn(self) -> list[str]:
        words, self.index.fresh = self.index.fresh, []
        first, last = len(self.index) - len(words), len(self.index)
        ids = self.ids_of(words)
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat = np.frombuffer(b"".join(ids), np.uint32)
        while last > len(self.start):
            self.start, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.length))
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.start[first:last] = self.used + np.cumsum(size) - size
        self.length[first:last] = size
        self.flat[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        return words

    def number(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))

    def ids(self, at: np.ndarray) -> np.ndarray:
        """Ids of numbered words, one word after the other."""
        if not len(at):
            return np.zeros(0, np.uint32)
        size = self.length[at]
        ends = np.cumsum(size)
        return self.flat[np.repeat(self.start[at] - (ends - size), size) + np.arange(ends[-1])]

    def gather_all(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Ids of texts that are cut into words; the new words of all of them are learnt together."""
        used = self.used
        at = [self.number(words) for words in texts]
        fresh = self.learn() if self.index.fresh else []
        found = [self.ids(a) for a in at]
        if len(self.index) > self.memory:
            self.used = used
            for word in fresh:
                del self.index[word]
        return found

    def gather(self, words: list[str]) -> np.ndarray:
        return self.gather_all([words])[0]


class SeenTable(WordTable):
    """A table in which a word stays from the second text on that brings it, so that words that come once take no room."""

    def __init__(self, ids_of, memory: int | None = None):
        super().__init__(ids_of, memory)
        self.seen, self.stays = bytearray(SEEN), 0

    def gather(self, words: list[str]) -> np.ndarray:
        used, at = self.used, self.number(words)
        if not self.index.fresh:
            return self.ids(at)
        fresh = self.learn()
        found, first = self.ids(at), len(self.index) - len(fresh)
        for word in fresh:
            del self.index[word]
        self.used = used
        if first < self.memory:
            self.keep(fresh, first)
        return found

    def get(self, word: str) -> bytes | None:
        """Ids of a word that stays."""
        at = self.index.get(word, self.memory)
        return self.flat[self.start[at] : self.start[at] + self.length[at]].tobytes() if at < self.stays else None

    def keep(self, fresh: list[str], first: int) -> None:
        """Of words that were learnt from number `first` on, take those up that were seen before, as far as there is room."""
        slots, again = [hash(word) % SEEN for word in fresh], []
        for k, slot in enumerate(slots):
            if self.seen[slot]:
                again.append(k)
            self.seen[slot] = 1
        again = again[: self.memory - first]
        if again:
            at = np.array(again) + first
            flat, size, last = self.ids(at), self.length[at], first + len(again)
            self.flat[self.used : self.used + len(flat)] = flat
            self.start[first:last] = self.used + np.cumsum(size) - size
            self.length[first:last] = size
            self.used += len(flat)
            self.index.update(zip([fresh[k] for k in again], range(first, last)))
            self.stays = last


class Encoder:
    """encode(text) gives the ids that the library gives with add_special_tokens=False."""

    def __init__(self, path: str, memory: int | None = None):
        import regex
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.model = self.library.model
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.find = regex.compile(PIECES).findall
        self.odd = regex.compile(f"[^{PLAIN}]").search
        self.shown = byte_characters()
        self.known: dict[str, bytes] = {}
        memory = memory or MEMORY
        self.memory = memory // 4
        self.words, self.pieces = SeenTable(self.ids_of_words, memory), SeenTable(self.ids_of_pieces, memory)

    def piece(self, piece: str) -> bytes:
        """Ids of a piece that is new; the library's model takes it in the characters that stand for its bytes."""
        if piece[0] == " " and piece.isascii() and piece[1:].isalpha():
            shown = "Ġ" + piece[1:]
        else:
            shown = piece.encode().decode("latin-1").translate(self.shown)
        ids = array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()
        if len(self.known) < self.memory:
            self.known[piece] = ids
        return ids

    def ids_of_pieces(self, pieces: list[str]) -> list[bytes]:
        known = self.known.get
        return [known(x) or self.piece(x) for x in pieces]

    def ids_of_words(self, words: list[str]) -> list[bytes]:
        """Ids of words with the space before them; NUL in its place: of the word alone."""
        known, stays, piece, tokenize, out = self.known.get, self.words.get, self.piece, self.model.tokenize, []
        for word in words:
            stem = word[:-1] if (stop := word[-1:]) in STOPS else word
            if stem.isalpha():
                ids = known(spaced := " " + stem)
                if ids is None and stop in STOPS:
                    ids = stays(stem)
                if ids is None:
                    shown = "Ġ" + (stem if stem.isascii() else stem.encode().decode("latin-1").translate(self.shown))
                    ids = array("I", [t.id for t in tokenize(shown)]).tobytes()
                    # a word without a stop is remembered by the table of words
                    if stop in STOPS and len(self.known) < self.memory:
                        self.known[spaced] = ids
                out.append(ids if stem is word else ids + (known(stop) or piece(stop)))
            else:
                cut = self.find(word[1:] if word[:1] == "\0" else f" {word}")
                out.append(b"".join([known(x) or piece(x) for x in cut]))
        return out

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint32)
        if self.odd(text) or any(s in text for s in self.special):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)
        runs = RUNS if "\t" in text or "\r" in text else SHORT
        if text[0] == " " or text[-1] == " " or any(run in text for run in runs):
            return self.pieces.gather(self.find(text))
        # a single line feed is a piece of its own, and the word after it has no space before it
        return self.words.gather(("\0" + text.replace("\n", " \0\n \0")).split(" "))
