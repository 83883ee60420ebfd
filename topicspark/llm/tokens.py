"""Token ids of whole texts by the tokenizers library, each piece of text encoded once.

A BPE tokenizer cuts a text into pre-tokens and encodes each on its own. No
pre-token of the two supported kinds reaches over a space between two words, so a
text is cut there, each distinct piece is encoded by the library once, and the
ids of a text are those of its pieces in order. A piece of letters alone is one
pre-token, which the library's model takes as it is; punctuation behind it is the
next one:

* byte-level: a space belongs to the word behind it. Texts with a run of white
  space, or with white space at an end, are encoded whole.
* word ends (``</w>``): white space is dropped.

Any other tokenizer encodes every text whole.
"""

from __future__ import annotations

import unicodedata
from array import array

import numpy as np

PIECES_KEPT = 600_000  # bound of a worker's table of pieces, some 100 MB; it starts anew beyond
_TAILS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"  # ASCII punctuation without the apostrophe of contractions
_MARK = "\0"  # in front of a piece that has no space before it
_LOADED: dict[str, Encoder] = {}


class Encoder:
    """Ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.size = self.tokenizer.get_vocab_size()
        self.width = 2 if self.size <= 1 << 16 else 4
        self.kept: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.word_ends = getattr(self.tokenizer.model, "end_of_word_suffix", None) == "</w>"
        plain = self.tokenizer.pre_tokenizer
        self.byte_level = isinstance(plain, pre_tokenizers.ByteLevel) and not plain.add_prefix_space and self.tokenizer.normalizer is None
        self.highest = max(vocabulary.values(), default=0)
        self.tails: dict[str, bytes] = {}
        self.model = self.tokenizer.model
        self.letters = {}  # the model's sign for a byte beyond ASCII, as the library spells it
        spell = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        for code in [*range(0x80, 0x800), *range(0x800, 0x10000, 0x400), *range(0x10000, 0x110000, 0x10000)]:
            if not 0xD800 <= code < 0xE000:
                self.letters.update(zip(chr(code).encode(), spell(chr(code))[0][0]))
        self.line = self.whole(["\n"])[0]

    def whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def __call__(self, texts: list[str]) -> list[bytes]:
        if self.word_ends:
            cut = [text.replace("\n", " ").split(" ") for text in texts]
            return [b"".join(ids) for ids in self._ids(cut)]
        if not self.byte_level:
            return self.whole(texts)
        found: list[bytes | None] = [None] * len(texts)
        odd, even, cut = [], [], []
        for k, text in enumerate(texts):
            if not text or _MARK in text or " ".join(text.split()) != text.replace("\n", " "):
                odd.append(k)
                continue
            pieces = text.replace("\n", " \n").split(" ")  # a line feed stays with the word behind it
            pieces[0] = _MARK + pieces[0]
            cut.append(pieces)
            even.append(k)
        for k, ids in zip(even, self._ids(cut)):
            found[k] = b"".join(ids)
        for k, each in zip(odd, self.whole([texts[k] for k in odd])):
            found[k] = each
        return found

    def _ids(self, cut: list[list[str]]) -> list[list[bytes]]:
        """The ids of every piece; pieces not met before are learned together."""
        if len(self.kept) > PIECES_KEPT:
            self.kept.clear()
        get = self.kept.get
        found = [list(map(get, pieces)) for pieces in cut]
        gaps = [k for k, ids in enumerate(found) if None in ids]
        if gaps:
            holes = [(k, [j for j, ids in enumerate(found[k]) if ids is None]) for k in gaps]
            new = {cut[k][j] for k, at in holes for j in at}
            lined = {piece: _MARK + piece[1:] for piece in new if piece[:1] == "\n"}
            self._learn(new.difference(lined).union(piece for piece in lined.values() if piece not in self.kept))
            self.kept.update((piece, self.line + self.kept[word]) for piece, word in lined.items())
            for k, at in holes:
                ids, pieces = found[k], cut[k]
                for j in at:
                    ids[j] = self.kept[pieces[j]]
        return found

    def _learn(self, new: set[str]) -> None:
        kept, tokenize, rest = self.kept, self.model.tokenize, []
        get, word_ends = kept.get, self.word_ends
        for piece in new:
            word = piece.rstrip(_TAILS)
            ids = get(word)
            if ids is None:
                if word.isascii() and word.isalpha():
                    spelled = word.lower() if word_ends else "Ġ" + word
                else:
                    spelled = self._spelled(word)
                    if spelled is None:
                        rest.append(piece)
                        continue
                ids = kept[word] = array("I", [t.id for t in tokenize(spelled)]).tobytes()
            if len(word) < len(piece):
                kept[piece] = ids + self._tail(piece[len(word) :])
        if rest:
            kept.update(zip(rest, self.whole([self._alone(piece) for piece in rest])))

    def _tail(self, tail: str) -> bytes:
        if tail not in self.tails:
            if len(self.tails) > PIECES_KEPT:
                self.tails.clear()
            self.tails[tail] = self.whole([tail])[0]
        return self.tails[tail]

    def _spelled(self, word: str) -> str | None:
        """A word of letters in the model's signs; None for any other piece."""
        first = word[:1] == _MARK
        body = word[1:] if first else word
        if not body.isalpha():
            return None
        if self.word_ends:
            if first:
                return None
            body = unicodedata.normalize("NFC", body)
            body = "".join(map(str.lower, body)) if "Σ" in body else body.lower()  # each sign by itself
            if not body.isalpha():  # a capital that lower case takes apart
                return None
        if not body.isascii():
            body = body.encode().decode("latin-1").translate(self.letters)
        return body if self.word_ends or first else "Ġ" + body

    def _alone(self, piece: str) -> str:
        return piece if self.word_ends else piece[1:] if piece[:1] == _MARK else " " + piece


def encoder(path: str) -> Encoder:
    """The worker's encoder of a tokenizer file, loaded once."""
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]


def slices(batch, rows: int = 512):
    """Parts of an Arrow batch, so that few texts are Python strings at a time."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def text_list(column) -> list[str]:
    """An Arrow column of strings as a list, null as the empty text."""
    return [t or "" for t in column.to_pylist()]
