"""Subword ids of whole texts as uint16 arrays (both vocabularies have fewer than 65,536 ids)."""

from __future__ import annotations

import base64
import os
import re
from array import array

import numpy as np

#: Pieces that one worker remembers in either of two generations; about 200 bytes each.
REMEMBERED = 200_000


#: Pieces whose words the pre-tokenizer leaves whole: Latin-1 letters, composed already, and a point or comma.
_PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([.,]?)")


class _Known(dict):
    """Ids of pieces as bytes, encoded when first asked for.

    When full, it becomes the old generation, from which pieces that come again return.
    """

    def __init__(self, encode):
        super().__init__()
        self.encode = encode
        self.old: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        found = self.old.get(piece)
        if found is None:
            found = self.encode(piece)
        self[piece] = found
        return found

    def turn(self) -> None:
        if len(self) > REMEMBERED:
            self.old = dict(self)
            self.clear()


class WordEncoder:
    """ids(text) equals Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids, for a vocabulary that drops white space.

    A text is cut at spaces and line feeds; the pre-tokenizer joins nothing across them, so a piece has the same ids
    alone as within the text, and each distinct piece is encoded once per worker: plain words by the tokenizer's model
    (its normaliser only lower-cases them), all others by the whole tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.known = Tokenizer.from_file(path), _Known(self._encode)
        self.model = self.tokenizer.model
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.bytes = {c: level.pre_tokenize_str(chr(c))[0][0] for c in range(0xC0, 0x100)}

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        known, out = self.known, []
        for text in texts:
            out.append(np.frombuffer(b"".join(map(known.__getitem__, text.replace("\n", " ").split(" "))), np.uint16))
            known.turn()
        return out

    def _encode(self, piece: str) -> bytes:
        plain = _PLAIN.fullmatch(piece)
        if not plain:
            return np.array(self.tokenizer.encode(piece, add_special_tokens=False).ids, np.uint16).tobytes()
        word, after = plain.groups()
        if after:
            return self.known[word.lower()] + self.known[after]
        if not word.islower():
            return self.known[word.lower()]
        return array("H", [t.id for t in self.model.tokenize(word if word.isascii() else word.translate(self.bytes))]).tobytes()


class ByteEncoder:
    """Byte-level BPE: the ids that tokenizers gives for byte_bpe_50k.json.

    byte_bpe_50k.tiktoken holds the same vocabulary as ranks; the library that reads it takes a quarter of the time.
    ``check_vocabulary`` compares both libraries on every entry of the vocabulary, ``check`` on a text; tests/llm does so
    on texts with every kind of character.
    """

    def __init__(self, path: str):
        self.path, self._other = path, None
        import public_tokenizers
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(os.path.splitext(path)[0] + ".tiktoken", "rb"))}
        names = [b""] * (max(ranks.values(), default=0) + 2)
        for name, k in [*ranks.items(), (b"<|endoftext|>", 50256)]:
            names[k] = name
        self.letters = np.frombuffer(b"".join(names), np.uint8)
        self.sizes = np.array([len(n) for n in names], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.encoding = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": 50256})

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        return [self.encoding.encode_to_numpy(t, allowed_special="all").astype(np.uint16) for t in texts]

    @property
    def other(self):
        """The tokenizers library's reading of the same vocabulary."""
        if self._other is None:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self._other = Tokenizer.from_file(self.path)
            self._other.encode_special_tokens = False
        return self._other

    def check(self, texts: list[str]) -> None:
        """Raise if the libraries differ on any of ``texts``."""
        for text, mine, theirs in zip(texts, self.ids(texts), self.other.encode_batch(texts, add_special_tokens=False), strict=True):
            if mine.tolist() != theirs.ids:
                raise ValueError(f"two readings of the vocabulary differ on {text[:60]!r}")

    def check_vocabulary(self) -> None:
        """As ``check``, on every entry of the vocabulary that is valid text, alone and after a letter."""
        entries = []
        for a, n in zip(self.starts.tolist(), self.sizes.tolist(), strict=True):
            try:
                entries.append(self.letters[a : a + n].tobytes().decode())
            except UnicodeDecodeError:  # part of a character
                continue
        self.check(entries + ["a" + x for x in entries])

    def text(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes that ids stand for, and where each id's begin (ids + 1)."""
        size = self.sizes[ids]
        at = np.concatenate([[0], np.cumsum(size)])
        return self.letters[np.repeat(self.starts[ids] - at[:-1], size) + np.arange(at[-1])], at


_encoders: dict[tuple[type, str], object] = {}


def encoder(kind: type, path: str):
    """One encoder for each file and Python worker."""
    if (kind, path) not in _encoders:
        _encoders[kind, path] = kind(path)
    return _encoders[kind, path]
