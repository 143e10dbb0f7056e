"""Token ids of whole texts, as raw little-endian unsigned 32-bit integers."""

from __future__ import annotations

import json
import os
import re
from array import array
from functools import lru_cache

#: Characters whose classes (letter, digit, space) are the same in every Unicode release:
#: ASCII without control characters other than tab and line ends, Latin, Greek and Cyrillic letters,
#: common punctuation, kana and common ideographs. Texts with others take the whole-text path.
PLAIN = re.compile(r"[^\t\n\r\x20-\x7e¡-¬®-ɏΑ-ΡΣ-ώЀ-џ‐-‧€ぁ-ゖァ-ヺ一-龥]")
#: The split of byte-level BPE before merges (fixed value of the public vocabulary).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A blank after other white space; elsewhere a blank always starts a new piece.
AFTER_SPACE = re.compile(r"\s ")
#: Marks that often follow a word; a run of them is one piece.
MARKS = ".,;:!?)*%&$#"
#: Pieces remembered in each Python worker, about 200 bytes each.
REMEMBERED = 700_000


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE writes each byte as one printable character: itself, or else from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


class _Pieces(dict):
    """Ids of a piece between blanks. Those of each word are kept for the next time that it occurs."""

    def __init__(self, split, merge):
        super().__init__()
        self.split, self.merge = split, merge

    def __missing__(self, piece: str) -> bytes:
        word = piece.rstrip(MARKS)
        if not word[1:].isalpha() or not (word[0] == " " or word[0].isalpha()):
            parts = self.split(piece)
            if len(parts) != 1:
                return b"".join([self[w] for w in parts])
        elif word != piece:  # letters, then marks: two pieces
            return self[word] + self[piece[len(word) :]]
        if len(self) >= REMEMBERED:
            self.clear()
        ids = self[piece] = self.merge(piece)
        return ids


class Encoder:
    """Ids by the library of the vocabulary file: tokenizers for .json, sentencepiece for .model.

    No begin, end or added special tokens; special strings in a text are handled as the library's
    default. For byte-level BPE the pieces between which no merge can happen are encoded by the
    library's model one by one and remembered; everything else is encoded as a whole text.
    """

    def __init__(self, path: str):
        self.pieces = None
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.whole = lambda text: array("I", model.encode(text, num_threads=1)).tobytes()
            self.vocabulary = model.get_piece_size()
            return
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        library.no_truncation()
        library.no_padding()
        self.whole = lambda text: array("I", library.encode(text, add_special_tokens=False).ids).tobytes()
        self.vocabulary = library.get_vocab_size()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.added = [x["content"] for x in spec.get("added_tokens") or ()]
        before = spec.get("pre_tokenizer") or {}
        if spec.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and spec["model"]["type"] == "BPE" and not spec["model"].get("dropout"):
            import regex

            self.split, model, letters = regex.compile(SPLIT).findall, library.model, _byte_letters()
            self.pieces = _Pieces(self.split, lambda w: array("I", [t.id for t in model.tokenize(w.encode().decode("latin-1").translate(letters))]).tobytes())

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.pieces is None or PLAIN.search(text) or any(a in text for a in self.added):
            return self.whole(text)
        get = self.pieces.__getitem__
        if AFTER_SPACE.search(text):
            return b"".join(map(get, self.split(text)))
        first, *rest = text.split(" ")
        return get(first) + b"".join([get(" " + p) for p in rest])


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder for each vocabulary file and Python worker."""
    return Encoder(path)
