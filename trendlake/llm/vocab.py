"""Tokenizers from public vocabulary files, with a cache of the pieces between white space or of words.

Both file kinds cut text at white space before anything else, so the ids of a text are the ids
of its pieces in turn. A worker keeps the pieces it has seen; texts with characters for which
the libraries and Python may disagree on white space go to the library whole.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import sys
from array import array

from trendlake.llm.common import held

#: Pieces a worker keeps; frequent ones come early, and later new ones are encoded each time.
PIECES = 700_000
#: Words a worker keeps; a word that is not kept costs little, and workers hold them through all later stages.
WORDS = 150_000
_UNUSUAL = re.compile(r"[^\S \n]|  |\n\n|\n | \n|\A\s|\s\Z")
_CONTROL = re.compile(r"[\x1c-\x1f\x85]|<\|")

#: Fixed values of the word tokenizer's file: how it normalises a text, and what it takes as one word.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
WORD_RULE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Texts that the two leave as they are but for case, and the same rule for their characters.
_LATIN = re.compile(r"[\t\n\r -~À-ÖØ-öø-ÿ]*")
_LATIN_WORD = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[a-zß-öø-ÿ]+|[0-9]|[!-/:-@\[-`{-~]+")


def default_path(name: str) -> str:
    """Where the installed public vocabulary file ``name`` lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def version(path: str) -> str:
    """The digest of a vocabulary file."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def _load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def packed(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit values."""
    values = array("I", ids)
    if sys.byteorder == "big":
        values.byteswap()
    return values.tobytes()


def _cuts_by_word_rule(path: str) -> bool:
    """Whether a tokenizer's file normalises by ``NORMALIZERS`` and cuts by ``WORD_RULE``."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    steps = (spec["pre_tokenizer"] or {}).get("pretokenizers") or [{}]
    cut = (steps[0].get("pattern") or {}).get("Regex")
    return (spec["normalizer"] or {}).get("normalizers") == NORMALIZERS and cut == WORD_RULE and [x["type"] for x in steps[1:]] == ["ByteLevel"]


def _cuts_at_blanks(path: str) -> bool:
    """Whether a file is a byte-level BPE that cuts texts as its own rule does, with special strings of ``<|``."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    cut = spec["pre_tokenizer"] or {}
    plain = cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True)
    return bool(plain and not spec["normalizer"] and all(t["content"].startswith("<|") for t in spec["added_tokens"]))


class SentencePieceCounter:
    """Token counts of a ``.model`` file, text by text."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)

    def count(self, text: str) -> int:
        return len(self.model.encode(text, num_threads=1))


class ByteLevelCounter:
    """Token counts of a ``.json`` file.

    Where it is a byte-level BPE whose pieces take the one blank before them along, pieces are
    looked up; any other file is given every text whole.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer = _load(path)
        self.by_piece = _cuts_at_blanks(path)
        self.newline = self.whole("\n")
        self.spaced: dict[str, int] = {}
        self.bare: dict[str, int] = {}

    def whole(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _sum(self, cache: dict[str, int], pieces: list[str], lead: str) -> int:
        counts = list(map(cache.get, pieces))
        if None in counts:
            missing = list({p for p, n in zip(pieces, counts, strict=True) if n is None})
            coded = self.tokenizer.encode_batch_fast([lead + p for p in missing], add_special_tokens=False)
            new = dict(zip(missing, map(len, coded), strict=True))
            counts = [new[p] if n is None else n for p, n in zip(pieces, counts, strict=True)]
            if len(cache) < PIECES:
                cache.update(new)
        return sum(counts)

    def count(self, text: str) -> int:
        if not text:
            return 0
        if not self.by_piece or _UNUSUAL.search(text) or _CONTROL.search(text):
            return self.whole(text)
        lines = [line.split(" ") for line in text.split("\n")]
        total = self.newline * (len(lines) - 1) + self._sum(self.bare, [line[0] for line in lines], "")
        return total + self._sum(self.spaced, [p for line in lines for p in line[1:]], " ")


class Words(dict):
    """The ids of lower-case words, as packed bytes; a word that is not kept is coded when it is asked for."""

    def __init__(self, model) -> None:
        from tokenizers.pre_tokenizers import ByteLevel

        super().__init__()
        self.model = model
        alphabet = ByteLevel(add_prefix_space=False, use_regex=False)
        letters = (chr(c) for c in range(0xDF, 0x100) if c != 0xF7)
        self.bytes_of = {ord(c): alphabet.pre_tokenize_str(c)[0][0] for c in letters}

    def __missing__(self, word: str) -> bytes:
        tokens = self.model.tokenize(word if word.isascii() else word.translate(self.bytes_of))
        ids = packed([t.id for t in tokens])
        if len(self) < WORDS:
            self[word] = ids
        return ids


class WordCoder:
    """Token ids, as little-endian unsigned 32-bit bytes, of a BPE that drops white space.

    Where the file cuts words by ``WORD_RULE`` after lower-casing, texts of ASCII and Latin-1
    letters are cut here and their words looked up; all others go to the library by pieces.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer = _load(path)
        self.pieces: dict[str, bytes] = {}
        self.words = Words(self.tokenizer.model) if _cuts_by_word_rule(path) else None

    def whole(self, text: str) -> bytes:
        return packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def encode(self, text: str) -> bytes:
        if _CONTROL.search(text):
            return self.whole(text)
        if self.words is not None and _LATIN.fullmatch(text):
            return b"".join(map(self.words.__getitem__, _LATIN_WORD.findall(text.lower())))
        pieces = text.split()
        found = list(map(self.pieces.get, pieces))
        if None in found:
            missing = list({p for p, b in zip(pieces, found, strict=True) if b is None})
            coded = self.tokenizer.encode_batch_fast(missing, add_special_tokens=False)
            new = {p: packed(c.ids) for p, c in zip(missing, coded, strict=True)}
            found = [new[p] if b is None else b for p, b in zip(pieces, found, strict=True)]
            if len(self.pieces) < WORDS:
                self.pieces.update(new)
        return b"".join(found)


def loaded(kind: type, path: str):
    """One instance for each worker process, held from task to task."""
    return held((kind.__name__, path), lambda: kind(path))


def counter(path: str):
    return loaded(SentencePieceCounter if path.endswith(".model") else ByteLevelCounter, path)
