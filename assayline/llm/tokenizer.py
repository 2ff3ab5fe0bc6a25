"""Small task-side helpers around a public tokenizer file: exact units, a bounded memo, decoding.

A unit is a stretch of text that the tokenizer treats alike whatever stands around it, so
the encoding of a text is the concatenation of the encodings of its units.
"""

from __future__ import annotations

import json
import os
import re
import sys
from array import array

import numpy as np

# Entries that the memo of one Python worker may hold; beyond that it starts afresh.
MEMO_UNITS = 250_000
# Longer units are encoded each time, so that an entry has a bounded size.
MEMO_UNIT_CHARS = 64

# Starts at a blank or line feed that follows other text: no match of the byte-level split
# pattern crosses that place, in either direction.
_UNITS = re.compile(r"[ \n]+[^ \n]*|[^ \n]+")
# Other white space (a superset of what tokenizers count as such) makes that argument invalid.
_OTHER_SPACE = re.compile(r"[^\S \n]|[\u180e\u200b\u2060\ufeff]")
_CUT = re.compile(r"(?<=[^\s\u180e\u200b\u2060\ufeff])[ \n]")


def load(definition: str):
    """The tokenizer of a JSON definition; workers keep what they build on it (see ``workers``)."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(definition)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def byte_alphabet() -> dict[str, int]:
    """Printable stand-in of each byte in byte-level vocabularies, to the byte."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(kept)]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteLevel:
    """Exact encoding and decoding with a byte-level BPE definition (split pattern, no normaliser)."""

    def __init__(self, definition: str):
        parsed = json.loads(definition)
        split = parsed.get("pre_tokenizer") or {}
        if parsed.get("normalizer") or split.get("type") != "ByteLevel" or not split.get("use_regex", True):
            raise ValueError("a byte-level BPE definition without normaliser is needed")
        if split.get("add_prefix_space"):
            raise ValueError("definitions that add a leading blank are not covered")
        self.tokenizer = load(definition)
        alphabet = byte_alphabet()
        self.to_text = {b: c for c, b in alphabet.items()}
        added = parsed.get("added_tokens") or []
        if any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in added):
            raise ValueError("added tokens that look at their neighbours are not covered")
        self.added = {t["content"]: t["id"] for t in added}
        self._special = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        # A boundary this far before the end of a text does not depend on what may follow.
        self.margin = 3 + max((len(t) for t in self.added), default=0)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.pieces = [b""] * (max(vocabulary.values()) + 1)
        self.symbols = [""] * len(self.pieces)
        for token, i in vocabulary.items():
            self.symbols[i] = token
            known = all(c in alphabet for c in token)
            self.pieces[i] = bytes(alphabet[c] for c in token) if known else token.encode()
        self.memo: dict[str, bytes] = {}

    # -- whole texts of moderate length ------------------------------------------------

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        split = [None if _OTHER_SPACE.search(t) else _UNITS.findall(t) for t in texts]
        wanted = set().union(*(u for u in split if u is not None))
        if len(self.memo) + len(wanted) > MEMO_UNITS:
            self.memo.clear()
        new = [u for u in wanted if u not in self.memo]
        long = {}
        for unit, ids in zip(new, self._library(new), strict=True):
            (self.memo if len(unit) <= MEMO_UNIT_CHARS else long)[unit] = ids
        whole = iter(self._library([t for t, u in zip(texts, split, strict=True) if u is None]))
        known = self.memo | long if long else self.memo
        return [next(whole) if u is None else b"".join(map(known.__getitem__, u)) for u in split]

    def _library(self, texts: list[str]) -> list[bytes]:
        if not texts:
            return []
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in found]

    def decode(self, ids: bytes) -> str:
        return decoded(self.pieces, ids)

    # -- single words, for texts that are put together from parts -------------------------

    def spans(self, text: str) -> list[tuple[int, int, str | None]]:
        """Start, end and byte-level form of each split of the text; None for an added token."""
        found, at = [], 0
        parts = self._special.split(text) if self._special else [text]
        for i, part in enumerate(parts):
            if i % 2:
                found.append((at, at + len(part), None))
            elif part:
                for form, (start, end) in self.tokenizer.pre_tokenizer.pre_tokenize_str(part):
                    found.append((at + start, at + end, form))
            at += len(part)
        return found

    def word(self, text: str, form: str | None) -> list[int]:
        """Ids of one split."""
        if form is None:
            return [self.added[text]]
        return [t.id for t in self.tokenizer.model.tokenize(form)]

    def cuts(self, text: str, leaf: int) -> list[tuple[int, bool]]:
        """Where to cut a long text, and whether a split certainly starts there.

        Every part has between one half and one and a half times ``leaf`` characters; a
        blank after other text in the second half of a leaf makes the cut certain.
        """
        found, at = [], leaf
        while at < len(text) - leaf // 2:
            hit = _CUT.search(text, at, min(at + leaf // 2, len(text)))
            place = hit.start() if hit else at
            found.append((place, hit is not None))
            at = place + leaf
        return found


def decoded(pieces: list[bytes], ids: bytes) -> str:
    """Text of packed ids, given the bytes of each token; broken characters are replaced."""
    data = b"".join([pieces[i] for i in np.frombuffer(ids, dtype="<u4").tolist()])
    return data.decode("utf-8", "replace")


class WordCounter:
    """Token counts of texts for definitions that drop white space and look at no neighbours of it."""

    def __init__(self, definition: str):
        parsed = json.loads(definition)
        steps = parsed.get("pre_tokenizer") or {}
        first = (steps.get("pretokenizers") or [steps])[0]
        if first.get("type") != "Split" or first.get("behavior") != "Removed" or not first.get("invert"):
            raise ValueError("a definition whose splits drop white space is needed")
        if "\\s" not in str(first.get("pattern")) or "(?" in str(first.get("pattern")):
            raise ValueError("splits may not take white space or look around")
        self.tokenizer = load(definition)
        self.memo: dict[str, int] = {}

    def count_many(self, texts: list[str]) -> list[int]:
        split = [[w for w in t.replace("\n", " ").split(" ") if w] for t in texts]
        wanted = set().union(*split)
        if len(self.memo) + len(wanted) > MEMO_UNITS:
            self.memo.clear()
        new = [w for w in wanted if w not in self.memo]
        found = self.tokenizer.encode_batch_fast(new, add_special_tokens=False) if new else []
        long = {}
        for word, encoded in zip(new, found, strict=True):
            (self.memo if len(word) <= MEMO_UNIT_CHARS else long)[word] = len(encoded.ids)
        known = self.memo | long if long else self.memo
        return [sum(map(known.__getitem__, words)) for words in split]


# Characters whose lower case and normal form are those of each by itself, without an apostrophe's rules.
_SAFE = re.compile(r"[ \n!-~À-ÖØ-öø-ÿ]*")
_LETTERS = re.compile(r"[a-zß-öø-ÿ]+")
# Signs that stand next to one another are one split; one between letters, digits and blanks is a split.
_SIGNS = re.compile(r"[!-/:-@\[-`{-~]{2}")
_MARKS = ',.;:!?()"-'
# Runs of letters and of signs, in texts without digits and apostrophes.
_RUNS = re.compile(r"[a-zß-öø-ÿ]+|[^ \na-zß-öø-ÿ]+")
_QUOTED = re.compile(r"[0-9']")
# A word of letters and the signs after it, which splits treat apart.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]+)")
# Units of each of the two generations that a worker remembers.
GENERATION = 300_000


class _Generations(dict):
    """Ids of the units met lately: when there are many, those of the generation before are forgotten."""

    def __init__(self, make):
        super().__init__()
        self.make, self.older = make, {}

    def __missing__(self, unit: str) -> bytes:
        ids = self.older.get(unit)
        if ids is None:
            ids = self.make(unit)
        if len(unit) <= MEMO_UNIT_CHARS:
            self[unit] = ids
        return ids

    def age(self) -> None:
        if len(self) > GENERATION:
            self.older = dict(self)
            self.clear()


class WordEncoder:
    """Ids of texts for definitions that drop white space.

    A text is taken apart into units whose encodings do not depend on their neighbours: single marks and what is
    between blanks and marks where that is certain, else what is between blanks.
    """

    def __init__(self, definition: str):
        parsed = json.loads(definition)
        self.tokenizer = WordCounter(definition).tokenizer
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.width = 2 if max(vocabulary.values()) < 1 << 16 else 4
        self.dtype = f"<u{self.width}"
        steps = parsed.get("normalizer") or {}
        kinds = {n["type"] for n in steps.get("normalizers") or [steps] if n}
        added = self.added = [t["content"] for t in parsed.get("added_tokens") or []]
        byte_level = (parsed["pre_tokenizer"].get("pretokenizers") or [{}])[-1].get("type") == "ByteLevel"
        self.plain = byte_level and sys.byteorder == "little" and kinds <= {"NFC", "Lowercase", "Replace"} and "Lowercase" in kinds
        # Added tokens are looked for before splits.
        self.plain = self.plain and all(_SIGNS.search(a) and not _PLAIN.fullmatch(a) for a in added)
        # The byte-level form of letters beyond ASCII, and the code of packed ids (both little-endian here).
        alphabet = {b: c for c, b in byte_alphabet().items()}
        self.forms = {c: "".join(alphabet[b] for b in chr(c).encode()) for c in range(0xC0, 0x100)}
        self.kind = "H" if self.width == 2 else "I"
        self.memo = _Generations(self._unit)

    def units(self, text: str) -> list[str]:
        if not self.plain or not _SAFE.fullmatch(text):
            return [w for w in text.replace("\n", " ").split(" ") if w]
        if _SIGNS.search(text):
            if _QUOTED.search(text) or any(a in text for a in self.added):
                return [w for w in text.replace("\n", " ").split(" ") if w]
            return _RUNS.findall(text.lower())
        text = text.lower()
        for mark in _MARKS:
            if mark in text:
                text = text.replace(mark, f" {mark} ")
        return text.split()

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, packed little-endian in ``dtype``."""
        self.memo.age()
        ids_of = self.memo.__getitem__
        return [b"".join(map(ids_of, self.units(t))) for t in texts]

    def _unit(self, unit: str) -> bytes:
        if self.plain and len(unit) <= MEMO_UNIT_CHARS:
            if _LETTERS.fullmatch(unit):
                return self._split(unit)
            if match := _PLAIN.fullmatch(unit):
                return self.memo[match[1].lower()] + self.memo[match[2]]
        return np.array(self.tokenizer.encode(unit, add_special_tokens=False).ids, dtype=self.dtype).tobytes()

    def _split(self, letters: str) -> bytes:
        """Ids of one split of lower-case letters, from the model itself."""
        form = letters if letters.isascii() else letters.translate(self.forms)
        return array(self.kind, [t.id for t in self.tokenizer.model.tokenize(form)]).tobytes()
