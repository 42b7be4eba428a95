"""Token ids of whole texts, by a public tokenizer."""

from __future__ import annotations

import json
import os
from array import array


class Encoder:
    """Encodes texts with a tokenizers file, remembering the ids of each word.

    The tokenizer drops white space and never joins what white space parts, so a text's ids are those
    of its parts between spaces and line ends in order. Where the file says that the tokenizer
    lower-cases and parts letters from other marks, a new word takes the ids of its lower-case form and
    of the marks after it. The memory of words has two halves: when the younger exceeds half of
    ``most_bytes``, it becomes the older one, whose words stay known if they occur again.
    """

    def __init__(self, path: str | None = None, most_bytes: int = 256 << 20) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("word_bpe_49k.json")
        self.tokenizer = Tokenizer.from_file(str(path))
        self.known: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}
        self.most, self.held = most_bytes // 2, 0
        self.parts = _parts_marks(json.loads(self.tokenizer.to_str()))

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        if self.held > self.most:
            self.older, self.known, self.held = self.known, {"": b""}, 0
        known, found, gaps, new = self.known, [], [], set()
        for text in texts:
            words = (text or "").replace("\n", " ").split(" ")
            got = list(map(known.get, words))
            if None in got:
                at = [i for i, g in enumerate(got) if g is None]
                missing = [words[i] for i in at]
                new.update(missing)
                gaps.append((got, at, missing))
            found.append(got)
        if new:
            formed = {w: self._forms(w) for w in new} if self.parts else {w: (w,) for w in new}
            ids = self._ids({f for forms in formed.values() for f in forms})
            for w, forms in formed.items():
                known[w] = x = ids[forms[0]] if len(forms) == 1 else ids[forms[0]] + ids[forms[1]]
                self.held += len(w) + len(x) + 150
            for got, at, missing in gaps:
                for i, w in zip(at, missing):
                    got[i] = known[w]
        return [b"".join(got) for got in found]

    def _forms(self, word: str) -> tuple[str, ...]:
        """The words whose ids make up a word's. Words that may hold a special token, or characters beyond Latin-1, keep their form."""
        if "<" in word or not word or not word.isascii() and max(word) > LATIN:
            return (word,)
        stem = word.rstrip(MARKS)
        if not stem[-1:].isalpha():
            stem = word
        marks, stem = word[len(stem) :], stem.lower()
        return (stem, marks) if marks else (stem,)

    def _ids(self, words: set[str]) -> dict[str, bytes]:
        """The ids of words: known ones, then words of lower-case letters by the model alone, then the rest by all steps of the tokenizer."""
        out, rest = {}, []
        known, older, tokenize = self.known.get, self.older.get, self.tokenizer.model.tokenize
        for w in words:
            ids = known(w)
            if ids is None:
                ids = older(w)
            if ids is not None:
                out[w] = ids
            elif self.parts and w.isalpha() and (w.isascii() or max(w) <= LATIN) and w == w.lower():
                out[w] = array("I", [t.id for t in tokenize(w if w.isascii() else w.encode().decode("latin-1").translate(BYTE_SIGNS))]).tobytes()
            else:
                rest.append(w)
        for w, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)):
            out[w] = array("I", e.ids).tobytes()
        return out


#: Marks that a letter before them is parted from.
MARKS = ".,;:!?)%&"
#: The last character of Latin-1; up to it, letters are composed already and have one lower-case letter.
LATIN = "\u00ff"
#: The signs by which byte-level models write bytes: printable ones by themselves, the others from 256 on.
_OTHER = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)]
BYTE_SIGNS = {b: 256 + k for k, b in enumerate(_OTHER)}


def _parts_marks(file: dict) -> bool:
    """Whether a tokenizers file composes and lower-cases, splits into letters, digits and runs of other marks, and has a byte-level BPE."""
    normalizers = (file.get("normalizer") or {}).get("normalizers") or [file.get("normalizer") or {}]
    splits = (file.get("pre_tokenizer") or {}).get("pretokenizers") or [file.get("pre_tokenizer") or {}]
    pattern = (splits[0].get("pattern") or {}).get("Regex", "")
    bytewise = splits[-1].get("type") == "ByteLevel" and not splits[-1].get("add_prefix_space") and not splits[-1].get("use_regex")
    if not bytewise or [n.get("type") for n in normalizers] != ["NFC", "Replace", "Lowercase"] or file.get("model", {}).get("type", "BPE") != "BPE":
        return False
    return splits[0].get("type") == "Split" and pattern.endswith(r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


_ENCODERS: dict[tuple[str | None, int], Encoder] = {}


def encoder(path: str | None = None, most_bytes: int = 256 << 20) -> Encoder:
    """This worker's encoder of a tokenizers file; by default word_bpe_49k.json of public_tokenizers."""
    if (path, most_bytes) not in _ENCODERS:
        _ENCODERS[path, most_bytes] = Encoder(path, most_bytes)
    return _ENCODERS[path, most_bytes]
