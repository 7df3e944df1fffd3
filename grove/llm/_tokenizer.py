"""Token ids as the tokenizers library gives them, with a memory of pieces within each Python worker.

A JSON file whose normaliser and pre-tokeniser are those of a lower-casing word BPE (NFC, white space to one
space, lower case; then letters, single digits, runs of other characters) drops white space and encodes
each piece between on its own. Such texts are cut at ASCII white space and, where a stretch has only
characters that NFC leaves alone, into the pieces themselves; the library encodes each distinct piece once.
Any other file gets whole texts. Special tokens' strings inside texts go to the library as they stand.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from functools import lru_cache

import numpy as np

#: The split pattern and normaliser of the word BPE files this memory is valid for.
WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
#: Printable ASCII without the apostrophe, ASCII white space and Latin-1 letters: NFC and the pattern are plain on these.
PLAIN = re.compile(r"[\x09-\x0d\x20-&(-~À-ÖØ-öø-ÿ]*")
PIECES = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[!-&(-/:-@\[-`{-~]+")
#: Pieces remembered by a worker, of so many characters at most; beyond that the memory is emptied. Results don't depend on it.
REMEMBERED, LONGEST = 600_000, 64


def byte_letters() -> list[str]:
    """The character that byte-level BPE writes for each byte: itself if it prints, else the next from U+0100."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in prints else chr(next(rest)) for b in range(256)]


def file_digest(path: str) -> str:
    """Digest of the tokenizer's file, with the library's version: equal digests give equal counts."""
    import tokenizers

    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + tokenizers.__version__.encode()).hexdigest()


class Encoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}, {}])
        self.by_piece = (
            (spec.get("normalizer") or {}).get("normalizers") == WORD_NORMALIZER
            and [s.get("type") for s in steps] == ["Split", "ByteLevel"]
            and steps[0].get("pattern") == {"Regex": WORD_SPLIT}
            and steps[0].get("behavior") == "Removed"
            and steps[0].get("invert") is True
            and not steps[1].get("add_prefix_space", True)
            and not steps[1].get("use_regex", True)
            and spec["model"].get("end_of_word_suffix") == "</w>"
            and not spec["model"].get("dropout")
            and not any(re.search(r"\s", t["content"]) or t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"])
        )
        if self.by_piece:
            self.marks = tuple({t["content"][:2] for t in spec["added_tokens"]})
            self.letters = byte_letters()
            self.bare = Tokenizer(self.whole.model)
            self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
            vocabulary = self.bare.get_vocab()
            self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.memory: dict[str, bytes] = {}

    def _pieces(self, text: str) -> list[str]:
        """Pieces in order; those that start with a space are stretches for the whole library."""
        if PLAIN.fullmatch(text) and not any(m in text for m in self.marks):
            return PIECES.findall(text.lower())
        out: list[str] = []
        for chunk in re.findall(r"[^\x20\x09-\x0d]+", text):
            if PLAIN.fullmatch(chunk) and not any(m in chunk for m in self.marks):
                out += PIECES.findall(chunk.lower())
            else:
                out.append(f" {chunk}")
        return out

    def _learn(self, pieces: set[str]) -> None:
        plain = [p for p in pieces if p[0] != " "]
        odd = [p for p in pieces if p[0] == " "]
        for i in range(0, len(plain), 500):
            some = plain[i : i + 500]
            # Printing ASCII is written as it is. The fast batch makes no offsets.
            joined = " ".join(p if p.isascii() else "".join(map(self.letters.__getitem__, p.encode())) for p in some)
            ids = np.array(self.bare.encode_batch_fast([joined], add_special_tokens=False)[0].ids, "<u4")
            cuts = (np.flatnonzero(self.ends[ids]) + 1) * 4
            if len(cuts) != len(some):  # a vocabulary that doesn't end its words: each on its own
                odd += [f" {p}" for p in some]
                self.memory.update((p, self._ids(p)) for p in some)
                continue
            raw, start = ids.tobytes(), 0
            for p, end in zip(some, cuts.tolist(), strict=True):
                self.memory[p] = raw[start:end]
                start = end
        for p in odd:
            self.memory[p] = self._ids(p[1:])

    def _ids(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text (null: none) as little-endian unsigned 32-bit integers."""
        if not self.by_piece:
            return [self._ids(t or "") for t in texts]
        cut = [self._pieces(t) if t else [] for t in texts]
        new = set().union(*cut).difference(self.memory)
        if len(self.memory) + len(new) > REMEMBERED:
            self.memory.clear()
            new = set().union(*cut)
        self._learn(new)
        out = [b"".join(map(self.memory.__getitem__, pieces)) for pieces in cut]
        for p in new:
            if len(p) > LONGEST:
                del self.memory[p]
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One per Python worker."""
    return Encoder(path)
