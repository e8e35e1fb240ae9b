"""Token ids and counts of a public tokenizer, with a bounded memory of the chunks already encoded.

Tokenizers that split text before they merge by one of the two patterns in CUTS have no token across the
cuts made below, so the ids of a text are those of its chunks, one after another. Texts with characters
for which that is not certain (white space beyond blank, tab, line feed and carriage return; special
strings) are encoded whole, and so are all texts with any other tokenizer.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from functools import lru_cache

from . import common

#: Chunks that a worker remembers in each of two generations; when one is full, the older is forgotten.
REMEMBERED = 250_000

#: Letters that begin a word and end where no letter or mark can follow are a chunk; so is what follows, up to white space.
LETTERS = r"[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff\u0152\u0153]++(?![^\x00-\x7f])"
WORDS = re.compile(LETTERS + r"|[^ \t\r\n]+")
#: One blank belongs to the word after it; of other white space the last character stands alone before a word.
SPACED = re.compile(" ?" + LETTERS + r"| ?[^ \t\r\n]+|[ \t\r\n]+(?![^ \t\r\n])|[ \t\r\n]")
RARE = re.compile(r"[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200d\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]|<\|")


#: How a tokenizer's file normalises and splits where the cuts hold.
CUTS = {
    "spaced": (None, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}),
    "words": (
        {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
        {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
    ),
}


@lru_cache(4)
def cuts(path: str) -> str | None:
    """Which of CUTS a tokenizer's file has; none: nothing is known of it."""
    with open(path, encoding="utf-8") as f:
        whole = json.load(f)
    special = all(x["content"].startswith("<|") for x in whole.get("added_tokens") or [])
    return next((k for k, v in CUTS.items() if special and (whole.get("normalizer"), whole.get("pre_tokenizer")) == v), None)


@lru_cache(4)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


@lru_cache(4)
def version(path: str) -> str:
    """Digest of a tokenizer's file."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def odd(text: str) -> bool:
    """Whether a text has to be encoded whole."""
    if text.isascii():
        return "<|" in text or any(c in text for c in "\x0b\x0c\x1c\x1d\x1e\x1f")
    return RARE.search(text) is not None


class Encoder:
    """Ids of texts as arrays of ``width`` bytes each."""

    def __init__(self, path: str):
        self.t, self.find = tokenizer(path), {"spaced": SPACED.findall, "words": WORDS.findall, None: None}[cuts(path)]
        self.known: dict = {}
        self.older: dict = {}
        self.width = 2 if self.t.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.code = {2: "H", 4: "I"}[self.width]
        common.remembered.append(self.forget)

    def forget(self) -> None:
        self.known, self.older = {}, {}

    def value(self, ids: list[int]):
        return array(self.code, ids).tobytes()

    def learn(self, wanted: set[str]) -> dict:
        """What is known after the chunks of ``wanted`` are."""
        known = self.known
        if len(known) > REMEMBERED:
            self.older, self.known = known, {}
            known = self.known
        older, miss = self.older, []
        for c in wanted:
            if c not in known:
                if c in older:
                    known[c] = older[c]
                else:
                    miss.append(c)
        for c, e in zip(miss, self.t.encode_batch_fast(miss, add_special_tokens=False)):
            known[c] = self.value(e.ids)
        return known

    def of(self, texts: list[str]) -> list:
        """The value of each text, from those of its chunks."""
        out: list = [None] * len(texts)
        whole = [i for i, x in enumerate(texts) if self.find is None or odd(x)]
        for i, e in zip(whole, self.t.encode_batch_fast([texts[i] for i in whole], add_special_tokens=False)):
            out[i] = self.value(e.ids)
        plain = [i for i in range(len(texts)) if out[i] is None]
        cut = [self.find(texts[i]) for i in plain]
        get = self.learn(set().union(*cut)).__getitem__
        for i, c in zip(plain, cut):
            out[i] = self.total(map(get, c))
        return out

    total = staticmethod(b"".join)


class Counter(Encoder):
    """Token counts instead of ids."""

    def value(self, ids: list[int]) -> int:
        return len(ids)

    total = staticmethod(sum)


@lru_cache(4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


@lru_cache(4)
def counter(path: str) -> Counter:
    return Counter(path)
