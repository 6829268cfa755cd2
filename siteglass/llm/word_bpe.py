"""Token ids of a word BPE vocabulary, with whole tokens looked up directly.

A text falls into pre-tokens by a fixed pattern, and each is encoded alone. Most are one
entry of the vocabulary. Which entries stand for themselves is proved beforehand: an
entry is kept if the library encodes its string alone as just that one token. A pre-token
among these needs no merging; all others go through the library's merges once and are
remembered while the worker has room.
"""

from __future__ import annotations

import json
from functools import cache
from itertools import chain

import numpy as np
import regex
from tokenizers import Tokenizer

# Chunks remembered per worker, some 150 bytes each.
REMEMBERED = 1_200_000

# Texts of these characters alone are lower-cased and cut at white space the same way by
# Python and by the tokenizer; others go through the tokenizer's own normalizer.
_UNUSUAL = regex.compile(r"[^\x00-\x1b\x20-ɏ]")


class WordBpe:
    """Encoder for a ``tokenizers`` file with NFC, lower case and ``</w>`` word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            settings = json.load(file)
        self.special = {t["content"]: t["id"] for t in settings["added_tokens"]}
        self._special = regex.compile("|".join(regex.escape(t) for t in self.special))
        pattern = settings["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self._pieces = regex.compile(pattern)
        self._normalizer = Tokenizer.from_file(path).normalizer
        settings["normalizer"], settings["added_tokens"] = None, []
        self._merging = Tokenizer.from_str(json.dumps(settings))
        vocabulary = self._merging.get_vocab()
        self._ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self._ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.whole = self._prove_whole(vocabulary)
        self._known = dict(self.whole)

    def _prove_whole(self, vocabulary: dict[str, int]) -> dict[str, bytes]:
        """Strings that encode alone as one token: string -> its id as bytes."""
        ids = np.array([i for t, i in vocabulary.items() if t.endswith("</w>")], dtype="<u4")
        texts = [t.strip() for t in self._merging.decode_batch(ids.reshape(-1, 1).tolist())]
        texts = [t.removesuffix("</w>") for t in texts]
        alone = self._merging.encode_batch_fast(texts, add_special_tokens=False)
        return {
            text: i.tobytes()
            for text, i, found in zip(texts, ids, alone)
            if found.ids == [int(i)] and self._pieces.fullmatch(text)
        }

    def _chunks(self, text: str) -> list[str]:
        """Runs without white space of a normalized text; no pre-token spans two."""
        if _UNUSUAL.search(text):
            return self._normalizer.normalize_str(text).split(" ")
        return text.lower().split()

    def _learn(self, chunks: set[str]) -> None:
        """Encode chunks not seen before: whole tokens directly, the rest by merges."""
        odd = {c for c in chunks if not c.isascii() and _UNUSUAL.search(c)}
        findall, known = self._pieces.findall, self._known
        cut = {c: findall(c) for c in chunks if c not in odd}
        plain = [p for p in set(chain.from_iterable(cut.values())) if p not in known]
        merged = {}
        if plain:
            joined = self._merging.encode_batch_fast([" ".join(plain)], add_special_tokens=False)
            ids = np.array(joined[0].ids, dtype="<u4")
            # Pre-tokens end with a token that carries the word end.
            ends = np.flatnonzero(self._ends[ids]) + 1
            raw, starts = ids.tobytes(), np.concatenate([[0], ends[:-1]])
            merged = {p: raw[4 * a : 4 * b] for p, a, b in zip(plain, starts.tolist(), ends.tolist())}
        for chunk, pieces in cut.items():
            if len(pieces) == 1:
                known[chunk] = merged.get(pieces[0]) or known[pieces[0]]
            else:
                known[chunk] = b"".join([merged.get(p) or known[p] for p in pieces])
        for chunk in odd:
            ids = self._merging.encode(chunk, add_special_tokens=False).ids
            known[chunk] = np.array(ids, dtype="<u4").tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of every text as little-endian unsigned 32-bit numbers; none for null."""
        parts: list[list] = []
        for text in texts:
            text = text or ""
            if "<|" in text and self._special.search(text):
                row, at = [], 0
                for m in self._special.finditer(text):
                    row += [*self._chunks(text[at : m.start()]), self.special[m[0]]]
                    at = m.end()
                parts.append(row + self._chunks(text[at:]))
            else:
                parts.append(self._chunks(text))
        if len(self._known) > REMEMBERED:
            self._known = dict(self.whole)
        new = set().union(*parts) if parts else set()
        new = {c for c in new if c not in self._known}
        for number in [c for c in new if isinstance(c, int)]:
            self._known[number] = int(number).to_bytes(4, "little")
            new.discard(number)
        if new:
            self._learn(new)
        find = self._known.__getitem__
        return [b"".join(map(find, row)) for row in parts]


@cache
def encoder(path: str) -> WordBpe:
    """One encoder per worker process and file."""
    return WordBpe(path)


def batches(texts: list[str | None], size: int = 1_000_000):
    """Slices of a list with about ``size`` characters each, one text at least."""
    start = total = 0
    for i, text in enumerate(texts):
        total += len(text or "")
        if total >= size:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
