"""Token ids of texts by a public byte-level BPE tokenizer, each distinct space-led piece encoded once."""

from __future__ import annotations

import array
import os
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np

_encoders: dict[str, Encoder] = {}
_BREAK = re.compile(r"(?<!\s) ")
_ANY = re.compile(r"\s")
_WIDE = re.compile(r"\s ")
#: ASCII marks but the apostrophe, which can begin a word
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: pieces that go through the tokenizer together
AT_ONCE = 100
#: ends of pieces that are kept
ENDS = 100_000


def default_tokenizer() -> str:
    """The tokenizer file that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids of whole texts, equal to ``Tokenizer.encode(text, add_special_tokens=False)``.

    The tokenizer splits a text before it merges bytes, and always splits before a space that follows a visible
    character. So the ids of a text are those of the pieces between such places, and pieces repeat: each is encoded
    once while it stays in the cache. The cache bounds memory only; when full, its longer half goes.
    Strings of special tokens within a text are ordinary text.
    """

    def __init__(self, path: str, cache_size: int = 1_200_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.cache: dict[str, bytes] = {}
        self.cache_size = cache_size
        line, pair = (self.tokenizer.encode(x, add_special_tokens=False).ids for x in ("\n", "x\n x"))
        self.line_end = line[0] if len(line) == 1 and pair.count(line[0]) == 1 else None
        self.ends: dict[str, bytes] = {}
        self.by_class = self.tokenizer.normalizer is None and str(self.tokenizer.pre_tokenizer).startswith("ByteLevel(") and "use_regex=True" in str(self.tokenizer.pre_tokenizer)

    @classmethod
    def of(cls, path: str) -> Encoder:
        """One encoder for each Python worker."""
        if path not in _encoders:
            _encoders[path] = cls(path)
        return _encoders[path]

    @property
    def vocabulary(self) -> int:
        return self.tokenizer.get_vocab_size()

    def _ids(self, pieces: list[str]) -> Iterator[bytes]:
        for lo in range(0, len(pieces), 2000):
            for e in self.tokenizer.encode_batch_fast(pieces[lo : lo + 2000], add_special_tokens=False):
                yield array.array("I", e.ids).tobytes()

    def _learn(self, parts: list[str]) -> None:
        """Put the ids of each part, led by a space, into the cache.

        A part that ends with marks after a letter or digit is that of its stem and of the marks, between which the
        tokenizer splits. Parts without white space go through the tokenizer many at once, a line each: it splits
        before the space after a line end, and only a line end has that id.
        """
        stems = self._stems(parts) if self.by_class else {}
        if stems:
            whole = [x for x in parts if x not in stems]
            parts = whole + list({stem for stem, _ in stems.values()}.difference(self.cache, whole))
        plain = [x for x in parts if x.isalnum() or x and _ANY.search(x) is None] if self.line_end is not None else []
        for lo in range(0, len(plain), AT_ONCE):
            some = plain[lo : lo + AT_ONCE]
            ids = self.tokenizer.encode_batch_fast([" " + "\n ".join(some)], add_special_tokens=False)[0].ids
            flat = np.array(ids, "<u4")
            ends = (np.append(np.flatnonzero(flat == self.line_end), len(flat)) * 4).tolist()
            raw = flat.tobytes()
            self.cache.update(zip(some, [raw[a + 4 : b] for a, b in zip([-4, *ends], ends)], strict=True))
        rest = [x for x in parts if x not in self.cache]
        self.cache.update(zip(rest, self._ids([f" {x}" for x in rest])))
        if stems:
            if len(self.ends) > ENDS:
                self.ends = {}
            new = list({end for _, end in stems.values()}.difference(self.ends))
            self.ends.update(zip(new, self._ids(new)))
            known, ends = self.cache, self.ends
            known.update([(x, known[stem] + ends[end]) for x, (stem, end) in stems.items()])

    def _stems(self, parts: list[str]) -> dict[str, tuple[str, str]]:
        """The stem and the marks of each part that ends with marks after a Latin letter or a digit."""
        out = {}
        for x in parts:
            if not x.isalnum() and x and (stem := x.rstrip(_MARKS)) and len(stem) < len(x) and stem[-1] < "\u0250" and stem[-1].isalnum():
                out[x] = stem, x[len(stem) :]
        return out

    def _shrink(self, needed: set[str]) -> None:
        """Keep the shorter half, which are the more frequent, and what is needed now."""
        kept = sorted(self.cache, key=len)[: self.cache_size // 2]
        self.cache = {x: self.cache[x] for x in kept} | {x: self.cache[x] for x in needed if x in self.cache}

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers; a null text has none."""
        heads: list[str] = []
        split: list[list[str]] = []
        for text in texts:
            text = text or ""
            parts = _BREAK.split(text) if _WIDE.search(text) else text.split(" ")
            if parts[0] == "" and len(parts) > 1 and _WIDE.match(text) is not None:
                heads.append(text)
                split.append([])
                continue
            heads.append(parts[0])
            split.append(parts[1:])
        new = list(set(chain.from_iterable(split)).difference(self.cache))
        if len(self.cache) + len(new) > self.cache_size:
            self._shrink(set(chain.from_iterable(split)))
            new = list(set(chain.from_iterable(split)).difference(self.cache))
        self._learn(new)
        known = self.cache.__getitem__
        return [h + b"".join(map(known, rest)) for h, rest in zip(self._ids(heads), split)]
