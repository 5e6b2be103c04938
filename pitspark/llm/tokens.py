"""Token ids of whole texts by a tokenizers file, with a cache of the pieces between white space.

Neither vocabulary lets a token span the place where white space begins after other characters: the
pattern that splits a text before any merge ends a match there. So a text may be cut at those places,
each distinct piece encoded once by the library, and the ids joined. Where white space counts, a text
with white space outside ASCII is given to the library whole.
"""

from __future__ import annotations

import functools
import os
import re

import numpy as np

#: Distinct pieces kept by one worker, and the longest piece that is kept.
CACHED_PIECES = 1_200_000
LONGEST_CACHED = 48

_WIDE_SPACE = re.compile("[\x85\xa0  -     　]")
_SPACE_THEN_WORD = re.compile(rb"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+").findall


def pieces_with_space(text: str) -> list[bytes]:
    """UTF-8 pieces that each begin where white space begins; their concatenation is the text."""
    if not text.isascii() and _WIDE_SPACE.search(text):
        return [text.encode()]
    return _SPACE_THEN_WORD(text.encode())


def pieces_without_space(text: str) -> list[bytes]:
    """UTF-8 pieces between ASCII white space, for vocabularies that drop white space."""
    return text.encode().split()


class TextEncoder:
    """Texts to little-endian unsigned ids of ``width`` bytes each."""

    def __init__(self, path: str, keeps_space: bool, width: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.split = pieces_with_space if keeps_space else pieces_without_space
        self.kind = f"<u{width}"
        self.cache: dict[bytes, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, without any special token."""
        lists = [self.split(t) for t in texts]
        missing = list(set().union(*lists).difference(self.cache))
        long: dict[bytes, bytes] = {}
        if missing:
            if len(self.cache) + len(missing) > CACHED_PIECES:
                self.cache.clear()
                missing = list(set().union(*lists))
            found = self.tokenizer.encode_batch_fast([m.decode() for m in missing], add_special_tokens=False)
            for piece, e in zip(missing, found):
                (self.cache if len(piece) <= LONGEST_CACHED else long)[piece] = np.array(e.ids, self.kind).tobytes()
        if not long:
            return [b"".join(map(self.cache.__getitem__, pieces)) for pieces in lists]
        return [b"".join(long[p] if p in long else self.cache[p] for p in pieces) for pieces in lists]


@functools.lru_cache(maxsize=4)
def text_encoder(path: str, keeps_space: bool, width: int) -> TextEncoder:
    """One encoder for each worker process."""
    return TextEncoder(path, keeps_space, width)
