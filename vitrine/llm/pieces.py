"""Whole texts encoded through a memory of their parts.

The public byte-level pattern always starts a new match at a blank that is followed by a character other than
white space, and where a run of letters, signs or digits gives way to another of these kinds or to a line feed.
Cut there, the parts of a text encode one by one to the ids of the whole text, and words repeat, so each is
encoded once per task.
"""

from __future__ import annotations

import gc
import re
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np

#: Parts that one task remembers; beyond it the memory starts anew. It bounds memory, never the input.
REMEMBERED = 500_000


def narrowest(n_ids: int) -> str:
    """The little-endian type that holds the ids."""
    return "<u2" if n_ids <= 1 << 16 else "<u4"


# letters of the Latin blocks; ASCII signs without the apostrophe, which begins contractions
_LETTER, _SIGN = "A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F", r"!-&(-/:-@\[-`{-~"
# A run of letters, signs or digits, with a blank before it, where a blank, a line feed or another of these kinds
# follows; a line feed between other characters; else all up to the next blank before a character that isn't white space.
_PARTS = re.compile(
    rf" ?[{_LETTER}]+(?=[ \n0-9{_SIGN}]|\Z)| ?[{_SIGN}]+(?=[ \n0-9{_LETTER}]|\Z)| ?[0-9]+(?=[ \n{_LETTER}{_SIGN}]|\Z)"
    r"|(?<!\s)\n(?=\S|\Z| \S)| ?(?:(?! \S)[\s\S])+").findall
_ONE_MATCH = re.compile(rf" ?[{_LETTER}]+| ?[{_SIGN}]+| ?[0-9]+|\n").fullmatch


class PartCoder:
    """Texts to id bytes through a memory of parts. ``learn`` gives the id bytes of unseen parts, told apart by whether a
    part is one match of the pattern."""

    def __init__(self, learn: Callable[[list[str], list[str]], Iterable[tuple[str, bytes]]], remembered: int = REMEMBERED):
        self.learn, self.remembered = learn, remembered
        self.known: dict[str, bytes] = {}

    def __call__(self, texts: Sequence[str]) -> list[bytes]:
        collecting = gc.isenabled()
        gc.disable()  # millions of strings come and go, none of them in a cycle
        try:
            return self._encoded(texts)
        finally:
            if collecting:
                gc.enable()

    def _encoded(self, texts: Sequence[str]) -> list[bytes]:
        if len(self.known) > self.remembered:
            self.known = {}
        cut = [_PARTS(t) for t in texts]
        seen: set[str] = set()
        for parts in cut:
            seen.update(parts)
        new = seen.difference(self.known)
        one = [p for p in new if _ONE_MATCH(p)]
        self.known.update(self.learn(one, [p for p in new if not _ONE_MATCH(p)]))
        find = self.known.__getitem__
        return [b"".join(map(find, parts)) for parts in cut]


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in the vocabulary: printable bytes for themselves, the others from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class LibraryCoder:
    """Id bytes by the tokenizers library.

    Parts that are one match go straight to the library's model, which saves searching for matches again; other parts are
    encoded as texts of their own. A text that holds the string of a special token is encoded whole, as the library treats it.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.n_ids = max(self.tokenizer.get_vocab(with_added_tokens=True).values()) + 1
        self.type = narrowest(self.n_ids)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.letters, self.by_part = byte_letters(), PartCoder(self._learn, remembered)

    def ids(self, texts: Sequence[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.type) for e in
                self.tokenizer.encode_batch_fast(list(texts), add_special_tokens=False)]

    def _learn(self, one: list[str], other: list[str]) -> Iterator[tuple[str, bytes]]:
        tokenize, letters, flat, stops = self.tokenizer.model.tokenize, self.letters, [], [0]
        for part in one:
            flat += [token.id for token in tokenize(part.encode().decode("latin-1").translate(letters))]
            stops.append(len(flat))
        ids = np.array(flat, self.type)
        body, places = ids.tobytes(), [ids.itemsize * k for k in stops]
        yield from zip(one, [body[a:b] for a, b in zip(places, places[1:])])
        yield from zip(other, [ids.tobytes() for ids in self.ids(other)])

    def __call__(self, texts: Sequence[str]) -> list[bytes]:
        whole = {i for i, t in enumerate(texts) if any(s in t for s in self.special)}
        if not whole:
            return self.by_part(texts)
        rest = iter(self.by_part([t for i, t in enumerate(texts) if i not in whole]))
        own = iter(self.ids([t for i, t in enumerate(texts) if i in whole]))
        return [next(own).tobytes() if i in whole else next(rest) for i in range(len(texts))]
