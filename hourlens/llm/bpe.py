"""Counting and encoding whole texts with a byte-pair tokenizer through pieces that tokenize alone.

A tokenizer's own rule never joins characters across certain borders: the
byte-level one cuts in front of every single space, the word one drops white
space. Texts are cut there first; a piece's tokens then depend on nothing else
and can be looked up. What a lookup does not know is encoded by the library.
"""

from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Callable, Collection
from functools import lru_cache

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

import regex  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

#: Characters on whose class or case the library and Python might differ: separators 28 to 31, which only
#: Python takes for white space, capital sigma, and all beyond the Latin blocks (these are looked at closer).
_RARE = re.compile("[\x1c-\x1fƀ-\U0010ffff]")
_OLD = unicodedata.ucd_3_2_0


@lru_cache(maxsize=4)
def load(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


@lru_cache(maxsize=4)
def special(path: str) -> tuple[dict[str, int], re.Pattern | None]:
    """Special strings with their ids, and a pattern that finds them."""
    found = {t.content: i for i, t in load(path).get_added_tokens_decoder().items()}
    longest = sorted(found, key=len, reverse=True)
    return found, re.compile("|".join(map(re.escape, longest))) if found else None


def plain(text: str) -> bool:
    """Whether all characters of a text have classes, cases and forms that no Unicode version disputes."""
    if _RARE.search(text) is None:
        return True
    return all(
        c not in "\x1c\x1d\x1e\x1fΣ" and _OLD.category(c) == unicodedata.category(c) != "Cn"
        and unicodedata.normalize("NFC", c) == c and not unicodedata.combining(c)
        for c in set(text) if c > "ſ" or c < " "
    )


#: A space that the byte-level rule does not cut in front of: after white space, before more or the end.
_INNER_SPACE = re.compile(r"\s (?:\s|\Z)")


def space_pieces(text: str) -> list[str] | None:
    """Pieces in front of each but the first of which a space was cut, or None for texts to encode as a whole."""
    return text.split(" ") if plain(text) and not _INNER_SPACE.search(text) else None


#: A full stop or comma beside another sign, with which it would make one part. The rule takes "_" for a sign.
_JOINED_SIGNS = re.compile(r"[.,](?:(?=_|[^\w\s])|(?<=_.)|(?<=[^\w\s].))")


def spaced(text: str) -> str | None:
    """The text in lower case with pieces between white space, or None for texts to encode as a whole.

    Single full stops and commas are parts of their own by the rule and are
    cut off, so that fewer different pieces are met.
    """
    if not plain(text):
        return None
    text = text.lower()
    return text if _JOINED_SIGNS.search(text) else text.replace(".", " . ").replace(",", " , ")


def _byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: itself if it prints, else the next free one."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    free = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(free)) for b in range(256)]


_LETTERS = _byte_letters()
_WRITTEN = dict(enumerate(_LETTERS))
_CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
#: Splitting rules of the two kinds of tokenizer, fixed values.
SPACED = regex.compile(_CONTRACTIONS + r"| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
UNSPACED = regex.compile(_CONTRACTIONS + r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


@lru_cache(maxsize=4)
def piece_encoder(path: str, rule: regex.Pattern) -> Callable[[str], list]:
    """Tokens of a piece of plain text by the library's model, without the cost of a full encoding with offsets."""
    tokenize = load(path).model.tokenize

    def encode(piece: str) -> list:
        if piece.isalpha():  # one part, in ASCII written as itself
            return tokenize(piece if piece.isascii() else piece.encode().decode("latin-1").translate(_WRITTEN))
        return [token for part in rule.findall(piece)
                for token in tokenize("".join([_LETTERS[b] for b in part.encode()]))]

    return encode


def after_space(path: str) -> Callable[[str], list]:
    """As above for a piece in front of which a space was cut."""
    tokenize, encode, space = load(path).model.tokenize, piece_encoder(path, SPACED), _LETTERS[32]
    return lambda piece: tokenize(space + piece) if piece.isascii() and piece.isalpha() else encode(" " + piece)


class Cache(dict):
    """Values of pieces met by this worker. It starts anew when it holds ``size`` pieces, which bounds memory."""

    def __init__(self, encode: Callable[[list[str]], list], size: int):
        super().__init__()
        self.encode, self.size = encode, size

    def add(self, pieces: Collection[str]) -> None:
        """Afterwards all of these distinct pieces are known."""
        new = [p for p in pieces if p not in self]
        if len(self) + len(new) > self.size:
            self.clear()
            new = list(pieces)
        self.update(zip(new, self.encode(new)))
