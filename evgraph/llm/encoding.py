"""Whole-text encoding with the tokenizers library inside Spark tasks.

Neither vocabulary lets a token cross the places where a text is cut here, so a text's ids are those of its parts, one after
the other, and most parts are words seen before. Each Python worker keeps the ids of a bounded number of parts in recent use and
has the library merge the others, those of a group of texts together.

A text of plain characters alone is cut into the pieces of the vocabulary's own pattern. Any other text is cut into chunks:
- for the lower-casing word vocabulary at spaces and line feeds, which it drops;
- for the byte-level vocabulary before every run of white space, which starts a new token there.
Plain chunks are made of pieces; the library encodes the others whole.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

PIECE_ROOM, CHUNK_ROOM, CHUNK_CHARS = 1_000_000, 100_000, 64
GROUP_CHARS = 1 << 20  # characters of the texts whose new pieces are merged together

#: White space as the tokenizer files' patterns have it (the Unicode property).
BLANK = "\t-\r \x85\xa0  -     　"
#: Letters of the plain alphabet below, for which Python's and the library's character classes agree.
LETTER, LOW = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u017e", "a-z\xdf-\xf6\xf8-\u017e"
PLAIN = re.compile(f"[ \n!-~{LETTER}]*")
SHORT_FORMS = "'(?:s|t|re|ve|m|ll|d)"
WORD_PIECES = re.compile(rf"[{LOW}]++|{SHORT_FORMS}|[0-9]|[^ \n{LOW}0-9]++")
BYTE_PIECES = re.compile(rf" ?[{LETTER}]++|{SHORT_FORMS}| ?[0-9]++| ?[^ \n{LETTER}0-9]++|[ \n]+(?![^ \n])|[ \n]++")
MARKS = (".", ",", "!", "?", ":", ";")
SEGMENTS = re.compile(f"[{BLANK}]*[^{BLANK}]+|[{BLANK}]+")
#: Texts of these characters alone can be lower-cased before they are cut: no letter here composes or changes its length.
LOWERS = re.compile("[\x00-įı-ž‐-‧‰-⁞]*")


def byte_letters() -> dict[int, str]:
    """Byte -> the printable character that stands for it in byte-level vocabularies (fixed values)."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("\xa1"), ord("\xac") + 1), *range(ord("\xae"), ord("\xff") + 1)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class Memo(dict):
    """chunk -> make(chunk) for at most `room` chunks of at most CHUNK_CHARS characters.

    Half of them are entered anew each time that half is full, so chunks that are no longer used go.
    """

    def __init__(self, make: Callable, room: int):
        super().__init__()
        self.make, self.room, self.before = make, room, {}

    def keep(self, chunk: str, found) -> None:
        if len(chunk) <= CHUNK_CHARS:
            if len(self) >= self.room // 2:
                self.before = self.copy()
                self.clear()
            self[chunk] = found

    def __missing__(self, chunk: str):
        found = self.before.get(chunk)
        if found is None:
            found = self.make(chunk)
        self.keep(chunk, found)
        return found


class Pieces(dict):
    """piece -> ids; a piece that is not known stands for itself and is noted in `wanted`."""

    def __init__(self, room: int):
        super().__init__()
        self.room, self.before, self.wanted = room, {}, {}

    def __missing__(self, piece: str) -> bytes | str:
        found = self.before.get(piece)
        if found is None:
            self.wanted[piece] = None
            return piece
        self[piece] = found
        return found

    def learn(self, make: Callable[[str], bytes | None]) -> dict[str, bytes | None]:
        """Makes and keeps what was wanted; None is not kept."""
        made = {piece: make(piece) for piece in self.wanted}
        self.wanted = {}
        if len(self) >= self.room // 2:
            self.before = self.copy()
            self.clear()
        self.update({k: v for k, v in made.items() if v is not None and len(k) <= CHUNK_CHARS})
        return made


class Encoder:
    """Texts -> the library's ids of each whole text, as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.letters = byte_letters()
        self.words = self.tokenizer.normalizer is not None
        self.cut = (WORD_PIECES if self.words else BYTE_PIECES).findall
        self.pieces, self.chunks = Pieces(PIECE_ROOM), Memo(self._chunk, CHUNK_ROOM)
        self.vocab_size = self.tokenizer.get_vocab_size()
        self.bytes_of = [k.to_bytes(4, "little") for k in range(self.vocab_size)]

    def _piece(self, piece: str) -> bytes | None:
        """Ids of a piece, or None if it isn't plain."""
        if not piece.isascii() or not piece.isalpha():
            if not PLAIN.fullmatch(piece):
                return None
            piece = piece.encode().decode("latin-1").translate(self.letters)
        of = self.bytes_of
        return b"".join([of[t.id] for t in self.model.tokenize(piece)])

    def _chunk(self, chunk: str) -> bytes:
        low = chunk.lower() if self.words else chunk
        if "<|" not in chunk and PLAIN.fullmatch(chunk) and PLAIN.fullmatch(low):
            return b"".join(map(self._piece, self.cut(low)))
        return array("I", self.tokenizer.encode(chunk, add_special_tokens=False).ids).tobytes()

    def _in_chunks(self, text: str) -> bytes:
        return b"".join(map(self.chunks.__getitem__, text.replace("\n", " ").split(" ") if self.words else SEGMENTS.findall(text)))

    def _in_pieces(self, text: str) -> list[bytes | str] | None:
        if "<|" in text or (self.words and not (text.isascii() or LOWERS.fullmatch(text))):  # added tokens go by the text as it is
            return None
        return list(map(self.pieces.__getitem__, self.cut(text.lower() if self.words else text)))

    def encode_all(self, texts: Iterable[str]) -> Iterator[bytes]:
        """The ids of each text, in order."""
        group: list[tuple[str, list[bytes | str] | None]] = []
        size = 0
        for text in texts:
            group.append((text, self._in_pieces(text)))
            size += len(text)
            if size >= GROUP_CHARS:
                yield from self._joined(group)
                group, size = [], 0
        yield from self._joined(group)

    def _joined(self, group: list[tuple[str, list[bytes | str] | None]]) -> Iterator[bytes]:
        new = self.pieces.learn(self._piece)
        odd = {piece for piece, ids in new.items() if ids is None}
        for text, parts in group:
            if parts is None or (odd and not odd.isdisjoint(parts)):
                yield self._in_chunks(text)
            else:
                yield b"".join([x if type(x) is bytes else new[x] for x in parts])

    def encode(self, text: str) -> bytes:
        return next(self.encode_all([text]))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One per worker process and vocabulary; it outlives the task."""
    return Encoder(path)
