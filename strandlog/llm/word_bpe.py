"""Encoding with the tokenizers library, a text's words one by one with the known ones remembered."""

from __future__ import annotations

import os
import re
from collections.abc import Collection, Iterator
from struct import pack

#: A process remembers the ids of about so many pieces of up to LONGEST characters, some 100 MB; then it forgets those of the older half that weren't met again.
REMEMBERED, LONGEST = 500_000, 64
#: A longer text is encoded in pieces of about so many characters; shorter ones together, up to so many.
PIECE, TOGETHER = 1 << 20, 1 << 22

#: The tokenizer's split pattern, and the same for texts of plain characters in lower case.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-ſ]+|[0-9]|[!-/:-@\\[-`{-~\xd7\xf7]+").findall
#: Plain characters are their own NFC, of the same class and case everywhere.
_PLAIN = re.compile("[ \n\x21-\x7e\xc0-įı-ſ]*").fullmatch

#: Kinds of the bytes of plain texts in lower case.
_SPACE, _LETTER, _DIGIT, _OTHER = range(4)
_KINDS = bytes(
    _SPACE if b in b" \n" else _LETTER if b in b"abcdefghijklmnopqrstuvwxyz" or b > 127 else _DIGIT if b in b"0123456789" else _OTHER for b in range(256)
)


def _split(text):
    """The kind of each byte of a plain text in lower case that ends with three line feeds, and where pieces start (bytes of white space don't count)."""
    import numpy as np

    kinds = np.frombuffer(_KINDS, np.uint8)[text]
    lead = np.flatnonzero(text == 0xC3)
    signs = lead[(text[lead + 1] == 0x97) | (text[lead + 1] == 0xB7)]  # the multiplication and division signs
    kinds[signs] = kinds[signs + 1] = _OTHER
    starts = kinds == _DIGIT
    starts[0] = True
    starts[1:] |= kinds[1:] != kinds[:-1]
    quotes = np.flatnonzero(text == ord("'"))
    quotes = quotes[(quotes == 0) | (kinds[quotes - 1] != _OTHER)]  # others belong to the piece before them
    a, b = text[quotes + 1], text[quotes + 2]
    one = quotes[np.isin(a, list(b"stmd"))]
    two = quotes[np.isin(a, list(b"rv")) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))]
    starts[one + 1] = starts[two + 1] = False
    after = np.concatenate([one + 2, two + 3])
    starts[after[kinds[after] == _LETTER]] = True
    return kinds, starts


def _groups(texts: list[str], size: int) -> Iterator[list[str]]:
    """Texts next to each other, of about so many characters; one of more than PIECE is alone."""
    at = 0
    while at < len(texts):
        end, own = at + 1, len(texts[at])
        while end < len(texts) and own < size and max(len(texts[at]), len(texts[end])) <= PIECE:
            own += len(texts[end])
            end += 1
        yield texts[at:end]
        at = end


_encoders: dict[str, "WordEncoder"] = {}


class WordEncoder:
    """The ids of whole texts as little-endian unsigned 32-bit integers, as the library gives them.

    The tokenizer drops white space, and no rule of it reaches across any, so a text's ids are those of its parts between
    spaces and line feeds. Texts or parts of plain characters, for which lower-casing and the split pattern can't differ
    between here and the library, are split here, texts of them many at once, and pieces that weren't seen before given to
    the library's model; other parts go through the whole library.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.model = self.tokenizer.model
        self.pieces: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        with open(path) as f:
            rules = json.load(f)
        steps = (rules["pre_tokenizer"] or {}).get("pretokenizers", [])
        normal = [n["type"] for n in (rules["normalizer"] or {}).get("normalizers", [])]
        self.simple = (
            normal == ["NFC", "Replace", "Lowercase"] and [s["type"] for s in steps] == ["Split", "ByteLevel"]
            and steps[0]["pattern"] == {"Regex": PATTERN} and steps[0]["invert"] and not steps[1]["use_regex"] and not steps[1]["add_prefix_space"]
        )
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # the characters by which byte-level models name bytes
        self.names = dict(zip(shown, map(chr, shown))) | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in shown)}

    def _parts(self, text: str) -> list[str]:
        """The pieces of a text; parts that aren't plain are one piece, marked by a space before it."""
        if self.simple and _PLAIN(text):
            return _PIECES(text.lower())
        out = []
        for w in text.replace("\n", " ").split(" "):
            if self.simple and _PLAIN(w):
                out += _PIECES(w.lower())
            else:
                out.append(" " + w)
        return out

    def _ids(self, piece: str) -> bytes:
        if piece[0] == " ":
            own = self.tokenizer.encode(piece[1:], add_special_tokens=False).ids
        else:
            own = [t.id for t in self.model.tokenize(piece.translate(self.names) if piece.isascii() else piece.encode().decode("latin-1").translate(self.names))]
        return pack(f"<{len(own)}I", *own)

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text. Texts are worked on in groups of about TOGETHER characters."""
        for group in _groups(texts, TOGETHER):
            if len(group) == 1 and len(group[0]) > PIECE:
                yield self._long(group[0])
            else:
                yield from self._group(group)

    def _group(self, texts: list[str]) -> list[bytes]:
        if len(self.pieces) > REMEMBERED // 2:
            self.older, self.pieces = self.pieces, {}
        plain = [bool(self.simple and _PLAIN(t)) for t in texts]
        own = iter(self._plain([t for t, p in zip(texts, plain) if p]))
        rest = (x for group in _groups([t for t, p in zip(texts, plain) if not p], PIECE) for x in self._mixed(group))
        return [next(own if p else rest) for p in plain]

    def _known(self, pieces: Collection[str]) -> list[bytes]:
        """The ids of each piece; short ones are remembered."""
        out = list(map(self.pieces.get, pieces))
        for k, p in enumerate(pieces):
            if out[k] is None:
                out[k] = self._ids(p) if (own := self.older.get(p)) is None else own
                if len(p) <= LONGEST:
                    self.pieces[p] = out[k]
        return out

    def _mixed(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, whatever its characters."""
        parts = [self._parts(t) for t in texts]
        distinct = list(set().union(*parts))
        known = dict(zip(distinct, self._known(distinct)))
        return [b"".join(map(known.__getitem__, p)) for p in parts]

    def _plain(self, texts: list[str]) -> list[bytes]:
        """The ids of each text of plain characters, split as _PIECES does, but over the bytes of all of them. Each distinct piece is looked up once, and its ids copied to its places."""
        import numpy as np
        import pyarrow as pa

        lower = [t.lower().encode() for t in texts]
        kinds, starts = _split(joined := np.frombuffer(b"\n".join(lower) + b"\n\n\n", np.uint8))
        filled = kinds != _SPACE
        at = np.append(np.flatnonzero(starts[filled]), np.count_nonzero(filled))
        pieces = pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype("<i8")), pa.py_buffer(joined[filled])).dictionary_encode()
        ids = pa.array(self._known(pieces.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary()).take(pieces.indices)
        ends = np.searchsorted(np.flatnonzero(starts & filled), np.cumsum([len(t) + 1 for t in lower])).tolist()
        place = np.frombuffer(ids.buffers()[1], "<i8")[ids.offset :] if len(ids) else np.zeros(1, int)
        data = memoryview(ids.buffers()[2] or b"")
        return [bytes(data[place[a] : place[b]]) for a, b in zip([0, *ends], ends)]

    def _long(self, text: str) -> bytes:
        out, at = [], 0
        while at < len(text):
            cut = min((c for c in (text.find(" ", at + PIECE), text.find("\n", at + PIECE)) if c >= 0), default=len(text))
            out += self._group([text[at:cut]])
            at = cut
        return b"".join(out)


def encoder(path: str) -> WordEncoder:
    """The process's encoder for this file."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)
