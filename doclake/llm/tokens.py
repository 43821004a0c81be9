"""Whole texts to token ids by a public tokenizer, with a memo of pieces.

Both vocabularies used here split a text before they merge, and no token crosses a single blank between two characters
that are not white space. So a text is cut there, each piece goes through the tokenizers library once, and the
ids are joined. A piece whose ends make the cut unsafe is joined with its neighbours first; results equal those of the
whole text. The memo is a cache of bounded size and never changes a result. A text that holds a special token's literal, which
is that token by the library's default, goes through the library uncut.
"""

from __future__ import annotations

import os
import string
from array import array

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Bytes that all memos of a worker may hold together, about; and the longest piece that is remembered.
MEMO, LONGEST = 320 << 20, 64
#: What an entry takes besides its characters and ids; places of the marks that a piece was met.
_ENTRY, _MET = 200, 1 << 20


class _Pieces(dict):
    """piece -> its ids as little-endian unsigned 32-bit integers; None if a text can't be cut at this piece's ends.

    A piece is remembered when it is met for the second time, so that the many words of one place take no room.
    """

    def __init__(self, make, share: float):
        self.make, self.most, self.held, self.met = make, MEMO * share - _MET, 0, bytearray(_MET)

    def __missing__(self, piece):
        ids = self.make(piece)
        mark = hash(piece) % _MET
        if not self.met[mark]:
            self.met[mark] = 1
        elif len(piece) <= LONGEST:
            self.held += _ENTRY + len(piece) + len(ids or b"")
            if self.held > self.most:
                self.clear()
                self.held, self.met = 0, bytearray(_MET)
            self[piece] = ids
        return ids


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.literals = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = self.tokenizer.model
        #: Blanks are part of the token after them, or vanish.
        self.blanks = self.tokenizer.normalizer is None
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        letters = [chr(c) for c in range(256) if chr(c).isalpha()]
        self.mapped = {ord(c): level.pre_tokenize_str(c)[0][0] for c in letters}
        self.lead = level.pre_tokenize_str(" ")[0][0] if self.blanks else ""
        self.line_end = self.whole("\n")
        # Shares of MEMO; of half of it where blanks are kept, since packing is a stage among others whose workers stay.
        room = 0.5 if self.blanks else 1.0
        self.pieces = _Pieces(self._after_blank if self.blanks else self._first, 0.7 * room)
        self.firsts = _Pieces(self._first, 0.2 * room)
        self.others = _Pieces(self.whole, 0.07 * room)
        self.marks = _Pieces(self.whole, 0.03 * room)

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _word(self, word: str, lead: str) -> bytes:
        """A word of letters alone, which the model sees as one."""
        mapped = (word if self.blanks else word.lower()).translate(self.mapped)
        return array("I", [t.id for t in self.model.tokenize(lead and self.lead + mapped or mapped)]).tobytes()

    def _made(self, piece: str, lead: str) -> bytes:
        """Letters and the marks after them are apart in both patterns; all else goes through the whole tokenizer."""
        if piece.isalpha():
            if max(piece) < "Ā":
                return self._word(piece, lead)
        else:
            word = piece.rstrip(string.punctuation)
            # Where lower case adds a mark to the letters, that mark belongs to those after it.
            if len(word) < len(piece) and word.isalpha() and (self.blanks or word.lower().isalpha()):
                own = self.pieces if lead or not self.blanks else self.firsts
                return own[word] + self.marks[piece[len(word) :]]
        return self.whole(lead + piece)

    def _first(self, piece: str) -> bytes:
        return self._made(piece, "")

    def _after_blank(self, piece: str) -> bytes | None:
        if not piece or piece[0].isspace() or piece[-1].isspace():
            return None
        if "\n" in piece:
            # A line end between two characters that are not white space is a token of its own.
            lines = piece.split("\n")
            if all(x and not x[0].isspace() and not x[-1].isspace() for x in lines):
                return self.pieces[lines[0]] + b"".join(self.line_end + self.firsts[x] for x in lines[1:])
        return self._made(piece, " ")

    def special(self, text: str) -> bool:
        return any(x in text for x in self.literals)

    def parts(self, text: str) -> list[str]:
        """The text in pieces between which no token lies, each with the blank before it."""
        if self.special(text):
            return [text]
        out, held = [], ""
        for k, part in enumerate(text.split(" ")):
            if not k:
                held = part
            elif part and not part[0].isspace() and held and not held[-1].isspace():
                out.append(held)
                held = " " + part
            else:
                held += " " + part
        return [*out, held]

    def encode(self, text: str | None) -> bytes:
        """All ids of a text; null is the empty text."""
        if not text:
            return b""
        if self.special(text):
            return self.whole(text)
        if not self.blanks:
            return b"".join(map(self.pieces.__getitem__, text.replace("\n", " ").split(" ")))
        first, *rest = text.split(" ")
        if first and not first[-1].isspace():
            try:
                return self.others[first] + b"".join(map(self.pieces.__getitem__, rest))
            except TypeError:  # a piece is None
                pass
        return b"".join(map(self.others.__getitem__, self.parts(text)))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker process and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
