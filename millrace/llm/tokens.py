"""Token ids of whole texts with a public tokenizer, at the speed of a table of words.

The tokenizers library splits a text into pieces before it merges bytes, and the
ids of a piece depend on the piece alone. So the pieces of a text are looked up
in a table, and the library's model is asked only for pieces not seen before. A
text with characters beyond the range in which this module knows the library's
splitting rule by heart, or with the content of an added token, goes to the
library whole; the ids are the same.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

from millrace.llm.textnum import on_release

#: Letters and digits below U+0250, and white space as the library's patterns mean it.
_LETTERS = "".join(c for c in map(chr, range(0x250)) if c.isalpha())
_DIGITS = "".join(c for c in map(chr, range(0x250)) if c.isnumeric())
_SPACES = "\t\n\x0b\x0c\r \x85\xa0"
_BEYOND = re.compile("[^\x00-\u024f]")
#: Bytes that a process keeps of pieces and their ids, with ENTRY for the dictionary's share of each; those not met lately
#: go, and pieces of more than LONG characters are not kept, which changes no result.
TABLE_BYTES, ENTRY, LONG = 128 << 20, 170, 256
#: The normalizer of the word-level byte models that this module knows by heart.
LOWERING = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]


def _classes(pattern: str) -> re.Pattern:
    """A pattern over \\p{L}, \\p{N} and \\s for characters below U+0250."""
    known = {r"\p{L}": re.escape(_LETTERS), r"\p{N}": re.escape(_DIGITS), r"\s": re.escape(_SPACES)}
    out, inside = "", False
    for part in re.findall(r"\\p\{[LN]\}|\\s|\\S|\[\^?|\]|.", pattern):
        inside = True if part[0] == "[" else False if part == "]" else inside
        if part in known:
            part = known[part] if inside else f"[{known[part]}]"
        elif part == r"\S":
            part = f"[^{known[chr(92) + 's']}]"
        out += part
    return re.compile(out)


def _byte_letters() -> dict[int, str]:
    """The printable stand-ins of byte-level models: printable bytes for themselves, the others in order from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Pieces(dict):
    """Piece -> its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, model):
        super().__init__()
        self.older: dict[str, bytes] = {}
        self.held = 0
        self.tokenize, self.letters = model.tokenize, {ord(chr(b)): c for b, c in _byte_letters().items()}

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            tokens = self.tokenize(piece.encode().decode("latin-1").translate(self.letters))
            ids = np.array([t.id for t in tokens], "<u4").tobytes()
        if len(piece) <= LONG:
            self[piece] = ids
            self.held += ENTRY + len(piece) + len(ids)
        return ids

    def shrink(self) -> None:
        """Once they fill half of TABLE_BYTES, the pieces met lately become the older ones, which go."""
        if self.held > TABLE_BYTES // 2:
            self.older = dict(self)
            self.clear()
            self.held = 0


class Encoder:
    """Ids of one tokenizer file as the library's encode(text, add_special_tokens=False).

    With ``special`` the contents of special tokens in a text are those tokens,
    the library's default; without, they are ordinary text.
    """

    #: The splitting rule of byte-level models that name none.
    PLAIN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, path: str, special: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = not special
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        self.size = self.whole.get_vocab_size()
        self.lower, self.split = False, None
        pre, norm = rules.get("pre_tokenizer") or {}, rules.get("normalizer")
        parts = pre.get("pretokenizers", [pre])
        if rules.get("post_processor") is None or rules["post_processor"].get("type") == "ByteLevel":
            if norm is None and len(parts) == 1 and parts[0].get("type") == "ByteLevel" and parts[0].get("use_regex") and not parts[0].get("add_prefix_space"):
                self.split = _classes(self.PLAIN)
            elif (
                [p.get("type") for p in parts] == ["Split", "ByteLevel"]
                and parts[0].get("invert")
                and parts[0].get("behavior") == "Removed"
                and not (parts[1].get("use_regex") or parts[1].get("add_prefix_space"))
                and norm is not None
                and norm.get("normalizers") == LOWERING
            ):
                self.split, self.lower = _classes(parts[0]["pattern"]["Regex"]), True
        found = {t["content"] for t in rules.get("added_tokens") or () if special or not t["special"]}
        self.added = sorted(found | {c.lower() for c in found} if self.lower else found)
        self.pieces = _Pieces(self.whole.model)

    def forget(self) -> None:
        """Keep no pieces."""
        self.pieces.clear()
        self.pieces.older, self.pieces.held = {}, 0

    def ids(self, text: str | None) -> bytes:
        """Little-endian unsigned 32-bit ids of the whole text; none for a null."""
        if not text:
            return b""
        plain = text.lower() if self.lower else text
        if self.split is None or not (plain.isascii() or not _BEYOND.search(plain)) or any(a in plain or a in text for a in self.added):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        self.pieces.shrink()
        return b"".join(map(self.pieces.__getitem__, self.split.findall(plain)))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of a file with the library's default for special tokens, one for each process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path, special=True)
    return _encoders[path]


def forget() -> None:
    """Keep no pieces of any file; tasks of other operators in this process call it by release_memory."""
    for e in _encoders.values():
        e.forget()


on_release.append(forget)


def public_path(name: str) -> str:
    """Where a file of the public tokenizers lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
