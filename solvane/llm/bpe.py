"""Exact byte-level BPE encoding with a memo of space-delimited chunks.

Byte-level BPE splits a text into pre-tokens before any merge, and a space that
is followed by a non-space always starts a pre-token.  Text between two such
places is therefore encoded alike wherever it stands, so each distinct chunk is
split once, each distinct pre-token goes through the ``tokenizers`` model once,
and ids are joined as bytes after that.  Texts in which a chunk could depend on
its surroundings (runs of white space), texts that hold the content of an added
token such as an end-of-text mark, and characters whose class the split pattern
might see differently are encoded whole by the library.

Defined results: ids are those of the library's own encoding without special
tokens added at the ends.  An added token's content in a text becomes that
token's id, as the library does by itself; with ``as_text`` it is encoded like
any other text, so that no text can give a special id.  Null and empty texts
have no ids.
"""

from __future__ import annotations

import gc
import os
import re
import struct

import regex

#: Words kept by one Python worker, twice: a full memo becomes the old one, whose words come back when they are met again.
MEMO_ENTRIES = 400_000
#: Longer ones are encoded but not kept.
MEMO_CHARS = 64

#: The published split pattern of this byte-level BPE.
SPLIT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Only these characters are split here: their classes are the same in every Unicode version.
_SETTLED = re.compile(r"[^\t-\r -ͷЀ-ԯ‐-‧₠-€]")


def _byte_letters() -> dict[int, str]:
    """Byte value -> the printable character that stands for it in the vocabulary."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = (b for b in range(256) if b not in set(shown))
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


#: Signs that are a pre-token of their own after a letter, at the end of a chunk.
_MARKS = ".,;:!?)]}"


class _Chunks(dict):
    r"""Chunk -> ids as bytes; None where the chunk must not be cut off from its text.

    A chunk stands after a space, but "\n..." stands for itself and "\x00..."
    is the beginning of a text or line, without a space before it.  Words are
    kept; a word with a sign after it is put together anew each time.
    """

    def __init__(self, library):
        super().__init__()
        self._library, self._model, self._letters = library, library.model, _byte_letters()
        self._find = regex.compile(SPLIT_PATTERN).findall
        self._marks = {c: self.piece(c) for c in _MARKS}
        self._line = self.piece("\n")
        self._old: dict[str, bytes | None] = {}

    def piece(self, piece: str) -> bytes:
        """Ids of one pre-token, by the library's BPE model."""
        ids = [t.id for t in self._model.tokenize(piece.encode().decode("latin-1").translate(self._letters))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _keep(self, chunk: str, ids: bytes | None) -> bytes | None:
        if len(chunk) <= MEMO_CHARS:
            if len(self) >= MEMO_ENTRIES:
                self._old = dict(self)
                self.clear()
            self[chunk] = ids
        return ids

    def __missing__(self, chunk: str) -> bytes | None:
        if chunk in self._old:
            return self._keep(chunk, self._old[chunk])
        first = chunk[:1]
        if first == "\n":
            rest = chunk[1:]
            if not rest:
                return self._line
            if not rest[0].isspace():
                ids = self["\x00" + rest]
                return None if ids is None else self._line + ids
        word = chunk[1:] if first == "\x00" else chunk
        mark = self._marks.get(chunk[-1:])
        if mark is not None and word[-2:-1].isalpha():
            ids = self[chunk[:-1]]
            return None if ids is None else ids + mark
        text = word if first == "\x00" or first == "\n" else " " + word
        settled = word.isascii() or not _SETTLED.search(word)
        if settled and word.isalpha():
            return self._keep(chunk, self.piece(text))
        if first == "\x00":
            alone = not text[:1].isspace() or text[0] == "\n"
        else:
            alone = first == "\n" or (first != "" and not first.isspace())
        if not alone:
            return self._keep(chunk, None)
        if settled:
            return self._keep(chunk, b"".join(map(self.piece, self._find(text))))
        e = self._library.encode(text, add_special_tokens=False)
        return self._keep(chunk, struct.pack(f"<{len(e.ids)}I", *e.ids))


class BpeEncoder:
    """Encodes texts to little-endian unsigned 32-bit ids; with as_text, contents of special tokens are plain text."""

    def __init__(self, path: str, as_text: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = as_text
        added = [t for t in self.library.get_added_tokens_decoder().values() if not (as_text and t.special)]
        self._marked = re.compile("|".join(re.escape(t.content) for t in added)).search if added else None
        pre = self.library.pre_tokenizer
        self._plain = type(pre).__name__ == "ByteLevel" and not pre.add_prefix_space and pre.use_regex and self.library.normalizer is None
        self._chunk = _Chunks(self.library).__getitem__ if self._plain else None

    def whole(self, texts: list[str]) -> list[bytes]:
        """The library's own encoding."""
        return [struct.pack(f"<{len(e.ids)}I", *e.ids) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of every whole text as bytes; None and the empty text give b""."""
        out: list[bytes | None] = []
        chunk, marked, collecting = self._chunk, self._marked, gc.isenabled()
        gc.disable()  # strings and bytes hold no cycles, and the memo is large
        try:
            for t in texts:
                if not t:
                    out.append(b"")
                elif not self._plain or "\n\n" in t or " \n" in t or "\x00" in t or (marked and marked(t)):
                    out.append(None)
                else:
                    try:
                        out.append(b"".join(map(chunk, ("\x00" + t.replace("\n", " \n")).split(" "))))
                    except TypeError:
                        out.append(None)
        finally:
            if collecting:
                gc.enable()
        left = [i for i, x in enumerate(out) if x is None]
        for i, x in zip(left, self.whole([texts[i] for i in left]), strict=True):
            out[i] = x
        return out


_ENCODERS: dict[tuple[str, bool], BpeEncoder] = {}


def encoder(path: str, as_text: bool = False) -> BpeEncoder:
    """The worker's encoder of one vocabulary file, kept between tasks."""
    if (path, as_text) not in _ENCODERS:
        _ENCODERS[path, as_text] = BpeEncoder(path, as_text)
    return _ENCODERS[path, as_text]
