"""Token ids of byte-level BPE vocabularies, chunk by chunk with a memory.

The pre-tokenizers of these vocabularies never join text across white space (a space at most
opens the next token), nor a letter or digit with a sign behind it, so a text is cut into chunks
there, and a chunk's ids are remembered as little-endian unsigned 32-bit bytes. A text where white
space meets white space is cut there by the pattern itself.

The tokenizers library encodes every chunk, once in the memory's life: new chunks of a slice of
texts are joined as they would stand in a text, and its ids are cut where the bytes that they stand
for end a chunk. Chunks that can't be joined so, and parts whose ids don't end with their chunks,
are joined with a mark of a known id before each; if the marks don't come out in the number they
went in, the library takes the chunks one by one. So ids depend on no earlier text.

The string of an added token inside a text is that token, as the library has it by default; the
library takes such a text whole. With ``special_as_text`` these strings are ordinary text.

Chunks are told apart and ids gathered in arrays; Python touches each different chunk of a slice once.

The empty text has no ids. A very long text is cut like any other: its chunks and ids are held once,
as arrays of about 20 bytes for each of its bytes at most.
"""

from __future__ import annotations

import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa

from tonewright.llm.common import tokenizer_path

#: Chunks in each of the two halves of a Python worker's memory.
CACHE_CHUNKS = 500_000
#: Chunks that are joined to one text for the library.
JOINED = 500

_SPACE = r"\t-\r \x85\xa0  -     　"
_CHUNKS = re.compile(f" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
#: Where one of these stands, white space may meet white space.
_MEETING = (b"  ", b"\n\n", b" \n", b"\n ", b"\t", b"\r", b"\x0b", b"\x0c")
_ODD = re.compile(rb"\xc2[\x80-\xa0]|\xe1\x9a\x80|\xe2\x80|\xe2\x81\x9f|\xe3\x80\x80")


#: Kinds of bytes: white space; letters and digits of ASCII; its signs but for the apostrophe, which may
#: belong to letters behind it; the first byte of U+00C0 to U+00FF, and second ones that make a letter.
_OTHER, _LINE, _BLANK, _WORD, _SIGN, _LEAD, _LATIN = range(7)


def _kind(byte: int) -> int:
    char = chr(byte)
    if byte >= 128:
        return _LEAD if byte == 0xC3 else _LATIN if byte < 0xC0 and byte not in (0x97, 0xB7) else _OTHER
    if char in " \t\n\r\x0b\x0c":
        return _LINE if char == "\n" else _BLANK
    return _WORD if char.isalnum() else _SIGN if 32 < byte < 127 and char != "'" else _OTHER


_KINDS = bytes(map(_kind, range(256)))


class ChunkEncoder:
    """Ids of whole texts under one tokenizers file."""

    def __init__(self, path: str, special_as_text: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark has a worker for each core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = special_as_text
        added = self.library.get_added_tokens_decoder().values()
        self.added = [] if special_as_text else [t.content.encode() for t in added]
        # white space that is dropped can't mark chunks off; a control character stands by itself
        self.by_word = not self._ask("\n")
        self.mark = " \x01 " if self.by_word else "\n"
        (self.mark_id,) = self._ask(self.mark)
        suffix = self.library.model.end_of_word_suffix or ""
        vocabulary = self.library.get_vocab(with_added_tokens=False)
        #: Bytes of normal text that each id stands for; each character of a token is one.
        self.sizes = np.zeros(self.library.get_vocab_size() + 1, np.int64)
        for token, i in vocabulary.items():
            self.sizes[i] = len(token) - (len(suffix) if suffix and token.endswith(suffix) else 0)
        self.fresh: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def _ask(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def _together(self, chunks: list[str]) -> list[bytes]:
        """Packed ids of chunks that hold neither the mark nor anything but it that is dropped."""
        parts = [self.mark + self.mark.join(chunks[i : i + JOINED]) for i in range(0, len(chunks), JOINED)]
        got = self.library.encode_batch_fast(parts, add_special_tokens=False)
        ids = np.fromiter(chain.from_iterable([g.ids for g in got]), np.uint32)
        marks = np.flatnonzero(ids == self.mark_id)
        if len(marks) != len(chunks):
            return [_packed(g.ids) for g in self.library.encode_batch_fast(chunks, add_special_tokens=False)]
        data = ids.astype("<u4").tobytes()
        ends = [*(4 * marks[1:]).tolist(), len(data)]
        return [data[a:b] for a, b in zip((4 * marks + 4).tolist(), ends, strict=True)]

    def _joined(self, chunks: list[bytes]) -> list[bytes]:
        """Packed ids of chunks that may follow each other in a text as they are, or as words."""
        space = b" " if self.by_word else b""
        out: list[bytes] = []
        for i in range(0, len(chunks), JOINED):
            part = chunks[i : i + JOINED]
            text = space.join(part).decode()
            (got,) = self.library.encode_batch_fast([text], add_special_tokens=False)  # one at a time: little memory
            ids = np.array(got.ids, "<u4")
            at = np.cumsum(self.sizes[ids])
            normal = part
            if self.library.normalizer is not None and not text.isascii():
                normal = [w.encode() for w in self.library.normalizer.normalize_str(text).split(" ")]
            ends = np.cumsum(np.fromiter(map(len, normal), np.int64, len(normal)))
            found = np.searchsorted(at, ends)
            if len(normal) != len(part) or not len(at) or at[-1] != ends[-1] or (at[found] != ends).any():
                out += self._together([c.decode() for c in part])
                continue
            data = ids.tobytes()
            stops = (4 * found + 4).tolist()
            out += [data[a:b] for a, b in zip([0, *stops], stops)]  # noqa: B905 - one start more
        return out

    def _joining(self, chunks: list[bytes]) -> tuple[list[bytes], list[bytes]]:
        """The chunks that a text may hold between others of their kind without a change of their ids:
        those whose bytes are their normal form's but for case, and the others."""
        if self.by_word:
            return [c for c in chunks if c.isascii()], [c for c in chunks if not c.isascii() and not _ODD.search(c)]
        return [c for c in chunks if c[0] == 32 and len(c) > 1 and c[1] > 32 and (c[1] < 128 or not _ODD.match(c, 1))], []

    def _learn(self, chunks: list[bytes]) -> None:
        """Put these chunks, no two of them equal, into the memory."""
        lacking = [c for c in chunks if c not in self.fresh]
        if len(self.fresh) + len(lacking) > CACHE_CHUNKS:
            self.older, self.fresh, lacking = self.fresh, {}, chunks
        fresh, older = self.fresh, self.older
        if older:
            fresh.update((c, older[c]) for c in lacking if c in older)
            lacking = [c for c in lacking if c not in older]
        new = lacking
        groups = self._joining(new)
        for alike in groups:
            fresh.update(zip(alike, self._joined(alike), strict=True))
        if sum(map(len, groups)) == len(new):
            return
        plain, other = [], []
        for c in new:
            if c not in fresh:
                text = c.decode()
                (other if text.isspace() or "\x01" in text else plain).append(text)
        if plain:
            fresh.update(zip([t.encode() for t in plain], self._together(plain), strict=True))
        if other:
            got = self.library.encode_batch_fast(other, add_special_tokens=False)
            fresh.update((t.encode(), _packed(g.ids)) for t, g in zip(other, got, strict=True))

    def _cut(self, texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
        """All chunks of these texts, and where each text's begin among them (and the last's end)."""
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
        opens = np.append(np.int64(0), ends)  # of each text, and of nothing behind the last
        whole = b"".join(texts)
        data, kinds = np.frombuffer(whole, np.uint8), np.frombuffer(whole.translate(_KINDS), np.uint8)
        first = np.unique(opens[opens < len(data)])
        worded = kinds == _WORD
        worded[1:] |= (kinds[:-1] == _LEAD) & (kinds[1:] == _LATIN)
        peeled = kinds == _SIGN
        peeled[1:] &= worded[:-1]
        if self.by_word:
            space = (kinds == _LINE) | (kinds == _BLANK)
            begins = ~space
            begins[1:] &= space[:-1]
            begins[first] = ~space[first]
            begins |= peeled
            at = np.flatnonzero(begins)
            begins, data = begins[~space], data[~space]
            starts = np.flatnonzero(begins)
        else:
            lines = data == 10
            begins = lines | (data == 32) | peeled
            begins[1:] |= lines[:-1]
            begins[first] = True
            for k, t in enumerate(texts):
                if any(m in t for m in _MEETING) or _ODD.search(t):
                    here = slice(opens[k], opens[k + 1])
                    begins[here] = peeled[here]
                    sizes = [len(c.encode()) for c in _CHUNKS.findall(t.decode())]
                    begins[opens[k] + np.cumsum([0, *sizes[:-1]])] = True
            at = starts = np.flatnonzero(begins)
        offsets = np.append(starts, len(data))
        chunks = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        return chunks, np.searchsorted(at, opens)

    def encode_all(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text, four bytes each."""
        whole = {k for k, t in enumerate(texts) if any(a in t for a in self.added)}
        chunks, bounds = self._cut([b"" if k in whole else t for k, t in enumerate(texts)])
        coded = chunks.dictionary_encode()
        _, offsets, values = coded.dictionary.buffers()
        ends = np.frombuffer(offsets, np.int64, len(coded.dictionary) + 1).tolist()
        values = values.to_pybytes() if values else b""
        distinct = [values[a:b] for a, b in zip(ends, ends[1:])]  # noqa: B905 - one end more
        self._learn(distinct)
        held = list(map(self.fresh.__getitem__, distinct))
        sizes = np.fromiter(map(len, held), np.int64, len(held)) >> 2
        which = coded.indices.to_numpy()
        lengths = sizes[which]
        ends = np.cumsum(lengths)
        # the ids of the chunk at hand follow one another in the memory's; where its first one stands
        base = (np.cumsum(sizes) - sizes)[which] - (ends - lengths)
        picked = np.arange(ends[-1] if len(ends) else 0)
        picked += np.repeat(base, lengths)
        data = np.frombuffer(b"".join(held), "<u4")[picked].tobytes()
        stops = (4 * np.append(0, ends)[bounds]).tolist()
        out = [data[a:b] for a, b in zip(stops, stops[1:])]  # noqa: B905 - one start more
        for k in whole:
            out[k] = _packed(self._ask(texts[k].decode()))
        return out

    def encode(self, text: bytes) -> bytes:
        return self.encode_all([text])[0]


def _packed(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()


_encoders: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """One encoder for each file in a Python worker, which serves many tasks."""
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]


BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"


def vocabulary(name: str) -> str:
    return tokenizer_path(name)
