"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

Encoding keeps a score-ordered agenda of adjacent symbol pairs: the best-scoring pair, the
leftmost among equals, is merged, its new neighbours join the agenda, stale entries are
skipped. Symbols that end up outside the vocabulary are spelt in byte pieces.

A word mark ``▁`` opens a run only after other characters unless the vocabulary has a piece
with an inner mark; then the agenda never merges across such a place, so runs are encoded one
by one and remembered. A vocabulary with such a piece is left to the library, text by text.

Many runs have their agendas side by side in arrays: a pair's entry is the rank of the piece it
would make and its place, in one number, so the least entry of a run is its best score, leftmost
among equals; a step merges the least entry of every run and renews the entries next to it.

Every new run is checked in its Arrow batch against the sentencepiece library, and so is one
whole text of each part of a batch; a text with any disagreement is encoded by the library.

Null is the empty text, which has no ids and decodes to ''. Equal pairs merge from the left.
A very long text is encoded whole, run by run: arrays hold at most ``AGENDA_CHARS`` of its
characters and a few bytes for each of its runs. Repeated rows are encoded each. An empty table
gives no rows; columns other than doc_id and text don't matter.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tonewright.llm.common import arrow_map, raw, slices, tokenizer_path

MARK = "▁"
#: Runs in each of the two halves of a Python worker's memory.
CACHE_RUNS = 350_000
#: Characters whose agendas are worked off together.
AGENDA_CHARS = 500_000
#: An agenda's entry of a pair that makes no piece.
NONE = np.int64(2**62)

_MARK = MARK.encode()
_RUNS = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")


class PieceCodec:
    """Encoder and decoder of one model file."""

    def __init__(self, path: str, cache_runs: int = CACHE_RUNS):
        import sentencepiece as spm

        self.library = spm.SentencePieceProcessor(model_file=path)
        lib, n = self.library, self.library.get_piece_size()
        self.pieces = [lib.id_to_piece(i) for i in range(n)]
        special = [lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i) for i in range(n)]
        byte = [lib.is_byte(i) for i in range(n)]
        self.ids = {p: i for i, p in enumerate(self.pieces) if not special[i] and not byte[i]}
        self._pairs(lib)
        self.bytes_id = {int(self.pieces[i][3:5], 16): i for i in range(n) if byte[i]}
        self.unknown = lib.unk_id()
        inner = any(MARK in p.lstrip(MARK) or ("\n" in p and len(p) > 1) for p in self.ids)
        # what this codec doesn't model is left to the library as a whole
        probe = lib.encode("a  b\tc ▁d ")
        self.whole = inner or len(self.bytes_id) != 256 or lib.decode(probe) != "a  b\tc  d "
        self.spelt = [
            b"" if special[i] else bytes([int(p[3:5], 16)]) if byte[i] else p.replace(MARK, " ").encode()
            for i, p in enumerate(self.pieces)
        ]
        self.decimal = [str(i).encode() for i in range(n)]
        self.cache_runs = cache_runs
        #: ids of a run as decimals joined by commas; the older half goes when the newer is full
        self.cache: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.wrong: set[bytes] = set()

    def _pairs(self, lib) -> None:
        """Which two symbols make which piece. Symbols are numbered by score, best first; then
        come characters of pieces that are no pieces themselves."""
        scores = {p: lib.get_score(i) for p, i in self.ids.items()}
        self.of = sorted(scores, key=scores.__getitem__, reverse=True)
        symbol = {p: k for k, p in enumerate(self.of)}
        for p in self.of:
            for c in p:
                symbol.setdefault(c, len(symbol))
        self.n_pieces, self.unknown_symbol = len(self.of), len(symbol)
        self.symbol_of = np.full(0x110000, self.unknown_symbol, np.int32)
        for s, k in symbol.items():
            if len(s) == 1:
                self.symbol_of[ord(s)] = k
        order = {s: k for k, s in enumerate(sorted(set(scores.values()), reverse=True))}
        self.rank = np.array([order[scores[p]] for p in self.of], np.int64)
        self.id_of = np.array([self.ids[p] for p in self.of], np.int32)
        self.pairs = PairTable(
            {
                symbol[p[:cut]] << 20 | symbol[p[cut:]]: k
                for k, p in enumerate(self.of)
                for cut in range(1, len(p))
                if p[:cut] in symbol and p[cut:] in symbol
            }
        )

    def agendas(self, runs: list[str]) -> list[list[int]]:
        """Ids of texts in which marks already stand for spaces."""
        out: list[list[int]] = []
        some, chars = [], 0
        for r in runs:
            some.append(r)
            chars += len(r)
            if chars >= AGENDA_CHARS:
                out += self._together(some)
                some, chars = [], 0
        return out + self._together(some) if some else out

    def _together(self, runs: list[str]) -> list[list[int]]:
        sizes = np.fromiter(map(len, runs), np.int64, len(runs))
        ends = np.cumsum(sizes)
        starts, n = ends - sizes, int(sizes.sum())
        if not n:
            return [[] for _ in runs]
        sym = np.full(n + 1, self.unknown_symbol, np.int32)  # the last stands beyond every run's end
        sym[:n] = self.symbol_of[np.frombuffer("".join(runs).encode("utf-32-le"), np.uint32)]
        after, prev = np.arange(1, n + 2), np.arange(-1, n)
        after[ends[sizes > 0] - 1] = n
        prev[starts[sizes > 0]] = n
        made = np.empty(n + 1, np.int32)

        def entries(at: np.ndarray) -> np.ndarray:
            """Agenda entries of the pairs that begin at these places."""
            piece = self.pairs.find(sym[at].astype(np.int64) << 20 | sym[after[at]])
            made[at] = piece
            return np.where(piece < 0, NONE, self.rank[piece] << 32 | at)

        agenda = entries(np.arange(n))
        # rows are runs with anything to merge; row k has its entries from begin[k] on
        rows = np.flatnonzero(sizes > 1)
        keep = np.repeat(sizes > 1, sizes)
        agenda, begin = agenda[keep], np.cumsum(sizes[rows]) - sizes[rows]
        while len(rows):
            best = np.minimum.reduceat(agenda, begin)
            open_ = best < NONE
            if not open_.all():
                left = open_.sum()
                if left < 0.75 * len(rows):  # let go of finished rows
                    held = np.repeat(open_, sizes[rows])
                    agenda, rows, best = agenda[held], rows[open_], best[open_]
                    begin = np.cumsum(sizes[rows]) - sizes[rows]
                    shift = begin - starts[rows]
                else:
                    best, shift = best[open_], (begin - starts[rows])[open_]
                if not left:
                    break
            else:
                shift = begin - starts[rows]
            i = best & 0xFFFFFFFF
            j = after[i]
            k = after[j]
            sym[i] = made[i]
            sym[j] = -1
            after[i] = k
            prev[k] = i  # what lies beyond an end is never read
            agenda[j + shift] = NONE
            agenda[i + shift] = entries(i)
            h = prev[i]
            inner = h < n
            h = h[inner]
            agenda[h + shift[inner]] = entries(h)
        sym = sym[:n]
        whole = sym >= 0
        count = np.concatenate([[0], np.cumsum(whole)])
        known = np.where(sym[whole] < self.n_pieces, sym[whole], 0)
        ids = self.id_of[known].tolist()
        cut = count[ends].tolist()
        out = [ids[a:b] for a, b in zip([0, *cut], cut, strict=False)]
        # characters outside the vocabulary are spelt in bytes
        for r in np.unique(np.searchsorted(ends, np.flatnonzero(sym >= self.n_pieces), "right")).tolist():
            spelt: list[int] = []
            for c, s in zip(runs[r], sym[starts[r] : ends[r]].tolist(), strict=True):
                if s >= self.n_pieces:
                    spelt.extend(self.bytes_id[b] for b in c.encode())
                elif s >= 0:
                    spelt.append(int(self.id_of[s]))
            out[r] = spelt
        return out

    def runs(self, text: bytes) -> list[bytes]:
        """The text with its opening mark, cut before marks and around line breaks."""
        if b"  " in text or b"\0" in text or b"\xe2\x96\x81" in text or text[:1] == b" ":
            return [r.replace(MARK, " ").encode() for r in _RUNS.findall((" " + text.decode()).replace(" ", MARK))]
        cut = (b" " + text).replace(b" ", b"\0 ").replace(b"\n", b"\0\n\0").split(b"\0")
        return [r for r in cut if r]

    def _learn(self, runs: set[bytes]) -> None:
        """Put these runs into the memory; new ones are held against the library's ids."""
        lacking = [r for r in runs if r not in self.cache]
        if len(self.cache) + len(lacking) > self.cache_runs:
            self.older, self.cache, lacking = self.cache, {}, runs
        cache, older = self.cache, self.older
        new = []
        for r in lacking:
            if r in older:
                cache[r] = older[r]
            else:
                new.append(r)
        if not new:
            return
        texts = [r.decode() for r in new]
        # after a line break the library adds no mark of its own: its first two ids are cut
        theirs = self.library.encode(["\n" + t for t in texts], num_threads=1)
        own = self.agendas([t.replace(" ", MARK) for t in texts])
        spelt, decimal = self.spelt, self.decimal
        for r, ids, t in zip(new, own, theirs, strict=True):
            if ids != t[2:] or b"".join([spelt[i] for i in ids]) != r.replace(_MARK, b" "):
                self.wrong.add(r)
            cache[r] = b",".join([decimal[i] for i in ids])

    def encode(self, text: str) -> list[int]:
        """Ids of one text, by the agenda."""
        if not text:
            return []
        if self.whole:
            return self.library.encode(text)
        return list(chain.from_iterable(self.agendas([r.decode().replace(" ", MARK) for r in self.runs(text.encode())])))

    def decode(self, ids: list[int]) -> str:
        """Text of ids: marks become spaces, the opening one goes, bytes join to characters."""
        out = b"".join([self.spelt[i] for i in ids]).decode(errors="replace")
        return out[1:] if out[:1] == " " else out

    def digest(self, texts: list[bytes]) -> list[tuple[int, str, str, bool]]:
        """n_tokens, ids_sha256, decoded_sha256 of each text, and if the library was needed."""
        cut = [[] if self.whole else self.runs(t) if t else [] for t in texts]
        out = []
        self._learn(set(chain.from_iterable(cut)))
        probe = min(range(len(texts)), key=lambda i: (not texts[i], len(texts[i])), default=None)
        for k, (text, runs) in enumerate(zip(texts, cut, strict=True)):
            if not text:
                out.append((0, _sha(b""), _sha(b""), False))
                continue
            own = not self.whole
            if own:
                csv = b",".join([self.cache[r] for r in runs])
                own = not self.wrong or self.wrong.isdisjoint(runs)
                # each run's ids were decoded when learnt, and gave the run
                back = b"".join(runs).replace(_MARK, b" ").removeprefix(b" ")
            if own and k == probe:
                theirs = self.library.encode(text.decode())
                own = ",".join(map(str, theirs)).encode() == csv and self.library.decode(theirs).encode() == back
            if not own:
                theirs = self.library.encode(text.decode())
                csv, back = ",".join(map(str, theirs)).encode(), self.library.decode(theirs).encode()
            n = csv.count(b",") + 1 if csv else 0
            out.append((n, _sha(csv), _sha(back), not own))
        return out


class PairTable:
    """Number of the piece that a pair of symbols makes: open addressing in arrays."""

    def __init__(self, pieces: dict[int, int]):
        self.bits = max(4, (4 * len(pieces)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, -1, np.int32)
        keys = np.fromiter(pieces, np.int64, len(pieces))
        values = np.fromiter(pieces.values(), np.int32, len(pieces))
        at = self._slot(keys)
        while len(keys):
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[free]  # of several, one gets the slot
            mine = self.keys[at] == keys
            self.values[at[mine]] = values[mine]
            keys, values, at = keys[~mine], values[~mine], (at[~mine] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Numbers of pieces, -1 for pairs that make none."""
        at = self._slot(keys)
        there = self.keys[at]
        out = self.values[at]
        out[there != keys] = -1
        ask = np.flatnonzero((there != keys) & (there >= 0))
        while len(ask):
            at[ask] = (at[ask] + 1) & ((1 << self.bits) - 1)
            there = self.keys[at[ask]]
            hit = there == keys[ask]
            out[ask[hit]] = self.values[at[ask[hit]]]
            ask = ask[~hit & (there >= 0)]
        return out


def _sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


_codecs: dict[str, PieceCodec] = {}


def codec(path: str) -> PieceCodec:
    """One codec for each model in a Python worker, which serves many tasks."""
    if path not in _codecs:
        _codecs[path] = PieceCodec(path)
    return _codecs[path]


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>) of every whole text, by the agenda; no shuffle."""
    path = path or tokenizer_path("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            for part in slices(batch):
                ids = [own.encode(t.decode()) for t in raw(part)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return arrow_map(docs, run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) of (doc_id, ids); null ids decode to ''."""
    path = path or tokenizer_path("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            texts = [own.decode(ids or []) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return arrow_map(encoded, run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, by_library) of every whole text."""
    path = path or tokenizer_path("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            for part in slices(batch):
                got = own.digest(raw(part))
                kinds = (pa.int64(), pa.string(), pa.string(), pa.bool_())
                cols = [part.column("doc_id")] + [pa.array([g[i] for g in got], k) for i, k in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "by_library"])

    return arrow_map(docs, run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, by_library boolean")
