"""SentencePiece encoding and decoding (BPE models) by a merge-type prefix table.

For BPE every prefix of a text has exactly one last token in the encoding of
that prefix: the token t that ends there for which the prefix before t ends in a
token p such that (p, t) is how the model encodes p + t.  One left-to-right pass
finds it: an Aho-Corasick automaton names the pieces that end at each place, a
memoised pair test accepts one of them, and the ids are recovered backwards.
The cost is linear in the text, however long a run without spaces is.

Pieces with a white-space mark after another character do not exist in the
usual models, so merges never reach over the start of a mark run; texts are then
cut there and the encodings of words are kept in a bounded table.

Defined cases: a null or empty text encodes to the begin and end ids only and
decodes to an empty text; other columns pass through ``encode``; repeated rows
are rows of their own; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import chain
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from flightgrid.llm._words import chunks

MARK = "▁"
#: Entries of the word table and of the pair table of one Python worker.
WORDS_KEPT = 300_000
PAIRS_KEPT = 1_500_000


class Bpe:
    """Encoder and decoder of one model, given as the bytes of its file."""

    def __init__(self, model: bytes):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.vocab_size()
        self.bos, self.eos, self.unk = sp.bos_id(), sp.eos_id(), sp.unk_id()
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        text = {i: sp.id_to_piece(i) for i in plain}
        self.byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        # What decoding puts for an id.
        self.surface = [b""] * n
        for i, p in text.items():
            self.surface[i] = p.replace(MARK, " ").encode()
        for b, i in enumerate(self.byte_ids):
            if sp.is_byte(i):
                self.surface[i] = bytes([b])
        self.surface[self.unk] = " ⁇ ".encode()
        self.is_byte = {i for i in self.byte_ids if sp.is_byte(i)}
        self.control = {i for i in range(n) if sp.is_control(i)}
        self.marked = {i for i, p in text.items() if p.startswith(MARK)}
        # Symbols: pieces, and characters of pieces that are no pieces themselves.
        score = {p: sp.get_score(i) for i, p in text.items()}
        order = {s: r for r, s in enumerate(sorted(set(score.values()), reverse=True))}
        self.rank = {p: order[s] for p, s in score.items()}
        self.id_of = {p: i for i, p in text.items()}
        chars = {c for p in self.id_of for c in p}
        names = [*self.id_of, *sorted(chars - set(self.id_of))]
        self.number = {p: k for k, p in enumerate(names)}
        self.names, self.size = names, [len(p) for p in names]
        self.out = [self._ids(p) for p in names]
        self.left, self.right, self.time = [-1] * len(names), [-1] * len(names), [-1] * len(names)
        self.automaton = ahocorasick.Automaton()
        usable = 0
        for k, p in enumerate(names):
            if len(p) > 1:
                parts = self._merge(p)
                if parts is None:
                    continue  # no merges lead to this piece
                self.left[k], self.right[k] = (self.number[x] for x in parts)
            self.automaton.add_word(p, k)
            usable += 1
        self.automaton.make_automaton()
        # Along a token's merges ranks must rise for the fast pair test.
        self.rising = [self._rises(k) for k in range(len(names))]
        self._arrays()
        self.cuts = not any(MARK in p.lstrip(MARK) for p in names)
        known = "".join(re.escape(c) for c in sorted(chars - {MARK}))
        self.pieces_of = re.compile(f"{MARK}+[{known}]*|[{known}]+|[^{known}{MARK}]" if self.cuts else f"[{known}{MARK}]+|[^{known}{MARK}]", re.S)
        self.chars = chars
        self.pairs: dict[int, bool] = {}
        self.parts = _Table(self._part)
        self.words = _Table(self._marked)

    def _ids(self, piece: str) -> bytes:
        if piece in self.id_of:
            return self.id_of[piece].to_bytes(4, "little")
        return b"".join(self.byte_ids[b].to_bytes(4, "little") for b in piece.encode())

    def _merges(self, parts: list[str]) -> Iterator[list[str]]:
        """Plain BPE: the best pair first, the leftmost of equals."""
        while len(parts) > 1:
            best = min(((self.rank.get(a + b, 1 << 30), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))), default=(1 << 30, 0))
            if best[0] == 1 << 30:
                return
            i = best[1]
            parts = [*parts[:i], parts[i] + parts[i + 1], *parts[i + 2 :]]
            yield parts

    def _merge(self, piece: str) -> tuple[str, str] | None:
        """The pair of the last merge that makes ``piece``, if BPE makes it."""
        before = list(piece)
        for after in self._merges(before):
            if len(after) == 1:
                return before[0], before[1]
            before = after
        return None

    def _rises(self, k: int) -> bool:
        if self.left[k] < 0:
            return True
        r = self.rank[self.names[k]]
        return all(self.left[c] < 0 or (self.rank[self.names[c]] < r and self._rises(c)) for c in (self.left[k], self.right[k]))

    def _fits(self, a: int, b: int) -> bool:
        """Whether BPE encodes the text of a followed by that of b as (a, b)."""
        names, rank = self.names, self.rank
        if not (self.rising[a] and self.rising[b]):
            parts = list(names[a] + names[b])
            for parts in self._merges(parts):  # noqa: B007
                pass
            return parts == [names[a], names[b]]
        # Undo the merges of both sides, latest first; a pair over the border that
        # would have merged before the merge undone last contradicts (a, b).
        none = 1 << 30
        before = none  # ranks from here on were too late to merge over the border
        while True:
            if rank.get(names[a] + names[b], none) < before:
                return False
            ra = rank[names[a]] if self.left[a] >= 0 else -1
            rb = rank[names[b]] if self.left[b] >= 0 else -1
            if ra < 0 and rb < 0:
                return True
            if ra > rb:  # on a tie the right one was made last
                before, a = ra, self.right[a]
            else:
                before, b = rb + 1, self.left[b]

    def word(self, w: str) -> bytes:
        """The ids of a text of known characters that is encoded on its own."""
        pairs, fits, size = self.pairs, self._fits, self.size
        last = [-1] * (len(w) + 1)
        for end, k in self.automaton.iter(w):
            end, length = end + 1, size[k]
            if last[end] >= 0:
                continue
            if length < end:
                p = last[end - length]
                key = p << 20 | k
                ok = pairs.get(key)
                if ok is None:
                    if len(pairs) >= PAIRS_KEPT:
                        pairs.clear()
                    ok = pairs[key] = fits(p, k)
                if not ok:
                    continue
            last[end] = k
        at, found = len(w), []
        while at:
            k = last[at]
            found.append(self.out[k])
            at -= size[k]
        found.reverse()
        return b"".join(found)

    def _arrays(self) -> None:
        """The same tables as arrays, for many words at once."""
        names, number = self.names, self.number
        self.a_left, self.a_right = np.array(self.left, np.int32), np.array(self.right, np.int32)
        self.a_rank = np.array([self.rank[p] if self.left[k] >= 0 else -1 for k, p in enumerate(names)], np.int32)
        self.a_len = np.array([len(p) for p in names], np.int64)
        self.a_rising = np.array(self.rising)
        self.a_id = np.array([self.id_of.get(p, -1) for p in names], np.int64)
        joins = {number[p[:i]] << 20 | number[p[i:]]: r for p, r in self.rank.items() for i in range(1, len(p)) if p[:i] in number and p[i:] in number}
        # Open addressing: the slot of a pair is its hash or one of the next few.
        self.bits = 20
        self.slot_key, self.slot_rank = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, 1 << 30, np.int32)
        self.probes = 1
        for key, r in joins.items():
            at = (key * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 64 - self.bits
            n = 1
            while self.slot_key[at] != -1:
                at, n = (at + 1) % (1 << self.bits), n + 1
            self.slot_key[at], self.slot_rank[at], self.probes = key, r, max(self.probes, n)

    def _joined(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of the pieces a + b; 1 << 30 where there is none."""
        key = a.astype(np.int64) << 20 | b
        at = ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)
        got = self.slot_key[at]
        out = np.where(got == key, self.slot_rank[at], np.int32(1 << 30))
        open_ = np.flatnonzero((got != key) & (got != -1))
        for _ in range(self.probes - 1):
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) & (1 << self.bits) - 1
            got = self.slot_key[at[open_]]
            hit = got == key[open_]
            out[open_[hit]] = self.slot_rank[at[open_[hit]]]
            open_ = open_[~hit & (got != -1)]
        return out

    def _fit(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """_fits of many pairs."""
        out = np.zeros(len(a), bool)
        odd = np.flatnonzero(~(self.a_rising[a] & self.a_rising[b]))
        for i in odd.tolist():
            out[i] = self._fits(int(a[i]), int(b[i]))
        live = np.flatnonzero(self.a_rising[a] & self.a_rising[b])
        a, b = a[live], b[live]
        before = np.full(len(live), 1 << 30, np.int32)
        while len(live):
            ok = self._joined(a, b) >= before
            ra, rb = self.a_rank[a], self.a_rank[b]
            done = ok & (ra < 0) & (rb < 0)
            out[live[done]] = True
            on = np.flatnonzero(ok & ~done)
            live, a, b, ra, rb = live[on], a[on], b[on], ra[on], rb[on]
            one = ra > rb
            before = np.where(one, ra, rb + 1)
            a, b = np.where(one, self.a_right[a], a), np.where(one, b, self.a_left[b])
        return out

    def many(self, words: list[str]) -> list[bytes]:
        """word() of each: the prefix tables of all words, column by column."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.cumsum(sizes + 1) - sizes - 1
        apart = next(c for c in map(chr, range(1, 1 << 16)) if c not in self.chars)
        flat = np.fromiter(chain.from_iterable(self.automaton.iter(apart.join(words))), np.int64)
        ends, toks = flat[0::2] + 1, flat[1::2]
        column = ends - starts[np.searchsorted(starts, ends, side="left") - 1]
        order = np.argsort(column, kind="stable")
        bounds = np.searchsorted(column[order], np.arange(1, int(sizes.max(initial=0)) + 2))
        last = np.full(int(sizes.sum()) + len(words) + 1, -1, np.int64)
        for j in range(len(bounds) - 1):
            m = order[bounds[j] : bounds[j + 1]]
            e, k = ends[m], toks[m]
            whole = self.a_len[k] == j + 1
            last[e[whole]] = k[whole]
            e, k = e[~whole], k[~whole]
            p = last[e - self.a_len[k]]
            fit = self._fit(p, k)
            last[e[fit]] = k[fit]
        at, live, rows, found = starts + sizes, np.arange(len(words)), [], []
        while len(live):
            k = last[at]
            rows.append(live)
            found.append(k)
            at = at - self.a_len[k]
            on = at > starts[live]
            at, live = at[on], live[on]
        if not rows:
            return []
        row, tok = np.concatenate(rows[::-1]), np.concatenate(found[::-1])
        order = np.argsort(row, kind="stable")
        ids, cuts = self.a_id[tok[order]], np.searchsorted(row[order], np.arange(len(words) + 1)) * 4
        raw, cuts = ids.astype("<u4").tobytes(), cuts.tolist()
        out = [raw[i:j] for i, j in zip(cuts, cuts[1:], strict=False)]
        for i in set(row[order][ids < 0].tolist()):  # symbols that are no pieces
            out[i] = self.word(words[i])
        return out

    def prepare(self, texts: list[str]) -> None:
        """Fill the word table with all new words of ``texts`` at once."""
        if not self.cuts:
            return
        seen: set[str] = set()
        for t in texts:
            if t and t[0] != " " and "  " not in t and MARK not in t:
                seen.update(t.split(" "))
        new = [w for w in seen if w not in self.words and len(w) <= 48]
        if len(self.words) + len(new) > WORDS_KEPT:
            self.words.clear()
            new = [w for w in seen if len(w) <= 48]
        cut = [self.pieces_of.findall(MARK + w) for w in new]
        parts = [p for p in {p for c in cut for p in c} if p[0] in self.chars]
        got = dict(zip(parts, self.many(parts), strict=True))
        for w, c in zip(new, cut, strict=True):
            self.words[w] = got[c[0]] if len(c) == 1 else b"".join(got[p] if p in got else self._part(p) for p in c)

    def _part(self, w: str) -> bytes:
        """A run of known characters, or one unknown character: its bytes."""
        return self.word(w) if w[0] in self.chars else b"".join(self.byte_ids[b].to_bytes(4, "little") for b in w.encode())

    def _marked(self, w: str) -> bytes:
        """A mark and then ``w``, which has none."""
        found = self.pieces_of.findall(MARK + w)
        return self.word(found[0]) if len(found) == 1 else b"".join(map(self.parts.__getitem__, found))

    def encode(self, text: str) -> bytes:
        """The ids of a whole text, begin and end included, as little-endian
        unsigned 32-bit integers."""
        head, tail = self.bos.to_bytes(4, "little"), self.eos.to_bytes(4, "little")
        if not text:
            return head + tail
        if self.cuts and text[0] != " " and "  " not in text and MARK not in text:
            return head + b"".join(map(self.words.__getitem__, text.split(" "))) + tail
        found = self.pieces_of.findall(MARK + text.replace(" ", MARK))
        return head + b"".join(map(self.parts.__getitem__, found)) + tail

    def decode(self, ids: bytes) -> bytes:
        """The UTF-8 text of ids given as encode() returns them."""
        numbers = np.frombuffer(ids, dtype="<u4").tolist()
        first = next((i for i in numbers if i not in self.control), None)
        got = b"".join(map(self.surface.__getitem__, numbers))
        try:
            got.decode()
        except UnicodeDecodeError:
            got = self._lenient(numbers)
        return got[1:] if first in self.marked else got

    def _lenient(self, numbers: list[int]) -> bytes:
        """Bytes that form no character become U+FFFD one by one."""
        out, run = [], bytearray()

        def flush() -> None:
            at = 0
            while at < len(run):
                for width in (1, 2, 3, 4):
                    try:
                        bytes(run[at : at + width]).decode()
                    except UnicodeDecodeError:
                        continue
                    out.append(bytes(run[at : at + width]))
                    at += width
                    break
                else:
                    out.append("�".encode())
                    at += 1
            run.clear()

        for i in numbers:
            if i in self.is_byte:
                run += self.surface[i]
            elif i not in self.control or run:
                flush()
                out.append(self.surface[i])
        flush()
        return b"".join(out)


class _Table(dict):
    """What ``make`` gives for a text; emptied when full, so its memory is bounded."""

    def __init__(self, make: Callable[[str], bytes]):
        super().__init__()
        self.make = make

    def __missing__(self, w: str) -> bytes:
        got = self.make(w)
        if len(w) <= 64:
            if len(self) >= WORDS_KEPT:
                self.clear()
            self[w] = got
        return got


#: Bytes of text that are encoded together; a new worker looks up all their words at once.
SLICE = 2 << 20
_LOADED: dict[bytes, Bpe] = {}


def load(model: bytes) -> Bpe:
    """The tables of a model, made once in each Python worker."""
    key = hashlib.sha256(model).digest()
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Bpe(model)
    return _LOADED[key]


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _shipped(df: DataFrame, path: str | None) -> Any:
    """The model file (a fixed vocabulary of a few hundred kB), sent to all executors."""
    with open(path or default_model(), "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(df: DataFrame, text: str = "text", path: str | None = None, out: str = "ids") -> DataFrame:
    """``df`` with a column ``out`` (array<bigint>) of the ids of each text."""
    model = _shipped(df, path)
    schema = T.StructType([*(f for f in df.schema.fields if f.name != out), T.StructField(out, T.ArrayType(T.LongType()))])
    kept = [f.name for f in schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(model.value)
        for batch in batches:
            for part in chunks(batch, text, SLICE):
                texts = part.column(part.schema.get_field_index(text)).to_pylist()
                bpe.prepare(texts)
                ids = [bpe.encode(t or "") for t in texts]
                offsets = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32)
                values = np.frombuffer(b"".join(ids), dtype="<u4").astype(np.int64)
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in kept), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], [*kept, out])

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, ids: str = "ids", path: str | None = None, out: str = "decoded") -> DataFrame:
    """``df`` with a column ``out`` of the text of each list of ids; null: empty."""
    model = _shipped(df, path)
    schema = T.StructType([*(f for f in df.schema.fields if f.name != out), T.StructField(out, T.StringType())])
    kept = [f.name for f in schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(model.value)
        for batch in batches:
            got = [bpe.decode(np.asarray(x or [], dtype="<u4").tobytes()).decode() for x in batch.column(batch.schema.get_field_index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), pa.array(got, pa.string())], [*kept, out])

    return df.mapInArrow(run, schema)


def round_trip_digests(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """Encode each whole text, decode its ids, and keep digests of both."""
    model = _shipped(df, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(model.value)
        for batch in batches:
            for part in chunks(batch, text, SLICE):
                n, a, b = [], [], []
                texts = part.column(1).to_pylist()
                bpe.prepare(texts)
                for t in texts:
                    ids = bpe.encode(t or "")
                    n.append(len(ids) // 4)
                    a.append(hashlib.sha256(ids).hexdigest())
                    b.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(a), pa.array(b)], [key, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
