"""Token counts and ids with public tokenizer files, in Arrow batches.

A text is cut where byte-level BPE begins a new word whatever stands around:
before a single space between two visible ASCII or Latin-1 characters, on both sides of a
single newline between such characters, and between an ASCII letter and a full
stop or comma.  No token crosses such a place (the special strings hold none),
so the pieces' ids joined are the ids of the whole text.  Equal pieces are
encoded once: a worker keeps up to `CACHE` pieces by 64-bit hash, with their
bytes, which each match is compared with; a piece that only hashes like another
is encoded by itself, so ids do not rest on the hash.  A new piece that is one word of letters goes
straight to the library's BPE model, any other through its whole pipeline.
Other tokenizers get whole texts, in batches balanced by bytes.

Edge cases: a null text counts as empty (0 tokens); special strings in a text
are treated as the library does by default; there is no truncation or padding;
a very long text is cut into pieces like any other, and only its ids grow with
it; repeated rows are counted each; an empty table gives an empty result; a
column of the input that has the name of an added one is replaced.
"""

from __future__ import annotations

import json
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .textops import Ranges, Texts, map_texts
from .workers import kept

CACHE = 1_000_000
_VISIBLE = np.zeros(256, bool)
_VISIBLE[33:127] = True
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".,;:!?#$%&*+-/()")] = True  # no character of a special string
#: One word of Latin-1 letters, with or without its leading space.
_WORD = r" ?(?:[A-Za-z]|\xC3[\x80-\x96\x98-\xB6\xB8-\xBF])+"


def _byte_names() -> dict[int, str]:
    """The character by which byte-level vocabularies name each byte: itself if printable, else the next from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}


def vocabulary_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(path: str) -> "Encoder":
    """The worker's encoder of this file; what it has learnt serves its later tasks."""
    held = kept("encoders")
    if path not in held:
        held[path] = Encoder(path)
    return held[path]


class _Column:
    """An array that grows at its end: all, the values so far."""

    def __init__(self, kind) -> None:
        self.room = np.zeros(1024, kind)
        self.all = self.room[:0]

    def __len__(self) -> int:
        return len(self.all)

    def add(self, values: np.ndarray) -> None:
        n = len(self.all) + len(values)
        if n > len(self.room):
            room = np.zeros(2 * n, self.room.dtype)
            room[: len(self.all)] = self.all
            self.room = room
        self.room[len(self.all) : n] = values
        self.all = self.room[:n]

    def cut(self, n: int) -> None:
        self.all = self.room[:n]


class Encoder:
    """ids(Texts) -> (flat ids, row offsets); made in each task from a vocabulary file's path."""

    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.pieces = False
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.encode = lambda texts: model.encode(texts, num_threads=1)
        else:
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            model.no_truncation()
            model.no_padding()
            batch = getattr(model, "encode_batch_fast", model.encode_batch)  # the same ids without offsets
            self.encode = lambda texts: [e.ids for e in batch(texts, add_special_tokens=False)]
            with open(path) as f:
                kind = json.load(f)
            pre = kind.get("pre_tokenizer") or {}
            self.pieces = (
                pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not kind.get("normalizer")
                and not any(a["lstrip"] or a["rstrip"] or a["single_word"] or " " in a["content"] for a in kind.get("added_tokens", ()))
            )
        if self.pieces:
            self.word, self.names = re.compile(_WORD.encode("latin-1")), _byte_names()
            self.bpe = model.model.tokenize
        self.keys = np.zeros(0, np.uint64)  # sorted hashes of known pieces
        self.slot = np.zeros(0, np.int32)  # of each key, its place in first and size
        # By slot: where the piece's ids begin in store and how many they are; its size in bytes, its first word, and where its further words begin in more.
        self.first, self.size, self.store = _Column(np.int32), _Column(np.int32), _Column(np.int32)
        self.bytes, self.head, self.rest, self.more = _Column(np.int64), _Column(np.uint64), _Column(np.int64), _Column(np.uint64)

    def encode_pieces(self, pieces: list[bytes]) -> list[list[int]]:
        out, rest = [], []
        for k, p in enumerate(pieces):
            if self.word.fullmatch(p):
                out.append([t.id for t in self.bpe(p.decode("latin-1").translate(self.names))])
            else:
                out.append(None)
                rest.append(k)
        for k, ids in zip(rest, self.encode([pieces[k].decode("utf-8", "replace") for k in rest])):
            out[k] = ids
        return out

    def learn(self, hashes: np.ndarray, pieces: list[bytes], keep: bool = True) -> np.ndarray:
        """Slots of new pieces (hashes are sorted); beyond CACHE, or if not to be kept, they serve this slice only."""
        got = self.encode_pieces(pieces)
        size = np.fromiter(map(len, got), np.int32, len(got))
        flat = np.fromiter(chain.from_iterable(got), np.int32, int(size.sum()))
        slot = (len(self.first) + np.arange(len(hashes))).astype(np.int32)
        self.first.add(len(self.store) + np.cumsum(size) - size)
        self.size.add(size)
        self.store.add(flat)
        if keep and len(self.keys) + len(hashes) <= CACHE:
            place = np.searchsorted(self.keys, hashes)
            self.keys, self.slot = np.insert(self.keys, place, hashes), np.insert(self.slot, place, slot)
            length = np.fromiter(map(len, pieces), np.int64, len(pieces))
            ends = np.cumsum(length)
            r = Ranges(np.frombuffer(b"".join(pieces), np.uint8), ends - length, ends)
            rest = np.zeros(len(pieces), np.int64)
            rest[r.long] = len(self.more) + r.first[:-1]
            for column, values in ((self.bytes, length), (self.head, r.head), (self.rest, rest), (self.more, r.more)):
                column.add(values)
        return slot

    def settle(self) -> None:
        """Forget what has no key."""
        n = len(self.keys)
        if len(self.first) > n:
            self.first.cut(n)
            self.size.cut(n)
            self.store.cut(int(self.first.all[-1] + self.size.all[-1]) if n else 0)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.keys):
            return np.zeros(len(keys), np.int32), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return self.slot[at], self.keys[at] == keys

    def ids(self, t: Texts, lengths_only: bool = False):
        if not self.pieces:
            got = self.encode([bytes(t.buf[a:b]).decode("utf-8", "replace") for a, b in zip(t.off[:-1], t.off[1:])])
            size = np.fromiter(map(len, got), np.int64, len(got))
            off = np.r_[0, np.cumsum(size)]
            return (None, off) if lengths_only else (np.fromiter((i for ids in got for i in ids), np.int32, int(off[-1])), off)
        buf = t.buf
        cut = np.zeros(len(buf), bool)
        if len(buf) > 2:
            here = buf[1:-1]
            latin = np.zeros(len(buf) - 2, bool)  # the byte before ends one of U+00C0 to U+00FF
            latin[1:] = buf[:-3] == 0xC3
            edge = (_VISIBLE[buf[:-2]] | latin) & (_VISIBLE[buf[2:]] | (buf[2:] == 0xC3))
            line = edge & (here == 10)
            letter = _ASCII_LETTER[buf[:-2]] | latin & (buf[:-2] != 0x97) & (buf[:-2] != 0xB7)
            cut[1:-1] = edge & (here == 32) | line | (letter & _STOP[here])
            cut[2:] |= line
        cut[t.off[:-1][t.off[:-1] < t.off[1:]]] = True
        lo = np.flatnonzero(cut)
        hi = np.r_[lo[1:], len(buf)].astype(np.int64)[: len(lo)]
        pieces = Ranges(buf, lo, hi)
        h = pieces.hash()
        order = np.argsort(h)
        new = np.ones(len(h), bool)
        new[1:] = h[order][1:] != h[order][:-1]
        first = order[new]
        keys, back = h[first], np.empty(len(h), np.int64)
        back[order] = np.cumsum(new) - 1
        slot, known = self.find(keys)
        # Pieces that only hash like another one of this slice or of the cache: those of eight bytes and one size cannot.
        size = pieces.size[order]
        alone = np.zeros(len(h), bool)
        if ((size[1:] != size[:-1]) & ~new[1:]).any():
            alone = pieces.size != pieces.size[first[back]]
        at = pieces.long[~alone[pieces.long]]
        rep = first[back[at]]
        at, rep = at[at != rep], rep[at != rep]
        rest = np.zeros(len(h), np.int64)
        rest[pieces.long] = pieces.first[:-1]
        alone[at] = ~_equal(pieces, at, pieces.head, rest, pieces.more, rep)
        at = np.flatnonzero(known)
        other = self.bytes.all[slot[at]] != pieces.size[first[at]]
        long = np.flatnonzero(~other & (pieces.size[first[at]] > 8))
        other[long] = ~_equal(pieces, first[at[long]], self.head.all, self.rest.all, self.more.all, slot[at[long]])
        if other.any():
            alone |= np.isin(back, at[other])
        data = buf.tobytes() if not known.all() or alone.any() else b""
        if not known.all():
            new = np.flatnonzero(~known)
            a, b = lo[first[new]].tolist(), hi[first[new]].tolist()
            slot[new] = self.learn(keys[new], [data[x:y] for x, y in zip(a, b)])
        slot = slot[back]
        if alone.any():
            at = np.flatnonzero(alone)
            slot[at] = self.learn(h[at], [data[x:y] for x, y in zip(lo[at].tolist(), hi[at].tolist())], keep=False)
        size = self.size.all[slot]
        ends = np.r_[0, np.cumsum(size, dtype=np.int64)]
        off = ends[np.searchsorted(lo, t.off)]
        at = None if lengths_only else np.arange(ends[-1]) + np.repeat(self.first.all[slot] - ends[:-1], size)
        out = None if lengths_only else self.store.all[at]
        self.settle()
        return out, off


def _equal(r: Ranges, i: np.ndarray, head, rest, more, j: np.ndarray) -> np.ndarray:
    """Whether range i[k] of r, of more than eight bytes, has the first and further words that stand at j[k], where one of its size is."""
    same = r.head[i] == head[j]
    own = np.searchsorted(r.long, i)
    n = r.first[own + 1] - r.first[own]
    ends = np.cumsum(n)
    step = np.arange(int(n.sum()))
    differs = r.more[step + np.repeat(r.first[own] - (ends - n), n)] != more[step + np.repeat(rest[j] - (ends - n), n)]
    same[np.repeat(np.arange(len(i)), n)[differs]] = False
    return same


def count_tokens(docs: DataFrame, path: str, limit: int = 1024, text: str = "text", keep=None) -> DataFrame:
    """Adds n_bytes, n_tokens and over_limit (n_tokens > limit)."""

    def make():
        e = encoder(path)

        def f(t: Texts):
            n = np.diff(e.ids(t, lengths_only=True)[1]).astype(np.int64)
            return [np.diff(t.off).astype(np.int64), n, pa.array(n > limit)]

        return f

    fields = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())]
    return map_texts(docs, make, fields, text, keep, uses=("encoders",))
