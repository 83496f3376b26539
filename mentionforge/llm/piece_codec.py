"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

All words of a batch of texts lie in flat numpy arrays of piece ids. A round finds each word's best adjacent pair (the
smallest merge rank, by a segmented minimum), merges its occurrences from the left, and compacts the arrays; words
without a mergeable pair leave. A merge whose result could itself take part in a better one is done one occurrence at a
time, so the order is the library's in every case.

Rows: a null text is an empty text; an empty text has the begin and end ids alone. Repeated rows and ties give equal
results, extra columns do not matter, an empty table gives an empty table. Texts of any length are taken whole.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import kernels as K
from .common import small_batches, table

SPACE = "▁"
_SPACE_BYTES = np.frombuffer(SPACE.encode(), np.uint8)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _fields(raw: bytes):
    """(field, value) of a protocol-buffer message."""

    def varint(i):
        value = shift = 0
        while True:
            c = raw[i]
            i += 1
            value |= (c & 127) << shift
            if c < 128:
                return value, i
            shift += 7

    i = 0
    while i < len(raw):
        key, i = varint(i)
        kind = key & 7
        if kind == 0:
            value, i = varint(i)
        elif kind == 2:
            n, i = varint(i)
            value, i = raw[i : i + n], i + n
        else:
            n = 4 if kind == 5 else 8
            value, i = raw[i : i + n], i + n
        yield key >> 3, value


class Codec:
    """A BPE model with byte fallback, identity normalisation and a dummy space before the text."""

    NORMAL, UNKNOWN, CONTROL, USER, BYTE, UNUSED = 1, 2, 3, 4, 6, 5

    def __init__(self, model_file: str):
        pieces, scores, kinds = [], [], []
        dummy, squeeze, charsmap, kind = True, True, b"", 1
        for field, value in _fields(open(model_file, "rb").read()):
            if field == 1:
                own = dict(_fields(value))
                pieces.append(own[1].decode())
                scores.append(float(np.frombuffer(own.get(2, b"\0\0\0\0"), "<f4")[0]))
                kinds.append(own.get(3, self.NORMAL))
            elif field == 2:
                kind = dict(_fields(value)).get(3, 1)
            elif field == 3:
                own = dict(_fields(value))
                dummy, squeeze, charsmap = bool(own.get(3, 1)), bool(own.get(4, 1)), own.get(2, b"")
        if kind != 2 or charsmap or squeeze or not dummy or self.USER in kinds or self.UNUSED in kinds:
            raise ValueError("only BPE models with identity normalisation and a dummy prefix are covered")
        if any(p[k] == SPACE and p[k - 1] != SPACE for p in pieces for k in range(1, len(p))):
            raise ValueError("a piece spans words")
        self.pieces, self.kinds = pieces, np.array(kinds)
        self.bos, self.eos = pieces.index("<s>"), pieces.index("</s>")
        n = len(pieces)
        normal = {p: i for i, p in enumerate(pieces) if kinds[i] == self.NORMAL}
        # symbols: pieces, and beyond them characters that are none, by code point
        byte_of = {int(p[3:5], 16): i for i, p in enumerate(pieces) if kinds[i] == self.BYTE}
        self.byte_id = np.array([byte_of[b] for b in range(256)], np.int64)
        self.outside = n
        self.char_id = np.arange(0x110000, dtype=np.int64) + n
        for p, i in normal.items():
            if len(p) == 1:
                self.char_id[ord(p)] = i
        order = {s: r for r, s in enumerate(sorted({scores[i] for i in normal.values()}, reverse=True))}
        left, right, made = [], [], []
        for p, i in normal.items():
            for k in range(1, len(p)):
                a, b = self._symbol(normal, p[:k]), self._symbol(normal, p[k:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    made.append(i)
        rank = np.array([order.get(scores[i], 0) if kinds[i] == self.NORMAL else 0 for i in range(n)], np.int64)
        left, right, made = (np.array(x, np.int64) for x in (left, right, made))
        # a piece is made at once in all places of a word only if no merge with it outranks it, and its rank is its own
        unsafe = np.zeros(n, bool)
        for side in (left, right):
            ok = side < n
            hit = side[ok][rank[made[ok]] <= rank[side[ok]]]
            unsafe[hit] = True
        ranks, per = np.unique(rank[list(normal.values())], return_counts=True)
        unsafe |= np.isin(rank, ranks[per > 1])
        self.rank_of, self.unsafe = rank, unsafe
        self._hash_pairs(left, right, made)
        # decoding
        surface = [bytes([int(p[3:5], 16)]) if kinds[i] == self.BYTE else b"" if kinds[i] == self.CONTROL else " ⁇ ".encode() if kinds[i] == self.UNKNOWN else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.surface_at = np.concatenate([[0], np.cumsum([len(s) for s in surface])])
        self.surface = np.frombuffer(b"".join(surface), np.uint8)

    def _symbol(self, normal: dict, text: str):
        if text in normal:
            return normal[text]
        return self.outside + ord(text) if len(text) == 1 else None

    def _hash_pairs(self, left, right, made) -> None:
        """An open-addressed table from a pair of symbols to the piece it makes."""
        key = left << 32 | right
        bits = 22
        slots, value = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int64)
        at, todo, self._steps = self._slot(key, bits), np.arange(len(key)), 1
        while len(todo):
            free = slots[at[todo]] < 0
            first = np.unique(at[todo[free]], return_index=True)[1]
            put = todo[free][first]
            slots[at[put]], value[at[put]] = key[put], made[put]
            todo = todo[slots[at[todo]] != key[todo]]
            if len(todo):
                at[todo] = (at[todo] + 1) & ((1 << bits) - 1)
                self._steps += 1
        self._slots, self._value, self._bits = slots, value, bits

    @staticmethod
    def _slot(key: np.ndarray, bits: int) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)

    def _made(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece each pair makes, or -1."""
        key = left << 32 | right
        at = self._slot(key, self._bits)
        got = self._slots[at]
        out = np.where(got == key, self._value[at], -1)
        todo = np.flatnonzero((got != key) & (got >= 0))
        for _ in range(self._steps):
            if not len(todo):
                break
            at[todo] = (at[todo] + 1) & ((1 << self._bits) - 1)
            got = self._slots[at[todo]]
            hit = got == key[todo]
            out[todo[hit]] = self._value[at[todo[hit]]]
            todo = todo[~hit & (got >= 0)]
        return out

    def _merge(self, sym: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge rounds over words (symbols end to end, and their offsets); returns the same form."""
        words = len(offs) - 1
        done_sym, done_word, done_n = [], [], []
        live = np.arange(words)
        far = np.int64(2**40)
        while len(live):
            n = len(sym)
            last = np.zeros(n, bool)
            last[offs[1:] - 1] = True
            made = np.full(n, -1, np.int64)
            inner = np.flatnonzero(~last)
            made[inner] = self._made(sym[inner], sym[inner + 1])
            rank = np.where(made >= 0, self.rank_of[made], far)
            best = np.minimum.reduceat(rank, offs[:-1])
            going = best < far
            size = np.diff(offs)
            if not going.all():
                out = ~going
                mask = np.repeat(out, size)
                done_sym.append(sym[mask])
                done_word.append(live[out])
                done_n.append(size[out])
                sym, made, rank = sym[~mask], made[~mask], rank[~mask]
                live, size, best = live[going], size[going], best[going]
                offs = np.concatenate([[0], np.cumsum(size)])
                if not len(live):
                    break
            hit = rank == np.repeat(best, size)
            pos = np.flatnonzero(hit)
            word = np.searchsorted(offs, pos, "right") - 1
            fresh = np.ones(len(pos), bool)
            fresh[1:] = word[1:] != word[:-1]
            # of places in a row that overlap (A A A), every second one from the left
            run = np.ones(len(pos), bool)
            run[1:] = (pos[1:] != pos[:-1] + 1) | fresh[1:]
            head = np.flatnonzero(run)
            nth = np.arange(len(pos)) - np.repeat(head, np.diff(np.append(head, len(pos))))
            take = (nth % 2 == 0) & (fresh | ~self.unsafe[made[pos]])
            pos, word = pos[take], word[take]
            sym[pos] = made[pos]
            gone = np.ones(len(sym), bool)
            gone[pos + 1] = False
            sym = sym[gone]
            offs = np.concatenate([[0], np.cumsum(size - np.bincount(word, minlength=len(size)))])
        if not done_sym:
            return sym, offs
        flat, word, size = np.concatenate(done_sym), np.concatenate(done_word), np.concatenate(done_n)
        at = np.concatenate([[0], np.cumsum(size)])[:-1]
        order = np.argsort(word)
        size = size[order]
        offs = np.concatenate([[0], np.cumsum(size)])
        return flat[np.repeat(at[order] - offs[:-1], size) + np.arange(offs[-1])], offs

    def _bytes_for(self, sym: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols that are no pieces become the byte pieces of their UTF-8 form."""
        odd = np.flatnonzero(sym >= self.outside)
        if not len(odd):
            return sym, offs
        cp = sym[odd] - self.outside
        width = 1 + (cp >= 0x80) + (cp >= 0x800) + (cp >= 0x10000)
        per = np.ones(len(sym), np.int64)
        per[odd] = width
        at = np.concatenate([[0], np.cumsum(per)])
        out = np.empty(at[-1], np.int64)
        plain = sym < self.outside
        out[at[:-1][plain]] = sym[plain]
        for w, lead in ((1, 0), (2, 0xC0), (3, 0xE0), (4, 0xF0)):
            own, c = at[odd[width == w]], cp[width == w]
            for k in range(w):
                part = (c >> (6 * (w - 1 - k))) & (0x3F if k else 0xFF)
                out[own + k] = self.byte_id[part | (lead if not k and w > 1 else 0x80 if k else 0)]
        return out, at[offs]

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of UTF-8 texts (bytes end to end, and their offsets) with begin and end ids, in the same form."""
        n = len(offs) - 1
        text = data.tobytes().decode()
        cp = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
        lead = (data & 0xC0) != 0x80
        at = np.concatenate([[0], np.cumsum(lead)])[offs]
        full = np.flatnonzero(np.diff(at))
        # the dummy space before each text that has any character
        add = np.zeros(n, np.int64)
        add[full] = 1
        start = at[:-1] + np.cumsum(add) - add
        chars = np.full(len(cp) + len(full), ord(SPACE), np.int64)
        own = np.ones(len(chars), bool)
        own[start[full]] = False
        chars[own] = cp
        chars[chars == 32] = ord(SPACE)
        space = chars == ord(SPACE)
        # a word starts at a text's start and wherever a space follows another character
        begin = np.zeros(len(chars), bool)
        begin[1:] = space[1:] & ~space[:-1]
        begin[start[full]] = True
        first = np.flatnonzero(begin)
        last = np.append(first[1:], len(chars)) if len(first) else first
        ids = np.empty(0, np.int64)
        got = np.zeros(n, np.int64)
        if len(first):
            sym = self.char_id[chars]
            one, back = _same_words(sym, first, last)
            size = (last - first)[one]
            woffs = np.concatenate([[0], np.cumsum(size)])
            flat = sym[np.repeat(first[one] - woffs[:-1], size) + np.arange(woffs[-1])]
            flat, woffs = self._bytes_for(*self._merge(flat, woffs))
            size = np.diff(woffs)[back]
            woff = np.concatenate([[0], np.cumsum(size)])
            ids = flat[np.repeat(woffs[:-1][back] - woff[:-1], size) + np.arange(woff[-1])]
            doc = np.searchsorted(start[full], first, "right") - 1
            got[full] = np.bincount(doc, weights=size, minlength=len(full)).astype(np.int64)
        out_at = np.concatenate([[0], np.cumsum(got + 2)])
        out = np.empty(out_at[-1], np.int64)
        body = np.ones(len(out), bool)
        body[out_at[:-1]] = False
        body[out_at[1:] - 1] = False
        out[body] = ids
        out[out_at[:-1]], out[out_at[1:] - 1] = self.bos, self.eos
        return out, out_at

    def decode(self, ids: np.ndarray, offs: np.ndarray) -> list[bytes]:
        """The texts of id sequences in UTF-8: control ids vanish, the dummy space goes, bad bytes become U+FFFD."""
        size = np.diff(self.surface_at)[ids]
        at = np.concatenate([[0], np.cumsum(size)])
        data = self.surface[np.repeat(self.surface_at[:-1][ids] - at[:-1], size) + np.arange(at[-1])]
        ends = at[offs]
        odd = self.kinds[ids] == self.BYTE
        # the first piece that is no control piece, if it starts with a space
        plain = self.kinds[ids] != self.CONTROL
        where = np.flatnonzero(plain)
        k = np.searchsorted(where, offs[:-1])
        head = np.where(k < len(where), where[np.minimum(k, max(len(where) - 1, 0))] if len(where) else 0, len(ids))
        out = []
        for d in range(len(offs) - 1):
            part, h = data[ends[d] : ends[d + 1]].tobytes(), head[d]
            if h < offs[d + 1] and not odd[h] and part[:1] == b" " and self.pieces[ids[h]][:1] == SPACE:
                part = part[1:]
            out.append(part.decode(errors="replace").encode() if odd[offs[d] : offs[d + 1]].any() else part)
        return out


def _same_words(sym: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words that tile sym: one word of each kind, and the kind of every word.

    Fingerprints only propose: every word is compared with the one it is taken for, symbol by symbol.
    """
    key = K.spans(sym.astype("<u4").view(np.uint8), first * 4, last * 4)
    _, one, back = np.unique(key, return_index=True, return_inverse=True)
    size = last - first
    like = one[back]
    other = size != size[like]
    like[other] = np.flatnonzero(other)
    unlike = np.flatnonzero(sym[np.repeat(first[like] - first, size) + np.arange(len(sym))] != sym)
    other[np.searchsorted(first, unlike, "right") - 1] = True
    kinds: dict[bytes, int] = {}
    for w in np.flatnonzero(other).tolist():
        word = sym[first[w] : last[w]].tobytes()
        if word not in kinds:
            kinds[word] = len(one)
            one = np.append(one, w)
        back[w] = kinds[word]
    return one, back


@lru_cache(2)
def codec(model_file: str) -> Codec:
    return Codec(model_file)


ENCODED = "ids binary, n_tokens long, decoded string"


def encode(df: DataFrame, model_file: str, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """`keep` columns with ids (little-endian unsigned 32-bit), n_tokens (begin and end included) and decoded."""
    return _codes(df, model_file, text, keep, digests=False)


def _codes(df: DataFrame, model_file: str, text: str, keep: tuple[str, ...], digests: bool) -> DataFrame:
    small_batches(df.sparkSession)
    more = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else ENCODED
    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep), more])

    def run(batches):
        model = codec(model_file)
        for batch, data, offs in K.slices(batches, text, 1 << 20):
            ids, at = model.encode(data, offs)
            raw = ids.astype("<u4").tobytes()
            parts = [raw[4 * a : 4 * b] for a, b in zip(at[:-1], at[1:])]
            back = model.decode(ids, at)
            own = [batch.column(c) for c in keep]
            count = pa.array(np.diff(at))
            if digests:
                own += [count, *(pa.array([hashlib.sha256(x).hexdigest() for x in xs]) for xs in (parts, back))]
                names = ["n_tokens", "ids_sha256", "decoded_sha256"]
            else:
                own += [pa.array(parts, pa.binary()), count, pa.array([x.decode() for x in back], pa.string())]
                names = ["ids", "n_tokens", "decoded"]
            yield pa.RecordBatch.from_arrays(own, names=[*keep, *names])

    return df.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)


def op5_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _codes(table(spark, sf_dir, "documents"), default_model(), "text", ("doc_id",), digests=True)
