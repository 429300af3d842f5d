"""SentencePiece encoding and decoding with pieces matched through a suffix array of the batch's text."""

from __future__ import annotations

import re
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ostinato.llm.common import give_back, pieces_of, short_batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
CHUNK = 1 << 16  # characters indexed at once
PART = 512 << 10  # bytes of text worked on at once
CACHED = 60_000  # segments whose pieces a worker keeps
KEPT = 1024  # characters up to which it keeps a segment's
LONG = 96  # characters up to which segments are relaxed together
_NEVER = np.int32(2**31 - 1)


def read_model(path: str = MODEL) -> list[tuple[str, float, int]]:
    """(piece, score, kind) of every id; kinds are 1 normal, 2 unknown, 3 control, 4 user-defined, 5 unused, 6 byte.

    Only models as the queries use are taken: byte-pair merges with byte fallback, no normalization,
    a leading space, and no user-defined or unused pieces. Others raise ValueError.
    """
    from sentencepiece import sentencepiece_model_pb2

    m = sentencepiece_model_pb2.ModelProto()
    m.ParseFromString(Path(path).read_bytes())
    n, t = m.normalizer_spec, m.trainer_spec
    pieces = [(p.piece, p.score, p.type) for p in m.pieces]
    if t.model_type != 2 or not t.byte_fallback or n.precompiled_charsmap or not n.add_dummy_prefix or n.remove_extra_whitespaces:
        raise ValueError("not a byte-pair model with byte fallback, identity normalization and a leading space")
    if any(k in (4, 5) for _, _, k in pieces):
        raise ValueError("user-defined and unused pieces aren't supported")
    return pieces


class PieceMatcher:
    """Finds all occurrences of all pieces in a batch of segments and relaxes them, sorted by position, to encodings.

    A byte-pair encoding is no best sum of scores, so an edge is relaxed by a test: of a prefix's encoding only the last
    piece is kept, and a piece that begins there extends it if no merge crosses the place between the two. For each
    prefix one edge passes. Of two merges that of the better score comes first, of equal scores the leftmost.
    """

    def __init__(self, pieces: list[tuple[str, float, int]]):
        normal = sorted(((i, p, s) for i, (p, s, k) in enumerate(pieces) if k == 1), key=lambda x: (-x[2], x[0]))
        self.ids = np.array([i for i, _, _ in normal], dtype=np.int32)
        joined = [p for _, p, _ in normal if len(p) > 1]
        rank = np.array([0, *np.cumsum(np.diff([s for _, _, s in normal]) != 0)], dtype=np.int32)  # equal scores tie
        self.byte = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(pieces) if k == 6}
        self.width = max(len(p) for _, p, _ in normal)
        self.words = -(-self.width // 4)
        letters = sorted({c for _, p, _ in normal for c in p})
        if len(letters) >= 0xFFFF:
            raise ValueError("too many distinct characters")
        self.letter = np.zeros(0x110000, dtype=np.uint16)
        self.letter[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.length = np.array([len(p) for _, p, _ in normal], dtype=np.int32)
        low = np.zeros((len(normal), 4 * self.words), dtype=np.uint64)
        for row, (_, p, _) in zip(low, normal, strict=True):
            row[: len(p)] = self.letter[[ord(c) for c in p]]
        high = np.where(np.arange(4 * self.words) < self.length[:, None], low, np.uint64(0xFFFF))
        self.low, self.high = ([self._pack(x[:, 4 * j : 4 * j + 4].T) for j in range(self.words)] for x in (low, high))
        self.sorted = np.argsort(self.low[0]).astype(np.int32)  # pieces are searched for in this order
        self.low, self.high = ([k[self.sorted] for k in x] for x in (self.low, self.high))
        # A piece has its space mark only in front, or consists of marks: a segment begins with a run of
        # marks. Line feeds are in no piece of several characters, so they stand alone.
        if any(SPACE in p.lstrip(SPACE) for p in joined):
            raise ValueError("a piece holds a space mark after other characters")
        self.split = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+" if any("\n" in p for p in joined) else f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n").findall
        self.cache: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}
        self.rank = np.append(rank, _NEVER)  # the number after the last piece's stands for none
        self.none = len(normal)
        self.number = np.int16 if self.none < 1 << 15 else np.int32  # small tables stay in a core's cache
        self._learn_merges([p for _, p, _ in normal])

    def _learn_merges(self, pieces: list[str]) -> None:
        """The two parts that each piece is last merged from; a piece that no merges lead to is never used."""
        n = len(pieces)
        self.left, self.right = np.full(n, -1, dtype=np.int32), np.full(n, -1, dtype=np.int32)
        self.born = np.where(self.length > 1, self.rank[:-1], np.int32(-1))  # when it is merged
        self.valid = self.length == 1
        text = "\0".join(pieces)
        code = self.letter[np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)]
        code[np.cumsum(self.length + 1)[:-1] - 1] = 0
        table, _, _ = self.edges(code)
        start = np.append(0, np.cumsum(self.length + 1)[:-1])
        for size in range(2, self.width + 1):
            for k in range(1, size):
                p = np.flatnonzero((self.length == size) & ~self.valid).astype(np.int32)
                a, b = table[start[p], k], table[start[p] + k, size - k]
                use = (a != self.none) & (b != self.none)
                p, a, b = p[use], a[use], b[use]
                use = self.valid[a] & self.valid[b] & (np.maximum(self.born[a], self.born[b]) <= self.born[p])
                p, a, b = p[use], a[use], b[use]
                use = self._apart(table, a, b, start[p] + k, self.born[p])
                p = p[use]
                self.left[p], self.right[p], self.valid[p] = a[use], b[use], True

    @staticmethod
    def _pack(c):
        c = [x.astype(np.uint64) for x in c]
        return c[0] << np.uint64(48) | c[1] << np.uint64(32) | c[2] << np.uint64(16) | c[3]

    def _bound(self, keys, pieces, lo, hi, after: bool) -> np.ndarray:
        """For every piece the number of sorted suffixes, of those between lo and hi, before it (or, with ``after``, up to it)."""
        n = len(keys[0])
        for _ in range(int((hi - lo).max(initial=0)).bit_length()):
            mid = (lo + hi) >> 1
            at = np.minimum(mid, n - 1)
            less, same = np.zeros(len(lo), dtype=bool), np.ones(len(lo), dtype=bool)
            for k, p in zip(keys, pieces, strict=True):
                x = k[at]
                less |= same & (x < p)
                same &= x == p
            go = (less | same if after else less) & (lo < hi)
            lo, hi = np.where(go, mid + 1, lo), np.where(go | (lo >= hi), hi, mid)
        return lo

    def edges(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All occurrences: a table over (position, length) of the piece that stands there, and (position, piece) as two arrays.

        Suffixes are sorted by as many characters as the longest piece has, by four, then by twice as many each time;
        each piece's occurrences are then one range.
        Binary search by the first four characters finds a range for every piece; longer pieces are searched on inside it.
        """
        n = len(code)
        padded = np.append(code, np.zeros(4 * self.words + 3, dtype=code.dtype))
        packed = self._pack([padded[i : n + 4 * self.words + i] for i in range(4)])
        order, done = np.argsort(packed[:n]), 4
        key = packed[:n][order]
        while done < self.width:
            rank = np.zeros(n + done, dtype=np.uint64)
            rank[order] = np.cumsum(np.append(True, key[1:] != key[:-1]))
            pair = rank[:n] << np.uint64(32) | rank[done:]
            order, done = np.argsort(pair), 2 * done
            key = pair[order]
        keys = [packed[4 * j : 4 * j + n][order] for j in range(self.words)]
        lo, hi = np.searchsorted(keys[0], self.low[0], "left"), np.searchsorted(keys[0], self.high[0], "right")
        far = np.flatnonzero((lo < hi) & (self.length[self.sorted] > 4))
        if len(far):
            a, b = lo[far], hi[far]
            lo[far] = self._bound(keys[1:], [x[far] for x in self.low[1:]], a, b, False)
            hi[far] = self._bound(keys[1:], [x[far] for x in self.high[1:]], a, b, True)
        count = hi - lo
        piece = np.repeat(self.sorted, count)
        position = order[np.arange(len(piece)) + np.repeat(lo - (np.cumsum(count) - count), count)]
        table = np.full((n, self.width + 2), self.none, dtype=self.number)  # the last column stays empty, for what is longer
        table[position, self.length[piece]] = piece
        return table, position, piece

    def _apart(self, table, x, y, at, limit) -> np.ndarray:
        """Whether pieces x and y, which meet at a position, stay apart: no merge before ``limit`` crosses it.

        The merges of both are undone, the later one first. Each time the two parts beside the place are looked up as one
        piece: had it come before the merge just undone, it would have been made instead.
        """
        flat, columns = table.ravel(), table.shape[1]
        out = np.ones(len(x), dtype=bool)
        which = np.arange(len(x))
        row = at * columns
        while len(which):
            lx = self.length[x]
            cross = self.rank[flat[row - lx * columns + np.minimum(lx + self.length[y], columns - 1)]] < limit
            out[which[cross]] = False
            bx, by = self.born[x], self.born[y]
            go = np.flatnonzero(~cross & ((bx >= 0) | (by >= 0)))
            which, row, x, y = which[go], row[go], x[go], y[go]
            first = bx[go] > by[go]
            limit = np.where(first, bx[go], by[go] + 1)
            x, y = np.where(first, self.right[x], x), np.where(first, y, self.left[y])
        return out

    def _pair_apart(self, table, x: int, y: int, at: int) -> bool:
        """``_apart`` for one pair; what it finds holds wherever they meet and is kept."""
        key = x * len(self.ids) + y
        if (found := self.pairs.get(key)) is None:
            if len(self.pairs) >= CACHED:
                self.pairs.clear()
            one = [np.array([v], dtype=np.int32) for v in (x, y)]
            found = self.pairs[key] = bool(self._apart(table, *one, np.array([at]), np.array([_NEVER]))[0])
        return found

    def _relax(self, table, begin, end, piece) -> np.ndarray:
        """The last piece of the encoding up to each position (-1 none, -2 a character without a piece), from edges sorted by
        their place in their segments, all segments together."""
        last = np.full(len(table) + 1, -1, dtype=np.int32)
        for a, b, p in zip(begin, end, piece, strict=True):
            before = last[a]
            free = (before < 0) | (p < 0)
            test = np.flatnonzero(~free)
            free[test] = self._apart(table, before[test], p[test], a[test], np.full(len(test), _NEVER))
            last[b[free]] = p[free]
        return last

    def _relax_long(self, table, a: int, b: int, last) -> None:
        """The same for one long segment, position by position."""
        for at in range(a, b):
            before = int(last[at])
            sizes = np.flatnonzero(table[at] != self.none).tolist()
            if 1 not in sizes:
                last[at + 1] = -2
            for size in sizes:
                p = int(table[at, size])
                if self.valid[p] and (before < 0 or self._pair_apart(table, before, p, at)):
                    last[at + size] = p

    def _pieces(self, segments: list[str]) -> list[bytes]:
        """Ids of each segment, as bytes of 32-bit integers."""
        text = "\0".join(segments)
        point = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
        size = np.array([len(s) for s in segments])
        start = np.append(0, np.cumsum(size + 1))[:-1]
        code = self.letter[point]
        code[(start + size)[:-1]] = 0
        table, begin, piece = self.edges(code)
        offset = np.arange(len(code)) - np.repeat(start, size + 1)[: len(code)]
        short = np.repeat(size <= LONG, size + 1)[: len(code)]
        alone = short & (table[:, 1] == self.none)  # characters without a piece
        alone[(start + size)[:-1]] = False
        alone = np.flatnonzero(alone)
        use = self.valid[piece] & short[begin]
        begin, piece = np.append(begin[use], alone), np.append(piece[use], np.full(len(alone), -2, dtype=np.int32))
        end = begin + np.where(piece < 0, 1, self.length[piece])
        place = (offset[begin] + end - begin).astype(np.uint16)
        order = np.argsort(place, kind="stable")
        cut = np.cumsum(np.bincount(place, minlength=1))[:-1]
        last = self._relax(table, *(np.split(x[order], cut) for x in (begin, end, piece)))
        for i in np.flatnonzero(size > LONG):
            self._relax_long(table, int(start[i]), int(start[i] + size[i]), last)
        chosen = np.zeros(len(code), dtype=bool)
        at, stop = start + size, start
        while len(at):  # back from the ends
            p = last[at]
            at = at - np.where(p < 0, 1, self.length[p])
            chosen[at] = True
            go = at > stop
            at, stop = at[go], stop[go]
        begin = np.flatnonzero(chosen)
        of = np.append(np.searchsorted(begin, start), len(begin))
        end = np.append(begin[1:], len(code))
        end[of[1:-1] - 1] = (start + size)[:-1]
        piece = last[end]
        known = piece >= 0
        ids = np.where(known, self.ids[piece], -1).astype(np.int32)
        out = []
        odd = set(np.unique(np.searchsorted(start, begin[~known], side="right") - 1).tolist())
        for i in range(len(segments)):
            a, b = of[i], of[i + 1]
            if i in odd:  # characters without a piece are written as their bytes
                one = [[int(ids[k])] if known[k] else [self.byte[x] for x in chr(point[begin[k]]).encode()] for k in range(a, b)]
                out.append(np.array([x for y in one for x in y], dtype=np.int32).tobytes())
            else:
                out.append(ids[a:b].tobytes())
        return out

    def stretches(self, segment: str) -> list[str]:
        """A segment cut where no piece's occurrence spans the place, so that no merge can: these encode on their own.

        Occurrences are looked for in windows of CHUNK characters, which overlap by a piece's length. What has no such
        place for longer than CHUNK (one letter repeated, say) stays whole and is relaxed on its own.
        """
        if len(segment) <= CHUNK:
            return [segment]
        spanned = np.zeros(len(segment) + self.width + 1, dtype=np.int32)
        for at in range(0, len(segment), CHUNK):
            part = segment[at : at + CHUNK + self.width]
            table = self.edges(self.letter[np.frombuffer(part.encode("utf-32-le", "replace"), dtype=np.uint32)])[0][:CHUNK]
            place, size = np.nonzero(table[:, 2:] != self.none)
            np.add.at(spanned, at + place + 1, 1)  # the places inside a piece of size + 2 characters
            np.add.at(spanned, at + place + size + 2, -1)
        free = np.flatnonzero(np.cumsum(spanned)[: len(segment)] == 0)
        free = free[free > 0]
        out, begin = [], 0
        while begin < len(segment):
            k = np.searchsorted(free, begin + CHUNK, side="right")
            near = free[k - 1] if k and free[k - 1] > begin else free[k] if k < len(free) else len(segment)
            out.append(segment[begin : int(near)])
            begin = int(near)
        return out

    def encode(self, texts: list) -> list[bytes]:
        """Ids of each text, as bytes of 32-bit integers; null and empty texts have none."""
        one: dict[str, str] = {}  # of a long text a repeated segment is held once
        met: set[str] = set()
        parts = []
        for t in texts:
            p = self.split(SPACE + t.replace(" ", SPACE)) if t else []
            if t and len(t) >= CHUNK:
                if any(len(s) > CHUNK for s in p):
                    p = [x for s in p for x in self.stretches(s)]
                p = [one.setdefault(s, s) for s in p]
            met.update(p)
            parts.append(p)
        if len(self.cache) > CACHED:
            self.cache.clear()
        new = [s for s in met if s not in self.cache]
        del one, met
        block, n = [], 0
        for i, s in enumerate(new):
            block.append(s)
            n += len(s) + 1
            if n >= CHUNK or i == len(new) - 1:
                self.cache.update(zip(block, self._pieces(block), strict=True))
                block, n = [], 0
        out = [b"".join(map(self.cache.__getitem__, p)) for p in parts]
        for s in new:
            if len(s) > KEPT:  # seldom met again
                del self.cache[s]
        return out


def encode(documents: DataFrame, model: str = MODEL, keep: list[str] | None = None) -> DataFrame:
    """Every row of ``documents`` as (doc_id, *keep, ids array<int>): the ids of its whole text.

    The model's pieces are matched through a suffix array of the batch's distinct segments (runs of
    characters between spaces and line feeds), and the edges found are relaxed by position. Null and empty texts have no ids; repeated rows stay
    repeated; columns not in ``keep`` are dropped. One map over the scan, no shuffle. Characters without
    a piece become the ids of their UTF-8 bytes. Batches are cut so that about PART bytes of text are worked on at once.
    """
    short_batches(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(read_model(model))

    def run(batches):
        give_back()
        matcher = PieceMatcher(shared.value)
        for batch in batches:
            for part in pieces_of(batch, [batch.schema.get_field_index("text")], PART):
                got = matcher.encode(part.column("text").to_pylist())
                offset = np.append(0, np.cumsum([len(x) // 4 for x in got])).astype(np.int32)
                ids = pa.ListArray.from_arrays(offset, np.frombuffer(b"".join(got), dtype=np.int32))
                part = part.drop_columns(["text"])
                yield pa.RecordBatch.from_arrays([*part.columns, ids], names=[*part.schema.names, "ids"])
            give_back()

    chosen = documents.select("doc_id", *(keep or []), "text")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema if f.name != "text"), "ids array<int>"])
    return chosen.mapInArrow(run, schema)


def bytes_of(pieces: list[tuple[str, float, int]]) -> list[bytes]:
    """The UTF-8 bytes that each id stands for, spaces in place of marks."""
    return [bytes([int(p[3:5], 16)]) if k == 6 else b"" if k == 3 else " ⁇ ".encode() if k == 2 else p.replace(SPACE, " ").encode() for p, _, k in pieces]


def _text_of(of: list[bytes], ids) -> bytes:
    return b"".join([of[i] for i in ids]).removeprefix(b" ")


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """Every row of ``encoded`` with ``text``, what its ``ids`` stand for, in place of them.

    Ids of bytes are joined to characters (those that form none give U+FFFD), space marks become
    spaces and the leading space goes. Control ids give nothing, ids outside the vocabulary and null
    ids nothing either; null or empty lists give an empty text.
    """
    shared = encoded.sparkSession.sparkContext.broadcast(read_model(model))

    def run(batches):
        of = bytes_of(shared.value)
        n = len(of)
        for batch in batches:
            texts = []
            for x in batch.column("ids"):
                ids = x.values.to_numpy(zero_copy_only=False) if x.is_valid else np.zeros(0, dtype=np.int32)
                if len(ids) and (x.values.null_count or ids.min() < 0 or ids.max() >= n):
                    ids = np.array([i for i in x.as_py() if i is not None and 0 <= i < n], dtype=np.int64)
                texts.append(_text_of(of, ids.tolist()).decode("utf-8", "replace"))
            part = batch.drop_columns(["ids"])
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, "text"])
            give_back()

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema if f.name != "ids"), "text string"])
    return encoded.mapInArrow(run, schema)


def encode_and_check(documents: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, n_pieces, ids, and whether decoding the ids gives the text back (round_trip).

    A text with a literal space mark (U+2581) can't come back: it decodes to a space. Null counts as
    empty. Both ways run in one map, so that a task needs one Python worker.
    """
    short_batches(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(read_model(model))

    def run(batches):
        give_back()
        matcher, of = PieceMatcher(shared.value), bytes_of(shared.value)
        for batch in batches:
            for part in pieces_of(batch, [batch.schema.get_field_index("text")], PART):
                texts = part.column("text").to_pylist()
                got = [np.frombuffer(x, dtype=np.int32) for x in matcher.encode(texts)]
                size = np.array([len(x) for x in got], dtype=np.int64)
                same = [_text_of(of, x.tolist()) == (t or "").encode("utf-8", "replace") for x, t in zip(got, texts, strict=True)]
                ids = pa.ListArray.from_arrays(np.append(0, np.cumsum(size)).astype(np.int32), np.concatenate([*got, np.zeros(0, dtype=np.int32)]))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(size), ids, pa.array(same)], names=["doc_id", "n_pieces", "ids", "round_trip"])
                del part, texts, got, ids, same
                give_back()

    chosen = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return chosen.mapInArrow(run, "doc_id long, n_pieces long, ids array<int>, round_trip boolean")
