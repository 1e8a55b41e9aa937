"""Byte-level BPE encoding and decoding with a segment tree over byte positions.

A text is split by the pre-token pattern. Each pre-token that is not itself a vocabulary entry is
merged in a segment tree over its byte positions: a leaf holds the rank of the pair that starts at
that byte, an inner node the leftmost minimum of its two children. A merge reads the root, joins the
pair, and updates the leaves of the two live neighbours and of the byte that died, each along one
path to the root. Many pre-tokens of one length class are merged side by side as rows of one array, few or long ones each in a tree of its own.

Edge cases: a null text counts as empty, an empty text has no ids and decodes to no bytes, a null
list of ids decodes to no bytes, repeated rows are encoded alike, an empty table gives an empty
table. Input columns named like an output column are replaced.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from kontig.llm.common import drop_clashes, released

#: Pre-tokens that a Python worker remembers before it starts anew (about 200 bytes each, their ids as bytes).
CACHE_ENTRIES = 50_000
#: Leaves of one array of trees: few enough that it stays in a core's cache.
TREE_LEAVES = 1 << 15
#: Longest pre-tokens that are merged side by side, and the fewest for which that pays.
SIDE_BY_SIDE, FEW = 512, 32
#: Letters and the whole alphabet of texts that the quicker form of the pattern splits alike.
_LATIN = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
_BEYOND_LATIN = re.compile(f"[^\\t-\\r -~\u00a1\u00a6-\u00a9\u00ab\u00b0\u00b1\u00b4\u00b6-\u00b8\u00bb\u00bf\u00d7\u00f7{_LATIN}]")
_SHIFT = 20
_NONE = np.iinfo(np.int64).max


def latin_form(pattern: str) -> re.Pattern | None:
    """The pattern with its letter and number classes written out for Latin texts; None if it has others."""
    plain = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^\\s0-9{_LATIN}]").replace(r"\p{L}", f"[{_LATIN}]").replace(r"\p{N}", "[0-9]")
    return None if r"\p" in plain else re.compile(plain)


class PairTable:
    """Ranks of id pairs in an open-addressing hash table that is probed for whole arrays."""

    def __init__(self, pairs: dict[int, int]):
        self.bits = max(4, (4 * len(pairs)).bit_length())
        size = 1 << self.bits
        self.keys, self.values = np.full(size, -1, np.int64), np.full(size, _NONE, np.int64)
        keys, values = np.array([*pairs], np.int64), np.array([*pairs.values()], np.int64)
        slot = self._slot(keys)
        while keys.size:
            free = self.keys[slot] < 0
            self.keys[slot[free]] = keys[free]
            self.values[slot[free]] = values[free]
            lost = self.keys[slot] != keys
            keys, values, slot = keys[lost], values[lost], (slot[lost] + 1) & (size - 1)
        placed = self.keys >= 0
        self.values[placed] = np.array([pairs[k] for k in self.keys[placed].tolist()], np.int64)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).view(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; _NONE where the two don't merge or one is missing (-1)."""
        key = left << _SHIFT | right  # negative if one is missing
        slot = self._slot(key)
        held = self.keys[slot]
        out = np.where(held == key, self.values[slot], _NONE)
        out[key < 0] = _NONE
        open_ = np.flatnonzero((held != key) & (held >= 0) & (key >= 0))
        while open_.size:
            slot[open_] = (slot[open_] + 1) & (len(self.keys) - 1)
            held = self.keys[slot[open_]]
            hit = held == key[open_]
            out[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (held >= 0)]
        return out


def read_ranks(lines: Iterable[bytes]) -> dict[bytes, int]:
    """Token bytes to rank, from lines of base64 bytes and decimal rank."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class SegmentTreeBpe:
    """Encoder and decoder for one rank table; ids are ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.latin = latin_form(pattern)
        self.cache: dict[str, bytes] = {}  # ids as 32-bit numbers: an eighth of what a tuple of them takes

    @cached_property
    def pairs(self) -> PairTable:
        """Built when something is encoded."""
        pairs = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << _SHIFT | right] = rank
        return PairTable(pairs)

    def _merge_class(self, pieces: list[bytes], leaves: int) -> list[bytes]:
        """Ids, as 32-bit numbers, of pieces with at most ``leaves`` bytes (a power of two)."""
        n = len(pieces)
        size = np.array([len(p) for p in pieces])
        flat = np.frombuffer(b"".join(pieces), np.uint8)
        column = np.arange(leaves)
        live = column < size[:, None]
        ids = np.full((n, leaves + 2), -1, np.int64)  # column 0 and the last one are sentinels
        ids[:, 1:-1][live] = self.byte_ids[flat]
        after = np.tile(np.arange(1, leaves + 3), (n, 1))
        before = np.tile(np.arange(-1, leaves + 1), (n, 1))

        def leaf(rank: np.ndarray, at: np.ndarray) -> np.ndarray:
            return np.where(rank == _NONE, _NONE, (np.where(rank == _NONE, 0, rank) << 32) | at)

        tree = np.full((n, 2 * leaves), _NONE, np.int64)
        tree[:, leaves:] = leaf(self.pairs.get(ids[:, 1:-1].ravel(), ids[:, 2:].ravel()).reshape(n, leaves), column)
        low = leaves
        while low > 1:
            half = low // 2
            tree[:, half:low] = np.minimum(tree[:, low : 2 * low : 2], tree[:, low + 1 : 2 * low : 2])
            low = half

        rows = np.flatnonzero(tree[:, 1] != _NONE)
        while rows.size:
            best = tree[rows, 1]
            at = (best & 0xFFFFFFFF) + 1
            dead = after[rows, at]
            ids[rows, at] = best >> 32
            ids[rows, dead] = -1
            far = after[rows, dead]
            after[rows, at] = far
            before[rows, np.minimum(far, leaves + 1)] = at
            near = before[rows, at]
            far_id = ids[rows, np.minimum(far, leaves + 1)]
            tree[rows, leaves + dead - 1] = _NONE
            tree[rows, leaves + at - 1] = leaf(self.pairs.get(ids[rows, at], far_id), at - 1)
            has = near >= 1
            left_rows, left = rows[has], near[has]
            tree[left_rows, leaves + left - 1] = leaf(self.pairs.get(ids[left_rows, left], ids[left_rows, at[has]]), left - 1)
            for changed, where in ((rows, dead), (rows, at), (left_rows, left)):
                node = (leaves + where - 1) >> 1
                while node.size and node[0]:
                    tree[changed, node] = np.minimum(tree[changed, 2 * node], tree[changed, 2 * node + 1])
                    node = node >> 1
            rows = rows[tree[rows, 1] != _NONE]

        kept = ids[:, 1:-1]
        mask = kept >= 0
        values = kept[mask].astype(np.int32).tobytes()
        ends = (4 * np.cumsum(mask.sum(1))).tolist()
        return [values[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def _merge_alone(self, raw: bytes) -> bytes:
        """Ids, as 32-bit numbers, of one piece, by a tree in plain arrays: a path ends at the first node that keeps its minimum."""
        n = len(raw)
        leaves = 1 << (n - 1).bit_length()
        start = self.byte_ids[np.frombuffer(raw, np.uint8)]
        rank = self.pairs.get(start[:-1], start[1:])
        whole = np.full(2 * leaves, _NONE, np.int64)
        whole[leaves : leaves + n - 1] = np.where(rank == _NONE, _NONE, np.where(rank == _NONE, 0, rank) << 32 | np.arange(n - 1))
        low = leaves
        while low > 1:
            half = low // 2
            np.minimum(whole[low : 2 * low : 2], whole[low + 1 : 2 * low : 2], out=whole[half:low])
            low = half
        tree, ids = array("q", whole.tobytes()), array("i", start.astype(np.int32).tobytes())
        after, before = array("i", range(1, n + 1)), array("i", range(-1, n - 1))
        ranks, tokens = self.ranks, self.tokens
        while (best := tree[1]) != _NONE:
            at, merged = best & 0xFFFFFFFF, best >> 32
            dead = after[at]
            far, near = after[dead], before[at]
            ids[at], ids[dead], after[at] = merged, -1, far
            changes = [(dead, None)]
            if far < n:
                before[far] = at
                changes.append((at, ranks.get(tokens[merged] + tokens[ids[far]])))
            else:
                changes.append((at, None))
            if near >= 0:
                changes.append((near, ranks.get(tokens[ids[near]] + tokens[merged])))
            for place, found in changes:
                node = leaves + place
                tree[node] = _NONE if found is None else found << 32 | place
                node >>= 1
                while node:
                    left, right = tree[2 * node], tree[2 * node + 1]
                    least = left if left < right else right
                    if tree[node] == least:
                        break
                    tree[node] = least
                    node >>= 1
        return array("i", (i for i in ids if i >= 0)).tobytes()

    def _learn(self, pieces: list[str]) -> None:
        """Put the ids of ``pieces`` into the cache."""
        classes: dict[int, list[tuple[str, bytes]]] = {}
        for piece in pieces:
            raw = piece.encode("utf-8", "surrogatepass")
            whole = self.ranks.get(raw)
            if whole is not None:
                self.cache[piece] = array("i", (whole,)).tobytes()
            else:
                classes.setdefault(max(2, 1 << (len(raw) - 1).bit_length()), []).append((piece, raw))
        for leaves, members in classes.items():
            if leaves > SIDE_BY_SIDE or len(members) < FEW:
                self.cache.update((piece, self._merge_alone(raw)) for piece, raw in members)
                continue
            step = max(1, TREE_LEAVES // leaves)
            for a in range(0, len(members), step):
                block = members[a : a + step]
                self.cache.update(zip((p for p, _ in block), self._merge_class([r for _, r in block], leaves), strict=True))

    def split(self, text: str | None) -> list[str]:
        if not text:
            return []
        quick = self.latin is not None and not _BEYOND_LATIN.search(text)
        return (self.latin if quick else self.pattern).findall(text)

    def encode_batch(self, texts: list[str | None]) -> list[array]:
        """The ids of each text."""
        words = [self.split(t) for t in texts]
        if len(self.cache) > CACHE_ENTRIES:
            self.cache.clear()
        unknown = set().union(*words)
        unknown.difference_update(self.cache.keys())
        self._learn(list(unknown))
        return [array("i", b"".join(map(self.cache.__getitem__, w))) for w in words]

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


_LOADED: dict[tuple, SegmentTreeBpe] = {}


def codec(path: str, pattern: str) -> SegmentTreeBpe:
    """The codec of a rank file, built once in each Python worker."""
    key = (path, pattern)
    if key not in _LOADED:
        with open(path, "rb") as lines:
            _LOADED[key] = SegmentTreeBpe(read_ranks(lines), pattern)
    return _LOADED[key]


#: Texts are split and merged in groups of about so many characters, which bounds a worker's memory.
GROUP_CHARS = 100_000


def _groups(column: pa.Array) -> Iterator[list]:
    group, held = [], 0
    for value in column:
        text = value.as_py()
        group.append(text)
        held += len(text) if text else 0
        if held >= GROUP_CHARS:
            yield group
            group, held = [], 0
    if group:
        yield group


def _encoder(rank_file: str, pattern: str, at: int, ids_col: str, keep_text: bool = True):
    def run(batches):
        bpe = codec(rank_file, pattern)
        bpe.cache.clear()  # what the worker's last task learnt
        for batch in batches:
            done = 0
            for group in _groups(batch.column(at)):
                flat = [np.frombuffer(ids, np.int32) for ids in bpe.encode_batch(group)]
                ends = np.cumsum([0, *map(len, flat)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(flat)))
                part = batch.slice(done, len(group))
                done += len(group)
                kept = [i for i in range(part.num_columns) if keep_text or i != at]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in kept), lists], [*(part.schema.names[i] for i in kept), ids_col])
        bpe.cache.clear()  # the worker lives on, beside those of other stages

    return run


def _decoder(rank_file: str, pattern: str, at: int, bytes_col: str):
    def run(batches):
        bpe = codec(rank_file, pattern)
        for batch in batches:
            column = batch.column(at)
            decoded = [bpe.decode(column[i].values.to_numpy().tolist()) if column[i].is_valid else b"" for i in range(len(column))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(decoded, pa.binary())], [*batch.schema.names, bytes_col])

    return run


def encode(df: DataFrame, rank_file: str, pattern: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``df`` with ``ids_col``, the token ids of the whole text as array<int>. Narrow: no shuffle."""
    df = drop_clashes(df, *({ids_col} - {text_col}))
    schema = T.StructType([*df.schema.fields, T.StructField(ids_col, T.ArrayType(T.IntegerType()))])
    encoder = _encoder(rank_file, pattern, df.columns.index(text_col), ids_col)
    return df.mapInArrow(lambda batches: released(encoder(batches)), schema)


def decode(df: DataFrame, rank_file: str, pattern: str, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """``df`` with ``bytes_col``, the bytes that the ids stand for, as binary. Narrow: no shuffle."""
    df = drop_clashes(df, *({bytes_col} - {ids_col}))
    schema = T.StructType([*df.schema.fields, T.StructField(bytes_col, T.BinaryType())])
    decoder = _decoder(rank_file, pattern, df.columns.index(ids_col), bytes_col)
    return df.mapInArrow(lambda batches: released(decoder(batches)), schema)


def round_trip(df: DataFrame, rank_file: str, pattern: str, text_col: str = "text", ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """``df`` without its text, with its ids and what they decode to: both steps in one Python worker. Narrow: no shuffle."""
    df = drop_clashes(df, *({ids_col, bytes_col} - {text_col}))
    at, others = df.columns.index(text_col), [f for f in df.schema.fields if f.name != text_col]
    encoder, decoder = _encoder(rank_file, pattern, at, ids_col, keep_text=False), _decoder(rank_file, pattern, len(others), bytes_col)
    schema = T.StructType([*others, T.StructField(ids_col, T.ArrayType(T.IntegerType())), T.StructField(bytes_col, T.BinaryType())])
    return df.mapInArrow(lambda batches: released(decoder(encoder(batches))), schema)
