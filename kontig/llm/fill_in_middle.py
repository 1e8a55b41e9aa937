"""Fill-in-middle texts by block rotation in place.

Two hashed cuts part a text into prefix, middle and suffix. The three sentinels are put in front of
the parts in a bytearray, and one rotation (three reversals) brings the parts into the order of
the form: ``psm`` is prefix, suffix, middle; ``spm`` is suffix, prefix, middle. Both put the middle last, so that a
model reads what surrounds it first. Undoing the rotation and taking the sentinels out gives the text back from output and form alone.

Edge cases: null text counts as empty; empty texts and texts that hold a sentinel stay plain; a null
key hashes as an empty one; repeated rows get equal results; an empty table gives an empty table; input columns named
like an output column are replaced. Very long texts take their own size and a fixed block more.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kontig.llm.common import drop_clashes, text_slices

#: Bytes that are swapped or scanned at once.
BLOCK = 1 << 20


@dataclass(frozen=True)
class Recipe:
    """How texts are cut: the seed of the hashes, per cent of texts that are rotated, of these per cent as spm, and the sentinels."""

    seed: int = 1
    rotated: int = 90
    spm: int = 20
    sentinels: tuple[str, str, str] = ("<P>", "<S>", "<M>")

    def __post_init__(self) -> None:
        marks = self.sentinels
        overlap = any(a[i:] == b[: len(a) - i] for a in marks for b in marks for i in range(1, len(a)))
        if len(set(marks)) < 3 or not all(marks) or overlap or any(a != b and a in b for a in marks for b in marks):
            raise ValueError("sentinels must differ and must not overlap, or an output could be read in two ways")

    @property
    def raw(self) -> tuple[bytes, bytes, bytes]:
        p, s, m = (x.encode() for x in self.sentinels)
        return p, s, m


def _reverse(buf: bytearray, lo: int, hi: int) -> None:
    """Reverse buf[lo:hi] in place, swapping blocks from both ends."""
    while hi - lo > 1:
        k = min(BLOCK, (hi - lo) // 2)
        head = buf[lo : lo + k]
        buf[lo : lo + k] = buf[hi - k : hi][::-1]
        buf[hi - k : hi] = head[::-1]
        lo, hi = lo + k, hi - k


def rotate(buf: bytearray, lo: int, mid: int, hi: int) -> None:
    """Exchange buf[lo:mid] and buf[mid:hi] in place by three reversals."""
    _reverse(buf, lo, mid)
    _reverse(buf, mid, hi)
    _reverse(buf, lo, hi)


def _leads(raw: bytes | bytearray, at: int) -> np.ndarray:
    """Which bytes of a block begin a code point."""
    return np.frombuffer(raw, np.uint8, min(BLOCK, len(raw) - at), at) & 0xC0 != 0x80


def code_points(raw: bytes | bytearray) -> int:
    if raw.isascii():
        return len(raw)
    return sum(int(np.count_nonzero(_leads(raw, at))) for at in range(0, len(raw), BLOCK))


def byte_offset(raw: bytes | bytearray, point: int) -> int:
    """Where the code point of this number begins, or the end."""
    if raw.isascii():
        return point
    for at in range(0, len(raw), BLOCK):
        leads = _leads(raw, at)
        here = int(np.count_nonzero(leads))
        if point < here:
            return at + int(np.flatnonzero(leads)[point])
        point -= here
    return len(raw)


def apply(raw: bytes, hashes: tuple[int, int, int, int], recipe: Recipe) -> tuple[str, int, int | None, int | None, bytearray]:
    """Form, code points, those of prefix and middle (none if plain) and the output."""
    n, out = code_points(raw), bytearray(raw)
    p, s, m = recipe.raw
    if not raw or p in raw or s in raw or m in raw or hashes[2] % 100 >= recipe.rotated:
        return "plain", n, None, None, out
    first, second = sorted(h % (n + 1) for h in hashes[:2])
    a, b = byte_offset(raw, first), byte_offset(raw, second)
    for at, mark in ((b, s), (a, m), (0, p)):  # from the right, so that places hold
        out[at:at] = mark
    prefix, middle = len(p) + a, len(m) + b - a
    if hashes[3] % 100 < recipe.spm:
        rotate(out, 0, prefix + middle, len(out))
        return "spm", n, first, second - first, out
    rotate(out, prefix, prefix + middle, len(out))
    return "psm", n, first, second - first, out


def invert(output: bytes | bytearray, form: str | None, recipe: Recipe) -> bytearray | None:
    """The text behind an output; None for what is no output of this form."""
    out = bytearray(output)
    p, s, m = recipe.raw
    if form == "plain":
        return out
    places = (out.find(p), out.find(s), out.find(m))
    if min(places) < 0 or form not in ("psm", "spm"):
        return None
    at_p, at_s, at_m = places
    if form == "psm" and at_p == 0 and at_s < at_m:
        rotate(out, at_s, at_m, len(out))
    elif form == "spm" and at_s == 0 and at_p < at_m:
        rotate(out, 0, at_p, len(out))
    else:
        return None
    for mark in (s, m, p):
        at = out.rfind(mark)
        del out[at : at + len(mark)]
    return out


def _hashes(key: Column, seed: int) -> Column:
    """The first four 8-digit groups of the hexadecimal sha256 of ``seed:key``, as array<long>."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return F.array(*[F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)])


def _mapped(df: DataFrame, at: int, columns: list[tuple[str, T.DataType, pa.DataType]], rows: Callable[[pa.RecordBatch], Iterator[tuple]], drop: tuple[str, ...] = ()) -> DataFrame:
    """``df`` without ``drop`` and with ``columns``, one tuple of ``rows`` for each row."""
    kept = [i for i, name in enumerate(df.columns) if name not in drop]
    names, kinds = [df.columns[i] for i in kept] + [c[0] for c in columns], [c[2] for c in columns]

    def run(batches):
        for batch in batches:
            for part in text_slices(batch, at):
                made = list(rows(part))
                new = [pa.array([r[k] for r in made], kind) for k, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in kept), *new], names)

    return df.mapInArrow(run, T.StructType([*(df.schema.fields[i] for i in kept), *(T.StructField(name, kind) for name, kind, _ in columns)]))


def _raw(value: pa.Scalar) -> bytes:
    return value.as_buffer().to_pybytes() if value.is_valid else b""


def transform(df: DataFrame, recipe: Recipe = Recipe(), key: str = "doc_id", text_col: str = "text", restored: bool = False) -> DataFrame:
    """``df`` with form string (plain, psm, spm), n_points, prefix_points and middle_points long (null if plain) and output string;
    with ``restored`` also the text rebuilt from output and form. Narrow: no shuffle."""
    names = ["n_points", "form", "prefix_points", "middle_points", "output"] + ["restored"] * restored
    df = drop_clashes(df, *({*names, "_hashes"} - {text_col, key})).withColumn("_hashes", _hashes(F.col(f"`{key}`"), recipe.seed))
    at, hashed = df.columns.index(text_col), df.columns.index("_hashes")

    def rows(part: pa.RecordBatch) -> Iterator[tuple]:
        hashes = part.column(hashed).flatten().to_numpy().reshape(-1, 4).tolist()
        for value, h in zip(part.column(at), hashes, strict=True):
            form, n, prefix, middle, out = apply(_raw(value), h, recipe)
            back = (bytes(invert(out, form, recipe)),) if restored else ()
            yield (n, form, prefix, middle, bytes(out), *back)

    kinds = {"form": (T.StringType(), pa.string()), "output": (T.BinaryType(), pa.binary()), "restored": (T.BinaryType(), pa.binary())}
    made = _mapped(df, at, [(n, *kinds.get(n, (T.LongType(), pa.int64()))) for n in names], rows, drop=("_hashes",))
    return made.withColumns({n: F.col(n).cast("string") for n in ("output", "restored")[: 1 + restored]})


def restore(df: DataFrame, recipe: Recipe = Recipe(), output_col: str = "output", form_col: str = "form") -> DataFrame:
    """``df`` with restored string, from output and form; null where the output is none of this form. Narrow: no shuffle."""
    df = drop_clashes(df, *({"restored"} - {output_col, form_col}))
    at, form_at = df.columns.index(output_col), df.columns.index(form_col)

    def rows(part: pa.RecordBatch) -> Iterator[tuple]:
        for value, form in zip(part.column(at), part.column(form_at).to_pylist(), strict=True):
            back = invert(_raw(value), form, recipe)
            yield (None if back is None else bytes(back),)

    return _mapped(df, at, [("restored", T.BinaryType(), pa.binary())], rows).withColumn("restored", F.col("restored").cast("string"))
