"""Token counts of whole texts, huge ones by overlapping chunks that resynchronise.

A boundary is *stable* where a non-space character is followed by a space or a line feed. The
pre-token pattern has no look-behind and no branch that runs from a non-space character into white
space, so tokens on both sides of a stable boundary never depend on each other:
``tokens(a + b) == tokens(a) + tokens(b)``. This holds for the byte-level pre-tokenizer with its own pattern,
without a normaliser and without added tokens that hold or strip white space; the tokenizer file is read for
that, and by any other file whole texts are encoded in one piece.

Huge documents are encoded in overlapping chunks with offsets. Two neighbouring chunks are spliced at
the first stable boundary inside their overlap that is a token edge in both encodings. If the
overlap has none, it is widened, up to the end of the text if need be. Other texts are cut at
their stable boundaries into pieces whose counts each Python worker remembers, so that the library
encodes each distinct piece once.

Edge cases: a null text counts as empty and has 0 tokens; repeated rows count alike; an empty table
gives an empty table; input columns named like the output column are replaced.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from kontig.llm.common import drop_clashes

#: Characters of a chunk without its overlap, and of the first overlap tried.
CHUNK_CHARS, OVERLAP_CHARS = 32_768, 256
#: Pieces that a Python worker remembers before it starts anew (about 150 bytes each).
CACHE_ENTRIES = 300_000
#: A piece runs from one stable boundary to the next.
_PIECE = re.compile(r"\s*\S+(?:[^\S \n]\s*\S+)*|\s+")
_STABLE = re.compile(r"(?<=\S)(?=[ \n])")

#: Text to the start offset of each of its tokens, in characters.
Starts = Callable[[str], list[int]]


def splice_counts(text: str, starts: Starts, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> int:
    """Number of tokens of ``text``, which is encoded by overlapping chunks."""
    total, begin = 0, 0  # text[:begin] is counted
    while True:
        core_end, width = begin + chunk, overlap
        if core_end + width >= len(text):
            return total + len(starts(text[begin:]))
        while True:
            left_end = min(len(text), core_end + width)
            left = starts(text[begin:left_end])
            right = {core_end + s for s in starts(text[core_end : min(len(text), left_end + width)])}
            edges = {begin + s for s in left}
            at = next((m.start() for m in _STABLE.finditer(text, core_end, left_end) if m.start() > core_end and m.start() in edges and m.start() in right), None)
            if at is not None:
                total += sum(begin + s < at for s in left)
                begin = at
                break
            if left_end == len(text):
                return total + len(left)
            width *= 4


def cuts_hold(tokenizer_file: str) -> bool:
    """Whether the file's tokens never depend on what lies beyond a stable boundary."""
    with open(tokenizer_file, encoding="utf-8") as lines:
        said = json.load(lines)
    before, added = said.get("pre_tokenizer") or {}, said.get("added_tokens") or []
    own = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space", True)
    return own and said.get("normalizer") is None and not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or re.search(r"\s", t["content"]) for t in added)


class Counter:
    """Token counts by one tokenizers file."""

    def __init__(self, tokenizer_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.cache: dict[str, int] = {}
        self.cuts = cuts_hold(tokenizer_file)

    def starts(self, text: str) -> list[int]:
        return [a for a, _ in self.tokenizer.encode(text, add_special_tokens=False).offsets]

    def count_batch(self, texts: list[str | None]) -> list[int]:
        if not self.cuts:
            return [len(self.tokenizer.encode(t or "", add_special_tokens=False)) for t in texts]
        pieces = [_PIECE.findall(t) if t and len(t) <= CHUNK_CHARS else [] for t in texts]
        if len(self.cache) > CACHE_ENTRIES:
            self.cache.clear()
        unknown = set().union(*pieces)
        unknown.difference_update(self.cache.keys())
        new = list(unknown)
        for a in range(0, len(new), 20_000):
            block = new[a : a + 20_000]
            self.cache.update(zip(block, map(len, self.tokenizer.encode_batch_fast(block, add_special_tokens=False)), strict=True))
        get = self.cache.__getitem__
        return [splice_counts(t, self.starts) if t and len(t) > CHUNK_CHARS else sum(map(get, p)) for t, p in zip(texts, pieces, strict=True)]


_LOADED: dict[str, Counter] = {}


def counter(tokenizer_file: str) -> Counter:
    """The counter of a file, built once in each Python worker."""
    if tokenizer_file not in _LOADED:
        _LOADED[tokenizer_file] = Counter(tokenizer_file)
    return _LOADED[tokenizer_file]


#: Texts are split in groups of about so many characters, which bounds a worker's memory.
GROUP_CHARS = 1_000_000


def count_tokens(df: DataFrame, tokenizer_file: str, text_col: str = "text", count_col: str = "n_tokens") -> DataFrame:
    """``df`` with ``count_col``, the number of tokens of the whole text. Narrow: no shuffle."""
    df = drop_clashes(df, *({count_col} - {text_col}))
    at = df.columns.index(text_col)

    def run(batches):
        tool = counter(tokenizer_file)
        for batch in batches:
            counts: list[int] = []
            group: list[str | None] = []
            held = 0
            for value in batch.column(at):
                text = value.as_py()
                group.append(text)
                held += len(text or "")
                if held >= GROUP_CHARS:
                    counts += tool.count_batch(group)
                    group, held = [], 0
            counts += tool.count_batch(group)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.array(counts, np.int64))], [*batch.schema.names, count_col])

    schema = T.StructType([*df.schema.fields, T.StructField(count_col, T.LongType())])
    return df.mapInArrow(run, schema)
