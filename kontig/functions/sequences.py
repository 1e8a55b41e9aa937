"""Scalar functions on nucleotide sequences, all built-in expressions that stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kontig.params import POLY_A_RATIO


def dna(text: Column) -> Column:
    """Any text as a sequence over ACGT: a-z cycle through the four bases, other characters go."""
    letters = F.regexp_replace(F.lower(text), "[^a-z]", "")
    return F.translate(letters, "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC")


def clean(seq: Column) -> Column:
    """Upper-case acgtn and a dot as N; other characters pass."""
    return F.translate(seq, "acgtn.", "ACGTNN")


def count_of(seq: Column, chars: str) -> Column:
    """Number of characters of ``seq`` among ``chars``."""
    return (F.length(seq) - F.length(F.translate(seq, chars, ""))).cast("long")


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGT", "TGCA"))


def gc_ratio(seq: Column) -> Column:
    """(G+C)/(A+C+G+T) in either case; null without such a base."""
    return F.try_divide(count_of(seq, "GCgc").cast("double"), count_of(seq, "ACGTacgt"))


def unknown_count(seq: Column) -> Column:
    return count_of(seq, "Nn.")


def read_valid(seq: Column) -> Column:
    """Fewer than 90 % upper-case A and no unknown base."""
    a = F.coalesce(F.try_divide(count_of(seq, "A").cast("double"), F.length(seq)), F.lit(0.0))
    return (a < POLY_A_RATIO) & ~seq.rlike("[Nn.]")


def replace_unknown(seq: Column) -> Column:
    return F.translate(seq, "Nn.", "CCC")


def has_gap(seq: Column, left: Column, right: Column) -> Column:
    """Whether an unknown base lies between two 1-based positions, both included."""
    return F.substr(seq, left, F.greatest(right - left + 1, F.lit(0))).rlike("[Nn.]")


def acgt_runs(seq: Column) -> Column:
    """Maximal runs of ACGT in either case, array<string>."""
    return F.regexp_extract_all(seq, F.lit("[ACGTacgt]+"), F.lit(0))


def pack(kmer: Column) -> Column:
    """Up to 31 bases as one long, two bits a base, A0 C1 G2 T3."""
    return F.conv(F.translate(kmer, "ACGT", "0123"), 4, 10).cast("long")


def unpack(code: Column, size: int) -> Column:
    return F.translate(F.lpad(F.conv(code.cast("string"), 10, 4), size, "0"), "0123", "ACGT")
