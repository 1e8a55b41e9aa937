"""Licence scan by sentence rules.

A sentence ends at a full stop, exclamation or question mark that white space follows. A normalised text is
its letters and digits, lower-cased, with single spaces, so comment marks go; ``rem`` and ``dnl`` at the begin of a line
go too. Known sentences become identifiers, in text order; they may be wrapped over any line ends, blank
ones included, but must begin or end where a line or a sentence does: a licence line without a full stop of its own
runs on into its neighbour. Of overlapping ones the first counts, and of those at one place the longest. A licence is
found where the identifiers of one of its rules occur in that order, whatever lies between. A rule takes the identifiers
that it matches away from the rules after it, so a more specific licence leaves nothing to a less specific one, while a
second notice in the same text is found on its own.

Everything is DataFrame functions over one row: no shuffle, and hot sources don't matter.

Edge cases: null and empty texts have no licence; repeated rows scan alike; an empty table gives an
empty table; input columns named like an output column are replaced.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kontig.llm.common import drop_clashes
from kontig.llm.license_rules import RULES, SENTENCES

#: Stands for a sentence end in a normalised text; a line feed for line ends.
_END = "\u0001"


def _plain(sentence: str) -> str:
    return " ".join("".join(c if c.isalnum() else " " for c in sentence.lower()).split())


def normalise(text: Column) -> Column:
    """Letters and digits, lower-cased, between single blanks, line feeds (one or more line ends, with any comment marks)
    and sentence ends; begins and ends with a line feed."""
    out = F.regexp_replace(F.translate(F.lower(text), _END, " "), r"[.!?]\s+", _END)
    out = F.regexp_replace(out, rf"[^\p{{L}}\p{{N}}{_END}\r\n]+", " ")
    out = F.concat(F.lit("\n"), F.regexp_replace(out, r" ?[\r\n][ \r\n]*", "\n"), F.lit("\n"))
    out = F.regexp_replace(out, rf"[ \n]?{_END}[ \n{_END}]*", _END)
    out = F.regexp_replace(out, r"\n[ \n]+|[ \n]+\n", "\n")
    return F.regexp_replace(out, r"\n(?:(?:rem|dnl)[ \n])+", "\n")


def _sought(known: dict[str, str]) -> str:
    """An expression for the longest known sentence that begins or ends a line or a sentence, over any line ends within."""
    any_of = "|".join(re.escape(text).replace("\\ ", "[ \n]") for text in sorted(known, key=lambda k: (-len(k), k)))
    edge, gap = rf"[\n{_END}]", rf"[ \n{_END}]"
    return f"(?<={edge})(?:{any_of})(?={gap})|(?<={gap})(?:{any_of})(?={edge})"


def scan(df: DataFrame, text_col: str = "text", sentences=SENTENCES, rules=RULES) -> DataFrame:
    """``df`` with sentence_ids array<string>, in text order, and licenses array<string>, in rule order."""
    df = drop_clashes(df, *({"sentence_ids", "licenses"} - {text_col}))
    known = {_plain(s): name for name, s in sentences}
    words = sorted({min((w for w in text.split() if len(w) > 2), key=lambda w: sum(f" {w} " in f" {t} " for t in known), default=text) for text in known})
    maybe = F.lower(F.col(text_col)).rlike("|".join(words))  # every known sentence holds one of these
    found = F.transform(F.regexp_extract_all(normalise(F.col(text_col)), F.lit(_sought(known)), F.lit(0)), lambda s: F.translate(s, "\n", " "))
    names = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    ids = F.transform(found, lambda s: names[s])
    empty = F.array().cast("array<string>")
    found = df.withColumn("sentence_ids", F.when(F.coalesce(maybe, F.lit(False)), ids).otherwise(empty))
    # an ordered rule is a regular expression over the identifiers, each between blanks; what it keeps are the gaps
    steps = F.array(*[F.struct(F.lit(name).alias("name"), F.lit("(.*?)".join(f" {x} " for x in order)).alias("pattern"), F.lit(" " + "".join(f"${k}" for k in range(1, len(order)))).alias("rest")) for name, order in rules])
    start = F.struct(F.concat(F.lit(" "), F.array_join("sentence_ids", "  "), F.lit(" ")).alias("left"), empty.alias("found"))
    apply = lambda at, rule: F.when(
        F.regexp_like(at["left"], rule["pattern"]),
        F.struct(F.regexp_replace(at["left"], rule["pattern"], rule["rest"]).alias("left"), F.array_append(at["found"], rule["name"]).alias("found")),
    ).otherwise(at)
    licenses = F.aggregate(steps, start, apply, lambda at: F.array_distinct(at["found"]))
    return found.withColumn("licenses", F.when(F.size("sentence_ids") > 0, licenses).otherwise(empty))
