"""Text: unified differences, three-way merges, what is text at all."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: First bytes of formats that are no text.
MAGIC = {"application/pdf": b"%PDF-", "image/png": b"\x89PNG", "image/jpeg": b"\xff\xd8\xff", "application/zip": b"PK\x03\x04", "application/gzip": b"\x1f\x8b", "image/gif": b"GIF8", "application/x-elf": b"\x7fELF"}


def mime(head: Column | str) -> Column:
    """The type that the first bytes name; text/plain for other valid UTF-8, else application/octet-stream."""
    data = F.col(head) if isinstance(head, str) else head
    out = F.when(F.is_valid_utf8(data.cast("string")), "text/plain").otherwise("application/octet-stream")
    for kind, first in MAGIC.items():
        out = F.when(F.hex(F.substring(data, 1, len(first))) == first.hex().upper(), kind).otherwise(out)
    return out


def diffable(head: Column | str) -> Column:
    """Whether content can be compared line by line: not empty, and text."""
    data = F.col(head) if isinstance(head, str) else head
    return (F.length(data) > 0) & (mime(data) == "text/plain")


def _key(line: str, spaces: str) -> str:
    if spaces == "ignore":
        return "".join(line.split())
    if spaces == "collapse":
        return " ".join(line.split())
    return line


def unified(old: str, new: str, context: int = 3, spaces: str = "keep") -> str:
    """A unified difference; empty if the texts are equal under `spaces` (keep, collapse, ignore)."""
    a, b = old.splitlines(keepends=True), new.splitlines(keepends=True)
    matcher = difflib.SequenceMatcher(None, [_key(x, spaces) for x in a], [_key(x, spaces) for x in b], autojunk=False)
    out = []
    for group in matcher.get_grouped_opcodes(context):
        first, last = group[0], group[-1]
        part = lambda x, y: f"{x + 1 if y > x else x},{y - x}" if y - x != 1 else f"{x + 1}"
        out.append(f"@@ -{part(first[1], last[2])} +{part(first[3], last[4])} @@\n")
        for tag, i, j, k, m in group:
            own = [(" ", x) for x in b[k:m]] if tag == "equal" else [*(("-", x) for x in a[i:j]), *(("+", x) for x in b[k:m])]
            out += [s + x if x.endswith("\n") else f"{s}{x}\n\\ No newline at end of file\n" for s, x in own]
    return "--- original\n+++ modified\n" + "".join(out) if out else ""


def merge3(base: str, ours: str, theirs: str) -> tuple[str, int]:
    """(text, conflicts): changes of both sides to base, conflicts between markers.

    Stretches of base that neither side changed are kept; between two of them a side that alone changed wins, equal changes
    are taken once, others conflict.
    """
    o, a, b = (x.splitlines(keepends=True) for x in (base, ours, theirs))

    def kept(x: list[str]) -> dict[int, int]:
        return {i + k: j + k for i, j, n in difflib.SequenceMatcher(None, o, x, autojunk=False).get_matching_blocks() for k in range(n)}

    in_a, in_b = kept(a), kept(b)
    anchors = [(i, in_a[i], in_b[i]) for i in range(len(o)) if i in in_a and i in in_b] + [(len(o), len(a), len(b))]
    out, conflicts, at = [], 0, (0, 0, 0)
    for i, j, k in anchors:
        mid, left, right = o[at[0] : i], a[at[1] : j], b[at[2] : k]
        if left == right or right == mid:
            out += left
        elif left == mid:
            out += right
        else:
            conflicts += 1
            ends = lambda x: [*x[:-1], x[-1] if x[-1].endswith("\n") else x[-1] + "\n"] if x else []
            out += ["<<<<<<< ours\n", *ends(left), "||||||| base\n", *ends(mid), "=======\n", *ends(right), ">>>>>>> theirs\n"]
        if i < len(o):
            out.append(o[i])
        at = (i + 1, j + 1, k + 1)
    return "".join(out), conflicts


def diffs(rows: DataFrame, key: str, old: str, new: str, context: int = 3, spaces: str = "keep") -> DataFrame:
    """(key, diff) of each row's two texts (null: empty)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            yield pd.DataFrame({"key": x["key"], "diff": [unified(a or "", b or "", context, spaces) for a, b in zip(x["old"], x["new"], strict=True)]})

    kind = dict(rows.dtypes)[key]
    given = rows.select(F.col(key).alias("key"), F.col(old).alias("old"), F.col(new).alias("new"))
    return given.mapInPandas(run, f"key {kind}, diff string").withColumnRenamed("key", key)


def merges(rows: DataFrame, key: str, base: str, ours: str, theirs: str) -> DataFrame:
    """(key, text, conflicts) of each row's three texts (null: empty)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            made = [merge3(o or "", a or "", b or "") for o, a, b in zip(x["base"], x["ours"], x["theirs"], strict=True)]
            yield pd.DataFrame({"key": x["key"], "text": [m[0] for m in made], "conflicts": [m[1] for m in made]})

    kind = dict(rows.dtypes)[key]
    given = rows.select(F.col(key).alias("key"), F.col(base).alias("base"), F.col(ours).alias("ours"), F.col(theirs).alias("theirs"))
    return given.mapInPandas(run, f"key {kind}, text string, conflicts long").withColumnRenamed("key", key)
