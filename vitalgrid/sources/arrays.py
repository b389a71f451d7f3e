"""Elements of JSON array files, however large a file is.

A JSON array is one value, so a plain reader gives each file to one task. Here a file is read in splits like any text: records
end at ``{``, which every document begins with. Whether such a brace opens a document depends on all text before it - it may
lie inside a string or deeper in a document - so there are two passes:

1. each split reports, for both answers to "does it begin inside a string?", how it ends: inside a string or not, the
   brackets it leaves open, and how many braces it has at each depth;
2. splits of a file are chained, which settles where every split begins; each then cuts its text into documents. A document
   that lies across a border is put together from its parts.

Only reports are chained, one small row per split; texts move only where a document crosses a border.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalgrid.session import cut_lineage

_ESCAPED = re.compile(r"\\.", re.DOTALL)


def _outside(piece: str, inside: bool) -> tuple[str, bool]:
    """A piece's text outside of strings, and whether it ends inside one."""
    parts = (_ESCAPED.sub("", piece) if "\\" in piece else piece).split('"')
    return "".join(parts[1::2] if inside else parts[::2]), inside != (len(parts) % 2 == 0)


def _level(plain: str) -> int:
    return plain.count("[") - plain.count("}") - plain.count("]")


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, seq, piece): texts between opening braces, in order of seq within a split."""
    rows = spark.read.option("lineSep", "{").text(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("seq"), F.col("value").alias("piece"))


REPORT = "file string, block long, inside boolean, ends_inside boolean, level int, braces map<int,long>, array boolean"


def _report(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per split and answer: how it ends, and its braces by the level before them, counted from the split's begin."""
    at, state, array = None, [], False

    def rows() -> pd.DataFrame:
        return pd.DataFrame([(*at, answer, inside, level, braces, array) for answer, (inside, level, braces) in zip((False, True), state)],
                            columns=["file", "block", "inside", "ends_inside", "level", "braces", "array"])

    for batch in batches:
        for file, block, piece in zip(batch["file"], batch["block"], batch["piece"]):
            if at != (file, block):
                if at is not None:
                    yield rows()
                at, state, array = (file, block), [(False, 0, {}), (True, 0, {})], piece.lstrip("\ufeff \t\r\n").startswith("[")
            for k, (inside, level, braces) in enumerate(state):
                plain, inside = _outside(piece, inside)
                level += _level(plain)
                if not inside:
                    braces[level] = braces.get(level, 0) + 1
                    level += 1
                state[k] = (inside, level, braces)
    if at is not None:
        yield rows()


STARTS = "file string, block long, inside boolean, level int, before long, base int"


def _chained(reports: pd.DataFrame) -> pd.DataFrame:
    """Where each split of a file begins: inside a string or not, at which level, after how many documents."""
    rows = reports.sort_values(["block", "inside"])
    inside, level, before, out = False, 0, 0, []
    base = 1 if bool(rows["array"].iloc[0]) else 0
    for block, pair in rows.groupby("block", sort=True):
        out.append((rows["file"].iloc[0], block, inside, level, before, base))
        r = pair[pair["inside"] == inside].iloc[0]
        before += dict(r["braces"]).get(base - level, 0)
        inside, level = bool(r["ends_inside"]), level + int(r["level"])
    return pd.DataFrame(out, columns=["file", "block", "inside", "level", "before", "base"])


PARTS = "file string, number long, block long, whole boolean, text string"


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Documents, or what a split holds of them. Number 0 is what comes before a file's first document."""
    at, held = None, []
    for batch in batches:
        out = []
        for file, block, piece, first_inside, first_level, before, base in zip(*[batch[c] for c in ("file", "block", "piece", "inside", "level", "before", "base")]):
            if at != (file, block):
                if held:
                    out.append((*part, "{".join(held)))  # noqa: F821
                at, held, inside, level, number, begun = (file, block), [], bool(first_inside), int(first_level), int(before), False
            plain, inside = _outside(piece, inside)
            level += _level(plain)
            held.append(piece)
            part = (file, number, block, False)
            if not inside:
                if level == base:  # the brace after this piece begins a document
                    out.append((file, number, block, begun, "{".join(held)))
                    number, held, begun = number + 1, [], True
                level += 1
        if out:
            yield pd.DataFrame(out, columns=["file", "number", "block", "whole", "text"])
    if held:
        yield pd.DataFrame([(*part, "{".join(held))], columns=["file", "number", "block", "whole", "text"])


def array_elements(spark: SparkSession, path: str) -> DataFrame:
    """(element): the text of every object of arrays, of single documents and of documents one after another."""
    pieces = _pieces(spark, path)
    starts = cut_lineage(pieces.select("file", "block", "piece").mapInPandas(_report, REPORT).groupBy("file").applyInPandas(_chained, STARTS), "splits")
    placed = pieces.join(starts, ["file", "block"]).sortWithinPartitions("file", "block", "seq")  # in order whichever join it is
    parts = placed.mapInPandas(_cut, PARTS).where("number > 0")
    whole = parts.where("whole").select("text")
    pieced = parts.where("NOT whole").groupBy("file", "number").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "text"))), lambda x: x["text"]), "{").alias("text"))
    text = F.rtrim(F.col("text"), F.lit(", \t\r\n]"))
    return whole.union(pieced.select("text")).where(text != "").select(F.concat(F.lit("{"), text).alias("element"))
