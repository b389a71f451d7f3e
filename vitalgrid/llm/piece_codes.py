"""SentencePiece ids of whole texts from a table of distinct marked words, and texts from ids.

A blank of a text becomes the marker U+2581, and one marker is put before a text that is not empty. Where the vocabulary has no
piece that goes on across a place, no merge can, so a text may be cut there and each part segmented for itself. Cuts are made
before the first marker of a run, around line feeds, and between a letter and those punctuation marks that follow a letter in no
piece; `Cutter` derives the marks from the vocabulary and refuses a vocabulary whose pieces cross markers. Words come again and again, so

1. all marked words of all texts are counted, and the most frequent (up to `TABLE`; all or none of those that come equally often, none that come once) are segmented once, by Spark;
2. this table, whose size is bounded, goes to all tasks; a word outside it is segmented when a task first meets it and then
   remembered (at most `MEMORY` words, then a task starts anew);
3. the ids of a text are those of its words, joined by position, and the end id.

The parts are segmented by the library with the vocabulary file that the caller names; ids of a text equal those that the library gives for the whole text.

Null and empty texts have the end id only and decode to the empty text. Texts of any length are whole: words are looked up one by one.
Repeated rows and ids, null ids and clashing column names do not matter: rows are mapped one by one and `keep` names what stays beside `ids`. An
empty table gives no rows. Ids outside the vocabulary are an error; a null list of ids decodes to null.
"""

from __future__ import annotations

import codecs
import hashlib
import re
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitalgrid.llm.common import cut_lineage

MARK = "▁"
#: Words of the broadcast table and characters of its longest; words that a task remembers and counts at a time; characters encoded at a time.
TABLE, LONGEST, MEMORY, COUNTED, AT_ONCE = 1 << 17, 48, 300_000, 200_000, 1 << 21

#: The library reports bytes that are no character one by one.
codecs.register_error("each-byte", lambda e: ("�", e.start + 1))


class Cutter:
    """Marked words of texts, and their ids."""

    def __init__(self, model: str) -> None:
        self.library = sentencepiece.SentencePieceProcessor(model_file=model)
        n = self.library.get_piece_size()
        special = {i for i in range(n) if self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_unused(i)}
        pieces = [self.library.id_to_piece(i) for i in range(n) if i not in special and not self.library.is_byte(i)]
        probe = "  ﬁ Ａ "
        if self.library.normalize(probe) != MARK + probe.replace(" ", MARK):
            raise ValueError("the vocabulary changes texts beyond marking blanks")
        if any(re.search(f"[^{MARK}]{MARK}", p) or "\n" in p for p in pieces):
            raise ValueError("pieces of the vocabulary go on across markers or line feeds")
        after_letter = {b for p in pieces for a, b in zip(p, p[1:]) if re.fullmatch(r"[^\W\d_]", a)}
        marks = "".join(re.escape(c) for c in ".,;:!?)(\"'-" if c not in after_letter)
        self.words = re.compile(rf"\n|{MARK}*[^\W\d_]+(?![^{MARK}\n{marks}])|{MARK}*[^{MARK}\n]+|{MARK}+").findall
        self.end = self.library.eos_id()
        # A line feed stands before a word, so that the marker the library adds does not touch it.
        self.before = len(self.library.encode("\n"))

    def cut(self, text: str) -> list[str]:
        return self.words(MARK + text.replace(" ", MARK)) if text else []

    def segment(self, words: Sequence[str]) -> list[bytes]:
        """The ids of each word, as 32-bit integers."""
        return [np.array(ids[self.before:], np.int32).tobytes() for ids in self.library.encode(["\n" + w for w in words], num_threads=1)]


class Decoder:
    """Texts of ids, as the library's `decode` gives them."""

    def __init__(self, model: str) -> None:
        library = sentencepiece.SentencePieceProcessor(model_file=model)
        n = library.get_piece_size()
        self.control = {i for i in range(n) if library.is_control(i)}
        self.marked = {i for i in range(n) if library.id_to_piece(i).startswith(MARK)}
        self.surface = [b"" if i in self.control else " ⁇ ".encode() if library.is_unknown(i) else bytes([int(library.id_to_piece(i)[1:-1], 16)]) if library.is_byte(i)
                        else library.id_to_piece(i).replace(MARK, " ").encode() for i in range(n)]

    def __call__(self, ids: list[int]) -> str:
        first = next((k for k, i in enumerate(ids) if i not in self.control), len(ids))
        last = len(ids)
        while last > first and ids[last - 1] in self.control:
            last -= 1
        ids = ids[first:last]
        if self.control.isdisjoint(ids):
            text = b"".join(map(self.surface.__getitem__, ids)).decode("utf-8", "each-byte")
        else:  # bytes do not make a character across a control id
            runs: list[list[int]] = [[]]
            for i in ids:
                if i in self.control:
                    runs.append([])
                else:
                    runs[-1].append(i)
            text = "".join(b"".join(map(self.surface.__getitem__, run)).decode("utf-8", "each-byte") for run in runs)
        return text[1:] if ids and ids[0] in self.marked else text


def word_counts(docs: DataFrame, model: str, text_col: str = "text") -> DataFrame:
    """(word, n) of all marked words of up to `LONGEST` characters."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, seen = Cutter(model), Counter()

        def flush() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])
            seen.clear()
            return rows

        for batch in batches:
            for text in batch.column(0):
                words = cutter.cut(text.as_py() or "")
                for s in range(0, len(words), COUNTED):
                    seen.update(words[s: s + COUNTED])
                    if len(seen) > COUNTED:
                        yield flush()
        yield flush()

    counted = docs.select(F.col(text_col).alias("text")).mapInArrow(count, "word string, n long")
    return counted.where(F.length("word") <= LONGEST).groupBy("word").agg(F.sum("n").alias("n"))


def word_table(docs: DataFrame, model: str, size: int = TABLE, text_col: str = "text") -> DataFrame:
    """(word, n, ids) of the most frequent marked words, each segmented once: all words of the greatest counts of which `size` hold all."""

    def segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Cutter(model)
        for batch in batches:
            words = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cutter.segment(words), pa.binary())], ["word", "n", "ids"])

    often = cut_lineage(word_counts(docs, model, text_col).where("n > 1"), "words")
    # The least count of which all words still fit; one row per distinct count.
    reach = Window.orderBy(F.col("n").desc())
    bar = often.groupBy("n").agg(F.count("*").alias("words")).withColumn("reached", F.sum("words").over(reach)).where(F.col("reached") <= size).agg(F.min("n")).first()[0]
    top = often.where(F.lit(False) if bar is None else F.col("n") >= bar)
    return cut_lineage(top.mapInArrow(segment, "word string, n long, ids binary"), "word-table")


def encode(docs: DataFrame, model: str, keep: Sequence[str] = ("doc_id",), text_col: str = "text", size: int = TABLE) -> DataFrame:
    """The columns `keep` and `ids`, an array of all ids of the text and the end id."""
    known = word_table(docs, model, size, text_col).select("word", "ids").toArrow()
    shared = docs.sparkSession.sparkContext.broadcast((known.column(0).to_pylist(), known.column(1).to_pylist()))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, frequent = Cutter(model), dict(zip(*shared.value))
        memory, end = dict(frequent), np.array([cutter.end], np.int32).tobytes()

        def ids_of(text: str) -> bytes:
            words = cutter.cut(text)
            try:
                return b"".join(map(memory.__getitem__, words)) + end
            except KeyError:
                pass
            if len(memory) > len(frequent) + MEMORY:
                memory.clear()
                memory.update(frequent)
            out = []
            for s in range(0, len(words), COUNTED):  # the words of one very long text may be more than a task remembers
                part = words[s: s + COUNTED]
                new = list(set(part).difference(memory))
                own = dict(zip(new, cutter.segment(new)))
                if len(memory) <= len(frequent) + MEMORY:
                    memory.update(own)
                out.append(b"".join([own[w] if w in own else memory[w] for w in part]))
            return b"".join(out) + end

        for batch in batches:
            texts, s = batch.column(batch.num_columns - 1), 0
            while s < batch.num_rows:
                codes, chars, e = [], 0, s
                while e < batch.num_rows and (e == s or chars < AT_ONCE):
                    text = texts[e].as_py() or ""
                    codes.append(ids_of(text))
                    chars += len(text)
                    e += 1
                offsets = np.concatenate([[0], np.cumsum([len(c) // 4 for c in codes])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(codes), np.int32)))
                yield pa.RecordBatch.from_arrays([c.slice(s, e - s) for c in batch.columns[:-1]] + [lists], [*names, "ids"])
                s = e

    rows = docs.select(*[F.col(c) for c in keep], F.col(text_col).alias("_text_"))
    names = [f"k{i}" for i in range(len(keep))]
    schema = T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, rows.schema.fields)] + [T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return rows.mapInArrow(read, schema).toDF(*keep, "ids")


def _by_ids(encoded: DataFrame, ids_col: str, function, fields: dict[str, T.DataType], arrow: list[pa.DataType]) -> DataFrame:
    """All columns and those that `function` makes of a list of ids."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = function()
        for batch in batches:
            lists, at = batch.column(batch.num_columns - 1), 0
            while at < batch.num_rows:
                out, size, s = [], 0, at
                while at < batch.num_rows and (at == s or size < AT_ONCE):
                    ids = lists[at].values
                    out.append((None,) * len(fields) if ids is None else made(ids.to_numpy(zero_copy_only=False).tolist()))
                    size += 0 if ids is None else len(ids)
                    at += 1
                yield pa.RecordBatch.from_arrays([c.slice(s, at - s) for c in batch.columns[:-1]] + [pa.array(c, t) for c, t in zip(zip(*out), arrow)], names)

    kept = [f"k{i}" for i in range(len(encoded.columns))]
    names = [*kept, *[f"made{i}" for i in range(len(fields))]]
    schema = T.StructType([T.StructField(n, t) for n, t in zip(names, [*[f.dataType for f in encoded.schema.fields], *fields.values()])])
    return encoded.select("*", F.col(ids_col).alias("_ids_")).mapInArrow(read, schema).toDF(*encoded.columns, *fields)


def decode(encoded: DataFrame, model: str, ids_col: str = "ids", name: str = "decoded") -> DataFrame:
    """All columns, and the text of the ids."""

    def decoder():
        read = Decoder(model)
        return lambda ids: (read(ids),)

    return _by_ids(encoded, ids_col, decoder, {name: T.StringType()}, [pa.string()])


def digests(encoded: DataFrame, model: str, ids_col: str = "ids") -> DataFrame:
    """The columns but the ids, with n_tokens, ids_sha256 (decimal ids joined by a space) and decoded_sha256 of each row."""

    def digester():
        read = Decoder(model)
        spelt = [str(i) for i in range(len(read.surface))]

        def of(ids: list[int]) -> tuple[int, str, str]:
            return len(ids), hashlib.sha256(" ".join(map(spelt.__getitem__, ids)).encode()).hexdigest(), hashlib.sha256(read(ids).encode()).hexdigest()

        return of

    made = {"n_tokens": T.LongType(), "ids_sha256": T.StringType(), "decoded_sha256": T.StringType()}
    kept = [c for c in encoded.columns if c != ids_col]
    out = _by_ids(encoded, ids_col, digester, made, [pa.int64(), pa.string(), pa.string()])
    return out.select(*kept, *made)
