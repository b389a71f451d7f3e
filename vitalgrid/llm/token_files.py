"""Token ids in files of directly addressable codes.

A file holds the ids of consecutive documents. Each id is cut into 8-bit chunks, lowest first; level k has the k-th chunks of
all ids that reach so far, a bitmap that tells which of them go on, and a rank directory with the number of set bits before
each 512-bit block. The place of an id in the next level is the rank of its bit, so any token, or any range of tokens, is read
by a few range reads, and nothing is decoded in between.

Layout, little-endian: magic, version, documents, tokens, levels (u32 u32 u64 u64 u32 u32); per level the count and the places
of values, bitmap and directory (4 x u64); document ids (i64), null marks (u8), first tokens (u64, one more than documents);
then the levels.

Documents are dealt out by ranges of doc_id, each task writes files of bounded size under names of its own, and only the
manifest, which Spark commits, says which files count; a task that runs again leaves an orphan, never a half-written file in use.

Ids are those of the tokenizers library. Texts of plain characters are cut into the pre-tokens of the vocabulary's own pattern
and each distinct pre-token is encoded once per worker; other texts are encoded whole. Both give the same ids (tested).

Null texts count as empty: such a document has the end id only. Repeated rows are separate documents, next to each other. Null
ids sort first. An empty table gives no files and no rows. Further columns are not read.
"""

from __future__ import annotations

import functools
import re
import struct
import unicodedata
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalgrid.llm import files
from vitalgrid.llm.common import cut_lineage, positions, staging_path

MAGIC, VERSION = 0x54434144, 1
HEAD, LEVEL = struct.Struct("<IIQQII"), struct.Struct("<QQQQ")
BLOCK_BITS = 512
#: Tokens after which a task starts its next file.
FILE_TOKENS = 1 << 22
#: Tokens decoded at once on reading.
READ_TOKENS = 1 << 18
#: Distinct pre-tokens a worker remembers, and characters of texts that are encoded at once.
MEMORY, GROUP = 400_000, 1 << 18


# --- ids of texts -------------------------------------------------------------------------------------------------------------

def _plain_characters() -> str:
    """Characters on which cutting by pattern and encoding whole agree: no composition, no context in lower-casing, no odd spaces."""
    some = [*range(0x20, 0x7F), *range(0xA1, 0x250), *range(0x2010, 0x2028), *range(0x2030, 0x205F), *range(0x20A0, 0x20C0)]
    found = {chr(c) for c in some if c not in (0xAD, 0x130)}
    return "\t\n\r" + "".join(sorted(c for c in found if set(c.lower()) <= found))


def _pre_token_pattern(plain: str) -> re.Pattern:
    kinds: dict[str, str] = {"L": "", "N": ""}
    for c in plain:
        kind = unicodedata.category(c)[0]
        if kind in kinds:
            kinds[kind] += c
    letters, digits = (re.escape(kinds[k]) for k in "LN")
    # Fixed value: the vocabulary file's own pattern, with its letter and number classes spelt out for plain characters.
    # Runs of letters come first; no other branch can start with a letter.
    return re.compile(rf"[{letters}]+|'s|'t|'re|'ve|'m|'ll|'d|[{digits}]|[^\s{letters}{digits}]+")


class Encoder:
    """Ids of texts as little-endian 32-bit bytes."""

    def __init__(self, vocabulary: str) -> None:
        from tokenizers import Tokenizer

        plain = _plain_characters()
        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.other = re.compile(f"[^{re.escape(plain)}]")
        self.pieces = _pre_token_pattern(plain)
        self.known: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, pieces: list[str]) -> None:
        """Encode new pre-tokens in one call: spaces keep them apart, and the library tells which id comes from which."""
        got = self.tokenizer.encode(" ".join(pieces), add_special_tokens=False)
        ids = np.asarray(got.ids, "<u4").tobytes()
        ends = np.cumsum(np.bincount(got.word_ids, minlength=len(pieces))) * 4
        self.known.update(zip(pieces, map(ids.__getitem__, map(slice, [0, *ends[:-1].tolist()], ends.tolist()))))

    def __call__(self, texts: list[str]) -> list[bytes]:
        cut = [None if self.other.search(t) or any(s in t for s in self.special) else self.pieces.findall(t.lower()) for t in texts]
        if len(self.known) > MEMORY:
            self.known.clear()
        new = set().union(*filter(None, cut)).difference(self.known)
        if new:
            self._learn(list(new))
        return [self.whole(t) if c is None else b"".join(map(self.known.__getitem__, c)) for t, c in zip(texts, cut)]


@functools.cache
def encoder(vocabulary: str) -> Encoder:
    """One per worker process, so that later tasks find its memory filled."""
    return Encoder(vocabulary)


def _groups(texts: list[str], characters: int = GROUP) -> Iterator[slice]:
    start, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= characters:
            yield slice(start, i + 1)
            start, size = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


# --- files --------------------------------------------------------------------------------------------------------------------

def _level(values: np.ndarray, more: np.ndarray) -> tuple[bytes, bytes, bytes]:
    padded = np.zeros(-(-len(more) // BLOCK_BITS) * BLOCK_BITS, bool)
    padded[: len(more)] = more
    ranks = np.concatenate([[0], np.cumsum(padded.reshape(-1, BLOCK_BITS).sum(1, dtype=np.uint64))]).astype("<u8")
    return values.tobytes(), np.packbits(padded, bitorder="little").tobytes(), ranks.tobytes()


def write_file(uri: str, doc_ids: list[int | None], ids: list[bytes]) -> int:
    """Write the documents' ids; the number of tokens."""
    rest = np.frombuffer(b"".join(ids), "<u4")
    n, levels, counts = len(rest), [], []
    while len(rest) or not levels:
        more = rest > 255
        levels.append(_level((rest & 255).astype(np.uint8), more))
        counts.append(len(rest))
        rest = rest[more] >> 8
        if not len(rest):
            break
    starts = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids], dtype=np.uint64)]).astype("<u8")
    table = np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes() + bytes(d is None for d in doc_ids) + starts.tobytes()
    place = HEAD.size + LEVEL.size * len(levels) + len(table)
    directory = b""
    for count, parts in zip(counts, levels):
        places = [place, place + len(parts[0]), place + len(parts[0]) + len(parts[1])]
        directory += LEVEL.pack(count, *places)
        place += sum(map(len, parts))
    with files.create(uri) as out:
        out.write(HEAD.pack(MAGIC, VERSION, len(doc_ids), n, len(levels), 8) + directory + table)
        for parts in levels:
            for part in parts:
                out.write(part)
    return n


class TokenFile:
    """Random access to the tokens of one file."""

    def __init__(self, uri: str) -> None:
        self.file = files.open_ranges(uri)
        magic, version, self.n_docs, self.n_tokens, n_levels, self.bits = HEAD.unpack(self.file.read_at(HEAD.size, 0))
        if magic != MAGIC or version != VERSION:
            raise ValueError(f"not a token file: {uri}")
        self.levels = list(LEVEL.iter_unpack(self.file.read_at(LEVEL.size * n_levels, HEAD.size)))
        at = HEAD.size + LEVEL.size * n_levels
        ids = np.frombuffer(self.file.read_at(8 * self.n_docs, at), "<i8")
        null = np.frombuffer(self.file.read_at(self.n_docs, at + 8 * self.n_docs), np.uint8)
        self.doc_ids = [None if z else int(i) for i, z in zip(ids, null)]
        self.starts = np.frombuffer(self.file.read_at(8 * self.n_docs + 8, at + 9 * self.n_docs), "<u8").astype(np.int64)

    def __enter__(self) -> TokenFile:
        return self

    def __exit__(self, *_: object) -> None:
        self.file.close()

    def _rank(self, level: int, i: int) -> int:
        """Ids of the level before the i-th that go on."""
        _, _, bitmap, ranks = self.levels[level]
        block = i // BLOCK_BITS
        before = int.from_bytes(self.file.read_at(8, ranks + 8 * block), "little")
        if not i % BLOCK_BITS:
            return before
        bits = np.frombuffer(self.file.read_at(BLOCK_BITS // 8, bitmap + block * BLOCK_BITS // 8), np.uint8)
        return before + int(np.unpackbits(bits, bitorder="little")[: i % BLOCK_BITS].sum())

    def _range(self, level: int, low: int, high: int) -> np.ndarray:
        _, values, bitmap, _ = self.levels[level]
        out = np.frombuffer(self.file.read_at(high - low, values + low), np.uint8).astype(np.uint32)
        first = low // 8
        bits = np.unpackbits(np.frombuffer(self.file.read_at(-(-high // 8) - first, bitmap + first), np.uint8), bitorder="little")
        more = np.flatnonzero(bits[low - 8 * first: high - 8 * first])
        if len(more):
            start = self._rank(level, low)
            out[more] |= self._range(level + 1, start, start + len(more)) << np.uint32(self.bits)
        return out

    def tokens(self, low: int, high: int) -> np.ndarray:
        return self._range(0, low, high) if high > low else np.zeros(0, np.uint32)

    def token(self, i: int) -> int:
        if not 0 <= i < self.n_tokens:
            raise IndexError(i)
        return int(self.tokens(i, i + 1)[0])

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(id, first token in the file, ids) of each document, reading many short ones at once."""
        d = 0
        while d < self.n_docs:
            e = max(d + 1, int(np.searchsorted(self.starts, self.starts[d] + READ_TOKENS, "right")) - 1)
            base = int(self.starts[d])
            got = self.tokens(base, int(self.starts[e]))
            for i in range(d, e):
                yield self.doc_ids[i], int(self.starts[i]), got[self.starts[i] - base: self.starts[i + 1] - base]
            d = e


# --- jobs ---------------------------------------------------------------------------------------------------------------------

def write_tokens(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1,
                 file_tokens: int = FILE_TOKENS, folder: str | None = None) -> DataFrame:
    """Encode and write all documents in ascending order of id; the manifest (path, start, n_docs, n_tokens), in file order."""
    folder = files.make_folder(folder or staging_path(docs.sparkSession, "token-files"))
    end = struct.pack("<I", end_id)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, task = encoder(vocabulary), TaskContext.get().partitionId()
        doc_ids: list[int | None] = []
        ids: list[bytes] = []
        size, shard = 0, 0

        def close() -> pd.DataFrame:
            uri = f"{folder}/{task:07d}-{shard:05d}-{uuid.uuid4().hex}.tok"
            return pd.DataFrame({"task": [task], "shard": [shard], "path": [uri], "n_docs": [len(doc_ids)], "n_tokens": [write_file(uri, doc_ids, ids)]})

        for batch in batches:
            texts = batch["text"].tolist()
            for part in _groups(texts):
                for doc, null, got in zip(batch["id"][part], batch["no_id"][part], encode(texts[part])):
                    doc_ids.append(None if null else int(doc))
                    ids.append(got + end)
                    size += len(got) // 4 + 1
                    if size >= file_tokens:
                        yield close()
                        doc_ids, ids, size, shard = [], [], 0, shard + 1
        if doc_ids:
            yield close()

    plain = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("id"), F.col(id_col).isNull().alias("no_id"),
                        F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    order = [F.desc("no_id"), F.asc("id")]
    dealt = plain.repartitionByRange(*order).sortWithinPartitions(*order, "text")
    manifest = cut_lineage(dealt.mapInPandas(write, "task long, shard long, path string, n_docs long, n_tokens long"), "manifest")
    return positions(manifest, [F.asc("task"), F.asc("shard")], {"start": F.col("n_tokens")}).select("path", "start", "n_docs", "n_tokens")


def read_tokens(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, start in zip(batch["path"], batch["start"]):
                with TokenFile(path) as file:
                    rows = [(d, start + first, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for d, first, ids in file.documents()]
                out = pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids_crc32"])
                yield out.astype({"doc_id": "Int64"})

    # A number of its own keeps Spark from merging the few, small rows of the manifest into one task.
    paths = manifest.select("path", "start").repartition(max(1, manifest.count()), "path")
    return paths.mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def encode_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write all documents' tokens, then read the files back."""
    return read_tokens(cut_lineage(write_tokens(docs, vocabulary, id_col, text_col), "token-manifest"))
