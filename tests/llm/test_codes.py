"""SentencePiece ids against the library, codes of vectors against brute force."""

import hashlib
import math
import random

import numpy as np
import pyarrow.parquet as pq
import pytest
import sentencepiece
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitalgrid.llm import part_codes, piece_codes
from vitalgrid.llm.queries import QUERIES, piece_vocabulary

SF = "/root/testdata/sf0.001"
HARD = "  ab.,e\n\t'\"-(▁é́ﬁ漢😀0_;:\rs\x00 the <s>"


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=piece_vocabulary())


# --- pieces -------------------------------------------------------------------------------------------------------------------

def test_ids_of_words_make_the_ids_of_texts(library):
    cutter, decoder, rng = piece_codes.Cutter(piece_vocabulary()), piece_codes.Decoder(piece_vocabulary()), random.Random(1)
    for _ in range(5000):
        text = "".join(rng.choice(HARD) for _ in range(rng.randint(0, 14)))
        ids = np.frombuffer(b"".join(cutter.segment(cutter.cut(text))), np.int32).tolist() + [cutter.end]
        assert "".join(cutter.cut(text)) == (text and "▁" + text.replace(" ", "▁"))
        assert ids == library.encode(text, add_eos=True) and decoder(ids) == library.decode(ids)


def test_any_ids_decode_as_in_the_library(library):
    decoder, rng = piece_codes.Decoder(piece_vocabulary()), random.Random(2)
    odd = [0, 1, 2, 3, 3 + 65, 3 + 0xE2, 3 + 0x82, 3 + 0xAC, 3 + 0xF0, 13, 259, 264, 523, 28705]
    for _ in range(5000):
        ids = [rng.choice(odd) for _ in range(rng.randint(0, 7))]
        assert decoder(ids) == library.decode(ids)


@pytest.mark.parametrize("size, memory, counted", [(1 << 17, 300_000, 200_000), (3, 2, 4), (0, 0, 1)])
def test_encoded_rows_do_not_depend_on_the_tables(spark, documents, rows, library, monkeypatch, size, memory, counted):
    monkeypatch.setattr(piece_codes, "MEMORY", memory)
    monkeypatch.setattr(piece_codes, "COUNTED", counted)
    long = "word and, wörd\n" * 9000
    texts = [None, "", " ", "  two  blanks ", "the same", "the same", long, "x" * 50_000, "null\x00 byte", "▁mark"]
    docs = documents([(k, t) for k, t in enumerate(texts)] + [(None, "no id"), (4, "the same"), (4, "other text, same id")], clashing=True)
    got = rows(piece_codes.decode(piece_codes.encode(docs, piece_vocabulary(), ("doc_id", "text"), size=size), piece_vocabulary()))
    assert len(got) == 13 and {r["doc_id"] for r in got} == {None, *range(10)}
    for r in got:
        ids = library.encode(r["text"] or "", add_eos=True)
        assert r["ids"] == ids and r["decoded"] == library.decode(ids)


def test_counts_and_empty_tables(spark, documents, rows):
    docs = documents([(1, "a b, a\na"), (2, "a"), (3, None)])
    counts = {r["word"]: r["n"] for r in rows(piece_codes.word_counts(docs, piece_vocabulary()))}
    assert counts == {"▁a": 3, "▁b": 1, ",": 1, "\n": 1, "a": 1}
    top = {r["word"] for r in rows(piece_codes.word_table(docs, piece_vocabulary(), 2))}
    assert top == {"▁a"}  # of the words that come once none
    twice = documents([(1, "a b a b c c c")])
    assert [{r["word"] for r in rows(piece_codes.word_table(twice, piece_vocabulary(), n))} for n in (0, 1, 2, 3)] == [set(), {"▁c"}, {"▁c"}, {"▁a", "▁b", "▁c"}]
    empty = piece_codes.encode(documents([]), piece_vocabulary())
    assert empty.columns == ["doc_id", "ids"] and empty.count() == 0 and piece_codes.decode(empty, piece_vocabulary()).count() == 0
    nothing = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert rows(piece_codes.decode(nothing, piece_vocabulary()))[0]["decoded"] is None


def test_query_of_pieces_over_the_whole_table(spark, rows, library):
    got = {r["doc_id"]: r for r in rows(QUERIES["op12_distinct_words"](spark, SF))}
    table = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    assert len(got) == len(table)
    for r in table:
        ids = library.encode(r["text"] or "", add_eos=True)
        one = got[r["doc_id"]]
        assert one["n_tokens"] == len(ids)
        assert one["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert one["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()


# --- parts of vectors ---------------------------------------------------------------------------------------------------------

VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("label", T.IntegerType())])


def _brute(rows):
    """The contract in plain Python: (codes with errors per kept row, label sums, digest)."""
    kept = [r for r in rows if r[1] and all(c is not None and math.isfinite(c) for c in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return [], {}, None
    whole = [[math.floor(256 * c) if abs(c) < 2 ** 52 else int(c) * 256 for c in r[1]] for r in kept]
    n = len(whole[0]) // 16
    cut = [[w[p * n:(p + 1) * n] for p in range(16)] for w in whole]
    book = [[c[p] for c in cut[:64]] for p in range(16)]

    def nearest(p, v):
        far = [sum((a - b) ** 2 for a, b in zip(v, e)) for e in book[p]]
        return far.index(min(far)), min(far)

    for _ in range(2):
        for p in range(16):
            chosen = [nearest(p, c[p])[0] for c in cut]
            for e in range(len(book[p])):
                own = [c[p] for c, k in zip(cut, chosen) if k == e]
                if own:
                    book[p][e] = [sum(x) // len(own) for x in zip(*own)] if e < 64 else None
        # entries move after all parts were assigned: parts are apart, so the order of parts does not matter
    out, sums = [], {}
    for r, c in zip(kept, cut):
        found = [nearest(p, c[p]) for p in range(16)]
        error = sum(d for _, d in found)
        sums[r[2]] = sums.get(r[2], 0) + error
        out.append((r[0], "".join(f"{k:02x}" for k, _ in found), min(error, part_codes.LONG_MAX), r[2]))
    text = ",".join(str(v) for p in range(16) for e in book[p] for v in e)
    return out, {k: min(v, part_codes.LONG_MAX) for k, v in sums.items()}, hashlib.sha256(text.encode()).hexdigest()


def _same(spark, rows, data):
    table = spark.createDataFrame(data, VECTORS).select("*", F.lit("x").alias("code"), F.lit(1).alias("error"), F.lit(2).alias("total"), F.lit(3).alias("k0"))
    want, sums, digest = _brute(data)
    got = rows(part_codes.compress(table))
    key = lambda r: (r[0] is None, r[0] or 0, *map(str, r[1:]))
    assert sorted([(r["vec_id"], r["code"], r["error"], r["label_error"]) for r in got], key=key) == sorted([(i, c, e, sums[k]) for i, c, e, k in want], key=key)
    assert {r["codebooks_sha256"] for r in got} <= {digest}


@pytest.mark.parametrize("n, scale, width", [(300, 0.2, 64), (200, 3.0, 32), (40, 1.0, 16), (150, 0.004, 48), (90, 1e7, 32), (70, 1e300, 16)])
def test_codes_equal_brute_force(spark, rows, n, scale, width):
    rng = random.Random(n)
    data = [(rng.randrange(10 * n), [rng.gauss(0, 1) * scale for _ in range(width)], rng.choice([None, 1, 2])) for _ in range(n)]
    _same(spark, rows, data + data[:7])


def test_codes_of_odd_rows(spark, rows):
    rng = random.Random(5)
    vector = lambda: [round(rng.gauss(0, 1), 1) for _ in range(32)]
    data = [(k, vector(), k % 3) for k in range(80)]
    odd = [(None, vector(), 1), (None, vector(), None), (90, None, 1), (91, [None] + vector()[1:], 1), (92, [float("nan")] + vector()[1:], 1),
           (93, [float("inf")] + vector()[1:], 1), (-5, [], 2), (7, vector(), 0), (8, data[8][1], None), (8, data[8][1], None)]
    _same(spark, rows, data + odd)
    assert rows(part_codes.compress(spark.createDataFrame([], VECTORS))) == []
    assert rows(part_codes.compress(spark.createDataFrame([(1, None, 1)], VECTORS))) == []
    other = rows(part_codes.compress(spark.createDataFrame(data + [(200, [1.0] * 48, 1), (201, [1.0] * 7, 1)], VECTORS)))
    assert len(other) == 80  # vectors of another length than the first are left out


def test_masks_hold_every_nearest_entry():
    rng = np.random.default_rng(3)
    for n in (1, 2, 63, 64):
        entries = rng.integers(-6, 6, (n, 3))
        points = rng.integers(-9, 9, (4000, 3))
        index, far = part_codes.Sliced(entries).nearest(points)
        every = ((points[:, None] - entries[None]) ** 2).sum(axis=2)
        assert np.array_equal(index, every.argmin(axis=1)) and np.array_equal(far, every.min(axis=1))


def test_approximations_are_near(spark, rows):
    rng = random.Random(6)
    table = spark.createDataFrame([(k, [rng.gauss(0, 0.1) for _ in range(64)], 0) for k in range(400)], VECTORS)
    book = part_codes.fit(table)
    got = rows(part_codes.decode(part_codes.encode(table, book, ("vec_id", "embedding")), book))
    for r in got:
        far = sum((math.floor(256 * a) - 256 * b) ** 2 for a, b in zip(r["embedding"], r["approximation"]))
        assert far == pytest.approx(r["error"])
