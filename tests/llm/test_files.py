"""Archives and token files: exact round trips, directories, random access, odd rows."""

import random
import struct
import zipfile

import numpy as np
import pytest

from vitalgrid.llm import files, token_files, warc_zip
from vitalgrid.llm.common import staging_path
from vitalgrid.llm.queries import word_vocabulary

PAGES = "page_id long, url string, html string"


def test_token_file_gives_every_token(tmp_path):
    rng = np.random.default_rng(3)
    ids = [rng.integers(0, top, n).astype("<u4").tobytes() for top, n in ((200, 700), (70_000, 1300), (2 ** 32, 90), (300, 0), (5, 1), (2 ** 24, 513))]
    uri = str(tmp_path / "x.tok")
    token_files.write_file(uri, [4, None, 7, 8, 9, 10], ids)
    flat = np.frombuffer(b"".join(ids), "<u4")
    with token_files.TokenFile(uri) as file:
        assert [file.token(i) for i in range(len(flat))] == flat.tolist()
        assert [(d, s, x.tobytes()) for d, s, x in file.documents()] == [(d, s, x) for d, s, x in zip([4, None, 7, 8, 9, 10], np.cumsum([0] + [len(x) // 4 for x in ids]), ids)]
        with pytest.raises(IndexError):
            file.token(len(flat))


def test_pre_tokens_give_the_librarys_ids():
    encode = token_files.encoder(word_vocabulary())
    letters = [chr(c) for c in (*range(0x250), *range(0x2000, 0x20D0))]
    rng = random.Random(5)
    texts = ["".join(rng.choices(letters, k=14)) for _ in range(3000)] + ["don't WE'LL i've 's ''s", "a<|endoftext|>b", "é Å", "İI ß ẞ", "日本 🙂", ""]
    assert encode(texts) == [encode.whole(t) for t in texts]


def test_documents_come_back_in_order(spark, documents, rows):
    docs = documents([(5, "Hello there"), (2, None), (None, "no id"), (9, ""), (2, "again 2"), (2, "again 2"), (7, "x" * 300_000)], clashing=True)
    manifest = token_files.write_tokens(docs, word_vocabulary(), file_tokens=10)
    got = rows(token_files.read_tokens(manifest), "start")
    got.sort(key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None, 2, 2, 2, 5, 7, 9]
    assert [r["start"] for r in got] == np.cumsum([0] + [r["n_tokens"] for r in got])[:-1].tolist()
    encode = token_files.encoder(word_vocabulary())
    import zlib
    assert got[5]["ids_crc32"] == zlib.crc32(encode.whole("x" * 300_000) + struct.pack("<I", 1)) and got[6]["n_tokens"] == 1
    assert token_files.encode_documents(documents([]), word_vocabulary()).count() == 0


def test_pages_come_back_from_archives(spark, rows):
    data = [(1, "http://a", "same"), (3, None, "same"), (2, "u\r\nv", "same"), (4, "b", None), (6, "c", ""), (5, "d", "other \r\n\r\n text"), (5, "d", "other \r\n\r\n text"), (None, "e", "same"), (None, "f", "alone")]
    from pyspark.sql import functions as F
    pages = spark.createDataFrame(data, PAGES).select("*", F.lit(1).alias("sha1"), F.lit(2).alias("payload"))
    got = {(r["page_id"], r["url"]): r for r in rows(warc_zip.archive_and_read(pages))}
    assert len(got) == 8 and all(r["payload_digest"] == warc_zip.digest((d[2] or "").encode()) for d in data for r in [got[(d[0], d[1] and d[1].replace("\r\n", "%0D%0A"))]])
    role = {k: (r["record_type"], r["refers_to"], r["payload_bytes"]) for k, r in got.items()}
    assert role[(1, "http://a")] == ("revisit", 3, 4) and role[(3, None)] == ("response", None, 4) and role[(None, "e")] == ("revisit", 3, 4)
    assert role[(4, "b")] == ("revisit", 6, 0) and role[(6, "c")] == ("response", None, 0) and role[(None, "f")] == ("response", None, 5)
    small = {r["page_id"]: r["record_type"] for r in rows(warc_zip.archive_and_read(pages.where("page_id < 4"), min_bytes=5))}
    assert set(small.values()) == {"response"}
    assert warc_zip.archive_and_read(pages.limit(0)).count() == 0


def test_many_archives_and_split_ranges(spark, rows):
    pages = spark.createDataFrame([(i, "u", f"page {i} " * (i % 50)) for i in range(400)], PAGES)
    manifest = warc_zip.write_archives(pages, archive_bytes=2000)
    assert manifest.count() > 8
    ranges = warc_zip.locate(manifest, range_bytes=500)
    assert ranges.count() > manifest.count()
    got = rows(warc_zip.read_records(ranges), "page_id")
    assert sorted(r["page_id"] for r in got) == list(range(400))


def test_zip64_directories_are_followed(tmp_path):
    """A directory whose sizes and places moved to ZIP64 fields, behind a comment that holds the end signature."""
    path = str(tmp_path / "x.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as z:
        z.comment = b"PK\x05\x06 not the end"
        z.writestr("archive/a", b"first")
        z.writestr("indexes/b", b"second")
    raw = open(path, "rb").read()
    with files.open_ranges(path) as file:
        found = {m.name: m for m in warc_zip.members(file)}
        assert file.read_at(6, warc_zip.data_start(file, found["indexes/b"])) == b"second"
    at = raw.index(warc_zip.CENTRAL)
    entry = bytearray(raw[at: raw.index(warc_zip.CENTRAL, at + 4)])
    struct.pack_into("<LL", entry, 20, warc_zip.FULL32, warc_zip.FULL32)
    struct.pack_into("<H", entry, 30, 28)
    struct.pack_into("<L", entry, 42, warc_zip.FULL32)
    entry += struct.pack("<HHQQQ", 1, 24, 5, 5, 0)
    end64 = warc_zip.END64_FORM.pack(warc_zip.END64, 44, 45, 45, 0, 0, 1, 1, len(entry), at)
    locator = warc_zip.LOCATOR64_FORM.pack(warc_zip.LOCATOR64, 0, at + len(entry), 1)
    end = warc_zip.END_FORM.pack(warc_zip.END, 0, 0, 0xFFFF, 0xFFFF, warc_zip.FULL32, warc_zip.FULL32, 0)
    wide = str(tmp_path / "y.zip")
    open(wide, "wb").write(raw[:at] + bytes(entry) + end64 + locator + end)
    with files.open_ranges(wide) as file:
        (member,) = warc_zip.members(file)
        assert member.name == "archive/a" and file.read_at(member.size, warc_zip.data_start(file, member)) == b"first"
    open(wide, "wb").write(b"no archive")
    with files.open_ranges(wide) as file, pytest.raises(ValueError):
        warc_zip.members(file)


def test_folders_are_new_each_time(spark):
    assert staging_path(spark, "x") != staging_path(spark, "x")
