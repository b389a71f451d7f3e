"""The pipeline stage by stage against brute force, on planted cases."""

import random
import re

import pytest

import corpus_pipeline
from tests.llm.test_joins import _brute, _brute_hits
from vitalgrid.llm import token_files
from vitalgrid.llm.queries import word_vocabulary


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    rng = random.Random(21)
    words, bad = [f"term{i}" for i in range(500)], ["grubber", "snivel", "dolt"]
    passages = [" ".join(f"bench{i}x{j}" for j in range(30)) for i in range(3)]
    rows, toxic, dirty = [], set(), set()
    for d in range(400):
        text = rng.choices(words, k=rng.randint(20, 90))
        if d % 8 == 0:
            text[3:3] = rng.choices(bad, k=2)
            toxic.add(d)
        elif d % 11 == 0:
            text[5:5] = passages[d % 3].split()[:25]
            dirty.add(d)
        rows.append((d, " ".join(text), "en", f"s{d % 4}", 0))
    copies = {1000 + i: rows[2 * i + 1][1] + (" tail" if i % 2 else "") for i in range(20)}
    rows += [(d, t, "en", "s0", 0) for d, t in copies.items()] + [(2000, None, "en", None, 0), (2001, "", None, "s1", None), (None, "text without id", "en", "s2", 1), (3, rows[3][1], "en", "s3", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(d, 1, int(d in toxic)) for d in range(400)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(enumerate(passages)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, toxic, dirty, list(enumerate(passages))


def test_every_stage(spark, planted):
    folder, rows, toxic, dirty, passages = planted
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "ngram_jaccard_join", "decontamination", "mixing", "token_output"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    one = corpus_pipeline.cut_lineage(stages["toxicity"](spark, docs, folder), "t1")
    kept = [(r["doc_id"], r["text"]) for r in one.collect()]
    assert sorted(kept, key=str) == sorted([(r[0], r[1]) for r in rows if r[0] not in toxic], key=str) and one.columns == columns

    two = corpus_pipeline.cut_lineage(stages["ngram_jaccard_join"](spark, one, folder), "t2")
    with_id = [r for r in kept if r[0] is not None]
    want = {d for d, _, c in _brute(with_id) if c == d}
    got = [r["doc_id"] for r in two.collect()]
    assert sorted(d for d in got if d is not None) == sorted(want) and got.count(None) == 1 and two.columns == columns

    three = corpus_pipeline.cut_lineage(stages["decontamination"](spark, two, folder), "t3")
    texts = {r["doc_id"]: r["text"] for r in two.collect()}
    clean = {d for d, t in texts.items() if not _brute_hits(t, passages)[4]}
    assert {r["doc_id"] for r in three.collect()} == clean and not clean & dirty and three.columns == columns

    four = corpus_pipeline.cut_lineage(stages["mixing"](spark, three, folder), "t4")
    times: dict = {}
    for r in four.collect():
        times[r["doc_id"]] = times.get(r["doc_id"], 0) + 1
    assert set(times) <= clean and max(times.values()) <= 3 and four.columns == columns
    taken = sum(n * len(re.findall(r"[^\x20\x09-\x0D]+", texts[d] or "")) for d, n in times.items())
    total = sum(len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in texts.items() if d in clean)
    assert abs(taken - total) <= 0.03 * total

    five = sorted(stages["token_output"](spark, four, folder).collect(), key=lambda r: r["start"])
    encode = token_files.encoder(word_vocabulary())
    ids = [r["doc_id"] for r in five]
    assert sorted(ids, key=lambda d: (d is not None, d)) == ids and len(ids) == sum(times.values())
    assert all(r["n_tokens"] == len(encode.whole(texts[r["doc_id"]] or "")) // 4 + 1 for r in five)


def test_run_is_all_stages(spark, planted):
    out = corpus_pipeline.run(spark, planted[0])
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and out.count() > 200


def test_empty_documents_go_through(spark, planted, tmp_path):
    folder = planted[0]
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0


def _shingles(text, k):
    w = (text or "").lower().split()
    return {tuple(w[i: i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def _like(a, b, k):
    return len(_shingles(a, k) & _shingles(b, k)) / len(_shingles(a, k) | _shingles(b, k))


def test_near_copies_by_five_words_and_four_fifths(spark):
    """A pair that is alike by five words at 0.82, but at less than 0.9 by three; one below 0.8; and families against brute force."""
    base = [f"u{i}" for i in range(200)]
    edited = lambda places: " ".join("edit" + w if i in places else w for i, w in enumerate(base))
    text, near, far = " ".join(base), edited({30, 80, 130, 180}), edited({30, 60, 90, 120, 150})
    assert 0.80 <= _like(text, near, 5) < 0.84 and _like(text, near, 3) < 0.9 and _like(text, far, 5) < 0.8
    docs = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    assert [r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs([(1, text), (2, near)]), "").collect()] == [1]
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs([(1, text), (3, far)]), "").collect()) == [1, 3]

    rng, rows = random.Random(4), []
    for _ in range(60):
        own = [f"v{rng.randrange(3000)}" for _ in range(rng.choice([6, 12, 40, 90, 250]))]
        for _ in range(5):
            gone = set(rng.sample(range(len(own)), rng.randint(0, max(1, len(own) // 35))))
            rows.append((len(rows), " ".join(f"z{rng.randrange(10**6)}" if i in gone else w for i, w in enumerate(own))))
    up = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i // 5 * 5, i):
            a, b = _shingles(rows[i][1], 5), _shingles(rows[j][1], 5)
            if 100 * len(a & b) >= 80 * len(a | b):
                one, two = up[i], up[j]
                up = [min(one, two) if u in (one, two) else u for u in up]
    got = sorted(r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs(rows), "").collect())
    assert got == [i for i, u in enumerate(up) if u == i] and 60 < len(got) < 300
