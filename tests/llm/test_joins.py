"""N-gram join, decontamination and mixing against brute force, and their odd rows."""

import hashlib
import random
import re

import numpy as np
import pytest

from vitalgrid.llm import components, decontamination, mixing, ngram_join


def _sets(texts, k=3):
    out = []
    for t in texts:
        w = (t or "").encode().lower().split()
        out.append({tuple(w[i: i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    return out


def _brute(rows):
    """component per row, linking by sets and by shared ids."""
    sets, up = _sets([t for _, t in rows]), list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 90 * len(a | b):
                up[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return [(d, len(s), least[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets))]


def _family(rng, n, length, edits):
    base = [f"w{rng.randrange(400)}" for _ in range(length)]
    out = [" ".join(base)]
    for _ in range(n - 1):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            i = rng.randrange(len(w))
            w[i: i + 1] = rng.choice([[], [f"v{rng.randrange(10**6)}"], [w[i], f"v{rng.randrange(10**6)}"]])
        if rng.random() < 0.3:
            base = w
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("seed,block", [(1, 1 << 21), (2, 1500)])
def test_join_is_exact(documents, rows, monkeypatch, seed, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rng = random.Random(seed)
    texts = [t for n, length, edits in ((30, 130, 5), (30, 60, 2), (25, 300, 14), (20, 12, 1), (20, 24, 1), (12, 3, 1), (40, 200, 9)) for t in _family(rng, n, length, edits)]
    texts += ["A b", "a B", "a", "", None, "A\tb\x0bc d", "a b c D"]
    data = list(enumerate(texts))
    rng.shuffle(data)
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows(ngram_join.join(documents(data, clashing=True)))]
    assert sorted(got) == sorted(_brute(data))


@pytest.mark.parametrize("percent", [60, 80, 90])
def test_signatures_lose_no_link(percent):
    """Linked sets have, in a class that both sign for, as many common signatures as each needs, and at least one."""
    rng, linked = np.random.default_rng(4), 0
    for n in (5, 9, 10, 17, 19, 40, 95, 300, 901):
        for _ in range(60):
            a = np.unique(rng.integers(0, 2 ** 63, n).astype(np.uint64))
            most = ngram_join.max_difference(len(a), percent)
            gone = int(rng.integers(0, most + 1))
            b = np.sort(np.concatenate([np.delete(a, rng.choice(len(a), min(n, int(rng.integers(0, gone + 1))), False)), rng.integers(0, 2 ** 63, gone // 2).astype(np.uint64)]))
            both = len(np.intersect1d(a, b))
            if 100 * both >= percent * (len(a) + len(b) - both) and not len(a) == both == len(b):
                linked += 1
                signed = ngram_join.signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), percent)
                good = False
                for level in np.unique(signed.level):
                    rows = [(signed.of == k) & (signed.level == level) for k in (0, 1)]
                    if rows[0].any() and rows[1].any():
                        common = len(np.intersect1d(signed.signature[rows[0]], signed.signature[rows[1]]))
                        good |= common >= max(1, *[int(signed.need[r][0]) for r in rows])
                assert good, (n, len(a), len(b), both)
    assert linked > 100


def test_join_odd_rows(documents, rows):
    text = "one two three four five six seven"
    got = rows(ngram_join.join(documents([(4, text), (4, text), (9, text), (None, text), (4, "other words in this row only"), (8, "other words in this row only")])))
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in got) == [(0, 0), (4, 4), (4, 4), (4, 4), (8, 4), (9, 4)]
    assert ngram_join.join(documents([])).count() == 0


def test_components_of_a_path_and_a_star(spark, rows):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in rows(components.components(spark.createDataFrame(edges, "a long, b long")))}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 140)}}


def test_components_of_stars_take_one_move(spark, rows, monkeypatch):
    """Stars are final once a move to the smallest neighbours changes nothing; a node with two roots is not."""
    written, told = [], components.cut_lineage
    monkeypatch.setattr(components, "cut_lineage", lambda df, name="stage": written.append(name) or told(df, name))
    stars = [(10 * i + j, 10 * i) for i in range(5) for j in range(1, 9)]
    got = {r["node"]: r["component"] for r in rows(components.components(spark.createDataFrame(stars + stars, "a long, b long")))}
    assert got == {n: n // 10 * 10 for e in stars for n in e} and written == ["edges", "large-star"]
    tied = spark.createDataFrame([*stars, (48, 30)], "a long, b long")
    assert {r["node"]: r["component"] for r in rows(components.components(tied))} == {**got, **{n: 30 for n in got if n >= 40}}


def _brute_hits(text, items):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    hit, named = set(), set()
    for item, t in items:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        n = min(13, len(w))
        windows = {tuple(w[i: i + n]) for i in range(len(w) - n + 1)} if w else set()
        for i in range(len(words) - n + 1 if n else 0):
            if tuple(words[i: i + n]) in windows:
                hit.update(range(i, i + n))
                named.add("" if item is None else str(item))
    return len(words), len(hit), len(named), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(words)


def test_decontamination_is_exact(spark, documents, rows):
    rng = random.Random(6)
    words = [f"k{i}" for i in range(12)] + ["é", "Ñu"]
    items = [(i, " ".join(rng.choices(words, k=n))) for i, n in enumerate((40, 13, 14, 5, 1, 0, 25, 30))] + [(10, None), (3, "same id other text"), (3, "same id other text"), (None, "no id here"), (11, "x x x x x x x x x x x x x x x")]
    docs = []
    for i in range(60):
        body = rng.choices([f"u{rng.randrange(50)}" for _ in range(9)] + words, k=rng.randint(0, 120))
        for _ in range(rng.randint(0, 3)):
            w = (rng.choice(items)[1] or "").split()
            if w:
                a = rng.randrange(len(w))
                body[rng.randint(0, len(body)): 0] = [x.upper() for x in w[a: a + rng.randint(1, 30)]]
        docs.append((i, rng.choice(["-", " ", ", "]).join(body)))
    docs += [(70, None), (71, ""), (72, "x " * 40), (5, "k1 k2"), (5, "k1 k2")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in rows(decontamination.decontaminate(documents(docs, clashing=True), benchmark)))
    assert got == sorted((d, *_brute_hits(t, items)) for d, t in docs)
    assert decontamination.decontaminate(documents([]), benchmark).count() == 0
    assert [r["n_hit"] for r in rows(decontamination.decontaminate(documents([(1, "a b")]), benchmark.limit(0)))] == [0]


def test_proximity_allows_slack(spark, documents, rows):
    benchmark = spark.createDataFrame([(1, "zebra common common quartz")], "item_id long, text string")
    docs = documents([(1, "a zebra common quartz"), (2, "zebra " + "a " * 30 + "quartz"), (3, "zebra common common common common quartz"), (4, "nothing")])
    assert sorted({r["doc_id"] for r in rows(decontamination.proximity_matches(docs, benchmark, slack=2))}) == [1, 3]


def test_mix_meets_targets(documents, rows):
    rng = random.Random(8)
    data, d = [], 0
    for source, n in (("a", 400), ("b", 40), ("c", 300), (None, 200)):
        for _ in range(n):
            d += 1
            data.append((d, "w " * min(3000, int(rng.paretovariate(1.1) * 20)), source))
    data += [(9001, None, "a"), (9002, "", "empty only"), (7, "x x", "a"), (7, "x x", "a")]
    docs = documents(data, clashing=True)
    out = rows(mixing.mix(docs), "doc_id", "size")
    assert len(out) == len(data) and out == rows(mixing.mix(docs.repartition(5)), "doc_id", "size")
    per = {}
    for r in out:
        assert r["taken"] == r["copies"] * r["size"] <= 3 * r["size"]
        s = per.setdefault(r["source"], [r["source_size"], r["target"], 0, 0])
        s[2] += r["taken"]
        s[3] += r["size"]
    order = sorted((s for s in per if s is not None)) + [None]
    weights = {s: i % 3 + 1 for i, s in enumerate(order)}
    total = sum(v[0] for v in per.values())
    capped = set()
    while True:
        level = (total - sum(3 * per[s][0] for s in capped)) / sum(weights[s] for s in per if s not in capped)
        more = {s for s in per if s not in capped and level * weights[s] > 3 * per[s][0]}
        if not more:
            break
        capped |= more
    for s, (size, target, taken, sizes) in per.items():
        assert size == sizes and target == pytest.approx(3 * size if s in capped else level * weights[s])
        assert abs(taken - target) <= 0.01 * target + 60
    assert mixing.mix(documents([])).count() == 0


def test_a_newton_step_joins_once(spark, documents, monkeypatch):
    """A step hands each source's state to its counts and takes the moved state from their sums: a join more is a table more in the driver."""
    joins, states = [], []
    join, staged = mixing.null_safe_join, mixing._staged
    monkeypatch.setattr(mixing, "null_safe_join", lambda *args: joins.append(1) or join(*args))
    monkeypatch.setattr(mixing, "_staged", lambda state: states.append(staged(state)) or states[-1])
    sizes = mixing.cut_lineage(mixing.sized(documents([(i, "w " * (i * i % 41 + 1), ["a", "b", None][i * i % 3]) for i in range(200)])))
    targets = mixing.source_targets(sizes)
    out = mixing.balance(sizes.groupBy("source", "size").count().withColumnRenamed("count", "n"), targets).collect()
    assert len(states) > 2 and states[-1][1] == 0 and len(joins) == len(states)
    assert {(r["source"], r["target"]) for r in out} == {(r["source"], r["target"]) for r in targets.collect()}


def test_rates_are_the_tilts_of_the_dual(documents, rows):
    data = [(i, "w " * (i % 37 + 1), "abc"[i % 3]) for i in range(300)]
    for source in "abc":
        part = [r for r in rows(mixing.mix(documents(data))) if r["source"] == source]
        mean = sum(r["size"] for r in part) / len(part)
        free = [(np.log(r["rate"]) * mean / r["size"]) for r in part if r["rate"] < 2.99]
        assert not free or max(free) - min(free) < 1e-3 * max(1, abs(free[0])) + 2e-5 * mean
        assert abs(sum(r["rate"] * r["size"] for r in part) - part[0]["target"]) < 0.5 + 1e-4 * part[0]["target"]


def test_passages_of_rows_without_id_are_found(spark, documents, rows):
    passage = [f"p{i}" for i in range(20)]
    items = spark.createDataFrame([("one", " ".join(passage))], "item_id string, text string")
    docs = [(None, "before " + " ".join(passage)), (None, "nothing of it"), (None, " ".join(passage[2:15])), (4, "x y " + " ".join(passage))]
    got = {(r["doc_id"], r["n_words"]): (r["n_hit"], r["contaminated"]) for r in rows(decontamination.decontaminate(documents(docs), items))}
    assert got == {(None, 21): (20, True), (None, 3): (0, False), (None, 13): (13, True), (4, 22): (20, True)}


def test_proximity_finds_a_short_item_with_one_word_replaced(spark, documents, rows):
    """The replaced word's original is in no document."""
    items = spark.createDataFrame([("short", "alpha beta gamma delta epsilon zeta"), ("absent", "eins zwei drei")], "item_id string, text string")
    docs = documents([(1, "so alpha beta CHANGED delta epsilon zeta it goes"), (2, "alpha alone and nothing else")])
    found = rows(decontamination.proximity_matches(docs, items))
    assert {(r["doc_id"], r["item_id"]) for r in found} == {(1, "short")} and all(r["n_anchors"] == 2 for r in found)


def test_signatures_that_come_once_are_not_written(spark, documents, tmp_path, monkeypatch):
    """However small the filters are: of texts that share nothing no signature is kept, of copies with one word changed some are; common ones fill no bucket."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(ngram_join, "BLOOM_BITS", 1 << 15)
    written = {}
    cut = ngram_join.cut_lineage

    def told(df, name):
        out = cut(df, name)
        written[name] = out.count()
        return out

    monkeypatch.setattr(ngram_join, "cut_lineage", told)
    texts = [(i, " ".join(f"w{i}x{j}" for j in range(60))) for i in range(300)]
    ngram_join.join(documents(texts)).count()
    assert written["signed"] == 0
    near = [(1000 + i, " ".join(f"w0x{j}" if j != 30 else f"other{i}" for j in range(60))) for i in range(2)]
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.join(documents(texts + near), percent=80).collect()}
    assert written["signed"] > 0 and got[1000] == got[1001] == 0 and sum(d != c for d, c in got.items()) == 2
    same = np.full(5000, 77, np.int64)
    packed = ngram_join._packed([(same, np.arange(5000), np.full(5000, 3), np.full(5000, 2))], 16)
    assert max(len(x) // ngram_join.CELL for x in packed["packed"]) < 400
    frame = spark.createDataFrame(packed).withColumn("packed", F.col("packed").cast("binary"))
    assert frame.count() == 16 and ngram_join.shared_signatures(frame).select("node").distinct().count() == 5000
