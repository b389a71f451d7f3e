"""N-gram Jaccard self-join: documents whose sets of word shingles have a Jaccard similarity of at least `PERCENT` per cent.

1. Each text becomes a set of 64-bit shingle hashes. Texts with equal sets are one class; its node is its smallest id.
2. Sets that may be linked differ in at most d elements, d known from their sizes. Shingles are dealt into d + e parts by hash:
   two linked sets agree in at least e parts. A part's signature is the sum of its mixed hashes. A set of whose parts fewer than e are
   shared with any other set (empty ones count as shared) is linked with nothing and leaves, which few common passages do not
   prevent. The others' nodes with a common signature are then tied to the smallest of them, which takes one edge
   per node, however many share it. No linked pair is lost: sizes fall into classes as wide as the threshold, and a set signs
   for its own class and, if a smaller partner may be there, for the class below. Empty parts sign only for sets that have at least e of them.
   Signatures are shuffled once, packed by the bucket they fall into; those that come once go no further.
3. Connected nodes form families. Only families' texts are read again (a Bloom filter of fixed size stands before the join).
4. Within a family the sets are put into one global order, which makes a trie: sets in lexicographic order are its paths, and
   the longest common prefix of neighbours its branches. A walk keeps, per trie node, the overlaps of the path so far with all sets of the
   block; sets with a common prefix share that work. A path, or a whole subtree, is left when what remains of it cannot lift any
   overlap to the threshold for a pair that is not connected yet.
5. Links are exact; those that connect what was not connected give the components.

A family too large for one block is split: first every block meets the family's first node, which settles all its near copies
in linear work; only sets that stayed apart then meet the other blocks.

Null and empty texts have no set and are linked with nothing, their component is their own id. Texts with fewer words than a shingle have
one shingle. Rows that share an id are in one component. Null ids take no part, their component is null. Repeated rows give
repeated rows. An empty table gives no rows. Ids are whole numbers; only id and text are read, further columns stay away.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalgrid.llm.common import cut_lineage, discard
from vitalgrid.llm.components import components

WORDS, PERCENT = 3, 90
#: Words a worker remembers; elements and sets of a block; bits of the Bloom filters.
MEMORY, BLOCK, SETS, BLOOM_BITS = 400_000, 1 << 21, 4096, 1 << 25
#: Signatures a task holds before it deals them out, those of a bucket as estimated, the least number of buckets, bytes of a packed signature.
HELD, BUCKET, BUCKETS, CELL = 1 << 19, 1 << 18, 256, 20
#: Bits of a page of a filter; fixed by Spark's bitmap functions.
PAGE = 1 << 15
_U = np.uint64
#: Signatures keep 48 bits: chance agreements only let a set pass for a candidate, and those of 10^13 signatures are a twentieth of any set's.
SHORT = _U(16)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads bits."""
    x = (x ^ (x >> _U(31))) * _U(0x7FB5D329728EA185)
    x = (x ^ (x >> _U(27))) * _U(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U(33))


class Hashes(dict):
    """Words' hashes, worked out when first asked for."""

    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


class Shingler:
    """Sets of shingle hashes of many texts at once."""

    def __init__(self, words: int = WORDS) -> None:
        self.words, self.known = words, Hashes()

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct hashes of all texts, one text after another, and where each begins."""
        split = [t.encode().lower().split() for t in texts]
        if len(self.known) > MEMORY:
            self.known.clear()
        lengths = np.array([len(s) for s in split], np.int64)
        flat = np.fromiter(map(self.known.__getitem__, chain.from_iterable(split)), _U, int(lengths.sum()))
        starts = np.concatenate([[0], np.cumsum(lengths)])
        k = self.words
        owner = np.repeat(np.arange(len(texts)), lengths)
        hashes = np.zeros(len(flat), _U)
        for j in range(k):
            shifted = flat[j:] if j else flat
            hashes[: len(shifted)] = mix(hashes[: len(shifted)] + shifted + _U(j + 1))
        left = starts[owner + 1] - np.arange(len(flat))  # words from here to the text's end
        whole = left >= k
        for i in np.flatnonzero((lengths > 0) & (lengths < k)):
            h = np.array([len(split[i])], _U)
            for x in flat[starts[i]: starts[i + 1]]:
                h = mix(h + x)
            hashes[starts[i]], whole[starts[i]] = h[0], True
        owner, hashes = owner[whole], hashes[whole]
        order = np.lexsort((hashes, owner))
        owner, hashes = owner[order], hashes[order]
        new = np.ones(len(hashes), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
        owner, hashes = owner[new], hashes[new]
        return hashes, np.searchsorted(owner, np.arange(len(texts) + 1))


@lru_cache(maxsize=None)
def size_classes(percent: int) -> np.ndarray:
    """Lower bounds of the classes; the first has sizes at which linked sets are equal. Partners are in one class or in neighbours."""
    bounds = [1, next(n for n in range(1, 10_000) if max_difference(n, percent))]
    while bounds[-1] < 1 << 40:
        bounds.append(max(bounds[-1] + 1, -(-bounds[-1] * 100 // percent)))
    return np.array(bounds, np.int64)


@lru_cache(maxsize=None)
def max_difference(small: int, percent: int) -> int:
    """Most elements by which a set and one of at least its size, `small`, may differ when linked."""
    large = small * 100 // percent
    return max(a + small - 2 * -(-percent * (a + small) // (100 + percent)) for a in range(max(small, large - 20), large + 1))


def spare(difference: int) -> int:
    """Parts beyond the greatest difference; linked sets agree in as many."""
    return 2 + difference // 4


@dataclass
class Signed:
    """Signatures of many sets: whose, for which class, and how many shared ones that set needs there to be linked with any other."""

    of: np.ndarray
    level: np.ndarray
    need: np.ndarray
    signature: np.ndarray


def signatures(hashes: np.ndarray, starts: np.ndarray, percent: int = PERCENT) -> Signed:
    """Signatures of all sets; none for sets that only equal ones can be linked with."""
    bounds = size_classes(percent)
    sizes = np.diff(starts)
    own = np.searchsorted(bounds, sizes, "right") - 1
    out: list[tuple[np.ndarray, ...]] = []
    mixed = mix(hashes + _U(0x5851F42D4C957F2D))
    for below in (0, 1):
        level = own - below
        # A set signs below its class only if a partner of that class can be large enough.
        signs = (level >= 1) & ((below == 0) | (sizes * percent <= 100 * (bounds[np.maximum(own, 1)] - 1)))
        who = np.flatnonzero(signs)
        if not len(who):
            continue
        most = {c: max(max_difference(int(s), percent) for s in range(max(1, int(bounds[c + 1]) - 24), int(bounds[c + 1]))) for c in set(level[who].tolist())}
        parts, extra = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        extra[who] = [spare(most[c]) for c in level[who].tolist()]
        parts[who] = [most[c] + spare(most[c]) for c in level[who].tolist()]
        begin = np.concatenate([[0], np.cumsum(parts)])
        owner = np.repeat(np.arange(len(sizes)), sizes)
        use = signs[owner]
        cell = begin[owner[use]] + (hashes[use] % parts[owner[use]].astype(_U)).astype(np.int64)
        sums, held = np.zeros(int(begin[-1]), _U), np.bincount(cell, minlength=int(begin[-1]))
        np.add.at(sums, cell, mixed[use])
        of = np.repeat(np.arange(len(sizes)), parts)
        part = np.arange(len(sums)) - begin[of]
        named = mix(sums + mix((level[of] * 1_000_003 + part).astype(_U))) >> SHORT
        empties = np.bincount(of[held == 0], minlength=len(sizes))
        many = empties >= extra  # empties sign, and count like any other part
        need = np.where(many, extra, extra - empties)
        wanted = (held > 0) | many[of]
        of = of[wanted]
        out.append((of, level[of], need[of], named[wanted].view(np.int64)))
    if not out:
        return Signed(*[np.zeros(0, np.int64)] * 4)
    return Signed(*[np.concatenate(x) for x in zip(*out)])


# --- the walk over the trie ---------------------------------------------------------------------------------------------------

class Groups:
    """Union-find over the sets of a block."""

    def __init__(self, n: int) -> None:
        self.up = np.arange(n)

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return int(i)

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)
        return i != j

    def labels(self) -> np.ndarray:
        up = self.up
        while not np.array_equal(up, up[up]):
            up = up[up]
        self.up = up
        return up


def trie_links(sets: list[np.ndarray], groups: Groups, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links that connect sets not connected in `groups`, which is updated."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets])
    values, coded = np.unique(np.concatenate(sets), return_inverse=True)
    counts = np.bincount(coded)
    rank = np.empty(len(values), np.int64)
    rank[np.argsort(-counts, kind="stable")] = np.arange(len(values))  # frequent first: long common prefixes
    ranked = rank[coded]
    cuts = np.concatenate([[0], np.cumsum(sizes)])
    paths = [np.sort(ranked[cuts[i]: cuts[i + 1]]) for i in range(m)]
    order = sorted(range(m), key=lambda i: paths[i].tolist())
    by = np.argsort(ranked, kind="stable")
    holders = np.repeat(np.arange(m), sizes)[by]
    first = np.searchsorted(ranked[by], np.arange(len(values) + 1))
    # Sets whose every element is theirs alone cannot be linked; others' tails of such elements add nothing.
    common = np.zeros(m + 1, np.int64)
    for k in range(1, m):
        a, b = paths[order[k - 1]], paths[order[k]]
        n = min(len(a), len(b))
        off = np.flatnonzero(a[:n] != b[:n])
        common[k] = off[0] if len(off) else n
    found: list[tuple[int, int]] = []
    need = lambda n: -(-percent * (n + sizes) // (100 + percent))

    def viable(overlap: np.ndarray, depth: int, least: int, most: int) -> np.ndarray:
        """Sets that a path of `least` to `most` elements may still be linked with after `depth` of them."""
        return (overlap + (most - depth) >= need(least)) & (sizes * percent <= 100 * most) & (least * percent <= 100 * sizes)

    stack: list[tuple[int, np.ndarray]] = [(0, np.zeros(m, np.int64))]
    k = 0
    while k < m:
        i = order[k]
        path = paths[i]
        while stack[-1][0] > common[k]:
            stack.pop()
        depth, overlap = stack[-1]
        overlap = overlap.copy()
        # The branch that the next set shares; at it the whole subtree may be left.
        branch = int(common[k + 1])
        stops = sorted({s for s in (branch, (depth + len(path)) // 2, len(path) - len(path) // 8, len(path)) if s > depth})
        left = False
        for stop in stops:
            tokens = path[depth:stop]
            spans = [holders[first[t]: first[t + 1]] for t in tokens]
            overlap += np.bincount(np.concatenate(spans), minlength=m)
            depth = stop
            labels = groups.labels()
            if stop == branch and branch > common[k]:
                end = k + 1
                while end < m and common[end] >= branch:
                    end += 1
                inside = np.array(order[k:end])
                may = viable(overlap, depth, int(sizes[inside].min()), int(sizes[inside].max()))
                if len(set(labels[inside].tolist())) == 1 and not np.any(may & (labels != labels[i])):
                    k, left = end, True
                    break
                stack.append((depth, overlap.copy()))
            if stop < len(path) and not np.any(viable(overlap, depth, len(path), len(path)) & (labels != labels[i])):
                if stop >= branch:
                    k, left = k + 1, True
                    break
        if left:
            continue
        labels = groups.labels()
        linked = np.flatnonzero((100 * overlap >= percent * (len(path) + sizes - overlap)) & (labels != labels[i]))
        for j in linked.tolist():
            if groups.join(i, j):
                found.append((i, j))
        k += 1
    return found


# --- jobs ---------------------------------------------------------------------------------------------------------------------

def shingle_sets(docs: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, digest) of each row."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler(words)
        for batch in batches:
            for s in range(0, len(batch), 256):
                part = batch.iloc[s: s + 256]
                hashes, starts = shingler(part["text"].tolist())
                digests = [hashlib.blake2b(hashes[a:b].tobytes(), digest_size=16).digest() if b > a else None for a, b in zip(starts, starts[1:])]
                yield pd.DataFrame({"doc_id": part["doc_id"].array, "n_shingles": np.diff(starts), "digest": digests})

    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInPandas(read, "doc_id string, n_shingles long, digest binary").withColumn("doc_id", F.col("doc_id").cast("long"))


def _places(key: Column, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(j)), F.lit(bits)) for j in (0, 1)]


def _filter(bits: DataFrame) -> np.ndarray:
    """Bytes of a Bloom filter, from its set bits (bit); collected as a bounded number of bitmaps.

    Its size is fixed; a full filter lets all through, and what it guards stays exact.
    """
    parts = bits.groupBy((F.col("bit") / PAGE).cast("int").alias("page")).agg(F.bitmap_construct_agg(F.col("bit") % PAGE).alias("bits"))
    out = np.zeros(BLOOM_BITS // 8, np.uint8)
    for r in parts.collect():
        at = r["page"] * PAGE // 8
        out[at: at + PAGE // 8] = np.frombuffer(r["bits"], np.uint8)
    return out


def _bloom(keys: DataFrame, column: str) -> np.ndarray:
    """The filter of a column's values, with two bits each."""
    return _filter(keys.select(F.explode(F.array(*_places(F.col(column), BLOOM_BITS))).alias("bit")))


def _held(bloom: np.ndarray, *places: np.ndarray) -> np.ndarray:
    sure = np.ones(len(places[0]), bool)
    for at in places:
        sure &= (bloom[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
    return sure


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, bit0, bit1) of rows with an id."""
    doc = F.col(id_col).cast("long")
    bits = [c.alias(f"bit{j}") for j, c in enumerate(_places(doc, BLOOM_BITS))]
    return docs.where(doc.isNotNull()).select(doc.alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *bits)


def _packed(held: list[tuple[np.ndarray, ...]], buckets: int) -> pd.DataFrame:
    """(bucket, packed) of some sets' signatures: equal signatures share a bucket, and a bucket's entries become one text of bytes.

    Of a signature that comes several times here one entry goes to that bucket; the others, known to be shared already, are dealt out evenly.
    Their need is negative, so a signature that very many sets have fills no bucket.
    """
    signature, node, level, need = (np.concatenate(x) for x in zip(*held))
    order = np.argsort(signature, kind="stable")
    signature, node, level, need = signature[order], node[order], level[order], need[order]
    again = np.zeros(len(signature), bool)
    again[1:] = signature[1:] == signature[:-1]
    known = again.copy()
    known[:-1] |= again[1:]
    bucket = signature % buckets
    bucket[again] = np.arange(int(again.sum())) % buckets
    cells = np.empty((len(signature), CELL), np.uint8)  # bytes of equal weight stand together in a text, which compresses them
    for at, width, values in ((0, 6, signature), (6, 8, node), (14, 2, level), (16, 4, np.where(known, -need, need))):
        cells[:, at: at + width] = np.ascontiguousarray(values, "<i8").view(np.uint8).reshape(-1, 8)[:, :width]
    by = np.argsort(bucket, kind="stable")
    cells, names = cells[by], bucket[by]
    cuts = np.flatnonzero(np.diff(names)) + 1
    spans = list(zip([0, *cuts.tolist()], [*cuts.tolist(), len(names)]))
    return pd.DataFrame({"bucket": [names[a] for a, _ in spans], "packed": [cells[a:b].T.tobytes() for a, b in spans]})


def _unpacked(packed: list[bytes]) -> tuple[np.ndarray, ...]:
    """Signatures, nodes, levels and needs of `_packed` texts."""
    cells = np.concatenate([np.frombuffer(x, np.uint8).reshape(CELL, -1) for x in packed], axis=1)

    def whole(at: int, width: int) -> np.ndarray:
        out = np.zeros((cells.shape[1], 8), np.uint8)
        out[:, :width] = cells[at: at + width].T
        return out.view("<i8").ravel()

    return whole(0, 6), whole(6, 8), whole(14, 2), whole(16, 4).astype(np.int32).astype(np.int64)


def packed_signatures(docs: DataFrame, nodes: np.ndarray, buckets: int, words: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(bucket, packed): signatures of rows that the filter `nodes` holds, see `_packed`."""
    sent = docs.sparkSession.sparkContext.broadcast(nodes)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler, mine, held, n = Shingler(words), sent.value, [], 0
        for batch in batches:
            part = batch[_held(mine, batch["bit0"].to_numpy(np.int64), batch["bit1"].to_numpy(np.int64))]
            for s in range(0, len(part), 256):
                some = part.iloc[s: s + 256]
                signed = signatures(*shingler(some["text"].tolist()), percent)
                held.append((signed.signature, some["id"].to_numpy(np.int64)[signed.of], signed.level, signed.need))
                n += len(signed.of)
                if n >= HELD:
                    yield _packed(held, buckets)
                    held, n = [], 0
        if n:
            yield _packed(held, buckets)

    return _texts(docs, id_col, text_col).mapInPandas(read, "bucket long, packed binary")


def shared_signatures(packed: DataFrame) -> DataFrame:
    """(node, level, need, signature) of all signatures that come more than once."""

    def meet(bucket: pd.DataFrame) -> pd.DataFrame:
        signature, node, level, need = _unpacked(bucket["packed"].tolist())
        order = np.argsort(signature, kind="stable")
        same = np.diff(signature[order]) == 0
        shared = need < 0
        shared[order[1:][same]] = True
        shared[order[:-1][same]] = True
        return pd.DataFrame({"node": node[shared], "level": level[shared], "need": np.abs(need[shared]), "signature": signature[shared]})

    return packed.groupBy("bucket").applyInPandas(meet, "node long, level long, need long, signature long")


def candidate_families(docs: DataFrame, nodes: DataFrame, shingles: int, words: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(node, family) of nodes that may be linked with others, by signatures. `shingles`, of all rows, says how many buckets there are."""
    mine = _bloom(nodes, "node")
    buckets = max(BUCKETS, shingles * 2 * (100 - percent) // 100 // BUCKET)
    rows = cut_lineage(shared_signatures(packed_signatures(docs, mine, buckets, words, percent, id_col, text_col)), "signed")
    counts = rows.groupBy("node", "level").agg(F.count("*").alias("n"), F.min("need").alias("least"))
    stay = cut_lineage(counts.where("n >= least").select("node", "level"), "staying")
    staying = rows.join(stay, ["node", "level"], "left_semi").select("signature", "node")
    first = staying.groupBy("signature").agg(F.min("node").alias("first"))
    stars = staying.join(first, "signature").where("node > first").select(F.col("node").alias("a"), F.col("first").alias("b"))
    families = cut_lineage(components(stars).withColumnRenamed("component", "family"), "families")
    discard(rows, stay)
    return families


def family_sets(docs: DataFrame, families: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """(family, node, hashes) of every family member's sets, repeated rows included. Rows that cannot be members are left out before the join."""
    bloom = docs.sparkSession.sparkContext.broadcast(_bloom(families, "node"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler, held = Shingler(words), bloom.value
        for batch in batches:
            part = batch[_held(held, batch["bit0"].to_numpy(np.int64), batch["bit1"].to_numpy(np.int64))]
            for s in range(0, len(part), 256):
                some = part.iloc[s: s + 256]
                hashes, starts = shingler(some["text"].tolist())
                yield pd.DataFrame({"id": some["id"].array, "hashes": [hashes[a:b].tobytes() for a, b in zip(starts, starts[1:])]})

    sets = _texts(docs, id_col, text_col).mapInPandas(read, "id long, hashes binary").where(F.length("hashes") > 0)
    return sets.join(families, F.col("id") == F.col("node")).select("family", "node", "hashes")


def _by_key(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Runs of equal keys in sorted rows."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if batch.empty:
            continue
        change = np.flatnonzero((batch[keys].iloc[1:].to_numpy() != batch[keys].iloc[:-1].to_numpy()).any(axis=1)) + 1
        pieces = [batch.iloc[a:b] for a, b in zip([0, *change], [*change, len(batch)])]
        if held and (pieces[0][keys].iloc[0] != held[-1][keys].iloc[0]).any():
            yield pd.concat(held)
            held = []
        held.append(pieces[0])
        for piece in pieces[1:]:
            yield pd.concat(held)
            held = [piece]
    if held:
        yield pd.concat(held)


def _once(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Sorted rows without those that repeat the row before, however many there are."""
    last = None
    for batch in batches:
        if batch.empty:
            continue
        told = batch[[*keys, "node", "hashes"]]
        fresh = (told != told.shift()).any(axis=1)
        fresh.iloc[0] = last is None or tuple(told.iloc[0]) != last
        last = tuple(told.iloc[-1])
        yield batch[fresh]


def _linked(rows: DataFrame, keys: list[str], percent: int) -> DataFrame:
    """(a, b): new links within each key. Members with equal `settled` are connected already."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in _by_key(_once(batches, keys), keys):
            nodes = group["node"].to_numpy()
            groups, seen = Groups(len(group)), {}
            for i, s in enumerate(group["settled"]):
                if not pd.isna(s):
                    groups.join(i, seen.setdefault(s, i))
            links = trie_links([np.frombuffer(h, _U) for h in group["hashes"]], groups, percent)
            yield pd.DataFrame({"a": [nodes[i] for i, _ in links], "b": [nodes[j] for _, j in links]}, dtype=np.int64)

    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, "node", "hashes")
    return dealt.select(*keys, "node", F.col("settled").cast("double").alias("settled"), "hashes").mapInPandas(read, "a long, b long")


def exact_links(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, b): links enough to connect what is connected, each of them exact."""
    sets = sets.withColumn("n", (F.length("hashes") / 8).cast("long"))
    members = sets.groupBy("family", "node", "n").agg(F.lit(1).alias("one"))  # repeated rows count once
    loads = members.groupBy("family").agg(F.ceil(F.greatest(F.sum("n") / BLOCK, F.count("*") / SETS)).alias("blocks"), F.min("node").alias("pivot"))
    dealt = sets.join(cut_lineage(loads, "loads"), "family").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    none = F.lit(None).cast("long").alias("settled")
    inside = dealt.select("family", "block", "node", "hashes", none)
    # The first node of a split family meets every block of it.
    pivots = dealt.where("node = pivot AND blocks > 1").select("family", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "node", "hashes", none)
    links = cut_lineage(_linked(inside.union(pivots), ["family", "block"], percent), "links")
    large = dealt.where("blocks > 1")
    if not large.limit(1).count():
        return links
    known = components(links)
    large = large.join(known, "node", "left").withColumn("settled", F.coalesce("component", "node")).drop("component")
    main = known.withColumnRenamed("node", "_node").withColumnRenamed("component", "main")
    large = large.join(main, F.col("pivot") == F.col("_node"), "left").drop("_node").withColumn("apart", ~F.col("settled").eqNullSafe(F.coalesce("main", "pivot")))
    large = cut_lineage(large, "settled")
    # Sets apart from the family's main part, in blocks of their own, meet every block.
    apart = large.where("apart").groupBy("family").agg(F.ceil(F.sum("n") / BLOCK).alias("apart_blocks"))
    there = large.join(apart, "family")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    one = there.select("family", "block", every("apart_blocks").alias("against"), "node", "hashes", "settled")
    other = there.where("apart").select("family", every("blocks").alias("block"), F.pmod(F.xxhash64("node"), F.col("apart_blocks")).alias("against"), "node", "hashes", "settled")
    return links.union(_linked(one.union(other), ["family", "block", "against"], percent))


def join(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row."""
    rows = cut_lineage(shingle_sets(docs, words, id_col, text_col), "shingle-sets")
    filled = rows.where("doc_id IS NOT NULL AND digest IS NOT NULL")
    classes = cut_lineage(filled.groupBy("digest").agg(F.min("doc_id").alias("node")), "classes")
    shingles = filled.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
    families = candidate_families(docs, classes, shingles, words, percent, id_col, text_col)
    sets = cut_lineage(family_sets(docs, families, words, id_col, text_col), "family-sets")
    links = cut_lineage(exact_links(sets, percent), "all-links")
    discard(sets, families)
    member = filled.select("doc_id", "digest").join(classes.select("digest", "node"), "digest")
    same_id = member.groupBy("doc_id").agg(F.min("node").alias("b"), F.max("node").alias("a")).where("a > b").select("a", "b")
    many = member.where("doc_id <> node").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    final = components(links.union(same_id).union(many)).withColumnRenamed("node", "_node")
    out = rows.join(final, (F.col("doc_id") == F.col("_node")) & F.col("digest").isNotNull(), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
