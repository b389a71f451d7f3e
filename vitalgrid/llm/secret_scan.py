"""Secret scans: fixed patterns, and a battery of randomness tests with control of false discoveries.

Candidates are runs of credential characters outside the base spans. The encoding (hex, base 32, base 36, base 62, base 64 and
its URL form) is the smallest alphabet that holds the run. Under the hypothesis that a run is drawn uniformly from its
alphabet, three tests give p-values: chi-squared of symbol counts (by its normal approximation in cube roots), runs above and
below the alphabet's middle, and serial correlation of neighbouring symbols. A run whose smallest p-value, times three, is
below `alpha` is not random.

Ordinary words pass such tests when short, so what is reported must also be unlikely as text: under the hypothesis of text,
the share of equal pairs among symbols is at least that of letters in words, and its spread shrinks with length; the normal
tail below the observed share is the discovery's p-value. False discoveries are controlled over all documents by the step-up
rule within each class of length: one aggregation over a grid of p-values finds, per class, the largest level whose expected
false share is below `rate`. The grid is counted down to whole steps, so the control is slightly stricter than the plain rule.

Base patterns are matched left to right without overlap, then short matches are dropped; a match that is too short still uses
up its text. Offsets are code points. Null and empty texts have no spans. Repeated rows count and are reported separately; a null id stays null.
Very long texts are scanned whole. An empty table gives no rows. Columns other than id and text are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitalgrid.llm.common import cut_lineage

#: The base patterns, and the least length of what they find (of group 2 for assign).
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]{24,}")
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"api_key", b"apikey")
MIN_ASSIGN, MIN_ACCESS = 6, 20
KINDS = ("assign", "access", "hex", "random")

CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])")
#: Alphabets in order of size; the first that holds a run is its encoding.
ALPHABETS = {
    "hex": "0123456789abcdef", "HEX": "0123456789ABCDEF", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz", "base62": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"}
_SETS = {k: frozenset(v) for k, v in ALPHABETS.items()}
_PLACES = {k: {c: i for i, c in enumerate(v)} for k, v in ALPHABETS.items()}
#: Share of equal pairs among the letters of ordinary words.
TEXT_PAIRS = 0.065
#: Level of the battery; rate of false discoveries; grid steps per power of ten of the p-values, and the last step.
ALPHA, RATE, STEPS, LAST = 0.01, 0.01, 4, 80


def tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def encoding(run: str) -> str | None:
    symbols = set(run)
    return next((name for name, held in _SETS.items() if symbols <= held), None)


def battery(run: str, name: str) -> tuple[float, float, float]:
    """p-values of uniformity, of runs and of serial correlation, under uniform draws."""
    places, k, n = _PLACES[name], len(ALPHABETS[name]), len(run)
    x = np.fromiter((places[c] for c in run), np.float64, n)
    counts = np.bincount(x.astype(np.int64), minlength=k)
    chi, free = float(((counts - n / k) ** 2).sum() * k / n), k - 1
    uniform = tail(((chi / free) ** (1 / 3) - 1 + 2 / (9 * free)) / math.sqrt(2 / (9 * free)))
    high = x >= k / 2
    ups = int(high.sum())
    downs = n - ups
    changes = 1 + int((high[1:] != high[:-1]).sum())
    mean = 1 + 2 * ups * downs / n
    spread = (mean - 1) * (mean - 2) / max(n - 1, 1)
    runs = 2 * tail(abs(changes - mean) / math.sqrt(spread)) if spread > 0 else 0.0
    centred = x - x.mean()
    power = float((centred ** 2).sum())
    serial = 2 * tail(abs(float((centred[1:] * centred[:-1]).sum()) / power + 1 / n) * math.sqrt(n)) if power > 0 else 0.0
    return uniform, runs, serial


def text_p(run: str) -> float:
    """How likely text has so few equal pairs of symbols; case and padding do not count."""
    counts = np.bincount(np.frombuffer(run.lower().encode(), np.uint8))
    n = int(counts.sum())
    pairs = n * (n - 1) / 2
    share = float((counts * (counts - 1.0)).sum()) / (n * (n - 1))
    return tail((TEXT_PAIRS - share) / math.sqrt(TEXT_PAIRS * (1 - TEXT_PAIRS) / pairs))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, in order."""
    out = []
    lowered = text.encode().lower()
    if any(k in lowered for k in KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_ASSIGN]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def random_spans(text: str, base: list[tuple[int, int, int]], alpha: float = ALPHA) -> Iterator[tuple[int, int, float]]:
    """(start, end, p-value as text) of runs outside the base spans that pass the battery."""
    i, reach = 0, 0
    for m in CANDIDATE.finditer(text):
        start, end = m.span()
        while i < len(base) and base[i][0] < end:
            reach = max(reach, base[i][2])
            i += 1
        run = m.group().rstrip("=")
        if reach > start or run.isalpha() and (run.islower() or run.isupper()) or run.isdigit():
            continue  # inside a base span, or one kind of character only, which is how words and numbers look
        name = encoding(run)
        if name is not None and 3 * min(battery(run, name)) >= alpha:
            yield start, end, text_p(run)


def length_class(n: int) -> int:
    return min(int(math.log2(n / 20) * 2), 12)


def scan(docs: DataFrame, alpha: float = ALPHA, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, found) per row: all base spans, and candidates with length class and p-value step."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bases, found = [], []
            for text in batch["text"]:
                base = base_spans(text)
                bases.append([{"start": s, "kind": k, "end": e} for s, k, e in base])
                found.append([{"start": s, "end": e, "length_class": length_class(e - s), "step": min(int(-math.log10(max(p, 1e-300)) * STEPS), LAST)}
                              for s, e, p in random_spans(text, base, alpha)])
            yield pd.DataFrame({"doc_id": batch["doc_id"], "base": bases, "found": found})

    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = docs.schema[id_col].dataType
    return rows.mapInPandas(read, "doc_id string, base array<struct<start: int, kind: int, end: int>>, "
                                  "found array<struct<start: int, end: int, length_class: int, step: int>>").withColumn("doc_id", F.col("doc_id").cast(kind))


def levels(scanned: DataFrame, rate: float = RATE) -> DataFrame:
    """(length_class, least_step): the step-up rule over all candidates of a class; classes without discoveries are missing."""
    counted = scanned.select(F.explode("found").alias("c")).groupBy("c.length_class", "c.step").agg(F.count("*").alias("n"))
    by_class = Window.partitionBy("length_class")
    down = by_class.orderBy(F.desc("step"))
    graded = counted.select("length_class", "step", F.sum("n").over(down).alias("below"), F.sum("n").over(by_class).alias("all"))
    # At most LAST + 1 steps a class. A step's p-values are below 10 ** (-step / STEPS).
    kept = graded.where(F.pow(F.lit(10.0), -F.col("step") / STEPS) * F.col("all") <= rate * F.col("below"))
    return kept.groupBy("length_class").agg(F.min("step").alias("least_step"))


def find_secrets(docs: DataFrame, alpha: float = ALPHA, rate: float = RATE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random) of each row."""
    scanned = cut_lineage(scan(docs, alpha, id_col, text_col), "scanned")
    level = cut_lineage(levels(scanned, rate), "levels")
    # At most one row per length class, of which there are 13: one map for all rows.
    least = F.map_from_entries(F.collect_list(F.struct("length_class", "least_step")))
    rows = scanned.crossJoin(F.broadcast(level.agg(least.alias("least"))))
    kept = F.filter("found", lambda c: c["step"] >= F.coalesce(F.element_at("least", c["length_class"]), F.lit(LAST + 1)))
    extra = F.transform(kept, lambda c: F.struct(c["start"].alias("start"), F.lit(3).alias("kind"), c["end"].alias("end")))

    def named(spans):
        names = F.array(*[F.lit(k) for k in KINDS])
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: int):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    return rows.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(named(F.col("base")), 256).alias("base_sha256"),
                       named(F.array_sort(F.concat("base", extra))).alias("spans"), F.size(kept).cast("long").alias("n_random"))
