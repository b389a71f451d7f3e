"""Benchmark decontamination with a positional inverted index, with DataFrame operations only.

1. Terms of the benchmark are counted over all documents.
2. Of each window (13 consecutive item words, or all words of a shorter item) the two rarest places become anchors.
3. The index holds the postings (term, document, position) of all anchor terms over all documents. A posting minus the
   anchor's place in its item is an alignment of item and document; lists are intersected by gathering, per alignment, the
   places that matched. Only windows with both anchors in place go on.
4. Those alignments are compared word by word with the document. Matches are exact; the index only says where to look.

Postings are spread by (document, item, alignment), rows without ids by their texts, so neither a frequent term nor a passage that many documents share meets
in one task. Benchmark tables are joined without hints: Spark broadcasts them below its size threshold and shuffles otherwise.

Null and empty texts have no words. Repeated documents give repeated rows; each row is compared with its own text,
rows with a null id too. Repeated benchmark rows count once; rows that share an item_id are one item with the windows of all its texts, and a null item_id is
the id "". Empty tables give no hits, or no rows. Columns other than ids and texts are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitalgrid.llm.common import PLAIN_WORD, cut_lineage, lower_ascii

WINDOW = 13


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(lower_ascii(text), F.lit(PLAIN_WORD), F.lit(1)), F.array().cast("array<string>"))


def item_words(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, item, tokens): distinct item texts with words; `item` tells texts of one id apart."""
    rows = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item_id"), words(F.col(text_col)).alias("tokens"))
    rows = rows.where(F.size("tokens") > 0).distinct()
    return rows.select("item_id", F.md5(F.concat_ws(" ", "item_id", F.array_join("tokens", " "))).alias("item"), "tokens")


def term_counts(docs: DataFrame, items: DataFrame, text_col: str = "text") -> DataFrame:
    """(term, n): how often each benchmark term occurs in all documents; absent terms are missing."""
    vocabulary = items.select(F.explode("tokens").alias("term")).distinct()
    seen = docs.select(F.explode(words(F.col(text_col))).alias("term"))
    return seen.join(vocabulary, "term", "left_semi").groupBy("term").agg(F.count("*").alias("n"))


def item_windows(items: DataFrame, counts: DataFrame, window: int = WINDOW, whole: bool = True) -> DataFrame:
    """(item, start, length, first, second): each window and its two rarest places; equal when it has one word.

    With `whole` windows with a word that no document has are left out, else only those words are.
    """
    places = items.select("item", F.size("tokens").alias("n_tokens"), F.posexplode("tokens").alias("place", "term"))
    rare = places.join(counts, "term", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    length = F.least(F.col("n_tokens"), F.lit(window))
    # A place lies in the windows that start at most length - 1 before it.
    starts = F.sequence(F.greatest(F.lit(0), F.col("place") - length + 1), F.least(F.col("place"), F.col("n_tokens") - length))
    inside = rare.select("item", "place", "n", length.alias("length"), F.explode(starts).alias("start"))
    # Rows of a (item, start) number at most `window`.
    gathered = inside.groupBy("item", "start", "length").agg(F.sort_array(F.collect_list(F.struct("n", "place"))).alias("by"))
    present = F.filter("by", lambda p: p["n"] > 0)
    if whole:
        gathered = gathered.where(F.size(present) == F.size("by"))
    else:
        gathered = gathered.withColumn("by", present).where(F.size("by") > 0)
    return gathered.select("item", "start", "length", F.element_at("by", 1)["place"].alias("first"),
                                          F.element_at("by", F.least(F.size("by"), F.lit(2)))["place"].alias("second"))


def mark(id_col: str, text_col: str) -> Column:
    """What tells rows without an id apart: a digest of their text. Rows with an id need none."""
    return F.when(F.col(id_col).isNull(), F.md5(F.coalesce(F.col(text_col), F.lit("")))).alias("mark")


def index(docs: DataFrame, terms: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Postings (term, doc_id, mark, pos) of the given terms over all documents; positions count from 0."""
    postings = docs.select(F.col(id_col).alias("doc_id"), mark(id_col, text_col), F.posexplode(words(F.col(text_col))).alias("pos", "term"))
    return postings.join(terms, "term", "left_semi").select("term", "doc_id", "mark", "pos")


def alignments(postings: DataFrame, items: DataFrame, windows: DataFrame) -> DataFrame:
    """(doc_id, mark, item, shift, spans): windows whose anchors all lie in place when the item is laid at `shift`."""
    anchors = windows.select("item", F.explode(F.array("first", "second")).alias("place")).distinct()
    placed = items.select("item", F.posexplode("tokens").alias("place", "term")).join(anchors, ["item", "place"])
    shifted = postings.join(placed, "term").select("doc_id", "mark", "item", (F.col("pos") - F.col("place")).alias("shift"), "place")
    met = shifted.groupBy("doc_id", "mark", "item", "shift").agg(F.collect_set("place").alias("met"))
    # Of the benchmark's size and staged, so that its size is known and a much-copied item can be split over tasks.
    wanted = cut_lineage(windows.groupBy("item").agg(F.collect_list(F.struct("start", "length", "first", "second")).alias("windows")), "item-windows")
    spans = F.filter("windows", lambda w: F.array_contains("met", w["first"]) & F.array_contains("met", w["second"]) & (w["start"] + F.col("shift") >= 0))
    spans = F.transform(spans, lambda w: F.struct(w["start"].alias("start"), w["length"].alias("length")))
    return met.join(wanted, "item").select("doc_id", "mark", "item", "shift", spans.alias("spans")).where(F.size("spans") > 0)


def phrase_matches(docs: DataFrame, found: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: kept columns, tokens and `matches` of (item_id, start, length), the windows found word for word."""
    named = found.join(items, "item").groupBy("doc_id", "mark").agg(F.collect_list(F.struct("item_id", "shift", "spans", F.col("tokens").alias("item_tokens"))).alias("laid"))
    rows = docs.select(F.col(id_col).alias("doc_id"), *keep, F.col(text_col).alias("_text"), mark(id_col, text_col).alias("_mark"))
    named = named.withColumnsRenamed({"doc_id": "_found", "mark": "_found_mark"})
    rows = rows.join(named, F.col("doc_id").eqNullSafe(F.col("_found")) & F.col("_mark").eqNullSafe(F.col("_found_mark")), "left").drop("_found", "_found_mark", "_mark")
    rows = rows.withColumn("tokens", words(F.col("_text"))).drop("_text")

    def same(place: Column, span: Column) -> Column:
        return F.slice("tokens", place["shift"] + span["start"] + 1, span["length"]) == F.slice(place["item_tokens"], span["start"] + 1, span["length"])

    def checked(place: Column) -> Column:
        return F.transform(F.filter(place["spans"], lambda s: same(place, s)),
                           lambda s: F.struct(place["item_id"].alias("item_id"), (place["shift"] + s["start"]).alias("start"), s["length"].alias("length")))

    return rows.withColumn("matches", F.when(F.col("laid").isNotNull(), F.flatten(F.transform("laid", checked)))).drop("laid")


def covered(matches: Column) -> Column:
    """Positions inside any of the spans."""
    spans = F.array_sort(F.array_distinct(F.transform(matches, lambda m: F.struct(m["start"].alias("start"), (m["start"] + m["length"]).alias("end")))))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    return F.aggregate(spans, zero, lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(a["end"], s["start"]))).cast("long").alias("n"),
                                                          F.greatest(a["end"], s["end"]).alias("end")), lambda a: a["n"])


def prepare(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """Items and the alignments of their windows with documents, as staged tables."""
    items = cut_lineage(item_words(benchmark), "items")
    counts = cut_lineage(term_counts(docs, items, text_col), "term-counts")
    windows = cut_lineage(item_windows(items, counts, window), "windows")
    anchors = windows.select("item", F.explode(F.array("first", "second")).alias("place")).distinct()
    terms = cut_lineage(items.select("item", F.posexplode("tokens").alias("place", "term")).join(anchors, ["item", "place"]).select("term").distinct(), "anchors")
    postings = cut_lineage(index(docs, terms, id_col, text_col), "postings")
    return items, cut_lineage(alignments(postings, items, windows), "alignments")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                  keep: tuple[str, ...] = (), share: int = 20) -> DataFrame:
    """(doc_id, kept columns, n_words, n_hit, n_items, items_sha256, contaminated): hit words are those inside a window's occurrence."""
    items, found = prepare(docs, benchmark, id_col, text_col, window)
    rows = phrase_matches(docs, found, items, id_col, text_col, keep)
    names = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["item_id"])))
    rows = rows.select("doc_id", *keep, F.size("tokens").cast("long").alias("n_words"), F.coalesce(covered(F.col("matches")), F.lit(0)).cast("long").alias("n_hit"),
                       F.coalesce(names, F.array().cast("array<string>")).alias("_names"))
    return rows.select("doc_id", *keep, "n_words", "n_hit", F.size("_names").cast("long").alias("n_items"), F.sha2(F.array_join("_names", ","), 256).alias("items_sha256"),
                       ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


def proximity_matches(docs: DataFrame, benchmark: DataFrame, slack: int = 3, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc_id, item_id, at, n_anchors): places where two or more anchors of an item lie within `slack` words of their distance.

    Postings are put into bands of `slack + 1` shifts; a band also takes the next band's postings, so no close pair is split.
    """
    items = cut_lineage(item_words(benchmark), "items")
    windows = cut_lineage(item_windows(items, cut_lineage(term_counts(docs, items, text_col), "term-counts"), window, whole=False), "windows")
    anchors = windows.select("item", F.explode(F.array("first", "second")).alias("place")).distinct()
    placed = items.select("item", "item_id", F.posexplode("tokens").alias("place", "term")).join(anchors, ["item", "place"])
    postings = index(docs, placed.select("term").distinct(), id_col, text_col)
    shifted = postings.join(placed, "term").select("doc_id", "item_id", "item", (F.col("pos") - F.col("place")).alias("shift"), "place")
    band = F.floor(F.col("shift") / (slack + 1))
    banded = shifted.select("*", F.explode(F.array(band, band - 1)).alias("band"))
    runs = banded.withColumn("near", F.size(F.collect_set("place").over(
        Window.partitionBy("doc_id", "item", "band").orderBy("shift").rangeBetween(0, slack))))
    return runs.where("near >= 2").groupBy("doc_id", "item_id", F.col("shift").alias("at")).agg(F.max("near").alias("n_anchors"))
