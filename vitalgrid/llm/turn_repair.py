"""Repair of conversations by the cheapest edits, found by a Viterbi walk over chunks that run side by side.

A conversation's rows are taken by turn (null first; equal turns by role, the first 64 characters, then digest of the text). Rows are kept (K, free),
deleted (D, 4), given another role (R, 3) or preceded by inserted empty rows (I, 3 each), so that the role initials read `(s?(ua)+)?`. Blank rows and
rows whose role and text were seen before must go; rows that stay without a closing `.`, `!` or `?` cost 3 more. Of equally cheap audits
the ASCII-least counts.

The walk goes backward over four states (nothing yet, after s, after u, after a); a row maps the vector of costs still to come to the one before it.
Conversations are cut into chunks of `CHUNK` rows or `CHUNK_CHARS` characters, wherever a sorted partition ends:

1. every chunk starts from a speculative vector at its right end, that of a conversation's end, and walks left, keeping its vectors;
2. fix-up passes hand each chunk its right neighbour's left vector; it walks again until its vector differs from the kept one by a
   constant only, from where on all else stays; passes go on until no chunk's right vector changes. Vectors are kept less their
   minimum, so "by a constant only" is equality, and the constants add up to the cost;
3. each chunk traces the cheapest edits from all four states; its map of states is nearly always constant, so speculative entry states settle in the
   same manner; then the one right trace gives audit and repaired rows.

Passes are joins of small tables (vectors and symbols, no texts); only conversations of several chunks take part. No conversation is collected anywhere:
a chunk is bounded, and the hash over a long conversation is fed chunk by chunk in order.

Null roles and texts count as one space. Null ids are one conversation of their own, null turns come first. Equal rows are one entry with a number,
which is how any number of them travels. Texts of any length are whole. Without rows there are no conversations. Further
columns, also of clashing names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitalgrid.llm.common import cut_lineage, null_safe_join

CHUNK, CHUNK_CHARS = 4096, 1 << 22
BLANKS = " \t\n\x0b\x0c\r"
DELETE, REROLE, INSERT, UNFINISHED = 4, 3, 3, 3
#: States: nothing yet, after s, after u, after a. Where an initial leads from each; what an inserted or given role leads to.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
LEADS = {"s": {START: AFTER_S}, "u": {START: AFTER_U, AFTER_S: AFTER_U, AFTER_A: AFTER_U}, "a": {AFTER_U: AFTER_A}}
NEW_ROLE = {START: "user", AFTER_S: "user", AFTER_U: "assistant", AFTER_A: "user"}
NEW_STATE = {START: AFTER_U, AFTER_S: AFTER_U, AFTER_U: AFTER_A, AFTER_A: AFTER_U}
#: Costs of ending: after u an answer is inserted, after s a pair.
END = (0, 2 * INSERT, INSERT, 0)
#: Symbols: x must go; s, u, a, o (another initial) finished; their capitals unfinished.
MUST_GO = "x"


def damage(conversations: DataFrame) -> DataFrame:
    """The contract's damage: by crc32 of `conv_id:turn` modulo 20 rows are dropped, emptied, unfinished, repeated or given to the user."""
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    spelt = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    kind = F.crc32(spelt.cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", kind.alias("kind"), F.when(kind == 4, "user").otherwise(role).alias("role"),
                                F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"))
    return rows.where("kind <> 0").select("conv_id", "turn", "role", "text", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("_")).drop("_")


class Walk:
    """Steps over cost vectors and traces, remembered: there are few different vectors."""

    def __init__(self) -> None:
        self.steps: dict[tuple, tuple] = {}
        self.traces: dict[tuple, tuple] = {}

    @staticmethod
    def before(right: tuple, symbol: str) -> tuple:
        """Costs before a row, from those after it."""
        costs = [c + DELETE for c in right]
        if symbol != MUST_GO:
            extra = UNFINISHED * symbol.isupper()
            leads = LEADS.get(symbol.lower(), {})
            for q in range(4):
                costs[q] = min(costs[q], REROLE + extra + right[NEW_STATE[q]])
                if q in leads:
                    costs[q] = min(costs[q], extra + right[leads[q]])
        for _ in range(2):  # inserted rows before this one
            costs = [min(c, INSERT + costs[NEW_STATE[q]]) for q, c in enumerate(costs)]
        return tuple(costs)

    def step(self, right: tuple, symbol: str) -> tuple[tuple, int]:
        """(vector less its minimum, the minimum) before a row."""
        key = (right, symbol)
        if key not in self.steps:
            costs = self.before(right, symbol)
            least = min(costs)
            self.steps[key] = tuple(c - least for c in costs), least
        return self.steps[key]

    def trace(self, right: tuple, symbol: str, state: int) -> tuple[str, int]:
        """The least letters up to and with this row, and the state after it."""
        key = (right, symbol, state)
        if key not in self.traces:
            costs, letters, q = self.before(right, symbol), "", state
            extra, leads = UNFINISHED * symbol.isupper(), LEADS.get(symbol.lower(), {})
            while True:  # the letters in their order
                if costs[q] == DELETE + right[q]:
                    letters, after = letters + "D", q
                elif costs[q] == INSERT + costs[NEW_STATE[q]]:
                    letters, q = letters + "I", NEW_STATE[q]
                    continue
                elif symbol != MUST_GO and q in leads and costs[q] == extra + right[leads[q]]:
                    letters, after = letters + "K", leads[q]
                else:
                    letters, after = letters + "R", NEW_STATE[q]
                break
            self.traces[key] = letters, after
        return self.traces[key]

    def backward(self, symbols: str, right: tuple, kept: bytes | None = None) -> tuple[tuple, int, bytes]:
        """(left vector, constant, vectors after each row as bytes); of `kept` vectors, what differs by a constant only is taken over.

        The constant is that of the rows walked over; with `kept` it is of no use, and the last pass counts it anew.
        """
        trail, total = bytearray(4 * len(symbols)), 0
        for i in range(len(symbols) - 1, -1, -1):
            now = bytes(right)
            if kept is not None and kept[4 * i: 4 * i + 4] == now:
                trail[: 4 * i + 4] = kept[: 4 * i + 4]
                return self.step(tuple(kept[:4]), symbols[0])[0], total, bytes(trail)
            trail[4 * i: 4 * i + 4] = now
            right, least = self.step(right, symbols[i])
            total += least
        return right, total, bytes(trail)

    def forward(self, symbols: str, trail: bytes, state: int) -> tuple[list[str], int]:
        """Letters of each row, and the state at the end."""
        out = []
        for i, symbol in enumerate(symbols):
            letters, state = self.trace(tuple(trail[4 * i: 4 * i + 4]), symbol, state)
            out.append(letters)
        return out, state


def _entries(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv, turn, role, text, digest, copies, again) of distinct rows; `again` if role and text come at an earlier turn as well."""
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(role_col, F.lit(" ")).alias("role"),
                        F.coalesce(text_col, F.lit(" ")).alias("text"))
    entries = rows.groupBy("conv", "turn", "role", "text").agg(F.count("*").alias("copies")).withColumn("digest", F.sha2("text", 256))
    at = F.struct(F.col("turn").isNotNull().alias("there"), "turn")
    spread = rows.select("conv", "turn", "role", F.sha2("text", 256).alias("digest"))
    firsts = spread.groupBy("conv", "role", "digest").agg(F.min(at).alias("first"), F.max(at).alias("last")).where("first <> last").select("conv", "role", "digest", "first")
    return null_safe_join(entries, firsts, ["conv", "role", "digest"], "left").withColumn("again", F.col("first").isNotNull() & (F.col("first") != at)).drop("first")


def _symbol() -> Column:
    bare = F.rtrim("text", F.lit(BLANKS))
    initial = F.substring("role", 1, 1)
    known = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    ended = F.substring(bare, -1, 1).isin(".", "!", "?")
    return F.when(bare == "", "b").when(F.col("again"), "x").when(ended, known).otherwise(F.upper(known))


CHUNK_FIELDS = ("part int, chunk int, more boolean, symbols string, copies array<long>, roles array<string>, texts array<string>, turns array<long>, "
                "low long, high long, n_turns long, first_turn long, last_turn long, first_initial string, last_initial string, "
                "blank long, duplicate long, truncated long, illegal long")
LEGAL = {"su", "ua", "au"}


def chunks(turns: DataFrame, size: int = CHUNK, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Conversations in chunks, in order of (part, chunk); `more` if the conversation goes on in the part's next chunk."""
    entries = _entries(turns, conv_col, turn_col, role_col, text_col).withColumn("symbol", _symbol()).withColumn("head", F.substring("text", 1, 64))
    order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("head"), F.col("digest")]
    dealt = entries.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "turn", "role", "text", "symbol", "copies")

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[dict]:
        part, number, held, chars, conv = TaskContext.get().partitionId(), 0, [], 0, None

        def close(more: bool) -> dict:
            nonlocal number, held, chars
            turn, role, text, symbol, copies = zip(*held)
            turn = [None if pd.isna(t) else int(t) for t in turn]
            initials = [r[:1] for r in role]
            known = sorted({t for t in turn if t is not None})
            fault = lambda s: sum(n for c, n in zip(symbol, copies) if c == s)
            alone = sum(n - 1 for c, n in zip(symbol, copies) if c not in "bx")
            row = {"conv": conv, "part": part, "chunk": number, "more": more, "symbols": "".join("x" if c == "b" else c for c in symbol), "copies": list(copies),
                   "roles": list(role), "texts": list(text), "turns": turn, "low": known[0] if known else None, "high": known[-1] if known else None, "n_turns": len(known),
                   "first_turn": turn[0], "last_turn": turn[-1], "first_initial": initials[0], "last_initial": initials[-1],
                   "blank": fault("b"), "duplicate": fault("x") + alone, "truncated": sum(c.isupper() for c in symbol),
                   "illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:])) + sum(n - 1 for n in copies)}
            number, held, chars = number + 1, [], 0
            return row

        for batch in batches:
            keys = batch["conv"].astype(object).where(batch["conv"].notna(), None)
            for c, t, r, x, s, n in zip(keys, batch["turn"], batch["role"], batch["text"], batch["symbol"], batch["copies"]):
                if held and (c != conv or len(held) >= size or chars >= CHUNK_CHARS):
                    yield close(c == conv)
                conv = c
                held.append((t, r, x, s, int(n)))
                chars += len(x)
        if held:
            yield close(False)

    schema = f"conv {dealt.schema['conv'].dataType.simpleString()}, {CHUNK_FIELDS}"
    return dealt.mapInPandas(lambda batches: _joined(pack(batches)), schema)


def _joined(rows: Iterator[dict], most: int = 512, chars: int = 1 << 23) -> Iterator[pd.DataFrame]:
    """Rows as frames of bounded size."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(map(len, row["texts"]))
        if len(held) >= most or size >= chars:
            yield pd.DataFrame(held, dtype=object)
            held, size = [], 0
    if held:
        yield pd.DataFrame(held, dtype=object)


def links(cut: DataFrame) -> DataFrame:
    """(part, chunk, next_part, next_chunk) of chunks whose conversation goes on in the next one."""
    inside = cut.where("more").select("part", "chunk", F.col("part").alias("next_part"), (F.col("chunk") + 1).alias("next_chunk"))
    # One row per partition.
    ends = cut.groupBy("part").agg(F.max("chunk").alias("chunk"), F.min_by(F.struct("conv"), "chunk").alias("first"), F.max_by(F.struct("conv"), "chunk").alias("last"))
    w = Window.orderBy("part")
    ends = ends.select("part", "chunk", "last", F.lead("part").over(w).alias("next_part"), F.lead("first").over(w).alias("next_first"))
    across = ends.where(F.col("next_part").isNotNull() & F.col("last.conv").eqNullSafe(F.col("next_first.conv")))
    return inside.union(across.select("part", "chunk", "next_part", F.lit(0).alias("next_chunk")))


def _expanded(symbols: str, copies) -> list[tuple[str, int]]:
    """Symbols and the numbers of further equal rows after them, which must all go."""
    return list(zip(symbols, (int(n) - 1 for n in copies)))


VECTORS = "part int, chunk int, symbols string, right binary, left binary, trail binary, exits array<int>"


def _walk(rows: DataFrame, exits: bool = False) -> DataFrame:
    """Walks chunks (part, chunk, symbols, right, kept vectors) from their right vectors; `exits` also maps entry states to those at the end."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        walk = Walk()
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                left, _, trail = walk.backward(r.symbols, tuple(r.right), r.trail)
                ends = [walk.forward(r.symbols, trail, q)[1] for q in range(4)] if exits else None
                out.append((r.part, r.chunk, r.symbols, bytes(r.right), bytes(left), trail, ends))
            yield pd.DataFrame(out, columns=["part", "chunk", "symbols", "right", "left", "trail", "exits"])

    return rows.select("part", "chunk", "symbols", "right", "trail").mapInPandas(read, VECTORS)


def stitched(cut: DataFrame, tied: DataFrame) -> tuple[DataFrame, int]:
    """((part, chunk, right, entry) of the chunks in `tied`, passes): true right vectors and entry states after the fix-up passes."""
    ends = tied.select("part", "chunk").union(tied.select(F.col("next_part").alias("part"), F.col("next_chunk").alias("chunk"))).distinct()
    mine = cut.join(ends, ["part", "chunk"]).select("part", "chunk", "symbols", F.lit(bytearray(END)).alias("right"), F.lit(None).cast("binary").alias("trail"))
    walked, passes, stale = cut_lineage(_walk(mine), "speculative"), 0, True
    from_right = tied.withColumnRenamed("part", "_part").withColumnRenamed("chunk", "_chunk")
    while stale:
        lefts = walked.select(F.col("part").alias("next_part"), F.col("chunk").alias("next_chunk"), F.col("left").alias("given"))
        given = from_right.join(lefts, ["next_part", "next_chunk"]).select(F.col("_part").alias("part"), F.col("_chunk").alias("chunk"), "given")
        asked = walked.join(given, ["part", "chunk"], "left")
        asked = asked.withColumn("changed", F.col("given").isNotNull() & (F.col("given") != F.col("right")))
        again = _walk(asked.where("changed").select("part", "chunk", "symbols", F.col("given").alias("right"), "trail")).withColumn("changed", F.lit(True))
        after = cut_lineage(asked.where("NOT changed").select(*walked.columns, "changed").unionByName(again), "fix-up")
        stale = after.where("changed").limit(1).count() > 0
        walked, passes = after.drop("changed"), passes + 1
    # Traces from every state; entry states settle in the same manner.
    mapped = cut_lineage(_walk(walked, exits=True).select("part", "chunk", "right", "exits"), "exits")
    before = tied.select(F.col("next_part").alias("part"), F.col("next_chunk").alias("chunk"), F.col("part").alias("prior_part"), F.col("chunk").alias("prior_chunk"))
    placed = mapped.join(before, ["part", "chunk"], "left").withColumn("entry", F.when(F.col("prior_part").isNull(), START).otherwise(AFTER_A))
    placed, stale = cut_lineage(placed, "entries"), True
    while stale:
        ends = placed.select(F.col("part").alias("prior_part"), F.col("chunk").alias("prior_chunk"), F.get("exits", F.col("entry")).alias("given"))
        fresh = placed.join(ends, ["prior_part", "prior_chunk"], "left").withColumn("old", F.col("entry")).withColumn("entry", F.coalesce("given", "entry"))
        fresh = cut_lineage(fresh.select(*placed.columns, "old"), "entries")
        stale = fresh.where("entry <> old").limit(1).count() > 0
        placed, passes = fresh.drop("old"), passes + 1
    return placed.select("part", "chunk", "right", "entry"), passes


SOLVED = ("part int, chunk int, tied boolean, last boolean, cost long, audit string, roles array<string>, texts array<string>, repaired_turns array<long>, "
          "sha string, low long, high long, n_turns long, blank long, duplicate long, truncated long, illegal long")


def solved(cut: DataFrame, tied: DataFrame, known: DataFrame | None, rows: bool = True) -> DataFrame:
    """Every chunk with its audit, its share of the cost and its repaired rows (without `rows` only their hash, of conversations of one chunk)."""
    if known is None:
        asked = cut.withColumns({"right": F.lit(bytearray(END)), "entry": F.lit(START), "tied": F.lit(False), "last": F.lit(True), "same_turn": F.lit(False), "pair": F.lit(None).cast("string")})
    else:
        nexts = tied.select("part", "chunk", "next_part", "next_chunk")
        follows = cut.select(F.col("part").alias("next_part"), F.col("chunk").alias("next_chunk"), F.col("first_turn").alias("then_turn"), F.col("first_initial").alias("then_initial"))
        edges = known.join(nexts, ["part", "chunk"], "left").join(follows, ["next_part", "next_chunk"], "left").select(
            "part", "chunk", "right", "entry", F.lit(True).alias("tied"), F.col("next_part").isNull().alias("last"), "then_turn", "then_initial")
        asked = cut.join(edges, ["part", "chunk"], "left")
        asked = asked.withColumns({"right": F.coalesce("right", F.lit(bytearray(END))), "entry": F.coalesce("entry", F.lit(START)), "tied": F.coalesce("tied", F.lit(False)),
                                   "last": F.coalesce("last", F.lit(True)), "same_turn": F.coalesce(F.col("then_turn") == F.col("last_turn"), F.lit(False)),
                                   "pair": F.concat("last_initial", "then_initial")})

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        walk = Walk()
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                left, cost, trail = walk.backward(r.symbols, tuple(r.right))
                letters, state = walk.forward(r.symbols, trail, int(r.entry))
                if r.entry == START and r.first:
                    cost += left[START]
                audit, q = [], int(r.entry)
                roles, texts, turns = [], [], []
                for i, (part, (_, more)) in enumerate(zip(letters, _expanded(r.symbols, r.copies))):
                    for letter in part:
                        if letter == "K":
                            roles.append(r.roles[i])
                            q = LEADS[r.roles[i][:1]][q]
                        elif letter != "D":
                            roles.append(NEW_ROLE[q])
                            q = NEW_STATE[q]
                        if letter != "D":
                            texts.append("" if letter == "I" else r.texts[i])
                            turns.append(None if letter == "I" or pd.isna(r.turns[i]) else int(r.turns[i]))
                    audit.append(part + "D" * more)
                    cost += DELETE * more
                if r.last:
                    while state in (AFTER_S, AFTER_U):
                        audit.append("I")
                        roles.append(NEW_ROLE[state])
                        texts.append("")
                        turns.append(None)
                        state = NEW_STATE[state]
                lines = "\n".join(f"{a}:{b}" for a, b in zip(roles, texts))
                sha = None if r.tied else hashlib.sha256(lines.encode()).hexdigest()
                keep = (roles, texts, turns) if rows else (None, None, None)
                out.append((r.conv, r.part, r.chunk, r.tied, r.last, cost, "".join(audit), *keep, sha, r.low, r.high, r.n_turns - bool(r.same_turn), r.blank, r.duplicate,
                            r.truncated, r.illegal + (0 if r.pair is None else r.pair not in LEGAL)))
            yield pd.DataFrame(out, columns=names, dtype=object)

    names = ["conv", *[f.split()[0] for f in SOLVED.split(", ")]]
    first = F.lit(True)
    if known is not None:
        heads = tied.select(F.col("next_part").alias("part"), F.col("next_chunk").alias("chunk"), F.lit(False).alias("head"))
        asked = asked.join(heads, ["part", "chunk"], "left")
        first = F.coalesce("head", F.lit(True))
    asked = asked.withColumn("first", first).select(
        "conv", "part", "chunk", "tied", "last", "first", "symbols", "copies", "right", "entry", "roles", "texts", "turns", "same_turn", "pair", "low", "high", "n_turns",
        "blank", "duplicate", "truncated", "illegal")
    return asked.mapInPandas(read, f"conv {cut.schema['conv'].dataType.simpleString()}, {SOLVED}")


@dataclass(frozen=True)
class Repair:
    """Chunks of conversations, how they are tied, and what the fix-up passes found."""

    cut: DataFrame
    tied: DataFrame
    known: DataFrame | None
    passes: int

    def turns(self) -> DataFrame:
        """(conv, part, chunk, place, turn, role, text) of the repaired rows; order by part, chunk, place. Inserted rows have no turn."""
        rows = solved(self.cut, self.tied, self.known)
        zipped = F.arrays_zip(F.col("repaired_turns").alias("turn"), F.col("roles").alias("role"), F.col("texts").alias("text"))
        return rows.select("conv", "part", "chunk", F.posexplode(zipped).alias("place", "row")).select("conv", "part", "chunk", "place", "row.turn", "row.role", "row.text")

    def report(self) -> DataFrame:
        """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conversation."""
        rows = solved(self.cut, self.tied, self.known, rows=False)
        measures = [F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")]
        span = F.max("high") - F.min("low") + 1 - F.sum("n_turns")
        if self.known is None:
            return rows.select("conv", F.coalesce(F.col("high") - F.col("low") + 1 - F.col("n_turns"), F.lit(0)).alias("gaps"), "blank", "duplicate", "truncated", "illegal",
                               "cost", "audit", F.col("sha").alias("repaired_sha256"))
        audits = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "chunk", "audit"))), lambda c: c["audit"]), "")
        totals = rows.groupBy("conv").agg(F.coalesce(span, F.lit(0)).alias("gaps"), *measures, audits.alias("audit"), F.max("sha").alias("sha"))
        out = null_safe_join(totals, self.hashes(), ["conv"], "left")
        return out.withColumn("repaired_sha256", F.coalesce("sha", "whole")).drop("sha", "whole")

    def hashes(self) -> DataFrame:
        """(conv, whole) of conversations of several chunks: one hash each, fed in order."""
        rows = solved(self.cut.join(self.known.select("part", "chunk"), ["part", "chunk"], "left_semi").select(self.cut.columns), self.tied, self.known).where("tied")
        lines = rows.select("conv", "part", "chunk", F.array_join(F.zip_with("roles", "texts", lambda a, b: F.concat_ws(":", a, b)), "\n").alias("lines"))

        def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            conv, held, some = None, None, False
            for batch in batches:
                keys = batch["conv"].astype(object).where(batch["conv"].notna(), None)
                for c, text in zip(keys, batch["lines"]):
                    if held is not None and c != conv:
                        yield pd.DataFrame({"conv": pd.Series([conv], dtype=object), "whole": [held.hexdigest()]})
                        held = None
                    if held is None:
                        conv, held, some = c, hashlib.sha256(), False
                    if text:
                        held.update((("\n" if some else "") + text).encode())
                        some = True
            if held is not None:
                yield pd.DataFrame({"conv": pd.Series([conv], dtype=object), "whole": [held.hexdigest()]})

        dealt = lines.repartition("conv").sortWithinPartitions("conv", "part", "chunk")
        return dealt.mapInPandas(read, f"conv {self.cut.schema['conv'].dataType.simpleString()}, whole string")


def repair(turns: DataFrame, size: int = CHUNK, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> Repair:
    cut = cut_lineage(chunks(turns, size, conv_col, turn_col, role_col, text_col), "chunks")
    tied = cut_lineage(links(cut), "links")
    if not tied.limit(1).count():
        return Repair(cut, tied, None, 0)
    known, passes = stitched(cut, tied)
    return Repair(cut, tied, known, passes)


def with_all(conversations: DataFrame, report: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """The report with every conversation of the first table; those without rows have zeros, an empty audit and the hash of nothing."""
    every = conversations.select(F.col(conv_col).alias("conv")).distinct()
    out = null_safe_join(every, report, ["conv"], "left")
    zeros = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(F.col("conv").alias(conv_col), *zeros, F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
