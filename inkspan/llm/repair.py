"""Conversation structure repair by weighted finite-state composition.

A conversation is an input acceptor, a chain with one symbol a row.  An edit
transducer keeps, reroles or deletes each row or inserts turns, and a grammar
acceptor allows the roles ``(s?(ua)+)?``.  The three are composed lazily: only
states that are reached exist.  The result is the shortest path in topological order
over weights (cost, labels), compared as pairs; labels are the edits' initials.

Such weights may be cut and put together again: an arc that reads no row costs
something, so two label strings of equal cost between the same two states are never
one the beginning of the other, and what follows can't change their order.  So blocks of
up to 512 rows are solved apart, from each grammar state to each, and a conversation's
blocks are multiplied in order.  Rows get their places from a sort by ranges, so a
conversation with a third of all rows is shared out; only its digest, which is one
sequence by nature, is made by one task, row by row in bounded memory.

Defined results: null roles and texts are one space; rows without a turn come first;
rows with the same turn go by role, then by their texts' md5; repeated rows are
duplicates but for the first; a null conv_id is a conversation; a role counts by its
first character, whatever follows; long texts count whole; other columns go, whatever
their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NOT_WORD_BREAK, cut

#: The grammar (s?(ua)+)? as states and moves by role; the path ends in a final state.
START, SYSTEM, USER, ASSISTANT = STATES = range(4)
MOVES = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
FINAL = (START, ASSISTANT)
#: Costs of the edits, and what an undeleted truncated row adds.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
ROLES = {"u": "user", "a": "assistant"}
#: Insertions in a row beyond which the grammar is back in a state it was in: more never pay.
MOST_INSERTED = 2
BLOCK_BITS = 9

Weight = tuple[int, str]


def edits(symbol: str) -> Iterator[tuple[str, str | None, int]]:
    """The transducer's arcs that read a symbol: (label, role written or None, cost).
    x must be deleted, a capital is truncated, o is a role outside the grammar."""
    yield "D", None, DELETE
    if symbol != "x":
        more = TRUNCATED if symbol.isupper() else 0
        yield "K", symbol.lower(), KEEP + more
        for role in ROLES:
            yield "R", role, REROLE + more


def insertions(inserted: int) -> Iterator[tuple[str, str, int]]:
    """The transducer's arcs that read nothing."""
    if inserted < MOST_INSERTED:
        for role in ROLES:
            yield "I", role, INSERT


def shortest(symbols: str, entry: int) -> dict[int, Weight]:
    """The least weight from a grammar state to each reachable one over the symbols.

    States of the composition are (rows read, insertions since, grammar state);
    in that order every arc goes forward."""
    layer: dict[tuple[int, int], Weight] = {(0, entry): (0, "")}

    def relax(to: dict, state: tuple[int, int], weight: Weight) -> None:
        if state not in to or weight < to[state]:
            to[state] = weight

    for at in range(len(symbols) + 1):
        for inserted in range(MOST_INSERTED):
            for (_, state), (cost, labels) in [x for x in layer.items() if x[0][0] == inserted]:
                for label, role, price in insertions(inserted):
                    if (state, role) in MOVES:
                        relax(layer, (inserted + 1, MOVES[state, role]), (cost + price, labels + label))
        if at == len(symbols):
            break
        read: dict[tuple[int, int], Weight] = {}
        for (_, state), (cost, labels) in layer.items():
            for label, role, price in edits(symbols[at]):
                if role is None or (state, role) in MOVES:
                    relax(read, (0, state if role is None else MOVES[state, role]), (cost + price, labels + label))
        layer = read
    out: dict[int, Weight] = {}
    for (_, state), weight in layer.items():
        if state not in out or weight < out[state]:
            out[state] = weight
    return out


@lru_cache(maxsize=20_000)
def block_weights(symbols: str) -> list[str | None]:
    """The weights of a block from each grammar state to each, as 'cost labels'."""
    found = [shortest(symbols, entry) for entry in STATES]
    return [f"{w[to][0]} {w[to][1]}" if to in w else None for w in found for to in STATES]


def through_blocks(blocks: list[list[str | None]]) -> Weight:
    """The least weight of a whole conversation from its blocks in order.  What all
    states' labels begin with is settled, so that only their ends are carried on."""
    settled: list[str] = []
    now: dict[int, Weight] = {START: (0, "")}
    for block in blocks:
        new: dict[int, Weight] = {}
        for state, (cost, labels) in now.items():
            for to in STATES:
                w = block[state * len(STATES) + to]
                if w is not None:
                    price, more = w.split(" ")
                    weight = (cost + int(price), labels + more)
                    if to not in new or weight < new[to]:
                        new[to] = weight
        same = os.path.commonprefix([labels for _, labels in new.values()])
        settled.append(same)
        now = {state: (cost, labels[len(same) :]) for state, (cost, labels) in new.items()}
    cost, labels = min(now[state] for state in FINAL if state in now)
    return cost, "".join(settled) + labels


def _row_key() -> Column:
    return F.crc32(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.coalesce(F.col("turn").cast("string"), F.lit(" "))).cast("binary"))


def plain(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text; null roles and texts are one space."""
    return conversations.select("conv_id", "turn", *[F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")])


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows dropped, emptied, without their ends, repeated or with a wrong role, by key."""
    kind = F.col("kind")
    rows = plain(conversations).withColumn("kind", _row_key() % 20).where("kind <> 0")
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(kind == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), times).drop("copy")


def _order(rows: DataFrame) -> tuple[Column, ...]:
    return (F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("digest"))


def marked(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, place, role, symbol, fault) of plain rows, without their texts.

    place orders a conversation's rows; it holds the number of a range of rows and
    the row's number in that."""
    blank = ~F.col("text").rlike(NOT_WORD_BREAK)
    ended = F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    initial = F.substring("role", 1, 1)
    known = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    slim = rows.select("conv_id", "turn", "role", F.md5("text").alias("digest"), blank.alias("blank"), ended.alias("ended"), known.alias("initial")).withColumn("row", F.monotonically_increasing_id())
    sorted_ = slim.repartitionByRange(*_order(slim), "row").sortWithinPartitions(*_order(slim), "row")
    placed = cut(sorted_.drop("row").withColumn("place", F.monotonically_increasing_id()))
    first = placed.groupBy("conv_id", "role", "digest").agg(F.min("place").alias("place")).select("place", F.lit(True).alias("is_first"))
    fault = F.when(F.col("blank"), "blank").when(F.col("is_first").isNull(), "duplicate").when(~F.col("ended"), "truncated")
    symbol = F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", F.upper("initial")).otherwise(F.col("initial"))
    return placed.join(first, "place", "left").withColumn("fault", fault).select("conv_id", "turn", "place", "initial", "fault", symbol.alias("symbol"))


def _folded(blocks: list[dict]) -> dict:
    cost, labels = through_blocks([b["weights"] for b in blocks])
    roles = "".join(b["roles"] for b in blocks)
    illegal = sum(roles[i : i + 2] not in ("su", "ua", "au") for i in range(len(roles) - 1))
    seen = [b for b in blocks if b["turns"]]
    turns = sum(b["turns"] for b in seen) - sum(b["least"] == a["most"] for a, b in zip(seen, seen[1:], strict=False))
    gaps = seen[-1]["most"] - seen[0]["least"] + 1 - turns if seen else 0
    return {"gaps": gaps, "illegal": illegal, "cost": cost, "audit": labels}


def repairs(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of plain rows."""
    placed = marked(rows).withColumn("block", F.shiftright("place", BLOCK_BITS))
    ordered = F.array_sort(F.collect_list(F.struct("place", "symbol", "initial")))
    faults = [F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")]
    blocks = placed.groupBy("conv_id", "block").agg(ordered.alias("rows"), *faults, F.min("turn").alias("least"), F.max("turn").alias("most"), F.size(F.collect_set("turn")).alias("turns"))
    weigh = F.udf(block_weights, "array<string>", useArrow=True)
    joined = lambda field: F.array_join(F.transform("rows", lambda x: x[field]), "")
    solved = blocks.select("conv_id", "block", "blank", "duplicate", "truncated", "least", "most", "turns", joined("initial").alias("roles"), weigh(joined("symbol")).alias("weights"))
    fold = F.udf(_folded_rows, "gaps long, illegal long, cost long, audit string", useArrow=True)
    whole = solved.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("block", "roles", "least", "most", "turns", "weights"))).alias("blocks"), *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")])
    return whole.withColumn("r", fold("blocks")).select("conv_id", "r.gaps", "blank", "duplicate", "truncated", "r.illegal", "r.cost", "r.audit")


def _folded_rows(blocks) -> dict:
    return _folded([b if isinstance(b, dict) else b.asDict() for b in blocks])


_TURNS = pa.schema([("conv_id", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())])


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order, each conversation's audit before them, to repaired turns."""
    audit, at, state = "", 0, START
    now: object = object()

    def inserted(out: list) -> None:
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            role = next(r for r in ROLES if (state, r) in MOVES)
            state, at = MOVES[state, role], at + 1
            out.append((now, ROLES[role], "", "I"))

    for batch in batches:
        out: list = []
        for key, order, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "kind", "role", "text")), strict=True):
            if order == 0:
                inserted(out)
                now, audit, at, state = key, text, 0, START
                continue
            inserted(out)
            edit, at = audit[at], at + 1
            if edit == "D":
                continue
            if edit == "R":
                role = next(ROLES[r] for r in ROLES if (state, r) in MOVES)
            state = MOVES[state, role[0]]
            out.append((now, role, text, edit))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _TURNS, strict=True)], schema=_TURNS)
    out = []
    inserted(out)
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _TURNS, strict=True)], schema=_TURNS)


def repaired(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """The repaired turns (conv_id, role, text, edit) of plain rows, by the audits of
    ``repairs``: a conversation's turns stand together and in order in a partition."""
    plans = audits.select(F.col("conv_id").cast("long"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"), F.lit("").alias("digest"))
    turns = rows.select(F.col("conv_id").cast("long"), F.lit(1).alias("kind"), F.col("turn").cast("long").alias("turn"), "role", "text", F.md5("text").alias("digest"))
    both = plans.unionByName(turns).repartition("conv_id")
    at = _order(both)
    return both.sortWithinPartitions(at[0], "kind", *at[1:]).select("conv_id", "kind", "role", "text").mapInArrow(_apply, "conv_id long, role string, text string, edit string")


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now: object = None
    digest = None
    for batch in batches:
        out = []
        for key, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
            if digest is None or key != now:
                if digest is not None:
                    out.append((now, digest.hexdigest()))
                now, digest = key, hashlib.sha256()
            else:
                digest.update(b"\n")
            digest.update(f"{role}:{text}".encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int64()), pa.array([h for _, h in out])], names=["conv_id", "repaired_sha256"])
    if digest is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([digest.hexdigest()])], names=["conv_id", "repaired_sha256"])


def op11(conversations: DataFrame) -> DataFrame:
    """Every conversation's faults after the damage, its cheapest repair and the
    repaired rows' digest."""
    rows = damaged(conversations)
    found = cut(repairs(rows))
    digests = repaired(rows, found).mapInArrow(_hashed, "conv_id long, repaired_sha256 string").withColumnRenamed("conv_id", "d")
    ids = conversations.select(F.col("conv_id").cast("long").alias("i")).distinct()
    whole = ids.join(found, F.col("i").eqNullSafe(F.col("conv_id")), "left").join(digests, F.col("i").eqNullSafe(F.col("d")), "left")
    counts = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = F.lit(hashlib.sha256().hexdigest())
    return whole.select(F.col("i").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", empty).alias("repaired_sha256"))
