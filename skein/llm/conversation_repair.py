"""Repair of conversation structure: each distinct sequence of roles and faults is solved once.

A conversation's rows become a string of one letter each (its role's class and whether it must or may go):
the signature. Signatures are few, conversations many: a memoised recursion finds the cheapest edits of each
distinct signature, the edits are joined back to all conversations that have it, and replayed on their rows.

Long conversations are cut into signatures of ``PIECE`` rows. A piece's solution lists the cheapest edits from
each state of the role pattern to each other, and such lists join to those of longer pieces, so no signature
grows with a conversation."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import arrow_schema, chunks_of, roomy, rows_of

#: Rows of a conversation that one signature stands for; also how deep the recursion goes.
PIECE = 128
DELETE, REROLE, INSERT, TRUNCATED = 3, 2, 2, 1
#: States of the role pattern (s?(ua)+)?: nothing yet, after s, after u, after a. Which state a role leads to; where a text may end.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
NEXT = {("s", START): AFTER_S, ("u", START): AFTER_U, ("u", AFTER_S): AFTER_U, ("u", AFTER_A): AFTER_U, ("a", AFTER_U): AFTER_A}
ENDS = (START, AFTER_A)
SPACES = " \t\n\x0b\x0c\r"
Way = tuple[int, str]


def wanted(state: int) -> int:
    """Where the role that may be made or inserted leads: an assistant after a user, else a user."""
    return AFTER_A if state == AFTER_U else AFTER_U


@lru_cache(maxsize=1 << 14)
def solve(signature: str, state: int) -> tuple[Way | None, ...]:
    """For each state in which the pattern may stand after the rows: the least cost from ``state`` and, of the edits that
    cost it, the ASCII-least initials; None where no edits lead there.

    Letters: ``s u a x`` by role (x: any other), capitals for truncated texts, ``D`` for rows that must go. Rows may be
    kept, given another role or deleted, each after up to two insertions; more only come back to the same state."""
    if not signature:
        return tuple((0, "") if s == state else None for s in range(4))
    row, rest = signature[0], signature[1:]
    best: list[Way | None] = [None] * 4
    for inserted in range(3):
        edits = [("D", DELETE, state)]
        if row != "D":
            late = TRUNCATED * row.isupper()
            edits.append(("R", REROLE + late, wanted(state)))
            if (kept := NEXT.get((row.lower(), state))) is not None:
                edits.append(("K", late, kept))
        for edit, cost, then in edits:
            for end, way in enumerate(solve(rest, then)):
                if way is not None:
                    new = (INSERT * inserted + cost + way[0], "I" * inserted + edit + way[1])
                    best[end] = min(new, best[end] or new)
        state = wanted(state)
    return tuple(best)


def finish(state: int) -> Way | None:
    """The insertions that end a conversation whose rows are all done."""
    for inserted in range(3):
        if state in ENDS:
            return INSERT * inserted, "I" * inserted
        state = wanted(state)
    return None


Table = list[list[Way | None]]


def joined(first: Table, then: Table) -> Table:
    """The cheapest edits of two pieces in a row. Of two equally cheap ways between the same states none begins the other
    (they consume the same rows, and insertions behind them that come back to a state cost), so the least of the whole is made of the least parts."""
    out: Table = [[None] * 4 for _ in range(4)]
    for s in range(4):
        for m in range(4):
            if first[s][m] is not None:
                for t in range(4):
                    if then[m][t] is not None:
                        new = (first[s][m][0] + then[m][t][0], first[s][m][1] + then[m][t][1])
                        out[s][t] = min(new, out[s][t] or new)
    return out


def best_edits(pieces: Iterator[Table]) -> Way:
    """The cheapest edits of a conversation from its pieces' solutions. Pieces are joined in pairs, then pairs of pairs."""
    stack: list[tuple[int, Table]] = []
    for table in pieces:
        n = 1
        while stack and stack[-1][0] <= n:
            m, before = stack.pop()
            n, table = n + m, joined(before, table)
        stack.append((n, table))
    while len(stack) > 1:
        (_, last), (_, before) = stack.pop(), stack.pop()
        stack.append((0, joined(before, last)))
    ways = stack[0][1][START] if stack else solve("", START)
    return min((w[0] + e[0], w[1] + e[1]) for s, w in enumerate(ways) if w is not None and (e := finish(s)) is not None)


def damage(conversations: DataFrame) -> DataFrame:
    """The test damage: by crc32 of ``conv_id:turn`` modulo 20 a row is dropped (0), emptied (1), loses its sentence ends
    (2), is doubled (3) or said by the user (4). Nulls are one space, but a null turn or conversation stays null."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", part("conv_id"), part("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(part("text"), "[.!?]", "")).otherwise(part("text"))
    role = F.when(kind == 4, "user").otherwise(part("role"))
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("kind")).filter("kind != 0")
    return rows.select("conv_id", "turn", "role", "text", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


def _ordered(rows: DataFrame) -> DataFrame:
    """Rows under the names used here, nulls in role or text as one space. Rows of a conversation are in the order of
    turn (nulls first), then role, then the digest of role and text, so that equal rows stand side by side."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), digest.alias("digest"))


#: What is counted of each conversation.
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal")


def signatures(rows: DataFrame) -> DataFrame:
    """One row per conversation and ``PIECE`` of its rows: the piece's signature and what it adds to the counts.

    No text is shuffled. A row's repeats in a conversation are told by joining each row to the first turn of its role
    and text, which is an aggregate: a row that a conversation repeats without end is spread like others."""
    o = _ordered(rows)
    last = F.right(F.rtrim("text", F.lit(SPACES)), F.lit(1))
    narrow = o.select("conv_id", "turn", "role", "digest", (last == "").alias("blank"), (~last.isin(".", "!", "?")).alias("open"))
    first = narrow.groupBy(F.col("conv_id").alias("c"), F.col("digest").alias("d")).agg(F.min(F.struct(F.col("turn").isNotNull().alias("k"), "turn")).alias("f"))
    met = narrow.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("d")) & F.col("turn").eqNullSafe(F.col("f.turn")), "left")
    w = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "digest")
    before = F.lag(F.struct("turn", "digest", F.substring("role", 1, 1).alias("i"))).over(w)
    told = met.select("conv_id", "turn", "role", "blank", "open", F.col("d").isNull().alias("late"), F.row_number().over(w).alias("pos"), before.alias("b"), F.col("digest"))
    same_turn = F.col("b").isNotNull() & F.col("b.turn").eqNullSafe(F.col("turn"))
    duplicate = ~F.col("blank") & (F.col("late") | (same_turn & (F.col("b.digest") == F.col("digest"))))
    initial = F.substring("role", 1, 1)
    letter = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    told = told.select(
        "conv_id", "pos", "turn", F.floor((F.col("pos") - 1) / PIECE).alias("piece"), F.col("blank"), duplicate.alias("duplicate"), (~F.col("blank") & ~duplicate & F.col("open")).alias("truncated"),
        (F.col("b").isNotNull() & ~F.concat("b.i", initial).isin("su", "ua", "au")).alias("illegal"), (F.col("turn").isNotNull() & ~same_turn).alias("new_turn"), letter.alias("letter"),
    )
    letter = F.when(F.col("blank") | F.col("duplicate"), "D").when(F.col("truncated"), F.upper("letter")).otherwise(F.col("letter"))
    string = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", letter.alias("l")))), lambda x: x["l"]), "")
    return told.groupBy("conv_id", "piece").agg(string.alias("signature"), F.min("turn").alias("lo"), F.max("turn").alias("hi"), F.count_if("new_turn").alias("turns"), *(F.count_if(F.col(c)).alias(c) for c in COUNTS[1:]))


def _solved(found: DataFrame) -> DataFrame:
    """Each distinct signature with its cheapest edits between all states."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("s", pa.int32()), ("t", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
        for b in batches:
            ways = [[{"s": s, "t": t, "cost": w[0], "audit": w[1]} for s in range(4) for t, w in enumerate(solve(x, s)) if w] for x in b.column("signature").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("signature"), pa.array(ways, kind)], ["signature", "ways"])
        solve.cache_clear()

    return found.select("signature").distinct().mapInArrow(roomy(run), "signature string, ways array<struct<s:int,t:int,cost:bigint,audit:string>>")


def audits(rows: DataFrame) -> DataFrame:
    """One row per conversation that has rows: its faults (``COUNTS``), the cost of the cheapest edits and their initials:
    Keep, Rerole, Delete, Insert. A conversation's pieces meet in one task, which holds the edits that it returns anyway."""
    pieces = signatures(rows)
    solved = pieces.join(_solved(pieces), "signature").drop("signature")
    names = ["lo", "hi", "turns", *COUNTS[1:]]
    dealt = solved.repartition("conv_id").sortWithinPartitions("conv_id", "piece")
    kind = dealt.schema["conv_id"].dataType.simpleString()

    def tables(rows: list[dict]) -> Iterator[Table]:
        for r in rows:
            table: Table = [[None] * 4 for _ in range(4)]
            for w in r["ways"]:
                table[w["s"]][w["t"]] = (w["cost"], w["audit"])
            yield table

    def done(key: object, rows: list[dict]) -> tuple:
        lo, hi = ([r[c] for r in rows if r[c] is not None] for c in ("lo", "hi"))
        gaps = max(hi) - min(lo) + 1 - sum(r["turns"] for r in rows) if lo else 0
        return (key, gaps, *(sum(r[c] for r in rows) for c in COUNTS[1:]), *best_edits(tables(rows)))

    schema = f"conv_id {kind}, " + "".join(f"{c} long, " for c in (*COUNTS, "cost")) + "audit string"
    out_schema = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = (done(key, list(rows)) for key, rows in groupby(rows_of(batches), key=lambda r: r["conv_id"]))
        yield from chunks_of(whole, out_schema)

    return dealt.select("conv_id", "piece", *names, "ways").mapInArrow(roomy(run), schema)


def _replay(rows: Iterator[dict]) -> Iterator[tuple[dict, str, str, str]]:
    """(conversation, edit, role, text) of each repaired row, and (conversation, "", "", "") before them. A conversation's
    audit comes before its rows."""
    head, audit, at, last = None, "", 0, ""

    def made() -> str:
        nonlocal last
        last = "assistant" if last[:1] == "u" else "user"
        return last

    for row in rows:
        while at < len(audit) and (audit[at] == "I" or row["audit"] is not None):
            at += 1
            yield head, "I", made(), ""
        if row["audit"] is not None:
            head, audit, at, last = row, row["audit"], 0, ""
            yield head, "", "", ""
            continue
        edit = audit[at]
        at += 1
        if edit == "K":
            last = row["role"]
        if edit != "D":
            yield head, edit, row["role"] if edit == "K" else made(), row["text"]
    for _ in audit[at:]:
        yield head, "I", made(), ""


def _with_audits(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Conversations' audits and rows side by side, each audit before its rows: the only shuffle of texts."""
    o = _ordered(rows).select("conv_id", F.lit(1).alias("step"), "turn", "role", "digest", "text", F.lit(None).cast("string").alias("audit"), *(F.lit(None).cast("long").alias(c) for c in (*COUNTS, "cost")))
    head = found.select("conv_id", F.lit(0).alias("step"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit(b"").alias("digest"), F.lit("").alias("text"), "audit", *COUNTS, "cost")
    return o.unionByName(head).repartition("conv_id").sortWithinPartitions("conv_id", "step", F.asc_nulls_first("turn"), "role", "digest").drop("step", "turn", "digest")


def repair(rows: DataFrame) -> DataFrame:
    """The repaired conversations (conv_id, pos, role, text, edit): rows are kept, given the role user or assistant, deleted
    or inserted with empty text, at the least cost, so that roles read system?, then user and assistant in turns.

    A row's first fault counts: blank, duplicate (role and text seen earlier in the conversation) or truncated (its last
    character ends no sentence). Blank and duplicate rows go. Null roles and texts are one space; null turns come first;
    a null conversation is one of its own. Rows of equal turn are taken by role, then by a digest of role and text.
    An empty table gives an empty one. Other columns are not read. Texts of any length are held one row at a time."""
    dealt = _with_audits(rows, audits(rows))
    schema = f"conv_id {dealt.schema['conv_id'].dataType.simpleString()}, pos long, role string, text string, edit string"
    out_schema = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[tuple]:
            pos = 0
            for head, edit, role, text in _replay(rows_of(batches)):
                pos = pos + 1 if edit else 0
                if edit:
                    yield head["conv_id"], pos, role, text, edit

        yield from chunks_of(out(), out_schema, 500)

    return dealt.mapInArrow(roomy(run), schema)


def digests(conversations: DataFrame, rows: DataFrame) -> DataFrame:
    """One row for each conversation of ``conversations``: :func:`audits` of ``rows`` and the SHA-256 of the repaired
    ``role:text`` lines. Conversations that have no rows left have zeros, no edits and the digest of nothing."""
    ids = conversations.select(F.col("conv_id").alias("id")).distinct()
    found = ids.join(audits(rows), F.col("id").eqNullSafe(F.col("conv_id")), "left").select(F.col("id").alias("conv_id"), *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in (*COUNTS, "cost")), F.coalesce("audit", F.lit("")).alias("audit"))
    dealt = _with_audits(rows, found)
    schema = f"conv_id {dealt.schema['conv_id'].dataType.simpleString()}, " + "".join(f"{c} long, " for c in (*COUNTS, "cost")) + "audit string, repaired_sha256 string"
    out_schema = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[tuple]:
            head, h, n = None, hashlib.sha256(), 0
            row = lambda: (head["conv_id"], *(head[c] for c in (*COUNTS, "cost")), head["audit"], h.hexdigest())
            for now, edit, role, text in _replay(rows_of(batches)):
                if not edit:
                    if head is not None:
                        yield row()
                    head, h, n = now, hashlib.sha256(), 0
                else:
                    h.update(("\n" * (n > 0) + f"{role}:{text}").encode())
                    n += 1
            if head is not None:
                yield row()

        yield from chunks_of(out(), out_schema)

    return dealt.mapInArrow(roomy(run), schema)
