"""Chat formatting, conversation repair and the filter audit against plain versions, and on odd rows."""

import collections
import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import chat_format, conversation_repair, filter_audit

# Chat formatting.


def test_escapes_come_back():
    rnd = random.Random(1)
    for _ in range(3000):
        text = "".join(rnd.choice(["<", "\\", "|", "<|im_end|>", "<|im_start|>", "a", "\n", "%0A", "%"]) for _ in range(rnd.randint(0, 9)))
        assert chat_format.unescape(chat_format.escape(text)) == text and "<|" not in chat_format.escape(text)
        assert chat_format.unescape_role(chat_format.escape_role(text)) == text
        turns = [(text, text), ("assistant", text + "<")]
        assert chat_format.read_turns(chat_format.marked_turns(turns)) == turns


def test_pieces_make_up_the_whole_output():
    rnd = random.Random(2)
    for n in (0, 1, 2, 8, 9, 30):
        turns = [(rnd.choice(["user", "assistant", ""]), rnd.choice(["", "a", "b", "<|im_end|>\n", "ab" * 50, "\\<|"])) for _ in range(n)]
        found = list(chat_format.locate(chat_format.marked_turns, turns))
        assert "".join(f[0] for f in found) == chat_format.marked_turns(turns)
        for (_, text), (piece, begin, end, rewritten, far) in zip(turns, found, strict=True):
            assert chat_format.unescape(piece[begin:end]) == text and not rewritten and not far


def test_templates_that_rewrite_history_are_found():
    def short(turns):  # earlier answers lose their thoughts
        return "".join(f"[{r}]{t if i == len(turns) - 1 else t.split('=')[-1]};" for i, (r, t) in enumerate(turns))

    found = list(chat_format.locate(short, [("user", "q"), ("assistant", "think=yes"), ("user", "r"), ("assistant", "no")]))
    assert [f[3] > 0 for f in found] == [False, False, True, False]
    assert found[2][3] == len("think=yes;")

    def counted(turns):  # says how many turns there have been
        return "".join(f"{i}:{t};" for i, (_, t) in enumerate(turns))

    assert [f[4] for f in chat_format.locate(counted, [("u", "x")] * 6, context=3)] == [False] * 3 + [True] * 3
    last = list(chat_format.locate(lambda turns: turns[-1][0] + "!", [("u", "x"), ("v", "y")]))  # drops texts
    assert [f[1:3] for f in last] == [(-1, -1)] * 2


def test_format_of_odd_rows(spark):
    rows = [(1, 0, "user", None), (1, None, None, "first"), (2, 0, "assistant", "x" * 200_000), (2, 1, "assistant", "<|im_end|>"), (2, 1, "assistant", "<|im_end|>"), (None, 3, "user", "")]
    df = spark.createDataFrame([(*r, "p", 7, True) for r in rows], "conv_id long, turn long, role string, text string, piece string, pos long, loss boolean").repartition(3)
    got = {r.conv_id: r for r in chat_format.digests(chat_format.format_turns(df)).collect()}
    assert set(got) == {1, 2, None}
    for key, turns in {1: [("", "first"), ("user", "")], 2: [("assistant", "x" * 200_000), ("assistant", "<|im_end|>"), ("assistant", "<|im_end|>")], None: [("user", "")]}.items():
        r = got[key]
        assert r.n_turns == len(turns) and r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        learnt = "".join(b for a, b in turns if a == "assistant")
        assert (r.loss_chars, r.loss_sha256) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest()) and r.formatted_chars == len(chat_format.marked_turns(turns))
    assert chat_format.format_turns(df.limit(0)).count() == 0


# Conversation repair.


def plain_edits(rows):
    """All edit sequences by brute force: rows are (initial, must go, truncated)."""
    best = None
    most = 3 * len(rows) + 4

    def legal(out):
        out = out[1:] if out[:1] == "s" and len(out) > 1 else out
        return out == "ua" * (len(out) // 2)

    def go(i, out, cost, audit, run):
        nonlocal best
        if best is not None and cost > best[0] or cost > most:
            return
        if i == len(rows) and legal(out) and (best is None or (cost, audit) < best):
            best = cost, audit
        if run < 3:
            for r in "ua":
                go(i, out + r, cost + 2, audit + "I", run + 1)
        if i < len(rows):
            initial, gone, late = rows[i]
            go(i + 1, out, cost + 3, audit + "D", 0)
            if not gone:
                go(i + 1, out + initial, cost + late, audit + "K", 0)
                for r in "ua":
                    go(i + 1, out + r, cost + 2 + late, audit + "R", 0)

    go(0, "", 0, "", 0)
    return best


def letters(rows):
    return "".join("D" if gone else (i.upper() if late else i) for i, gone, late in rows)


def table(signature):
    return [list(conversation_repair.solve(signature, s)) for s in range(4)]


def test_solved_signatures_equal_brute_force():
    kinds = [(i, False, late) for i in "suax" for late in (0, 1)] + [("u", True, 0)]
    cases = [list(c) for n in range(3) for c in itertools.product(kinds, repeat=n)]
    rnd = random.Random(5)
    cases += [[rnd.choice(kinds) for _ in range(rnd.randint(3, 4))] for _ in range(60)]
    for rows in cases:
        got = conversation_repair.best_edits(iter([table(letters(rows))]))
        assert got == plain_edits(rows), rows


def test_pieces_join_to_the_solution_of_the_whole():
    rnd = random.Random(6)
    for _ in range(40):
        s = "".join(rnd.choice("suaxSUAXD") for _ in range(rnd.randint(0, 60)))
        cut = sorted(rnd.randint(0, len(s)) for _ in range(rnd.randint(0, 6)))
        pieces = [s[a:b] for a, b in zip([0, *cut], [*cut, len(s)], strict=True)]
        assert conversation_repair.best_edits(map(table, pieces)) == conversation_repair.best_edits(iter([table(s)]))


def plain_repair(rows):
    """(counts, cost, audit, repaired lines) of rows (turn, role, text) by loops."""
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()))
    seen, marks, counts = set(), [], collections.Counter()
    for t, role, text in order:
        body = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
        seen.add((role, text))
        counts[fault] += 1
        marks.append((role[:1] if role[:1] in ("s", "u", "a") else "x", fault in ("blank", "duplicate"), fault == "truncated"))
    initials = [r[1][:1] for r in order]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
    turns = {r[0] for r in order} - {None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    cost, audit = conversation_repair.best_edits(iter([table(letters(marks))]))
    out, rest = [], iter(order)
    for e in audit:
        row = next(rest) if e != "I" else (None, "", "")
        if e != "D":
            role = row[1] if e == "K" else "assistant" if out and out[-1][0][:1] == "u" else "user"
            out.append((role, row[2]))
    return (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit), out


def test_repair_equals_loops(spark):
    rnd = random.Random(7)
    rows = []
    for c in [*range(60), None]:
        for t in range(rnd.randint(1, 12) if c != 7 else 700):
            text = rnd.choice([None, "", "  ", "Yes.", "No!", "cut", "so\n. ", "Tell me?", f"n{t}.", f"m{t}", "é. "])
            rows += [(c, rnd.choice([t, t, t, None, t + 3]), rnd.choice(["system", "user", "assistant", "user", "assistant", "tool", None, ""]), text)] * rnd.choice([1, 1, 1, 2])
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "conv_id long, turn long, role string, text string, audit string, pos long, digest long").repartition(5)
    groups = collections.defaultdict(list)
    for c, t, role, text in rows:
        groups[c].append((t, " " if role is None else role, " " if text is None else text))
    got = {r.conv_id: r for r in conversation_repair.digests(df, df).collect()}
    turns = collections.defaultdict(list)
    for r in conversation_repair.repair(df).orderBy("pos").collect():
        turns[r.conv_id].append((r.role, r.text))
    assert set(got) == set(groups)
    for c, own in groups.items():
        counts, out = plain_repair(own)
        r = got[c]
        assert (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit) == counts, c
        assert turns[c] == out and r.repaired_sha256 == hashlib.sha256("\n".join(f"{a}:{b}" for a, b in out).encode()).hexdigest()


def test_damage_and_conversations_without_rows(spark):
    rows = [(c, t, role, "One. Two!") for c in range(40) for t, role in enumerate(["system", "user", "assistant"])] + [(None, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = []
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind:
            want += [(c, t, "user" if kind == 4 else role, "" if kind == 1 else "One Two" if kind == 2 else text)] * (2 if kind == 3 else 1)
    key = lambda r: str(r)
    damaged = conversation_repair.damage(df)
    assert sorted(map(tuple, damaged.collect()), key=key) == sorted(want, key=key)
    left = conversation_repair.digests(df, damaged.filter("conv_id < 0"))
    assert {(r.cost, r.gaps, r.audit, r.repaired_sha256) for r in left.collect()} == {(0, 0, "", hashlib.sha256(b"").hexdigest())} and left.count() == 41
    none = df.limit(0)
    assert conversation_repair.digests(none, conversation_repair.damage(none)).count() == conversation_repair.repair(none).count() == 0


# Filter audit.


def plain_audit(rows, labels):
    """Rows of (part, order, step, counts) by applying every order to every row."""
    out, first = collections.defaultdict(lambda: collections.Counter()), {}
    for d, _, text in rows:
        if d is not None:
            first[text or ""] = min(d, first.get(text or "", d))
    total = collections.Counter()
    for d, part, text in rows:
        text, part = text or "", part or ""
        w = [x for x in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text).split(" ") if x]
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text), "D": any(c in "#$%&*|" for c in text), "E": d is not None and first.get(text, d) < d}
        for order in map("".join, itertools.permutations("ABCDE")):
            gone = False
            for step, f in enumerate(order, 1):
                c = out[part, order, step]
                here = fails[f] and not gone
                c["removed"] += here
                c["redundant"] += fails[f] and gone
                c["unique_fails"] += fails[f] and sum(fails.values()) == 1
                c["good_lost"] += here and (d, "quality") in labels
                c["toxic_lost"] += here and (d, "toxic") in labels
                gone |= fails[f]
                c["kept"] += not gone
                total[part, f] += here
    return {k: {**{x: int(c[x]) for x in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")}, "shapley": int(total[k[0], k[1][k[2] - 1]])} for k, c in out.items()}


def test_audit_equals_every_order_on_odd_rows(spark):
    rnd = random.Random(8)
    texts = [None, "", " \x0b\t", "word " * 250, "A", "# x", "é" * 10, " ".join(f"w{i}" for i in range(300)), "x y " * 300, "🙂 ABC " * 100, "q " * 60_000]
    rows = [(rnd.choice([*range(50), None]), rnd.choice(["s", "t", "", None]), rnd.choice(texts)) for _ in range(90)]
    labels = [(i, rnd.choice([0, 1, None]), rnd.choice([0, 1, None])) for i in [*range(30), *range(10), None]]
    docs = spark.createDataFrame([(*r, True, 3, "n") for r in rows], "doc_id long, source string, text string, good boolean, n long, part string").repartition(4)
    marks = spark.createDataFrame([(*x, "z") for x in labels], "doc_id long, quality int, toxic int, part string")
    known = {(d, name) for d, q, t in labels for name, v in (("quality", q), ("toxic", t)) if v == 1 and d is not None}
    want = plain_audit(rows, known)
    got = {(r.part, r.filter_order, r.step): {k: r[k] for k in next(iter(want.values()))} for r in filter_audit.audit(docs, marks).collect()}
    assert got == want
    assert filter_audit.audit(docs.limit(0), marks).count() == 0
    assert filter_audit.audit(docs, marks.limit(0)).agg(F.sum("good_lost")).first()[0] == 0


@pytest.mark.parametrize("n", [0, 1, 7, 8, 9, 1000])
def test_packed_counts_equal_boolean_sums(n):
    rnd = np.random.default_rng(n)
    part, fails, labels = np.sort(rnd.integers(0, 5, n)), rnd.random((3, n)) < 0.4, rnd.random((2, n)) < 0.5
    if not n:
        return
    parts, counts = filter_audit.subset_counts(part, fails, labels)
    for i, p in enumerate(parts):
        for subset in range(8):
            left = (part == p) & ~np.any([fails[j] for j in range(3) if subset >> j & 1] or [np.zeros(n, bool)], axis=0)
            assert counts[i, subset].tolist() == [left.sum(), (left & labels[0]).sum(), (left & labels[1]).sum()]


def test_turns_that_look_far_back_are_rendered_after_all_others():
    def numbered(turns):
        return "".join(f"{i} of {turns[0][0]}: {t};" for i, (_, t) in enumerate(turns))

    turns = [("user" if i else "first", f"t{i}") for i in range(30)]
    out = ""
    for piece, begin, end, rewritten, _ in chat_format.locate(numbered, turns, context=4):
        out = out[: len(out) - rewritten] + piece
        assert rewritten == 0 and piece[begin:end].startswith("t")
    assert out == numbered(turns)
