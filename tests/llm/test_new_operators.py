"""Operators 11, 12 and 13 against brute force and held-out accuracy."""

import collections
import hashlib
import heapq
import itertools
import random
import zlib

import numpy as np
import pytest

from hindcast.llm import conversations as V
from hindcast.llm import filter_audit as A
from hindcast.llm import language_id as L
from hindcast.sources.tables import read_table

WS = " \t\n\x0b\f\r"


# --- 11

def test_swaps_pass_through_all_orders():
    for n in range(1, 7):
        order = list(range(n))
        seen = [tuple(order)]
        for k in A.adjacent_swaps(n):
            order[k], order[k + 1] = order[k + 1], order[k]
            seen.append(tuple(order))
        assert sorted(seen) == sorted(itertools.permutations(range(n)))


def audited_by_hand(masks, filters):
    """Every order and step from the masks alone."""
    out, shapley = {}, collections.Counter()
    for order in itertools.permutations(filters):
        left = dict(masks)
        for step, f in enumerate(order, 1):
            bit = 1 << filters.index(f)
            gone = {m: c for m, c in left.items() if m & bit}
            left = {m: c for m, c in left.items() if not m & bit}
            total = lambda cs, k: sum(c[k] for c in cs.values())
            fails = sum(c[0] for m, c in masks.items() if m & bit)
            out["".join(order), step] = (total(left, 0), total(gone, 0), fails - total(gone, 0), masks.get(bit, (0,))[0],
                                         total(gone, 1), total(gone, 2))
            shapley[f] += total(gone, 0)
    return {k: (*v, shapley[k[0][k[1] - 1]]) for k, v in out.items()}


@pytest.mark.parametrize("filters", ["A", "AB", "ABCD", "ABCDE"])
def test_diagrams_give_every_order(filters):
    r = random.Random(len(filters))
    for filled in (0, 1, 5, 32):
        masks = {r.randrange(1 << len(filters)): (r.randint(0, 5), r.randint(0, 2), r.randint(0, 2)) for _ in range(filled)}
        got = {row[1:3]: row[3:] for row in A.audited("p", masks, filters)}
        assert got == audited_by_hand(masks, filters)


def test_diagrams_share_equal_parts_and_swap_back():
    masks = {m: (1, 0, 1) for m in range(32)}
    d = A.Diagram("ABCDE", masks)
    assert [len(x) for x in d.levels] == [1] * 5
    d = A.Diagram("ABCDE", {m: (m, 0, 0) for m in range(32)})
    assert [len(x) for x in d.levels] == [1, 2, 4, 8, 16]
    before = list(d.steps())
    d.swap(2)
    assert d.order == list("ABDCE") and list(d.steps()) != before
    d.swap(2)
    assert list(d.steps()) == before


def test_audit_of_edge_rows(spark):
    long = " ".join(f"w{n}" for n in range(250))
    rows = [(1, long, "s"), (2, long, "s"), (2, long, "s"), (None, long, "s"), (3, None, None), (4, "", "t"), (5, "é " * 250, "t"),
            (6, "AB " + long, "t"), (7, "A" * 300 + long, "t"), (8, "x | " * 200 + long * 3, "t"), (9, " ".join("abc"), None)]
    docs = spark.createDataFrame([(*x, "k", 1) for x in rows], "doc_id long, text string, source string, same string, n int")
    labels = spark.createDataFrame([(2, 1, 0), (2, 0, None), (3, None, 1), (None, 1, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    want = collections.defaultdict(lambda: collections.defaultdict(lambda: [0, 0, 0]))
    for i, t, s in rows:
        t = t or ""
        words = [w for w in "".join(" " if c in WS else c for c in t).split(" ") if w]
        mask = ((len(words) < 200) + 2 * (100 * len(set(words)) < 50 * len(words))
                + 4 * (100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t)) + 8 * any(c in "#$%&*|" for c in t)
                + 16 * (i is not None and first[t] < i))
        cell = want[s or ""][mask]
        for k, x in enumerate((1, i == 2, i == 3)):
            cell[k] += x
    got = collections.defaultdict(dict)
    for r in A.audit(A.measured(docs, labels)).collect():
        got[r.part][r.filter_order, r.step] = tuple(r)[3:]
    assert set(got) == set(want) == {"", "s", "t"}
    for part in got:
        assert got[part] == audited_by_hand({m: tuple(c) for m, c in want[part].items()}, "ABCDE")
    assert A.audit(A.measured(docs.limit(0), labels)).count() == 0
    assert A.audit(A.measured(docs, labels.limit(0))).count() == 1800


# --- 12

def damaged_by_hand(rows):
    """conversation -> rows (turn, role, text) in order, after damage."""
    out = {}
    for conv, turn, role, text in rows:
        mine = out.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        what = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if what == 0:
            continue
        text = "" if what == 1 else "".join(c for c in text if c not in ".!?") if what == 2 else text
        mine += [(turn, "user" if what == 4 else role, text)] * (2 if what == 3 else 1)
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest())
    return {c: sorted(rs, key=key) for c, rs in out.items()}


def faults_by_hand(rows):
    seen, out = set(), []
    for _, role, text in rows:
        body = "".join(" " if c in WS else c for c in text).rstrip(" ")
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def repaired_by_hand(rows, faults):
    """Least (cost, audit) over all edits, by Dijkstra over (rows read, state) with the
    whole audit in the key, and the lines it leaves."""
    moves = {"": "su", "s": "u", "u": "a", "a": "u"}
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, at, state, lines = heapq.heappop(heap)
        if (at, state) in done:
            continue
        done.add((at, state))
        if at == len(rows) and state in ("", "a"):
            return cost, audit, "\n".join(lines)
        for to in moves[state]:
            if to != "s":
                heapq.heappush(heap, (cost + 5, audit + "I", at, to, (*lines, {"u": "user:", "a": "assistant:"}[to])))
        if at < len(rows):
            _, role, text = rows[at]
            heapq.heappush(heap, (cost + 2, audit + "D", at + 1, state, lines))
            if faults[at] in (None, "truncated"):
                extra = 5 if faults[at] else 0
                for to in moves[state]:
                    if role[:1] == to:
                        heapq.heappush(heap, (cost + extra, audit + "K", at + 1, to, (*lines, f"{role}:{text}")))
                    if to != "s":
                        name = {"u": "user", "a": "assistant"}[to]
                        heapq.heappush(heap, (cost + extra + 1, audit + "R", at + 1, to, (*lines, f"{name}:{text}")))


def results_by_hand(rows):
    out = {}
    for conv, mine in damaged_by_hand(rows).items():
        faults = faults_by_hand(mine)
        cost, audit, text = repaired_by_hand(mine, faults)
        turns = {t for t, *_ in mine if t is not None}
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0,
                     *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
                     sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:])),
                     cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def test_repair_of_random_rows_is_the_cheapest():
    r = random.Random(12)
    for n in range(3000):
        roles = r.choice([["user", "assistant"], ["user", "assistant", "system"], ["user", "u2", "assistant", "system", "sys", "bot", ""]])
        rows = [(k, r.choice(roles), r.choice(["Yes.", "no", "", f"t{k}!", f"t{k}"])) for k in range(r.randint(0, 9))]
        c = V.Conversation(n)
        for row in rows:
            c.repair.row(row[1], row[2], faults_by_hand(rows[:rows.index(row) + 1])[-1])
        faults = [faults_by_hand(rows[:rows.index(row) + 1])[-1] for row in rows]
        cost, audit, text = repaired_by_hand(rows, faults)
        assert c.repair.done() == (cost, audit, hashlib.sha256(text.encode()).hexdigest()), rows


def held(node):
    return 1 + sum(held(c) for c in node.children)


def test_decided_edits_leave_memory():
    r, c, most = random.Random(3), V.Conversation(1), 0
    for k in range(20_000):
        role = r.choice(["user", "assistant", "assistant", "system"])
        c.take(k, role, f"turn {k}" + r.choice([".", ".", ""]), V.ROW)
        most = max(most, held(c.repair.root))
    assert most < 400 and len(c.repair.audit) > 19_000
    tied = V.Conversation(2)  # Delete/Keep or Keep/Delete of each pair: ties that stay open
    for k in range(40):
        tied.take(k, "user", f"t{k}.", V.ROW)
    rows = [(k, "user", f"t{k}.") for k in range(40)]
    cost, audit, text = repaired_by_hand(rows, [None] * 40)
    assert tied.result()[6:] == (cost, audit, hashlib.sha256(text.encode()).hexdigest())


def test_conversations_of_every_kind(spark, sf_small):
    r = random.Random(5)
    rows = [(c, t, r.choice(["user", "assistant", "system", None, "", "bot"]), r.choice(["Yes.", "no", None, "", "  \n", f"a {t}.", "Same!", " "]))
            for c in [*range(60), None, -5] for t in [*range(r.randint(1, 9)), None, r.randrange(20), r.randrange(20)]]
    rows += rows[:40] + [(1000, t, "user", "hot.") for t in range(600)] + [(1001, k, "user", "x" * 200_000 + ".") for k in range(3)]
    gone = next(k for k in range(10_000) if zlib.crc32(f"{k + 5000}:0".encode()) % 20 == 0) + 5000
    rows.append((gone, 0, "user", "Yes."))
    table = spark.createDataFrame([(*x, 1, "h") for x in rows], "conv_id long, turn long, role string, text string, kind int, hash string")
    got = {x.conv_id: tuple(x)[1:] for x in V.repaired(table.repartition(7)).collect()}
    want = results_by_hand(rows)
    assert got == want
    assert got[gone] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert V.repaired(table.limit(0)).count() == 0

    given = read_table(spark, sf_small, "conversations")
    want = results_by_hand([(x.conv_id, x.turn, x.role, x.text) for x in given.collect()])
    assert {x.conv_id: tuple(x)[1:] for x in V.op12_conversation_repair(spark, sf_small).collect()} == want


# --- 13

def bundle_by_hand(text, dimensions):
    symbols, gap = [0], True
    for c in text:
        kept = c.isalpha()
        if kept or not gap:
            symbols.append(ord(c.lower()[0]) if kept else 0)
        gap = not kept
    symbols += [] if gap else [0]
    total = np.zeros(dimensions)
    for k in range(len(symbols) - L.NGRAM + 1):
        bound = np.ones(dimensions)
        for place, s in enumerate(reversed(symbols[k:k + L.NGRAM])):
            bound = bound * np.roll(L.symbol_vector(s, dimensions), place)
        total += bound
    return total


def test_bundles_against_single_steps(monkeypatch):
    told = ["The cat, the hat!", " Ünïcode  ßtraße 12 x", "a", "", None, "12 ??", "ab" * 300, "É é"]
    for dimensions in (64, 700):
        p = L.Profiler(dimensions)
        got, letters = p.bundles(told)
        assert letters.tolist() == [True, True, True, False, False, False, True, True]
        for text, row in zip(told, got):
            assert (row == (bundle_by_hand(text, dimensions) if any(map(str.isalpha, text or "")) else 0)).all(), text
        for bound, value in (("SYMBOLS_AT_A_TIME", 50), ("GRAMS_AT_A_TIME", 3)):
            monkeypatch.setattr(L, bound, value)
            assert (L.Profiler(dimensions).bundles(told)[0] == got).all()


def test_language_of_held_out_rows(spark):
    docs = read_table(spark, "/root/testdata/sf0.01", "documents")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    rows = L.op13_language_id(spark, "/root/testdata/sf0.01").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(truth) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.98 * len(held)


def test_languages_of_edge_rows(spark):
    one, two = "the cat sat on the mat and the dog ", "le chat est sur la table et le chien "
    rows = [(1, one * 5, "en"), (2, two * 5, "fr"), (3, one * 3, "en"), (4, two * 3, "fr"), (6, "", "en"), (7, None, "de"), (8, "12 !", "de"),
            (9, one * 40_000, None), (None, two, None), (10, two, None), (10, two, None), (11, "qzx", None)]
    docs = spark.createDataFrame([(*x, 0.5, "z") for x in rows], "doc_id long, text string, lang string, score double, language string")
    model = L.fitted(docs.repartition(3))
    taught = [(t, g) for i, t, g in rows if g and t and zlib.crc32(str(i).encode()) % 5 and any(map(str.isalpha, t))]
    assert model.languages == sorted({g for _, g in taught}) == ["en", "fr"]
    for g, prototype in zip(model.languages, model.prototypes):
        want = sum((x := bundle_by_hand(t, L.DIMENSIONS)) / np.linalg.norm(x) for t, k in taught if k == g)
        assert np.allclose(prototype, want / np.linalg.norm(want), atol=1e-5)
    got = L.scored(docs, model).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.lang_pred) for r in got) == sorted(
        (i is None, i or 0, "und" if not t or not any(map(str.isalpha, t)) else "en" if t.startswith("the") else "fr" if t.startswith("le") else
         next(r.lang_pred for r in got if r.doc_id == 11)) for i, t, _ in rows)
    assert all(0 <= r.score <= 1 and (r.score == 0) == (r.lang_pred == "und") or r.doc_id == 11 for r in got)
    twins = [(r.lang_pred, r.score) for r in got if r.doc_id == 10]
    assert twins[0] == twins[1]
    none = L.fitted(docs.limit(0))
    assert none.languages == [] and {r.lang_pred for r in L.scored(docs, none).collect()} == {"und"}
    assert L.scored(docs.limit(0), model).count() == 0
