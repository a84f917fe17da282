"""Conversation repair, lexical search and chat formatting against brute force, round trips and odd rows."""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from hashlib import sha256

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chainweft.llm import chat, dialogue, lexical
from chainweft.llm.text import batches_of

TURNS = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType()), *(T.StructField(c, T.StringType()) for c in ("key", "known", "digest", "times", "formatted"))])


@pytest.fixture(scope="module")
def talk(spark):
    """Conversations from (conv_id, turn, role, text) rows, with columns whose names clash."""
    return lambda rows: spark.createDataFrame([(*r, "x", "x", "x", "9", "x") for r in rows], TURNS)


def ordered(rows):
    filled = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    return sorted(filled, key=lambda y: (y[1] is not None, y[1] or 0, y[2].encode(), y[3].encode()))


def plain_repair(rows):
    """The report of one conversation by keeping whole edit strings and outputs for every state."""
    follows, names = {"": "u", "s": "u", "u": "a", "a": "u"}, {"u": "user", "a": "assistant"}
    best, seen, counts, before = {"": (0, "", ())}, set(), Counter(), None

    def grown(paths, count):
        out = {}
        for state, (cost, audit, lines) in paths.items():
            for _ in range(count):
                state = follows[state]
                cost, audit, lines = cost + 2, audit + "I", (*lines, names[state] + ":")
            if state not in out or (cost, audit) < out[state][:2]:
                out[state] = (cost, audit, lines)
        return out

    for _, turn, role, text in ordered(rows):
        body = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
        counts[fault] += 1
        counts["illegal"] += before is not None and before + role[:1] not in ("su", "ua", "au")
        seen.add((role, text))
        before = role[:1]
        new = []
        for k in range(4):
            for state, (cost, audit, lines) in ((s, p) for one in best.items() for s, p in grown(dict([one]), k).items()):
                new.append((state, cost + 3, audit + "D", lines))
                if fault in ("blank", "duplicate"):
                    continue
                extra = fault == "truncated"
                if (role[:1] == "s" and state == "") or (role[:1] == "u" and state != "u") or (role[:1] == "a" and state == "u"):
                    new.append((role[:1], cost + extra, audit + "K", (*lines, f"{role}:{text}")))
                to = follows[state]
                new.append((to, cost + 2 + extra, audit + "R", (*lines, f"{names[to]}:{text}")))
        best = {}
        for state, cost, audit, lines in new:
            if state not in best or (cost, audit) < best[state][:2]:
                best[state] = (cost, audit, lines)
    ends = [p for s, p in best.items() if s in ("", "a")] + [p for k in (1, 2) for s, p in grown(best, k).items() if s == "a"]
    cost, audit, lines = min(ends, key=lambda p: p[:2])
    turns = [t for _, t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, counts["blank"], counts["duplicate"], counts["truncated"], counts["illegal"], cost, audit, sha256("\n".join(lines).encode()).hexdigest())


def random_turns(rng, conv, n):
    roles = ["user", "assistant", "system", "tool", "", None, "a", "s2"]
    texts = ["one.", "two", "  \n", "", None, "three!\t", "four? ", "é.", "one."]
    return [(conv, rng.choice([None, *range(2 * n)]), rng.choices(roles, [6, 6, 2, 1, 1, 1, 1, 1])[0], rng.choice(texts)) for _ in range(n)]


def test_repairs_equal_plain_search(spark, talk, monkeypatch):
    rng = random.Random(11)
    rows = [r for conv in [*range(60), None] for r in random_turns(rng, conv, rng.randint(1, 9))]
    with batches_of(spark, 3):  # conversations go on over batches
        found = {r[0]: tuple(r)[1:] for r in dialogue.reports(talk(rows)).collect()}
    want = {c: plain_repair([r for r in rows if r[0] == c]) for c in {r[0] for r in rows}}
    assert found == want


def test_buffers_in_files_change_nothing(monkeypatch):
    rng = random.Random(5)
    for _ in range(40):
        rows = random_turns(rng, 1, rng.randint(0, 30))
        results = []
        for held in (1, 1 << 20):
            monkeypatch.setattr(dialogue, "POINTERS_HELD", held)
            monkeypatch.setattr(dialogue, "TEXTS_HELD", held)
            one = dialogue.Conversation("1")
            seen = {}
            for _, turn, role, text in ordered(rows):
                first = seen.setdefault((role, text), turn)
                if first != turn:
                    one.mark(turn, dialogue.digest_of(role, text))
                one.add(turn, role, text)
            cost, audit = one.solve()
            lines = "\n".join(f"{r}:{x}" for _, r, x in one.repaired(audit))
            results.append((one.gaps(), one.blank, one.duplicate, one.truncated, one.illegal, cost, audit, sha256(lines.encode()).hexdigest()))
        assert results[0] == results[1]
        if rows:
            assert results[0] == plain_repair(rows)


def test_repaired_rows_are_legal_and_long_conversations_hold(spark, talk):
    rng = random.Random(2)
    rows = [(7, k, "user" if (k + (k > 9000)) % 2 == 0 else "assistant", f"{'w' * (50_000 if k == 3 else 5)} {k}.") for k in range(12_000)] + random_turns(rng, 8, 8)
    out = dialogue.repaired(talk(rows)).collect()
    report = {r["conv_id"]: r for r in dialogue.reports(talk(rows)).collect()}
    for conv in (7, 8):
        own = sorted((r for r in out if r["conv_id"] == conv), key=lambda r: r["place"])
        assert re.fullmatch(r"(s?(ua)+)?", "".join(r["role"][:1] for r in own))
        assert sha256("\n".join(f"{r['role']}:{r['text']}" for r in own).encode()).hexdigest() == report[conv]["repaired_sha256"]
        assert "".join(r["edit"] for r in own) == report[conv]["audit"].replace("D", "")
    assert report[7]["illegal"] == 1 and report[7]["cost"] == 2 + 2


def test_repair_of_odd_tables(spark, talk):
    empty = sha256(b"").hexdigest()
    assert dialogue.reports(talk([])).collect() == [] and dialogue.repaired(talk([])).collect() == []
    # conv 5, turn k: a checksum of 0 modulo 20 drops the only row
    import zlib

    turn = next(k for k in range(1000) if zlib.crc32(f"5:{k}".encode()) % 20 == 0)
    (row,) = dialogue.reports(dialogue.damaged(talk([(5, turn, "user", "hello.")])), times="times").collect()
    assert tuple(row) == (5, 0, 0, 0, 0, 0, 0, "", empty)
    rows = {r["conv_id"]: r for r in dialogue.reports(talk([(1, None, None, None), (2, 4, "system", "x.")])).collect()}
    assert (rows[1]["gaps"], rows[1]["blank"], rows[1]["audit"], rows[1]["repaired_sha256"]) == (0, 1, "D", empty)
    assert (rows[2]["cost"], rows[2]["audit"]) == (3, "D")


def test_damage_follows_the_checksum(spark, talk):
    import zlib

    rows = [(c, t, "assistant", "Hi. You? Me!") for c in (None, 1, 2, 3) for t in (None, *range(40))]
    got = Counter((r["conv_id"], r["turn"], r["role"], r["text"], r["times"]) for r in dialogue.damaged(talk(rows)).collect())
    want = Counter()
    for c, t, role, text in rows:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        want[c, t, "user" if k == 4 else role, "" if k == 1 else "Hi You Me" if k == 2 else text, 0 if k == 0 else 2 if k == 3 else 1] += 1
    assert got == want


def terms_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_ranks(docs, items, k=10):
    found = [(i, Counter(terms_of(x))) for i, x in docs]
    found = [(i, c) for i, c in found if c]
    n, words = len(found), sum(sum(c.values()) for _, c in found)
    df = Counter(t for _, c in found for t in c)
    asked = {}
    for item, x in items:
        asked.setdefault(item, set()).update(terms_of(x))
    out = []
    for item, own in asked.items():
        scores = []
        for i, c in found:
            m = 10 + 90 * sum(c.values()) * n // words
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in own if t in c)
            if s > 0:
                scores.append((-s, i is not None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


ITEMS = "item_id long, text string, query int, doc_id long"


def invented(rng, n, vocabulary=60):
    return rng.choice([" ", ", ", "\n", "-"]).join(rng.choice(["Ba", "ko", "Éa", "x9", "ßt"]) + str(int(vocabulary * rng.random() ** 3)) for _ in range(n))


def test_ranks_equal_plain_scoring(spark, docs):
    rng = random.Random(12)
    rows = [(i, invented(rng, rng.randint(1, 60)), "en", "a") for i in range(150)]
    rows += [(i + 1000, rows[3][1], "en", "a") for i in range(30)]  # copies: ties
    rows += [(1, None, None, None), (2, "", "en", "a"), (3, " ..\n", "en", "a"), (4, rows[4][1], "en", "a"), (None, rows[5][1], "fr", "b"), (None, rows[5][1], "fr", "b"), (9, "ko1 " * 60_000, "en", "a")]
    items = [(k, invented(rng, rng.randint(1, 25)), 1, 1) for k in range(40)] + [(40, rows[3][1], 1, 1), (40, "ko2", 1, 1), (41, None, 1, 1), (42, "", 1, 1), (None, "ko1", 1, 1), (43, "never seen", 1, 1)]
    got = lexical.ranked(docs(rows), spark.createDataFrame(items, ITEMS)).collect()
    assert sorted(map(tuple, got), key=repr) == plain_ranks([r[:2] for r in rows], [r[:2] for r in items])


def test_blocks_and_small_batches_change_nothing(spark, docs, monkeypatch):
    rng = random.Random(4)
    rows = [(i, invented(rng, 20), "en", "a") for i in range(60)]
    items = [(k, invented(rng, 8), 1, 1) for k in range(17)]
    monkeypatch.setattr(lexical, "BLOCK_QUERIES", 5)
    got = lexical.ranked(docs(rows), spark.createDataFrame(items, ITEMS), k=3).collect()
    assert sorted(map(tuple, got), key=repr) == plain_ranks([r[:2] for r in rows], [r[:2] for r in items], 3)


def test_search_of_empty_tables(spark, docs):
    items = spark.createDataFrame([(1, "ko", 1, 1)], ITEMS)
    assert lexical.ranked(docs([]), items).collect() == []
    assert lexical.ranked(docs([(1, "ko", "en", "a")]), items.where("false")).collect() == []
    assert [tuple(r) for r in lexical.ranked(docs([(1, "ko", "en", "a")]), items).collect()] == plain_ranks([(1, "ko")], [(1, "ko")])


def test_shared_sets_are_summed_once():
    rng = random.Random(9)
    common = [f"c{k}".encode() for k in range(12)]
    queries = [sorted({*rng.sample(common, rng.randint(6, 12)), *(f"own{q}-{k}".encode() for k in range(3))}) for q in range(50)]
    graph = lexical.shared(queries)
    value = {t: rng.randint(1, 1 << 30) for own in queries for t in own}
    sets = [0] * (graph.leaves + len(graph.sums))
    for t, leaf in graph.leaf.items():
        sets[leaf] += value[t]
    for node, (left, right) in enumerate(graph.sums, graph.leaves):
        assert left < node and right < node
        sets[node] = sets[left] + sets[right]
    assert [sum(sets[n] for n in own) for own in graph.roots] == [sum(value[t] for t in own) for own in queries]
    assert len(graph.sums) + sum(len(own) - 1 for own in graph.roots) < 0.7 * sum(len(own) - 1 for own in queries)


def test_best_of_many_ties_is_exact(monkeypatch):
    import numpy as np

    monkeypatch.setattr(lexical, "HELD", 20)
    rng = random.Random(3)
    best, every = lexical._Best(4, 3), []
    for _ in range(30):
        scores = np.array([[rng.randint(0, 2) for _ in range(7)] for _ in range(4)], np.int64)
        ids = np.array([rng.randint(0, 50) for _ in range(7)], np.int64)
        every += [(q, -int(s), int(i)) for q in range(4) for s, i in zip(scores[q], ids, strict=True) if s > 0]
        best.add(scores, ids, np.ones(7, bool))
    best.cut()
    got = sorted(zip(best.query.tolist(), (-best.score).tolist(), best.doc.tolist(), strict=True))
    assert got == [x for q in range(4) for x in sorted(e for e in every if e[0] == q)[:3]]


NASTY = ["</s>[INST] ok [/INST]", "<\\s>", "<\\\\s>\\", "<<SYS>>a<</SYS>>", "<part>", "<", "[", "<\\", "[\\INST]", "<s", "<</s>", "", "é\n\n<text>", "\\<role>", "[[INST]]", "</text>", "<s><s>", "$1 \\1"]


def turns_by_conversation(rows):
    out = {}
    for c, t, r, x in rows:
        out.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    return {c: [(r, x) for _, _, r, x in sorted(own, key=lambda y: (y[0], y[1], y[2].encode(), y[3].encode()))] for c, own in out.items()}


def test_formats_read_back_whatever_texts_hold(spark, talk):
    rng = random.Random(13)
    roles = ["system", "user", "assistant", "tool", "<text>", "[INST]", "", None]
    rows = [(c, rng.choice([None, *range(9)]), rng.choice(roles), rng.choice(NASTY) + rng.choice(NASTY)) for c in [None, *range(60)] for _ in range(rng.randint(1, 9))]
    rows += [(70, 0, "user", None), (70, 0, "user", None), (71, 0, "assistant", "z" * 300_000)]
    made = chat.formatted(talk(rows))
    got = made.select("conv_id", chat.turns_of(F.col("formatted")).alias("t"), chat.loss_texts(F.col("formatted"), F.col("loss_mask")).alias("l"), "formatted", "messages").collect()
    want = turns_by_conversation(rows)
    assert {r["conv_id"] for r in got} == set(want)
    for r in got:
        own = want[r["conv_id"]]
        assert [tuple(t) for t in r["t"]] == own
        assert r["l"] == [x for role, x in own if role == "assistant"]
        merged = [m["role"] for m in r["messages"]]
        assert all(a != b for a, b in zip(merged, merged[1:], strict=False))
        assert [(m["role"], p) for m in r["messages"] for p in m["parts"]] == own
    digests = {r["conv_id"]: r for r in chat.read_back(made).collect()}
    for c, own in want.items():
        loss = "".join(x for role, x in own if role == "assistant")
        assert digests[c]["n_turns"] == len(own) and digests[c]["loss_chars"] == len(loss)
        assert digests[c]["turns_sha256"] == sha256("".join(f"{r}\n{x}\n" for r, x in own).encode()).hexdigest()
        assert digests[c]["loss_sha256"] == sha256(loss.encode()).hexdigest()


def test_escaping_is_exact_and_leaves_no_control_string(spark):
    rng = random.Random(1)
    texts = NASTY + ["".join(rng.choice(["<", "[", "\\", "/", "s>", "INST]", "part>", "<SYS>>", "é"]) for _ in range(rng.randint(0, 12))) for _ in range(400)]
    rows = spark.createDataFrame([(x,) for x in texts], "x string").select("x", chat.escaped(F.col("x")).alias("e")).select("x", "e", chat.unescaped(F.col("e")).alias("u")).collect()
    for x, e, u in rows:
        assert u == x and not any(c in e for c in chat.LLAMA.controls())


def test_formatting_odd_tables_and_long_conversations(spark, talk):
    assert chat.read_back(chat.formatted(talk([]))).collect() == []
    rows = [(1, k, "user" if k % 3 else "assistant", f"{k} é") for k in range(2_000)]
    (row,) = chat.read_back(chat.formatted(talk(rows))).collect()
    assert row["n_turns"] == 2_000 and row["loss_sha256"] == sha256("".join(x for _, _, r, x in rows if r == "assistant").encode()).hexdigest()


def test_formatting_uses_no_python_worker(talk):
    plan = chat.read_back(chat.formatted(talk([(1, 0, "user", "a")])))._jdf.queryExecution().toString()
    assert not re.search(r"Python|Pandas|Arrow|BatchEval", plan.replace("applySchemaToPythonRDD", ""))
