import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from slmeval.llm import conversations as cv
from slmeval.llm import queries
from slmeval.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]")
LEGAL = re.compile(r"(s?(ua)+)?\Z")
INSERTS = [(), ("u",), ("a",), ("u", "a"), ("a", "u")]


def plain_faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        body = WORD.findall(text)
        if not body:
            out.append("blank")
        elif (role, text) in seen:
            out.append("duplicate")
        else:
            out.append(None if body[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def choices(row, fault):
    """(cost, letter, new role) of a turn."""
    yield 4, "D", None
    if fault not in ("blank", "duplicate"):
        more = 3 if fault == "truncated" else 0
        yield more, "K", row[1]
        yield 3 + more, "R", "user"
        yield 3 + more, "R", "assistant"


def exhaustive(rows):
    """Try every combination of edits, with up to two inserted turns at any place."""
    fault, best = plain_faults(rows), None
    full = {"u": "user", "a": "assistant"}
    for gaps in itertools.product(INSERTS, repeat=len(rows) + 1):
        for picks in itertools.product(*(list(choices(r, f)) for r, f in zip(rows, fault))):
            cost, audit, lines = 0, "", []
            for i in range(len(rows) + 1):
                cost, audit = cost + 3 * len(gaps[i]), audit + "I" * len(gaps[i])
                lines += [(full[g], "") for g in gaps[i]]
                if i < len(rows):
                    cost, audit = cost + picks[i][0], audit + picks[i][1]
                    if picks[i][2] is not None:
                        lines.append((picks[i][2], rows[i][2]))
            if LEGAL.match("".join(r[:1] or "-" for r, _ in lines)) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, "\n".join(f"{r}:{t}" for r, t in lines))
    return best


def plain(rows):
    """The same minimum by dynamic programming over whole audits: state 0 start, 1 after s, 2 after u, 3 after a."""
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    best = {0: (0, "", ())}

    def inserts(now):
        for _ in range(3):
            for s, (c, a, t) in list(now.items()):
                symbol = "a" if s == 2 else "u"
                new = (c + 3, a + "I", t + (({"u": "user", "a": "assistant"}[symbol], ""),))
                to = step[s, symbol]
                if to not in now or new < now[to]:
                    now[to] = new
        return now

    for row, fault in zip(rows, plain_faults(rows)):
        new = {}
        # every state with each number of inserts is tried, as a dearer prefix never helps but a longer one may tie
        for s0, way in best.items():
            chain, s, w = [(s0, way)], s0, way
            for _ in range(3):
                symbol = "a" if s == 2 else "u"
                s, w = step[s, symbol], (w[0] + 3, w[1] + "I", w[2] + (({"u": "user", "a": "assistant"}[symbol], ""),))
                chain.append((s, w))
            for s, (c, a, t) in chain:
                for cost, letter, role in choices(row, fault):
                    to = s if role is None else step.get((s, role[:1]))
                    if to is None:
                        continue
                    cand = (c + cost, a + letter, t + (((role, row[2]),) if role is not None else ()))
                    if to not in new or cand[:2] < new[to][:2]:
                        new[to] = cand
        best = new
    ends = inserts(dict(best))
    c, a, t = min((ends[s] for s in (0, 3) if s in ends), key=lambda x: x[:2])
    return c, a, "\n".join(f"{r}:{x}" for r, x in t)


def plain_summary(rows):
    """``rows``: (turn, role, text) in order."""
    fault, turns = plain_faults(rows), [t for t, _, _ in rows if t is not None]
    cost, audit, text = plain(rows)
    first = [r[:1] for _, r, _ in rows]
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, fault.count("blank"), fault.count("duplicate"),
            fault.count("truncated"), sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:])), cost, audit,
            hashlib.sha256(text.encode()).hexdigest())


def damage(conv, turn, role, text):
    conv, turn_, role, text = (" " if x is None else x for x in (conv, turn, role, text))
    kind = zlib.crc32(f"{conv}:{turn_}".encode()) % 20
    if kind == 0:
        return []
    text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
    return [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)


def plain_query(rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv] += damage(conv, turn, role, text)
    none = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])
    return {c: plain_summary(sorted(x, key=key)) if x else none for c, x in by.items()}


def summary_of(rows):
    return {r[0]: tuple(r[1:]) for r in rows}


@pytest.mark.parametrize("seed", range(60))
def test_repair_equals_exhaustive_search(seed):
    rnd = random.Random(seed)
    rows = [(i, rnd.choice(["system", "user", "assistant", "tool", ""]), rnd.choice(["a.", "b!", "c", "", "d?"]))
            for i in range(rnd.randint(0, 3))]
    repair = cv.Repair()
    for (_, role, _), fault in zip(rows, plain_faults(rows)):
        repair.feed(role[:1], *cv._fault_free(fault))
    expected = exhaustive(rows)
    assert repair.finish() == expected[:2] == plain(rows)[:2]
    assert plain(rows)[2] == expected[2]


@pytest.mark.parametrize("seed", range(40))
def test_longer_conversations_and_segments(seed):
    rnd = random.Random(100 + seed)
    rows = [(i, rnd.choice(["system", "user", "assistant", "user", "assistant", "tool"]), rnd.choice(["a.", "b!", "c", "", "d?", f"{i}."]))
            for i in range(rnd.randint(4, 60))]
    faults = plain_faults(rows)
    repair = cv.Repair()
    for (_, role, _), fault in zip(rows, faults):
        repair.feed(role[:1], *cv._fault_free(fault))
    cost, audit, text = plain(rows)
    assert repair.finish() == (cost, audit)
    turns = [(r, t, f, n, n) for (n, r, t), f in zip(rows, faults)]
    made = cv._edit_rows(0, cv.STACKS[0], turns, audit)
    assert "\n".join(f"{e[6]}:{e[7]}" for e in made if e[6] is not None) == text and sum(e[9] for e in made) == cost
    assert [e[1:3] for e in made] == sorted({e[1:3] for e in made})
    # cut into segments, folded: the same audit
    import pyarrow as pa
    cuts = sorted(rnd.sample(range(1, len(rows)), min(3, len(rows) - 1)))
    tables = []
    for pid, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(rows)])):
        part = pa.table({"conv": [7] * (b - a), "pid": pa.array([pid] * (b - a), pa.int32()), "pos": list(range(a, b)),
                         "role": [r[1] for r in rows[a:b]], "fault": pa.array(faults[a:b], pa.string())})
        tables.append(cv._segment(part))
    ways = sorted(cv._fold(pa.concat_tables(tables)).to_pylist(), key=lambda r: r["pid"])
    assert "".join(w["audit"] for w in ways) == audit


def test_query_by_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = summary_of(QUERIES["op11_glr_repair"](spark, SF).collect())
    assert got == plain_query(rows)


ROWS = [(None, 1, "user", "a."), (None, 2, "assistant", None), (None, None, None, "b."), (1, None, "user", "x."), (1, None, "assistant", "y."),
        (2, 0, "", "z."), (2, 1, "tool", "q"), (3, 5, "user", "same."), (3, 5, "user", "same."), (3, 6, "user", "same."),
        (4, 9, "assistant", "é" * 50_000 + "!"), (5, -3, "system", "s."), (5, 10, "user", "\x0b.\x0c"), (6, 1, "user", "a ")]
ROWS += [(9, i, ("user", "assistant")[i % 2 if i % 17 else 1], f"hot {i % 400}" + ".!?"[i % 3] * (i % 11 > 0)) for i in range(1500)]
ROWS += [(9, 3, "user", "equal.")] * 200


@pytest.mark.parametrize("parts", [1, 9])
def test_edges_and_hot_conversation(spark, parts):
    df = spark.createDataFrame([(*r, 1, "x") for r in ROWS], "conv_id long, turn long, role string, text string, pos int, Fault string")
    got = queries.repaired_summaries(df, queries.damaged(df), num_partitions=parts).collect()
    assert summary_of(got) == plain_query(ROWS)
    assert len(got) == len({r[0] for r in ROWS})


def test_edits_table(spark):
    df = spark.createDataFrame([(1, 0, "user", "hi."), (1, 1, "user", "there."), (2, 0, "assistant", "no")],
                               "conv_id long, turn long, role string, text string")
    edits, summary = cv.repair_conversations(df)
    assert edits.columns == ["conv", "pos", "step", "turn", "was", "action", "role", "text", "fault", "cost"]
    got = [(r.conv, r.action, r.role, r.text, r.cost) for r in edits.orderBy("conv", "pos", "step").collect()]
    assert got == [(1, "K", "user", "hi.", 0), (1, "R", "assistant", "there.", 3), (2, "D", None, "no", 4)]
    assert {(r.conv, r.cost, r.audit) for r in summary.collect()} == {(1, 3, "KR"), (2, 4, "D")}


def test_no_rows(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert queries.repaired_summaries(df, queries.damaged(df)).count() == 0
    gone = spark.createDataFrame([(i, 0, "user", "x.") for i in range(60)], df.schema)
    got = summary_of(queries.repaired_summaries(gone, queries.damaged(gone).filter(F.lit(False))).collect())
    assert set(got.values()) == {(0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())} and len(got) == 60
