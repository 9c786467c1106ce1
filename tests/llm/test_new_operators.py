"""Exact dedup, conversation repair and fill-in-middle against brute force and SQL; odd rows included."""

import glob
import hashlib
import itertools
import os
import random
import re
import zlib
from collections import defaultdict

import duckdb
import pytest

pytest.importorskip("tessera.llm")
from pyspark.sql import functions as F  # noqa: E402

from tessera.llm import exact, infill, oracles, queries, repair  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, id string, hash string, n long, keep_id long"  # extra columns that clash


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def docs_frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "x", "h", 1, 5) for i, t in rows], DOCS).repartition(3)


TEXTS = ["a", "b", "a", None, "", "  ", "a ", "A", "a", "東京\n", "東京\n", "x" * 1_000_000, "x" * 1_000_000, "x" * 999_999 + "y", "one\ntwo\nthree", "<S>", "a<M", "\n\n\n", "no end\nat all", "\r\n\r\n"] + ["same"] * 40
ROWS = [(i * 3 % 61, t) for i, t in enumerate(TEXTS)] + [(0, "a"), (7, "same"), (None, "same"), (None, "lone"), (None, None), (None, "twin"), (None, "twin")]


@pytest.mark.parametrize("weak", [False, True])
@pytest.mark.parametrize("keep", ["smallest", "largest"])
@pytest.mark.parametrize("hot", [1, 2000])
def test_exact_duplicates(spark, weak, keep, hot):
    """weak: a hash that most texts share, so only comparing bytes tells them apart."""
    groups = defaultdict(list)
    for i, t in ROWS:
        groups[t or ""].append(i)
    best = {t: (min if keep == "smallest" else max)([i for i in ids if i is not None], default=None) for t, ids in groups.items()}
    want = [(i, best[t or ""], len(groups[t or ""]), i == best[t or ""], sha(t or "")) for i, t in ROWS]
    hashed = (lambda text: F.unhex(F.md5(F.length(text).cast("string")))) if weak else exact.md5_hash
    found = exact.exact_duplicates(docs_frame(spark, ROWS), keep=keep, content_hash=hashed, hot_groups=hot)
    assert found.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)
    if not weak:
        kept = exact.without_copies(docs_frame(spark, ROWS), keep=keep)
        assert kept.columns == [c.split()[0] for c in DOCS.split(", ")]
        assert sorted((r.text or "" for r in kept.collect())) == sorted(groups)


def test_exact_normalised(spark):
    found = exact.exact_duplicates(docs_frame(spark, [(1, "A b"), (2, "a B"), (3, "c")]), normalise=F.lower)
    assert sorted(map(tuple, found.collect())) == [(1, 1, 2, True, sha("a b")), (2, 1, 2, False, sha("a b")), (3, 3, 1, True, sha("c"))]


def test_empty_tables(spark):
    docs = spark.createDataFrame([], DOCS)
    chats = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert exact.exact_duplicates(docs).count() == exact.without_copies(docs).count() == infill.fill_in_middle(docs).count() == 0
    assert repair.damage_and_repair(chats).count() == repair.repair_reports(chats).count() == repair.repaired_messages(chats).count() == 0


@pytest.mark.parametrize("name", ["op11_exact_dedup", "op12_conversation_repair", "op13_fill_in_middle"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    wanted = con.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in wanted.description]
    found = queries.QUERIES[name](spark, SF_DIR)
    assert sorted(found.columns) == sorted(columns)
    assert sorted(map(tuple, found.select(columns).collect()), key=str) == sorted(wanted.fetchall(), key=str)


# Fill-in-middle.


def cut_by_list(i, text, unit=infill.LINES, rate=100, spm=50, seed=7):
    units = re.findall(unit, text)
    h = [int(x, 16) for x in re.findall("." * 8, sha(f"{seed}:{'' if i is None else i}"))[:4]]
    low, high = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if text == "" or re.search("<[PSM]>", text) or h[2] % 100 >= rate:
        return i, len(units), "plain", None, None, text
    spm_form = h[3] % 100 < spm
    return i, len(units), "spm" if spm_form else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm_form else f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("rate, spm, unit", [(100, 50, infill.LINES), (60, 20, infill.LINES), (100, 100, r"\S+\s*|\s+"), (100, 0, r"(?s:.)")])
def test_fill_in_middle(spark, rate, spm, unit):
    r = random.Random(rate)
    rows = ROWS[:16] + [(i, "".join(r.choices(["ab", "\n", "é", "<", "S>", "P", "\r", " "], k=r.randint(0, 30)))) for i in range(200, 400)] + [(None, "x\ny\nz"), (5, "\n" * 200_000)]
    if unit.startswith("(?s"):
        rows = [x for x in rows if len(x[1] or "") < 1000]
    found = infill.fill_in_middle(docs_frame(spark, rows), unit=unit, rate=rate, spm_rate=spm).withColumn("again", infill.restored("output", "form")).collect()
    assert sorted((tuple(x)[:6] for x in found), key=str) == sorted((cut_by_list(i, t or "", unit, rate, spm) for i, t in rows), key=str)
    assert sorted(x.again for x in found) == sorted(t or "" for _, t in rows)
    assert {x.form for x in found} >= {"plain", "spm" if spm else "psm"}


def test_marks_must_not_overlap():
    for bad in (("<P>", "<P>", "<M>"), ("", "a", "b"), ("aba", "c", "d"), ("ab", "bc", "d"), ("abc", "b", "d")):
        with pytest.raises(ValueError):
            infill.Marks(*bad).check()
    infill.Marks("[pre]", "[suf]", "[mid]").check()


# Conversation repair.

STEPS = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})


def cheapest(rows):
    """(cost, audit, roles and texts) by trying every string of edits up to a length; rows: (role, text, fault)."""
    best = None
    for n in range(0, 2 * len(rows) + 4):
        for word in itertools.product("DIKR", repeat=n):
            if sum(x != "I" for x in word) != len(rows):
                continue
            q, i, cost, out = 0, 0, 0, []
            for x in word:
                role, text, fault = rows[i] if x != "I" else (None, "", "")
                i += x != "I"
                made = "assistant" if q == 2 else "user"
                if x == "D":
                    cost += 4
                    continue
                if x == "K":
                    made = role if role[:1] in STEPS[q] else None
                if made is None or x != "I" and fault in ("blank", "duplicate"):
                    break
                cost += (0 if x == "K" else 3) + 3 * (fault == "truncated")
                q = STEPS[q][made[:1]]
                out.append((made, text))
            else:
                if q in (0, 3):
                    best = min(best or (10**9, "", []), (cost, "".join(word), out))
    return best


def faults(rows):
    """Rows in order with their faults; rows: (turn, role, text)."""
    out, seen = [], set()
    for _, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).digest())):
        marks = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append((role, text, "blank" if not marks else "duplicate" if (role, text) in seen else "truncated" if marks[-1] not in ".!?" else ""))
        seen.add((role, text))
    return out


def report(rows, edits=None):
    told = faults(rows)
    turns = {t for t, _, _ in rows if t is not None}
    cost, audit, out = edits or cheapest(told)
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(told, told[1:]))
    counts = [sum(f == x for *_, f in told) for x in ("blank", "duplicate", "truncated")]
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *counts, illegal, cost, audit, sha("\n".join(f"{a}:{b}" for a, b in out)))


def chats_frame(spark, rows):
    return spark.createDataFrame([(c, t, r, x, 1, "e") for c, t, r, x in rows], "conv_id long, turn long, role string, text string, part int, audit string").repartition(3)


def some_chats(n, longest, seed):
    r = random.Random(seed)
    rows = []
    for c in range(n):
        size = r.randint(1, longest)
        for _ in range(size):
            rows.append((c, r.choice([None, *range(2 * size)]), r.choice(["system", "user", "user", "assistant", "assistant", "tool", "unknown", ""]), r.choice(["Yes.", "No!", "half", "", " \n", "why?\x0b ", "東京。", "Yes."])))
    return rows


def test_repair_against_every_edit(spark):
    rows = some_chats(60, 3, 1) + [(None, 1, None, None), (None, None, "user", "Hi."), (1000, None, "user", None)]
    plain = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    want = {c: report([x[1:] for x in plain if x[0] == c]) for c in {x[0] for x in plain}}
    found = repair.repair_reports(chats_frame(spark, rows)).collect()
    assert {x[0]: tuple(x)[1:] for x in found} == want and len(found) == len(want)


def by_sql(rows):
    """REPAIR without the damage."""
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    told = con.execute(re.sub(r"% 20 AS kind", "% 20 * 0 + 9 AS kind", oracles.REPAIR)).fetchall()
    return sorted(told, key=str)


@pytest.mark.parametrize("unit_rows", [1, 7, 1 << 16])
def test_repair_of_long_and_cut_conversations(spark, unit_rows):
    """One conversation holds most rows, so that it lies in several tasks and its units are chained."""
    rows = some_chats(30, 12, 2) + [(99, *x[1:]) for x in some_chats(1, 1, 3)] + [(50, t, *x[2:]) for t, x in enumerate(some_chats(120, 6, 4))]
    r = random.Random(9)
    rows = [(c, t, role, text + (f" {r.randint(0, 60)}." if c == 50 and text.strip() else "")) for c, t, role, text in rows]
    want = by_sql(rows)
    chats = chats_frame(spark, rows)
    assert sorted(map(tuple, repair.repair_reports(chats, unit_rows=unit_rows).collect()), key=str) == want
    parts = defaultdict(list)
    for m in repair.repaired_messages(chats, unit_rows=unit_rows).collect():
        parts[m.conv_id].append((m.part, m.seq, m.k, m.edit, m.role, m.text))
    told = {c: ("".join(m[3] for m in sorted(ms)), sha("\n".join(f"{m[4]}:{m[5]}" for m in sorted(ms) if m[3] != "D"))) for c, ms in parts.items()}
    assert told == {w[0]: w[7:9] for w in want}


def test_damage(spark):
    rows = [(c, t, "assistant", f"One. Two! Three? {c}") for c in range(40) for t in (*range(4), None)] + [(None, None, None, None), (7, 1, None, None)]
    want = []
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        row = (c, t, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
        want += [row] * (0 if kind == 0 else 2 if kind == 3 else 1)
    assert sorted(map(tuple, repair.damaged(chats_frame(spark, rows)).collect()), key=str) == sorted(want, key=str)
    whole = repair.damage_and_repair(chats_frame(spark, [(3, t, "user", "x.") for t in range(100) if zlib.crc32(f"3:{t}".encode()) % 20 == 0])).collect()
    assert [tuple(x) for x in whole] == [(3, 0, 0, 0, 0, 0, 0, "", sha(""))]
