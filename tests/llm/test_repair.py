import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from rostrum.llm import queries, repair

SCHEMA = "conv_id long, turn long, role string, text string"
NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
PUT = {"": "user", "s": "user", "u": "assistant", "a": "user"}


def cheapest(rows):
    """(cost, audit, repaired rows) by the least (cost, initials) from each place and state, without a table of states."""
    states = ["", "s", "u", "a"]
    best = [{} for _ in range(len(rows) + 1)]
    for i in range(len(rows), -1, -1):
        here = {q: (0, "", []) if i == len(rows) and q in ("", "a") else (10**9, "", []) for q in states}
        for q in states if i < len(rows) else ():
            role, text, fault = rows[i]
            add = lambda c, letter, out, nxt: here.__setitem__(q, min(here[q], (nxt[0] + c, letter + nxt[1], out + nxt[2])))  # noqa: B023, E731
            add(4, "D", [], best[i + 1][q])
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                add(3 + more, "R", [(PUT[q], text)], best[i + 1][NEXT[q, PUT[q][0]]])
                if (q, role[:1]) in NEXT:
                    add(more, "K", [(role, text)], best[i + 1][NEXT[q, role[:1]]])
        for _ in range(5):
            for q in states:
                cost, letters, out = here[NEXT[q, PUT[q][0]]]
                here[q] = min(here[q], (cost + 3, "I" + letters, [(PUT[q], ""), *out]))
        best[i] = here
    return best[0][""]


def brute(table, damage=True):
    """The contract in plain Python, a conversation at a time."""
    out = {}
    for conv in {r[0] for r in table}:
        rows = []
        for c, turn, role, text in (r for r in table if r[0] == conv):
            read = lambda x: " " if x is None else str(x)
            kind, role, text = zlib.crc32(f"{read(c)}:{read(turn)}".encode()) % 20 if damage else 9, read(role), read(text)
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            rows += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
        seen, judged, turns = set(), [], [r[0] for r in rows if r[0] is not None]
        for _, role, text in rows:
            said = re.findall(r"[^\x20\x09-\x0D]", text)
            judged.append((role, text, "blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else None))
            seen.add((role, text))
        cost, audit, fixed = cheapest(judged)
        n = lambda fault: sum(f == fault for *_, f in judged)  # noqa: B023, E731
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, n("blank"), n("duplicate"), n("truncated"),
            sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(judged, judged[1:], strict=False)),
            cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in fixed).encode()).hexdigest(),
        )
    return out


def made(n=120, seed=1):
    rng = random.Random(seed)
    rows = []
    for conv in range(n):
        turn = rng.randint(0, 3)
        for _ in range(rng.randint(0, 14)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", "agent", "Ärger", None])
            text = rng.choice(["Yes.", "No!", "Why?", "cut off", "", " \t\n", None, "same words.", "same words.", "fin. \x0b", "non ", f"text {rng.random()}.", f"open {rng.random()}"])
            rows.append((conv if conv % 17 else None, None if rng.random() < 0.05 else turn, role, text))
            turn += rng.choice([0, 1, 1, 1, 2, 5])
    rows += [(10**6, t, "user", None) for t in range(3)] + [(10**6 + 1, None, "assistant", "All null turns.")] + [(10**6 + 2, 5, "user", "copy")] * 40
    rows += [(2**60 + k, 2**60 + k, "user" if k % 2 else "assistant", "Ids of many bits.") for k in range(4)]
    return rows


def summed(rows, **kw):
    out = repair.summaries(repair.edited(repair.faulted(rows), **kw))
    return {r[0]: tuple(r[1:]) for r in out.collect()}


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(made(), SCHEMA).repartition(3)


def test_query_equals_brute_force(spark, table, tmp_path):
    rows = [tuple(r) for r in table.collect()]
    table.withColumns({c: F.lit("clash") for c in ("place", "fault", "edits", "block", "kind", "digest")}).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r[0]: tuple(r[1:]) for r in queries.op12_conversation_repair(spark, str(tmp_path)).collect()}
    assert got == brute(rows)


@pytest.mark.parametrize("bits", [0, 2, 16])
def test_blocks_do_not_matter(spark, table, bits):
    rows = [tuple(r) for r in table.collect()]
    assert summed(table, block_bits=bits) == brute(rows, damage=False)


def test_a_conversation_of_many_blocks(spark):
    rng = random.Random(4)
    rows = [(1, t, rng.choice(["user", "assistant", "system"]), rng.choice(["Fine.", "open end", f"A text {t}."])) for t in range(3000)] + [(2, 0, "user", "Hi.")]
    assert summed(spark.createDataFrame(rows, SCHEMA).repartition(5), block_bits=6) == brute(rows, damage=False)


def test_repaired_rows_are_those_of_the_hash(spark, table):
    rows = repair.edited(repair.faulted(table))
    by = {}
    for r in sorted(repair.repaired(rows).collect(), key=lambda r: (r["place"], r["part"])):
        by.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    for conv, values in brute([tuple(r) for r in table.collect()], damage=False).items():
        said = by.get(conv, [])
        assert hashlib.sha256("\n".join(said).encode()).hexdigest() == values[-1]
        assert re.fullmatch("(s?(ua)+)?", "".join(x[:1] for x in said))


def test_few_states_and_their_sums(spark):
    table = repair.CostTable()
    steps, moves = table.explored
    assert len(table.vectors) < 64
    rng = random.Random(9)
    for _ in range(50):
        kinds = [rng.randrange(9) for _ in range(rng.randint(1, 30))]
        before, leads = table.summed(kinds)
        for state in range(len(table.vectors)):
            cut = rng.randint(0, len(kinds))
            middle, _ = table.summed(kinds[cut:])
            assert before[state] == table.summed(kinds[:cut])[0][middle[state]]


def test_nothing_gives_nothing(spark):
    assert summed(spark.createDataFrame([], SCHEMA)) == {}


def test_states_have_their_numbers_before_any_row_is_seen():
    table = repair._table.__wrapped__()
    before = list(table.vectors)
    table.traced([0, 3, 5, 1, 2, 4] * 5, table.end, 0, True, True)
    assert table.vectors == before and len(before) == len(table.explored[0])
