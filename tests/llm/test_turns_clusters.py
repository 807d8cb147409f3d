import hashlib
import math
import zlib
from itertools import product

import numpy as np
import pytest

from isofield.llm import exponion, turns


def edit_costs(rows):
    """The cheapest edits of rows (initial, fault) by whole strings: every state with (cost, audit)."""
    after = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}

    # best[q]: the least (cost, audit) from q over the rest, built from the end; an insertion may come anywhere.
    def with_insertions(best):
        out = dict(best)
        for _ in range(4):
            for q in range(4):
                to = 3 if q == 2 else 2
                if to in out:
                    way = (out[to][0] + 3, "I" + out[to][1])
                    out[q] = min(out.get(q, (10 ** 9, "")), way)
        return out

    best = with_insertions({0: (0, ""), 3: (0, "")})
    for initial, fault in reversed(rows):
        now = {}
        for q in range(4):
            ways = [(best[q][0] + 4, "D" + best[q][1])]
            if fault not in ("blank", "duplicate"):
                extra = 3 if fault == "truncated" else 0
                if initial in after[q]:
                    to = after[q][initial]
                    ways.append((best[to][0] + extra, "K" + best[to][1]))
                to = 3 if q == 2 else 2
                ways.append((best[to][0] + extra + 3, "R" + best[to][1]))
            now[q] = min(ways)
        best = with_insertions(now)
    return best[0]


def brute_repair(conversations):
    """Contract in plain Python: {conv_id: result}."""
    text = lambda x: " " if x is None else str(x)
    groups = {}
    for conv, turn, role, said in conversations:
        rows = groups.setdefault(conv, [])
        kind = zlib.crc32(f"{text(conv)}:{text(turn)}".encode()) % 20
        role, said = text(role), text(said)
        if kind == 0:
            continue
        said = "" if kind == 1 else "".join(c for c in said if c not in ".!?") if kind == 2 else said
        rows += [(turn, "user" if kind == 4 else role, said)] * (2 if kind == 3 else 1)
    out = {}
    for conv, rows in groups.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, faults = set(), []
        for _, role, said in rows:
            body = said.strip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not body else "duplicate" if (role, said) in seen else "truncated" if body[-1] not in ".!?" else "")
            seen.add((role, said))
        known = [r[0] for r in rows if r[0] is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
        cost, audit = edit_costs([(r[1][:1], f) for r, f in zip(rows, faults)])
        lines, at = [], 0
        for e in audit:
            due = "assistant" if lines and lines[-1][0][:1] == "u" else "user"
            if e == "I":
                lines.append((due, ""))
                continue
            _, role, said = rows[at]
            at += 1
            if e != "D":
                lines.append((due if e == "R" else role, said))
        out[conv] = (gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], sum(p not in ("su", "ua", "au") for p in pairs), cost, audit,
                     hashlib.sha256("\n".join(f"{r}:{s}" for r, s in lines).encode()).hexdigest())
    return out


def conversations(seed, n, sizes):
    rng = np.random.default_rng(seed)
    rows = []
    for conv in range(n):
        for turn in range(int(rng.integers(0, sizes))):
            role = str(rng.choice(["user", "assistant", "system", "tool", ""], p=[0.45, 0.4, 0.07, 0.05, 0.03]))
            rows.append((conv if conv else None, int(rng.choice([turn, turn + 3])) if rng.random() < 0.95 else None, role if rng.random() < 0.97 else None,
                         str(rng.choice(["Yes.", "No!", "Cut", " ", "One more  ", "Why? \t"])) + (str(turn) + "." if rng.random() < 0.8 else "")))
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("parts", [None, 6])
def test_repair_against_brute_force(spark, parts):
    rows = conversations(3, 60, 14) + [(None, None, None, None), (99, 5, "user", None), (99, None, "assistant", "Hm."), (99, None, "assistant", "Hm.")]
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA + ", audit int")  # a column with the name of ours
    got = {r.conv_id: tuple(r)[1:] for r in turns.damage_and_repair(df, parts).collect()}
    assert got == brute_repair(rows)


def test_one_conversation_over_many_parts(spark):
    """A third of all rows and more in one conversation, with many copies: the parts' results are put together."""
    rows = [(7, k, ["user", "assistant", "user", "tool"][k % 4], f"Line {k % 50}." if k % 11 else "Cut") for k in range(1500)] + [(7, None, "user", "Copy.")] * 300
    rows += [(c, t, "user" if t % 2 == 0 else "assistant", f"{t}.") for c in range(8, 100) for t in range(4)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.conv_id: tuple(r)[1:] for r in turns.damage_and_repair(df, 9).collect()}
    assert got == brute_repair(rows)


def test_every_short_sequence_of_rows(spark):
    """All initials and faults of up to four rows, parsed in one piece and cut in two anywhere."""
    kinds = [(i, f) for i in range(4) for f in (0, 1, 3)]
    names = {0: "", 1: "blank", 3: "truncated"}
    for n in range(5):
        for combo in product(kinds, repeat=n) if n < 4 else [tuple(kinds[(a * 7 + b) % 12] for b in (0, a % 5, a % 3, a)) for a in range(300)]:
            rows = bytes(i * 4 + f for i, f in combo)
            cost, chart = turns.parse(rows, turns.END)
            want = edit_costs([("sua-"[i], names[f]) for i, f in combo])
            assert (cost[0], turns.edits(rows, chart, 0, turns.END)) == want


def test_empty_and_all_dropped(spark):
    assert turns.damage_and_repair(spark.createDataFrame([], SCHEMA)).count() == 0
    gone = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    got = turns.damage_and_repair(spark.createDataFrame([(gone, 0, "user", "Hi.")], SCHEMA)).first()
    assert tuple(got) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    far = spark.createDataFrame([(1, -2 ** 63, "user", "A."), (1, 2 ** 63 - 1, "assistant", "B.")], SCHEMA)
    assert turns.repair(far, far).first().gaps == 2 ** 63 - 1


def lloyd(rows, k=8, rounds=10):
    """The contract in Python integers."""
    kept = [(i, [int(math.floor(v)) * 1024 if abs(v) > 1e300 else int(math.floor(v * 1024)) for v in x]) for i, x in rows if x is not None and len(x) == 64 and all(v is not None and math.isfinite(v) for v in x)]
    name = lambda r: hashlib.sha256(f"3:{'null' if r[0] is None else r[0]}".encode()).hexdigest()
    centres = [x for _, x in sorted(kept, key=lambda r: (name(r), r[1]))[:k]]
    square = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b))
    assign = lambda: [min((square(x, c), j) for j, c in enumerate(centres)) for _, x in kept]
    for _ in range(rounds):
        to = assign()
        for j in range(len(centres)):
            own = [x for (_, x), (_, a) in zip(kept, to) if a == j]
            if own:
                centres[j] = [sum(col) // len(own) for col in zip(*own)]
    to = assign()
    cap = lambda v: v if v < 2 ** 63 else None
    inertia = {j: sum(d for d, a in to if a == j) for _, j in to}
    return [(i, j, cap(d), cap(inertia[j]), cap(sum(inertia.values())), hashlib.sha256(",".join(map(str, centres[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(kept, to)]


def clustered(spark, rows, kind="float"):
    df = spark.createDataFrame([(i, x, 5) for i, x in rows], f"vec_id long, embedding array<{kind}>, cluster int")  # a column with the name of ours
    return sorted(map(repr, map(tuple, exponion.cluster(df).collect())))


def test_clusters_against_brute_force(spark):
    rng = np.random.default_rng(2)
    middles = rng.normal(0, 0.3, (12, 64))
    rows = [(k, (middles[k % 12] + rng.normal(0, 0.1, 64)).astype(np.float32).tolist()) for k in range(300)]
    rows += [(300 + k, rows[k % 3][1]) for k in range(40)] + [(None, rows[5][1]), (4, rows[4][1]), (400, None), (401, [0.5] * 63), (402, [None] + [0.1] * 63), (403, [float("nan")] * 64), (404, [float("inf")] * 64), (405, [])]
    assert clustered(spark, rows) == sorted(map(repr, lloyd(rows)))


def test_ties_and_few_vectors(spark):
    grid = [(k, [float((k >> d) & 1) for d in range(4)] + [0.0] * 60) for k in range(16)] * 2
    assert clustered(spark, grid) == sorted(map(repr, lloyd(grid)))
    for few in ([], grid[:1], [grid[3]] * 5, grid[:7]):
        assert clustered(spark, few) == sorted(map(repr, lloyd(few)))


def test_huge_components(spark):
    rng = np.random.default_rng(4)
    rows = [(k, (rng.normal(0, 1, 64) * 10.0 ** (k % 5 * 4)).tolist()) for k in range(40)] + [(90, [1e306] * 64), (91, [5000.25] * 64)]
    assert clustered(spark, rows, "double") == sorted(map(repr, lloyd(rows)))


def test_search_scans_few_centroids_and_finds_the_nearest(spark):
    rng = np.random.default_rng(6)
    centres = rng.integers(-3000, 3000, (64, 8))
    x = (centres[rng.integers(0, 64, 4000)] + rng.integers(-40, 40, (4000, 8))).astype(float)
    c = exponion.Centroids(centres.tolist())
    first, upper, lower = exponion.nearest(x, np.zeros(4000, int), np.full(4000, np.inf), np.zeros(4000), c)
    whole = ((x[:, None] - centres[None]) ** 2).sum(2)
    assert (first == whole.argmin(1)).all() and (upper >= np.sqrt(whole.min(1)) - 1e-6).all()
    seen = []
    squares = c.squares
    c.squares = lambda rows, which: (seen.append(len(rows) * len(which)), squares(rows, which))[1]
    again, _, _ = exponion.nearest(x, first, upper + 5.0, lower - 5.0, c)
    assert (again == first).all() and sum(seen) < 0.1 * 64 * 4000
