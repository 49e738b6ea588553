"""Audits against all edit sequences and a search over states, repaired texts against a plain version."""

import hashlib
import heapq
import itertools
import random
import zlib

from palimpsest.llm import turn_repair as tr
from palimpsest.llm.common import table

LETTERS = {tr.SYSTEM: "s", tr.USER: "u", tr.ASSISTANT: "a"}


def cheapest(kinds: bytes) -> tuple[int, str]:
    """Cheapest first, ASCII-least among equals: every edit of every row, one at a time."""
    heap, done = [(0, "", 0, "")], set()
    while heap:
        cost, audit, i, last = heapq.heappop(heap)
        if i == len(kinds) and last in ("", "a"):
            return cost, audit
        if (i, last) in done:
            continue
        done.add((i, last))
        want = "a" if last == "u" else "u"
        heapq.heappush(heap, (cost + 3, audit + "I", i, want))
        if i < len(kinds):
            cut, kind = divmod(kinds[i], tr.CUT)
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, last))
            if kind != tr.GONE:
                letter = LETTERS.get(kind)
                if letter == want or letter == "s" and last == "":
                    heapq.heappush(heap, (cost + 3 * cut, audit + "K", i + 1, letter))
                heapq.heappush(heap, (cost + 3 * cut + 3, audit + "R", i + 1, want))


def every_edit(kinds: bytes, most: int) -> tuple[int, str]:
    """The same by listing all audits of up to ``most`` letters."""
    found = []
    for n in range(most + 1):
        for audit in itertools.product("DIKR", repeat=n):
            if sum(e != "I" for e in audit) != len(kinds):
                continue
            i, cost, last, good = 0, 0, "", True
            for e in audit:
                want = "a" if last == "u" else "u"
                if e == "I":
                    cost, last = cost + 3, want
                    continue
                cut, kind = divmod(kinds[i], tr.CUT)
                i += 1
                if e == "D":
                    cost += 4
                    continue
                letter = LETTERS.get(kind)
                good &= kind != tr.GONE
                if e == "K":
                    good &= letter == want or letter == "s" and last == ""
                    cost, last = cost + 3 * cut, letter
                else:
                    cost, last = cost + 3 * cut + 3, want
            if good and last in ("", "a"):
                found.append((cost, "".join(audit)))
    return min(found)


ALL = (1, 2, 3, 4, 5, 9, 10, 11, 12)


def test_search_equals_listing():
    for n in range(4):
        for kinds in itertools.product(ALL, repeat=n):
            assert cheapest(bytes(kinds)) == every_edit(bytes(kinds), n + 2)


def test_short_audits():
    for n in range(5):
        for kinds in itertools.product(ALL, repeat=n):
            assert tr.cheapest_audit(bytes(kinds)) == cheapest(bytes(kinds)), kinds


def test_blocks_and_random_audits():
    rng = random.Random(3)
    for _ in range(400):
        n = rng.randrange(1, 60)
        usual = [2 + (i % 2) for i in range(n)]
        kinds = bytes(k if rng.random() < rng.choice((0.2, 0.7, 1)) else rng.choice(ALL) for k in usual)
        expected = cheapest(kinds)
        for size in (1, 2, 3, 7, 16, 256):
            assert tr.cheapest_audit(kinds, size) == expected, (size, list(kinds))


def test_long_conversation():
    rng = random.Random(4)
    kinds = bytes(rng.choice(ALL) if rng.random() < 0.3 else 2 + i % 2 for i in range(3000))
    assert tr.cheapest_audit(kinds) == cheapest(kinds)


def plain(rows):
    convs = {}
    for conv, turn, role, text in rows:
        out = convs.setdefault(conv, [])
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fate == 0:
            continue
        if fate == 1:
            text = ""
        if fate == 2 and text is not None:
            text = "".join(c for c in text if c not in ".!?")
        out += [(turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    for conv, rows in convs.items():
        def key(r):
            digest = hashlib.md5(r[2].encode()).digest() if r[2] is not None else b""
            return (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "", r[2] is not None, digest)
        rows.sort(key=key)
        kinds, seen, counts = [], [], dict(blank=0, duplicate=0, truncated=0)
        for turn, role, text in rows:
            kind = {"s": 1, "u": 2, "a": 3}.get((role or "")[:1], 4)
            bare = (text or "").rstrip(" \t\n\v\f\r")
            if not bare:
                counts["blank"] += 1
                kind = 5
            elif (role, text) in seen:
                counts["duplicate"] += 1
                kind = 5
            elif bare[-1] not in ".!?":
                counts["truncated"] += 1
                kind += 8
            seen.append((role, text))
            kinds.append(kind)
        turns = [t for t, _, _ in rows if t is not None]
        initials = [(r or "")[:1] for _, r, _ in rows]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit = cheapest(bytes(kinds))
        out, i, last = [], 0, ""
        for e in audit:
            want = "a" if last == "u" else "u"
            name = {"u": "user", "a": "assistant"}[want]
            if e == "I":
                out.append(f"{name}:")
                last = want
                continue
            _, role, text = rows[i]
            i += 1
            if e == "K":
                out.append(f"{role}:{text}")
                last = role[0]
            elif e == "R":
                out.append(f"{name}:{text}")
                last = want
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        yield (conv, gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit,
               hashlib.sha256("\n".join(out).encode()).hexdigest())


COLUMNS = ("conv_id", *tr.COUNTS, "audit", "repaired_sha256")


def run(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.select(*COLUMNS).collect()), key=repr)


def test_whole_table(spark):
    docs = table(spark, "/root/testdata/sf0.001", "conversations")
    rows = [tuple(r) for r in docs.select("conv_id", "turn", "role", "text").collect()]
    assert run(tr.op13_turn_repair(spark, "/root/testdata/sf0.001")) == sorted(plain(rows), key=repr)


def test_odd_rows(spark):
    rng = random.Random(5)
    rows = []
    for conv in [*range(60), None]:
        for _ in range(rng.choice((1, 2, 5, 9, 400 if conv == 7 else 12))):
            rows.append((conv, rng.choice((None, *range(6))) if conv != 7 else rng.randrange(1000),
                         rng.choice(("user", "assistant", "user", "assistant", "system", "tool", "Ünique", "", None)),
                         rng.choice((None, "", " \n\t", "Ja.", "Nein", "Was?", "é…", "x" * 50_000 + "!", f"n{rng.random()}."))))
    rows += rows[:50]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' as copies", "1 as digest", "2 as fate", "3 as counts")
    assert run(tr.repair(tr.damaged(df))) == sorted(plain(rows), key=repr)
    assert run(tr.repair(tr.damaged(df.limit(0)))) == []
