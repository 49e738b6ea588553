"""Conversation repair: turns aligned to every feasible length of the alternating grammar, the cheapest audit kept."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import bound_batches, table
from palimpsest.llm.registry import query

#: What an edit costs, and what an undeleted truncated row adds.
DELETE, INSERT, REROLE, CUT_OFF = 4, 3, 3, 3
#: Kinds of rows: initials of roles, any other initial, and rows that must go. CUT is added for truncated rows.
SYSTEM, USER, ASSISTANT, OTHER, GONE, CUT = 1, 2, 3, 4, 5, 8
#: States between rows: what was given last; NONE is the start. A conversation may end in NONE or ASSISTANT.
NONE = 0
#: Turns of one table of costs; a longer conversation is a chain of such blocks.
BLOCK = 256
#: Rows of a conversation whose audit a task remembers, and how many it remembers; neither changes a result.
SHORT, KNOWN = 32, 1 << 15
_FAR = 1 << 40
_NAMES = {USER: "user", ASSISTANT: "assistant"}


def _greedy(kinds: list[int], state: int) -> int:
    """The cost of an alignment found at once: keep what alternates, insert what is missing, rerole strangers."""
    cost = 0
    for kind in kinds:
        cut, kind = divmod(kind, CUT)
        want = ASSISTANT if state == USER else USER
        if kind == GONE:
            cost += DELETE
            continue
        cost += CUT_OFF * cut
        if kind == want:
            state = want
        elif kind in (USER, ASSISTANT):
            cost, state = cost + INSERT, kind
        else:
            cost, state = cost + REROLE, want
    return cost + (INSERT if state == USER else 0)


class _Block:
    """Costs of a stretch of turns against every length of the alternating string that lies within the incumbent's band.

    All lengths that end alike share their suffixes, so ``tables[last][i, r]`` serves them all: the least cost of turning rows
    i, i + 1, ... into the last r letters of a string that ends in ``last``. ``after`` is the cost from each
    state at the block's end. Only the end of a conversation may have insertions after its last row; elsewhere
    they belong to the next block, so that every alignment has one way to fall into blocks.
    """

    def __init__(self, kinds: list[int], after: list[int], end: bool, whole: bool) -> None:
        self.kinds, self.after, self.end, n = kinds, after, end, len(kinds)
        self.tables = {}
        cut = sum(k > CUT for k in kinds)
        left, cuts = [0] * (n + 1), [0] * (n + 1)
        for i in range(n - 1, -1, -1):
            left[i] = left[i + 1] + (kinds[i] != GONE)
            cuts[i] = cuts[i + 1] + (kinds[i] > CUT)
        # a border inside a conversation asks for any state on either side, which some insertions and reroles always give
        spare = _greedy(kinds, NONE if whole else ASSISTANT) + (0 if whole else 2 * (INSERT + REROLE + INSERT)) - DELETE * (n - left[0]) - CUT_OFF * cut
        up = spare // INSERT
        low = [max(0, left[i] - min(spare, cuts[i]) - max(0, spare - cuts[i]) // DELETE) for i in range(n + 1)]
        for last in (USER, ASSISTANT):
            if after[last] < _FAR:
                self.tables[last] = self._table(last, left, low, up)

    def _table(self, last: int, left: list[int], low: list[int], up: int) -> np.ndarray:
        n, width = len(self.kinds), left[0] + up + 1
        costs = np.full((n + 1, width), _FAR, np.int64)
        length = np.arange(width)
        letter = np.where(length % 2 == 1, last, USER + ASSISTANT - last)
        high = min(left[n] + up, width - 1)
        costs[n, :high + 1] = INSERT * length[:high + 1] if self.end else np.where(length[:high + 1] == 0, 0, _FAR)
        for i in range(n - 1, -1, -1):
            lo, hi = low[i], min(left[i] + up, width - 1) + 1
            best = costs[i + 1, lo:hi] + DELETE
            kind = self.kinds[i]
            if kind != GONE:
                first = max(lo, 1)
                match = costs[i + 1, first - 1:hi - 1] + CUT_OFF * (kind // CUT) + REROLE * (letter[first:hi] != kind % CUT)
                np.minimum(best[first - lo:], match, out=best[first - lo:])
            costs[i, lo:hi] = np.minimum.accumulate(best - INSERT * length[lo:hi]) + INSERT * length[lo:hi]
        return costs

    def _ends(self, state: int, i: int) -> Iterator[tuple[int, int, int]]:
        """(cost up to the conversation's end, last letter, length) of every feasible length from a state before row i."""
        odd_last = ASSISTANT if state == USER else USER
        for last, costs in self.tables.items():
            first = 1 if last == odd_last else (0 if last == state else 2)
            for r in range(first, costs.shape[1], 2):
                if costs[i, r] < _FAR:
                    yield int(costs[i, r]) + self.after[last], last, r

    def _least(self, state: int, i: int) -> int:
        """As the least of _ends, and of deleting all rows where nothing but a start stands."""
        odd_last = ASSISTANT if state == USER else USER
        found = [_FAR if state in (USER, ASSISTANT) else DELETE * (len(self.kinds) - i) + self.after[state]]
        for last, costs in self.tables.items():
            found.append(int(costs[i, (1 if last == odd_last else (0 if last == state else 2))::2].min(initial=_FAR)) + self.after[last])
        return min(found)

    def _system(self) -> list[tuple[int, int]]:
        """(cost, row) of keeping each row that can be the system's, after deleting all before it."""
        return [(DELETE * i + CUT_OFF * (k // CUT) + self._least(SYSTEM, i + 1), i) for i, k in enumerate(self.kinds) if k % CUT == SYSTEM]

    def cost(self, state: int) -> int:
        """The least cost from a state before this block to the conversation's end."""
        found = self._least(state, 0)
        if state == NONE:
            found = min([found, *[c for c, _ in self._system()]])
        return min(found, _FAR)

    def audit(self, state: int) -> tuple[str, int]:
        """The ASCII-least of the cheapest audits of this block, and the state after it: every feasible length is traced and compared."""
        best = self.cost(state)
        found = self._audits(state, 0, best)
        if state == NONE:
            kept = max([i for c, i in self._system() if c == best], default=None)  # the latest: D comes before K
            if kept is not None:
                rest = best - DELETE * kept - CUT_OFF * (self.kinds[kept] // CUT)
                found += [("D" * kept + "K" + a, s) for a, s in self._audits(SYSTEM, kept + 1, rest)]
        return min(found)

    def _audits(self, state: int, i: int, best: int) -> list[tuple[str, int]]:
        rest = len(self.kinds) - i
        found = [(self._trace(last, i, r), last) for c, last, r in self._ends(state, i) if c == best]
        if state in (NONE, SYSTEM) and DELETE * rest + self.after[state] == best:
            found.append(("D" * rest, state))
        return found

    def _trace(self, last: int, i: int, r: int) -> str:
        costs, n, out = self.tables[last], len(self.kinds), []
        while i < n or r:
            here = costs[i, r]
            if i < n and costs[i + 1, r] + DELETE == here:
                out.append("D")
                i += 1
            elif r and (i < n or self.end) and costs[i, r - 1] + INSERT == here:
                out.append("I")
                r -= 1
            else:
                out.append("K" if self.kinds[i] % CUT == (last if r % 2 else USER + ASSISTANT - last) else "R")
                i, r = i + 1, r - 1
        return "".join(out)


def cheapest_audit(kinds: bytes, size: int = BLOCK) -> tuple[int, str]:
    """Cost and ASCII-least audit of the cheapest edits that give the rows' kinds the form (s?(ua)+)?.

    A conversation of up to ``size`` rows is one table. A longer one is cut in blocks: costs from their borders are carried
    back from the end, then audits are traced block by block; so memory and time grow with its length, not its square.
    """
    if len(kinds) <= size:
        block = _Block(list(kinds), [0, _FAR, _FAR, 0], True, True)
        return block.cost(NONE), block.audit(NONE)[0]
    parts = [list(kinds[i:i + size]) for i in range(0, len(kinds), size)]
    after, ahead = [0, _FAR, _FAR, 0], []
    for k in range(len(parts) - 1, -1, -1):
        ahead.append(after)
        block = _Block(parts[k], after, k == len(parts) - 1, False)
        after = [block.cost(state) for state in (NONE, SYSTEM, USER, ASSISTANT)]
    total, state, out = after[NONE], NONE, []
    for k, part in enumerate(parts):
        audit, state = _Block(part, ahead[len(parts) - 1 - k], k == len(parts) - 1, False).audit(state)
        out.append(audit)
    return total, "".join(out)


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after the damage that CRC-32 of ``conv_id:turn`` deals, and copies (0 is a dropped row, 2 a repeated one)."""
    conv, turn = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn"))
    fate = F.crc32(F.concat(conv, F.lit(":"), turn).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", "role", "text", fate.alias("fate"))
    return rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("fate") == 0, 0).when(F.col("fate") == 3, 2).otherwise(1).alias("copies"))


def _in_order(rows: DataFrame, first: Column | None = None) -> DataFrame:
    """Rows of a conversation in one stream: by turn (nulls first), then role and the text's digest; they are sorted, not gathered."""
    keys = [F.col("conv_id").asc_nulls_first()] + ([first.asc()] if first is not None else [])
    return rows.repartition("conv_id").sortWithinPartitions(*keys, *[F.col(c).asc_nulls_first() for c in ("turn", "role", "digest")])


class _Judge:
    """Rows of one conversation after another, in order; each conversation's counts, cost and audit."""

    def __init__(self) -> None:
        self.out: list[tuple] = []
        self.conv: tuple = ()
        self.known: dict[bytes, tuple[int, str]] = {}  # audits of short conversations, which repeat often

    def start(self, conv: int | None) -> None:
        self.conv = (conv,)
        self.kinds, self.seen, self.previous = bytearray(), set(), None
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.turns, self.first, self.last = 0, None, None

    def row(self, turn: int | None, role: str | None, digest: bytes | None, blank: bool, cut: bool) -> None:
        if turn is not None and turn != self.last:
            self.turns, self.last = self.turns + 1, turn
            self.first = turn if self.first is None else self.first
        initial = (role or "")[:1]
        if self.previous is not None and self.previous + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.previous = initial
        kind = OTHER if not initial else {"s": SYSTEM, "u": USER, "a": ASSISTANT}.get(initial, OTHER)
        again = (role, digest) in self.seen
        if blank:
            self.blank, kind = self.blank + 1, GONE
        elif again:
            self.duplicate, kind = self.duplicate + 1, GONE
        elif cut:
            self.truncated, kind = self.truncated + 1, kind + CUT
        if not blank and not again:
            self.seen.add((role, digest))
        self.kinds.append(kind)

    def finish(self) -> None:
        if self.conv:
            kinds = bytes(self.kinds)
            cost, audit = found = self.known.get(kinds) or cheapest_audit(kinds)
            if len(kinds) <= SHORT and len(self.known) < KNOWN:
                self.known[kinds] = found
            gaps = self.last - self.first + 1 - self.turns if self.turns else 0
            self.out.append((self.conv[0], gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit))


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
AUDITS = "conv_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", audit string"


def _batches(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def audits(rows: DataFrame) -> DataFrame:
    """conv_id, the counts and the audit of every conversation of ``rows`` (as of ``damaged``, with a digest)."""
    schema = pa.schema([("conv_id", pa.int64()), *[(c, pa.int64()) for c in COUNTS], ("audit", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = _Judge()
        for batch in batches:
            for conv, turn, role, digest, blank, cut, copies in zip(*[c.to_pylist() for c in batch.columns]):
                if judge.conv != (conv,):
                    judge.finish()
                    judge.start(conv)
                for _ in range(copies):
                    judge.row(turn, role, digest, blank, cut)
            if judge.out:
                yield _batches(judge.out, schema)
                judge.out = []
        judge.finish()
        if judge.out:
            yield _batches(judge.out, schema)

    text = F.coalesce(F.col("text"), F.lit(""))
    last = F.right(F.rtrim(text, F.lit(" \t\n\v\f\r")), F.lit(1))
    flags = rows.select("conv_id", "turn", "role", "digest", (~text.rlike(r"[^\x20\x09-\x0D]")).alias("blank"),
                        (~last.isin(".", "!", "?")).alias("cut"), "copies")
    return _in_order(flags).mapInArrow(run, AUDITS)


class _Writer:
    """The repaired conversation's digest, fed row by row."""

    def __init__(self, row: tuple) -> None:
        self.row, self.hash, self.at, self.state, self.empty = row, hashlib.sha256(), 0, NONE, True

    def _give(self, role: str, text: str) -> None:
        self.hash.update(("" if self.empty else "\n").encode() + f"{role}:{text}".encode("utf-8", "surrogatepass"))
        self.empty = False

    def _next(self) -> int:
        self.state = ASSISTANT if self.state == USER else USER
        return self.state

    def inserted(self) -> None:
        audit = self.row[-1]
        while self.at < len(audit) and audit[self.at] == "I":
            self._give(_NAMES[self._next()], "")
            self.at += 1

    def feed(self, role: str | None, text: str | None) -> None:
        self.inserted()
        edit = self.row[-1][self.at]
        self.at += 1
        if edit == "K":
            self.state = SYSTEM if role[0] == "s" else self._next()
            self._give(role, text)
        elif edit == "R":
            self._give(_NAMES[self._next()], text)

    def done(self) -> tuple:
        self.inserted()
        return (*self.row, self.hash.hexdigest())


def repair(rows: DataFrame) -> DataFrame:
    """Per conversation of ``rows`` (conv_id, turn, role, text, copies): faults, cost, audit, and the digest of the repaired text.

    Faults and audits are found from narrow rows (no texts); then each audit goes ahead of its conversation's texts, which are
    read once in order and never held. A conversation's audit is one value and its digest one SHA-256, so its rows pass one
    task as a sorted stream, which keeps a byte and a digest for each row. Rows with one turn are taken by role, then by the
    MD5 of the text, nulls first; a null role has no initial, a null text is blank; rows without a conv_id are one conversation.
    """
    bound_batches(rows.sparkSession)
    rows = rows.withColumn("digest", F.unhex(F.md5(F.col("text").cast("binary"))))
    found = audits(rows)
    schema = pa.schema([("conv_id", pa.int64()), *[(c, pa.int64()) for c in COUNTS], ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, out = None, []
        for batch in batches:
            for conv, role, text, copies, counts in zip(*[c.to_pylist() for c in batch.columns]):
                if counts is not None:
                    if writer is not None:
                        out.append(writer.done())
                    writer = _Writer((conv, *[counts[c] for c in (*COUNTS, "audit")]))
                for _ in range(copies):
                    writer.feed(role, text)
            if out:
                yield _batches(out, schema)
                out = []
        if writer is not None:
            yield _batches([writer.done()], schema)

    counts = found.select("conv_id", F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("binary").alias("digest"),
                          F.lit(None).cast("string").alias("text"), F.lit(0).alias("copies"), F.struct(*COUNTS, "audit").alias("counts"))
    texts = rows.filter("copies > 0").select("conv_id", "turn", "role", "digest", "text", "copies", F.lit(None).cast(counts.schema["counts"].dataType).alias("counts"))
    both = _in_order(counts.unionByName(texts), F.col("counts").isNull())
    return both.select("conv_id", "role", "text", "copies", "counts").mapInArrow(run, AUDITS + ", repaired_sha256 string")


@query("op13_turn_repair")
def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damaged(table(spark, sf_dir, "conversations")))
