"""Conversation structure repair: turns are aligned with the role grammar ``(s?(ua)+)?`` at the least cost.

Faults of a row, of which the first counts: blank (nothing but white space), duplicate (its role and text stood
earlier in the conversation), truncated (the last character that isn't white space is none of ``.!?``). Edits: Keep 0,
Rerole to user or assistant 3, Delete 4 (the only one for blank and duplicate rows), Insert an empty user or assistant
turn 3; a truncated row that stays adds 3. Of the cheapest audits (the edits' initials) the ASCII-least is taken.

Method: Wagner-Fischer with the target string of every feasible length. The targets end alike, ``...uaua``, so the
tables of all lengths are the suffix columns of one: D[i][k] is the cost of aligning the turns from i on with the last
k characters. It is kept in an Ukkonen band: an alignment of cost t has at most t/4 deletes and t/3 inserts; t starts at
what the faults cost anyway and doubles until the incumbent, the least D[0][n] of all lengths n (with a leading
``s``: after the deletes in front of a kept system row), is at most t. The audits of all lengths that tie are traced
and compared. Conversations beyond ``LONG`` rows use the same table with its columns folded by the target's
period, which is linear in the rows and as exact (cells whose rest of the target starts alike have equal futures).

Spark counts equal rows (so copies of a row, however many, are one), finds first occurrences by a grouped
minimum and deals conversations to tasks in sorted order. A task reads rows one after the other: the first pass
keeps a byte per row of the conversation at hand, the second, with the audit in front of the rows, emits repaired
rows. No text is gathered; what a task holds is as long as the audit it has to return.

Defined cases: a null role or text is one space; a null conv_id is a conversation of its own; rows go by turn (nulls
first), role and md5 of the text; an original conversation without rows has the empty audit; an empty
table gives an empty result; columns other than conv_id, turn, role and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rulespire.llm.common import WORD, crc32_sql, map_arrow
from rulespire.session import cut_lineage

#: Fixed values of the contract: costs of the edits and of keeping a truncated row, names of inserted roles.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
NAMES = {"u": "user", "a": "assistant"}
BLANKS = " \t\n\x0b\f\r"
#: Faults by number; the first that holds counts.
FINE, BLANK, DUPLICATE, CUT = range(4)
#: Rows from which the table is folded; MB of text per emitted batch.
LONG, BATCH = 2048, 1 << 20
_FAR = 1 << 40


def costs(roles: str, faults: bytes) -> list[tuple[int, int, int]]:
    """Per row what it costs to let it stand as s, u and a."""
    out = []
    for role, fault in zip(roles, faults):
        extra = TRUNCATED if fault == CUT else 0
        stand = [extra if role == "s" else _FAR, extra + (0 if role == "u" else REROLE), extra + (0 if role == "a" else REROLE)]
        out.append((_FAR,) * 3 if fault in (BLANK, DUPLICATE) else tuple(stand))
    return out


def _edit(role: str, want: str) -> str:
    return "K" if role == want else "R"


class _Band:
    """D[i][k] for all i and the k within the band of cutoff t; target of length k: alternating, ends in a."""

    def __init__(self, rows: list[tuple[int, int, int]], t: int):
        m, self.less = len(rows), t // DELETE
        width = self.less + t // INSERT + 1
        self.m, self.d = m, np.full((m + 1, width), _FAR, np.int64)
        places = np.arange(width)
        for i in range(m, -1, -1):
            k = places - self.less + (m - i)
            if i == m:
                base = np.where(k == 0, 0, _FAR)
            else:
                down = self.d[i + 1]
                base = np.minimum(np.append(down[1:], _FAR) + DELETE, np.where(k % 2 == 0, rows[i][1], rows[i][2]) + down)
                base[k < 0] = _FAR
            self.d[i] = np.minimum(_FAR, np.minimum.accumulate(base - INSERT * places) + INSERT * places)

    def at(self, i: int, k: int) -> int:
        x = k - (self.m - i) + self.less
        return int(self.d[i, x]) if 0 <= x < self.d.shape[1] and k >= 0 else _FAR

    def lengths(self, i: int) -> Iterator[tuple[int, int]]:
        """Feasible lengths of the target of the rows from i on (whole pairs) with their costs."""
        for k in range(max(0, self.m - i - self.less), self.m - i - self.less + self.d.shape[1]):
            if k % 2 == 0 and self.at(i, k) < _FAR:
                yield k, self.at(i, k)


class _Folded:
    """The same table for long conversations: columns by the rest's parity, 0 apart from other even ones."""

    def __init__(self, rows: list[tuple[int, int, int]]):
        self.m = len(rows)
        self.d = np.empty((self.m + 1, 3), np.int64)  # nothing left; a pair or more; an assistant's turn and pairs
        none, pairs, odd = 0, 2 * INSERT, INSERT
        self.d[self.m] = none, pairs, odd
        for i in range(self.m - 1, -1, -1):
            _, u, a = rows[i]
            gone, left = none, min(none, pairs)
            p, o = min(DELETE + pairs, u + odd), min(DELETE + odd, a + left)
            none = gone + DELETE
            odd = min(o, INSERT + min(none, p))
            pairs = min(p, INSERT + odd)
            self.d[i] = none, pairs, odd


def align(roles: str, faults: bytes, long: int = LONG) -> tuple[int, str]:
    """Least cost and ASCII-least audit of the cheapest edits."""
    m, rows = len(roles), costs(roles, faults)
    if m > long:
        return _align_folded(roles, rows)
    t = sum(DELETE if r[1] >= _FAR else 0 for r in rows) + sum(TRUNCATED for f in faults if f == CUT) + 2 * DELETE
    while True:
        band = _Band(rows, t)
        found = [(c, "", 0, k) for k, c in band.lengths(0)]
        for i, role in enumerate(roles):
            if DELETE * i > t:
                break
            if rows[i][0] < _FAR:
                found += [(DELETE * i + rows[i][0] + c, "D" * i + "K", i + 1, k) for k, c in band.lengths(i + 1) if k]
        best = min((c for c, *_ in found), default=_FAR)
        if best <= t:
            break
        t *= 2
    return best, min(head + _trace(roles, rows, band, i, k) for c, head, i, k in found if c == best)


def _trace(roles: str, rows: list, band: _Band, i: int, k: int) -> str:
    out = []
    while i < band.m or k:
        c, stand = band.at(i, k), rows[i][1 + k % 2] if i < band.m and k else _FAR
        if i < band.m and DELETE + band.at(i + 1, k) == c:
            out.append("D")
            i += 1
        elif k and INSERT + band.at(i, k - 1) == c:
            out.append("I")
            k -= 1
        else:
            assert stand + band.at(i + 1, k - 1) == c
            out.append(_edit(roles[i], "ua"[k % 2]))
            i, k = i + 1, k - 1
    return "".join(out)


def _align_folded(roles: str, rows: list) -> tuple[int, str]:
    """As ``align`` with the folded table."""
    table = _Folded(rows)
    d, m = table.d, table.m
    best = int(min(d[0, 0], d[0, 1]))
    for i, role in enumerate(roles):
        if rows[i][0] < _FAR and DELETE * i <= best:
            best = min(best, DELETE * i + rows[i][0] + int(d[i + 1, 1]))
    found = [("", 0, c) for c in (0, 1) if d[0, c] == best]
    for i in range(m):
        if rows[i][0] < _FAR and DELETE * i + rows[i][0] + int(d[i + 1, 1]) == best:
            found.append(("D" * i + "K", i + 1, 1))
    audits = []
    for head, i, column in found:
        out = [head]
        while i < m or column:
            c = int(d[i, column])
            # the rest after one more character: an odd rest leaves nothing or pairs, pairs leave an odd rest
            after = [] if column == 0 else [2] if column == 1 else [0, 1]
            stand = rows[i][1 if column == 1 else 2] if i < m and column else _FAR
            if i < m and DELETE + int(d[i + 1, column]) == c:
                out.append("D")
                i += 1
                continue
            insert = [x for x in after if INSERT + int(d[i, x]) == c]
            stay = [x for x in after if i < m and stand + int(d[i + 1, x]) == c]
            out.append("I" if insert else _edit(roles[i], "ua"[column - 1]))
            # where both are as cheap, nothing left: deletes to the end are the least audit
            column, i = (insert[0], i) if insert else (stay[0], i + 1)
        audits.append("".join(out))
    return best, min(audits)


def _flags(rows: DataFrame) -> DataFrame:
    """Distinct rows with their number n and the fault of the first copy; order columns turn, role, h."""
    said = rows.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
    ).withColumn("h", F.md5("text"))
    one = said.groupBy("conv_id", "turn", "role", "h").agg(F.count(F.lit(1)).alias("n"), F.first("text").alias("text"))
    # nulls first: -1 before 0, then by turn
    when = F.struct(F.col("turn").isNotNull().alias("has"), F.coalesce("turn", F.lit(0)).alias("turn"))
    first = said.groupBy(F.col("conv_id").alias("c_"), F.col("role").alias("r_"), F.col("h").alias("h_")).agg(F.min(when).alias("first"))
    both = one.join(first, F.col("conv_id").eqNullSafe(F.col("c_")) & (F.col("role") == F.col("r_")) & (F.col("h") == F.col("h_")))
    bare = F.rtrim("text", F.lit(BLANKS))
    fault = (
        F.when(~F.col("text").rlike(WORD), BLANK).when(F.col("first") < when, DUPLICATE)
        .when(~F.substring(bare, -1, 1).isin(".", "!", "?"), CUT).otherwise(FINE))
    return both.select("conv_id", "turn", "role", "h", "text", "n", fault.cast("int").alias("fault"))


def _in_order(df: DataFrame) -> DataFrame:
    """Whole conversations in one task each, their first row being the one that stands for the conversation."""
    return df.repartition("conv_id").sortWithinPartitions("conv_id", F.col("head").desc(), "turn", "role", "h")


_STATS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_LEGAL = {"su", "ua", "au"}


def _audit(batches):
    """Rows in order -> a row per conversation."""
    out: list[tuple] = []
    state = None

    def done(s):
        conv, roles, faults, low, high, distinct = s
        roles, faults = "".join(roles), b"".join(faults)
        cost, audit = align(roles, faults)
        illegal = sum(roles[k : k + 2] not in _LEGAL for k in range(len(roles) - 1))
        gaps = high - low + 1 - distinct if distinct else 0
        return conv, gaps, faults.count(BLANK), faults.count(DUPLICATE), faults.count(CUT), illegal, cost, audit

    def table(rows):
        names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
        cols = list(zip(*rows))
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n == "audit" else pa.int64()) for n, c in zip(names, cols)], names)

    for b in batches:
        for conv, head, turn, initial, fault, n in zip(*(b.column(k).to_pylist() for k in ("conv_id", "head", "turn", "initial", "fault", "n"))):
            if head:
                if state:
                    out.append(done(state))
                state = [conv, [], [], None, None, 0]
                continue
            state[1].append(initial * n)
            state[2].append(bytes([fault]) + bytes([BLANK if fault == BLANK else DUPLICATE]) * (n - 1))
            if turn is not None and turn != state[4]:
                state[3] = turn if state[3] is None else state[3]
                state[4] = turn
                state[5] += 1
        if out:
            yield table(out)
            out = []
    if state:
        yield table([done(state)])


def audits(rows: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit: a row per conversation of ``rows`` or ``conversations``."""
    known = (rows if conversations is None else conversations).select("conv_id").distinct()
    return _audits(_flags(rows), known)


def _audits(flags: DataFrame, known: DataFrame) -> DataFrame:
    heads = known.select(F.col("conv_id").cast("long").alias("conv_id"), F.lit(True).alias("head"), F.lit(None).cast("long").alias("turn"), *[F.lit("").alias(c) for c in ("role", "h", "initial")], F.lit(0).alias("fault"), F.lit(0).cast("long").alias("n"))
    # a role's initial; an empty role is as any other
    initial = F.when(F.substring("role", 1, 1).isin("s", "u", "a"), F.substring("role", 1, 1)).otherwise(F.lit("-"))
    rows = flags.select("conv_id", F.lit(False).alias("head"), "turn", "role", "h", initial.alias("initial"), "fault", "n")
    return map_arrow(_in_order(heads.unionByName(rows)).drop("role", "h"), _audit, f"conv_id long, {_STATS}")


_REPAIRED = "conv_id long, place long, edit string, role string, text string"


def _repair(batches):
    """Heads and rows in order -> the head, then the repaired rows, numbered."""
    out: list[tuple] = []
    held = 0
    conv, audit, at, place, last = None, "", 0, 0, ""

    def row(edit, role, text):
        nonlocal place, last, held
        out.append((conv, place, edit, role, text))
        place, last, held = place + 1, role[:1], held + len(text) + 40

    def inserts():
        nonlocal at
        while at < len(audit) and audit[at] == "I":
            row("I", NAMES["a" if last == "u" else "u"], "")
            at += 1

    def table():
        nonlocal out, held
        cols = list(zip(*out))
        done = pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()))], ["conv_id", "place", "edit", "role", "text"])
        out, held = [], 0
        return done

    for b in batches:
        for c, head, role, text, n, said in zip(*(b.column(k).to_pylist() for k in ("conv_id", "head", "role", "text", "n", "audit"))):
            if head:
                inserts()
                conv, audit, at, place, last = c, said, 0, 0, ""
                out.append((conv, -1, "", "", ""))
                continue
            for _ in range(n):
                inserts()
                edit, at = audit[at], at + 1
                if edit == "K":
                    row("K", role, text)
                elif edit == "R":
                    row("R", NAMES["a" if last == "u" else "u"], text)
            if held > BATCH:
                yield table()
    inserts()
    if out:
        yield table()


def _digest(batches):
    """Repaired rows in order -> conv_id and hash of its ``role:text`` lines."""
    now = None
    for b in batches:
        done = []
        for conv, place, role, text in zip(*(b.column(k).to_pylist() for k in ("conv_id", "place", "role", "text"))):
            if place < 0:
                done.append(now)
                now = (conv, hashlib.sha256())
            else:
                now[1].update((b"\n" if place else b"") + f"{role}:{text}".encode())
        done = [d for d in done if d]
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1].hexdigest() for d in done])], ["conv_id", "repaired_sha256"])
    if now:
        yield pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int64()), pa.array([now[1].hexdigest()])], ["conv_id", "repaired_sha256"])


def _with_heads(flags: DataFrame, found: DataFrame) -> DataFrame:
    none = F.lit(None).cast("string")
    heads = found.select("conv_id", F.lit(True).alias("head"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("h"), none.alias("text"), F.lit(0).cast("long").alias("n"), "audit")
    rows = flags.select("conv_id", F.lit(False).alias("head"), "turn", "role", "h", "text", "n", none.alias("audit"))
    return _in_order(heads.unionByName(rows)).drop("turn", "h")


def repaired_rows(rows: DataFrame, found: DataFrame) -> DataFrame:
    """conv_id, place, edit, role, text: the repaired conversations; ``found`` comes from ``audits``."""
    return map_arrow(_with_heads(_flags(rows), found), _repair, _REPAIRED).filter("place >= 0")


def damage(rows: DataFrame) -> DataFrame:
    """The contract's damage, decided by the crc of conv_id and turn."""
    space = F.lit(" ")
    text, role = F.coalesce("text", space), F.coalesce("role", space)
    case = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))) % 20
    df = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), case.alias("case")).filter("case <> 0")
    df = df.withColumn("copy", F.explode(F.when(F.col("case") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    spoilt = F.when(F.col("case") == 1, F.lit("")).when(F.col("case") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return df.select("conv_id", "turn", F.when(F.col("case") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), spoilt.alias("text"))


def op12_structure_repair(spark, sf: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text")
    flags = cut_lineage(_flags(damage(rows)))
    found = cut_lineage(_audits(flags, rows.select("conv_id").distinct()))
    repaired = map_arrow(_with_heads(flags, found), _repair, _REPAIRED)
    digests = map_arrow(repaired, _digest, "conv_id long, repaired_sha256 string").withColumnRenamed("conv_id", "c_")
    return found.join(digests, F.col("conv_id").eqNullSafe(F.col("c_"))).drop("c_")


def _oracle() -> str:
    far = 1 << 40
    lone = lambda role: f"CASE WHEN bad THEN {far} ELSE extra + CASE WHEN initial = '{role}' THEN 0 ELSE 3 END END"
    return f"""WITH RECURSIVE keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
cased AS (SELECT conv_id, turn, role, text, {crc32_sql('k')} % 20 AS d FROM keyed),
damaged AS (SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role, CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN d = 3 THEN 2 ELSE 1 END)) AS copy FROM cased WHERE d <> 0),
placed AS (SELECT *, row_number() OVER w - 1 AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again, lag(left(role, 1)) OVER w AS before
  FROM damaged WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy)),
faulty AS (SELECT *, left(role, 1) AS initial, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank' WHEN again THEN 'duplicate'
  WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 'truncated' ELSE '' END AS fault FROM placed),
priced AS (SELECT *, fault IN ('blank', 'duplicate') AS bad, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS extra FROM faulty),
step AS (SELECT conv_id, i, role, text, initial, CASE WHEN bad OR initial <> 's' THEN {far} ELSE extra END AS s, {lone('u')} AS u, {lone('a')} AS a FROM priced),
convs AS (SELECT c.conv_id, count(p.i) AS n, coalesce(max(p.turn) - min(p.turn) + 1 - count(DISTINCT p.turn), 0) AS gaps,
  count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
  count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN priced p ON c.conv_id IS NOT DISTINCT FROM p.conv_id GROUP BY c.conv_id),
back AS (SELECT conv_id, n AS i, [0, 6, 3, 0]::BIGINT[] AS c FROM convs
  UNION ALL SELECT conv_id, i, [least(r1, 3 + least(r3, 3 + r4)), least(r2, 3 + least(r3, 3 + r4)), least(r3, 3 + r4), least(r4, 3 + r3)] FROM (
    SELECT s.conv_id, s.i, least(4 + c[1], s + c[2], u + c[3]) AS r1, least(4 + c[2], u + c[3]) AS r2, least(4 + c[3], a + c[4]) AS r3, least(4 + c[4], u + c[3]) AS r4
    FROM back b JOIN step s ON s.conv_id IS NOT DISTINCT FROM b.conv_id AND s.i = b.i - 1)),
walk AS (SELECT conv_id, 0::BIGINT AS i, 1 AS q, '' AS audit, []::VARCHAR[] AS lines FROM convs
  UNION ALL SELECT conv_id, CASE WHEN e = 'I' THEN i ELSE i + 1 END, CASE WHEN e = 'D' THEN q WHEN e = 'K' AND q = 1 AND initial = 's' THEN 2 WHEN q = 3 THEN 4 ELSE 3 END, audit || e,
    CASE e WHEN 'D' THEN lines WHEN 'K' THEN list_append(lines, role || ':' || text) ELSE list_append(lines, CASE WHEN q = 3 THEN 'assistant' ELSE 'user' END || ':' || CASE e WHEN 'R' THEN text ELSE '' END) END FROM (
    SELECT w.*, s.role, s.text, s.initial, CASE WHEN n.c IS NOT NULL AND b.c[q] = 4 + n.c[q] THEN 'D' WHEN b.c[q] = 3 + b.c[CASE WHEN q = 3 THEN 4 ELSE 3 END] THEN 'I'
      WHEN s.initial = CASE WHEN q = 3 THEN 'a' ELSE 'u' END OR (q = 1 AND s.initial = 's' AND b.c[q] = s.s + n.c[2]) THEN 'K' ELSE 'R' END AS e
    FROM walk w JOIN back b ON b.conv_id IS NOT DISTINCT FROM w.conv_id AND b.i = w.i LEFT JOIN back n ON n.conv_id IS NOT DISTINCT FROM w.conv_id AND n.i = w.i + 1
      LEFT JOIN step s ON s.conv_id IS NOT DISTINCT FROM w.conv_id AND s.i = w.i
    WHERE n.c IS NOT NULL OR q IN (2, 3))),
final AS (SELECT conv_id, arg_max(audit, length(audit)) AS audit, arg_max(lines, length(audit)) AS lines FROM walk GROUP BY conv_id)
SELECT v.conv_id, gaps::BIGINT AS gaps, blank, duplicate, truncated, illegal, b.c[1]::BIGINT AS cost, audit, sha256(array_to_string(lines, chr(10))) AS repaired_sha256
FROM convs v JOIN back b ON b.conv_id IS NOT DISTINCT FROM v.conv_id AND b.i = 0 JOIN final f ON f.conv_id IS NOT DISTINCT FROM v.conv_id"""


ORACLE = _oracle()
