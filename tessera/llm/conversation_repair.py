"""Conversation structure repair: weighted CYK parsing over spans of turns.

The repair grammar accepts the role initials ``(s?(ua)+)?``. In Chomsky normal form its
nonterminals are the pairs of places (p, q) of that pattern, each standing for what leads
from p to q, and its rules are (p, q) -> (p, r) (r, q). A turn is kept, given another role or
deleted, at a cost; turns may be inserted anywhere, which the closure of each leaf under
insertion takes in. A cell holds a nonterminal's cheapest (cost, audit), audit being the
edits' initials in order, and ties go to the least audit. Equal costs over one span exclude
that one audit begins the other (further insertions cost), so least cells combine to least
cells. Spans are combined bottom-up by their length. As nonterminals are pairs of places,
every split of a span gives the same cell, so a span of 2**i turns is split in its middle
only; a test holds this against all splits.

Rows are sorted over partitions, a long conversation over many, and numbered by counts of
partitions. Leaves meet in segments of SEGMENT turns, segments in a tree of FAN a node, so no
task holds a conversation's turns. Only the digest of a repaired text goes through one
conversation in order, row by row, since the hash asks for that; that pass holds the audit
and the hash's state.

Defined cases: null roles and texts are one space, null ids and turns one space in the
checksum's key; null turns come first; equal turns go by role, then text; a null conversation
id is a conversation; an empty role has no initial, and can't be kept; repeated rows are
duplicates, and repair alike; an empty table gives no rows. Columns other than id, turn, role
and text are not read.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from .common import materialise, table

#: Turns of one segment, and cells that a node of the tree over segments joins.
SEGMENT, FAN = 2048, 16
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1

#: Places of the pattern: at the start, after s, after u, after a. Steps by initial; the text may end at START or ASSISTANT.
START, SYSTEM, USER, ASSISTANT = range(4)
STEPS = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
SPANS = [(p, q) for p in range(4) for q in range(4) if p == q or q in (USER, ASSISTANT) or (p, q) == (START, SYSTEM)]
RULES = [(at, [(SPANS.index((p, r)), SPANS.index((r, q))) for r in range(4) if (p, r) in SPANS and (r, q) in SPANS]) for at, (p, q) in enumerate(SPANS)]
Cells = tuple  # of (cost, audit) or None, one for each of SPANS

#: Kinds of turns, one character each: initial (o: any other) of a turn that may stay, in upper case if truncated; x must go.
MUST_GO = "x"


def least(a, b):
    return b if a is None or b is not None and b < a else a


def joined(left: Cells, right: Cells) -> Cells:
    """Cells of a span from those of its two parts."""
    out = []
    for _, splits in RULES:
        best = None
        for i, j in splits:
            a, b = left[i], right[j]
            if a is not None and b is not None and (best is None or a[0] + b[0] <= best[0]):
                best = least(best, (a[0] + b[0], a[1] + b[1]))
        out.append(best)
    return tuple(out)


def cells(found: dict) -> Cells:
    return tuple(found.get(span) for span in SPANS)


@lru_cache
def nothing() -> Cells:
    """Cells of an empty span: insertions only. A chain of two reaches every place that insertions reach."""
    once = {(p, p): (0, "") for p in range(4)}
    for initial in "ua":
        for p, q in STEPS[initial].items():
            once[p, q] = least(once.get((p, q)), (INSERT, "I"))
    return joined(cells(once), cells(once))


@lru_cache
def leaf(kind: str) -> Cells:
    """Cells of one turn, closed under insertion before and after it."""
    found: dict = {}
    extra = TRUNCATED if kind.isupper() else 0
    for p in range(4):
        found[p, p] = (DELETE, "D")
        if kind != MUST_GO:
            for initial, cost, letter in ((kind.lower(), KEEP, "K"), ("u", REROLE, "R"), ("a", REROLE, "R")):
                q = STEPS.get(initial, {}).get(p)
                if q is not None:
                    found[p, q] = least(found.get((p, q)), (cost + extra, letter))
    return joined(joined(nothing(), cells(found)), nothing())


@lru_cache(maxsize=1 << 15)
def short_span(kinds: str) -> Cells:
    if len(kinds) == 1:
        return leaf(kinds)
    half = 1 << (len(kinds) - 1).bit_length() - 1
    return joined(short_span(kinds[:half]), short_span(kinds[half:]))


def parse(spans: list[Cells]) -> Cells:
    """Cells of consecutive spans, combined in pairs until one is left."""
    while len(spans) > 1:
        spans = [joined(*spans[i : i + 2]) if i + 1 < len(spans) else spans[i] for i in range(0, len(spans), 2)]
    return spans[0] if spans else nothing()


def chart(kinds: str, step: int = 8) -> Cells:
    """Cells of a span of turns; short spans are remembered by their kinds."""
    return parse([short_span(kinds[i : i + step]) for i in range(0, len(kinds), step)])


def best(span: Cells) -> tuple[int, str]:
    """The cheapest (cost, audit) of a whole conversation."""
    return min(x for x in (span[SPANS.index((START, START))], span[SPANS.index((START, ASSISTANT))]) if x is not None)


# ------------------------------------------------------------------ rows


def damage(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows (conv_id, turn, role, text) damaged by the checksum of their place: dropped, emptied, unpunctuated, repeated, or given to the user."""
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    how = F.crc32(F.concat(named(id_col), F.lit(":"), named(turn_col)).cast("binary")) % 20
    marked = rows.select(F.col(id_col).alias("conv_id"), F.col(turn_col).alias("turn"), named(role_col).alias("role"), named(text_col).alias("text"), how.alias("how")).where("how <> 0")
    text = F.when(F.col("how") == 1, F.lit("")).when(F.col("how") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("how") == 4, F.lit("user")).otherwise(F.col("role"))
    times = F.explode(F.when(F.col("how") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return marked.select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("copy")).drop("copy")


def named_id(id_col: str = "conv_id"):
    """The id as a key that is never null."""
    return F.coalesce(F.col(id_col).cast("string"), F.lit(" "))


def numbered(rows: DataFrame) -> DataFrame:
    """Rows with ``conv``, a key, and ``pos``, the row's place in its conversation, as a written table.

    Rows are sorted over range partitions; equal rows go to different ones by their place in the
    input, so a conversation or a row that makes up much of the table fills many partitions.
    """
    order = ["conv", F.col("turn").asc_nulls_first(), "role", "text", "salt"]
    keyed = rows.withColumns({"conv": named_id(), "salt": F.monotonically_increasing_id()})
    ranged = keyed.repartitionByRange(*order).sortWithinPartitions(*order).drop("salt")

    def count(batches):
        # sorted: a conversation's rows of a partition are consecutive
        conv, at = None, 0
        for batch in batches:
            places = []
            for value in batch.column(batch.schema.get_field_index("conv")).to_pylist():
                at = at + 1 if value == conv else 0
                conv = value
                places.append(at)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places, pa.int64())], names=[*batch.schema.names, "at"])

    schema = StructType([*ranged.schema]).add("at", LongType())
    held = materialise(ranged.mapInArrow(count, schema).withColumn("part", F.spark_partition_id()), "repair-rows")
    parts = held.groupBy("conv", "part").agg(F.count("*").alias("n"))
    before = parts.withColumn("before", F.sum("n").over(Window.partitionBy("conv").orderBy("part")) - F.col("n"))
    # a partition's start splits one conversation at most: no more rows than partitions
    split = F.broadcast(before.where("before > 0").select("conv", "part", "before"))
    return held.join(split, ["conv", "part"], "left").select("conv", "turn", "role", "text", (F.col("at") + F.coalesce("before", F.lit(0))).alias("pos"))


def kinds(rows: DataFrame) -> DataFrame:
    """(conv, pos, fault, kind) of numbered rows; fault is blank, duplicate, truncated or null.

    A row is a duplicate unless it is the first of its conversation, role and text: firsts are
    found by one aggregation over digests, then met by their places, which are distinct.
    """
    digest = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))
    last = F.substring(F.rtrim("text", F.lit(" \t\n\x0b\f\r")), -1, 1)
    short = rows.select("conv", "pos", F.substring("role", 1, 1).alias("initial"), last.alias("last"), digest.alias("digest"))
    firsts = short.groupBy("conv", "digest").agg(F.min("pos").alias("pos")).select("conv", "pos", F.lit(True).alias("is_first"))
    judged = short.drop("digest").join(firsts, ["conv", "pos"], "left")
    fault = F.when(F.col("last") == "", "blank").when(F.col("is_first").isNull(), "duplicate").when(~F.col("last").isin(".", "!", "?"), "truncated")
    letter = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("o")
    kind = F.when(F.col("fault").isin("blank", "duplicate"), F.lit(MUST_GO)).when(F.col("fault") == "truncated", F.upper(letter)).otherwise(letter)
    return judged.withColumn("fault", fault).withColumn("kind", kind).select("conv", "pos", "fault", "kind")


SPAN = "conv string, segment bigint, costs array<bigint>, audits array<string>"


def audits(turns: DataFrame, segment: int = SEGMENT, fan: int = FAN) -> DataFrame:
    """(conv, cost, audit): the cheapest repair of each conversation of (conv, pos, kind)."""
    dealt = turns.groupBy("conv", F.floor(F.col("pos") / segment).alias("segment"))
    leaves = dealt.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "kind"))), lambda x: x["kind"]), "").alias("kinds"))

    def spans(batches):
        for batch in batches:
            found = [chart(k) for k in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *packed(found)], names=["conv", "segment", "costs", "audits"])

    def join(batches):
        for batch in batches:
            found = [parse([unpacked(c, a) for c, a in zip(x["costs"], x["audits"], strict=True)]) for x in zip_lists(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *packed(found)], names=["conv", "segment", "costs", "audits"])

    def last(batches):
        for batch in batches:
            found = [best(unpacked(x["costs"], x["audits"])) for x in zip_lists(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c for c, _ in found], pa.int64()), pa.array([a for _, a in found], pa.string())], names=["conv", "cost", "audit"])

    tree = materialise(leaves.mapInArrow(spans, SPAN), "repair-spans")
    most = (tree.agg(F.max("segment")).first()[0] or 0) + 1
    while most > 1:
        nodes = tree.groupBy("conv", F.floor(F.col("segment") / fan).alias("segment")).agg(F.array_sort(F.collect_list(F.struct("segment", "costs", "audits"))).alias("parts"))
        nodes = nodes.select("conv", "segment", F.transform("parts", lambda x: x["costs"]).alias("costs"), F.transform("parts", lambda x: x["audits"]).alias("audits"))
        tree, most = nodes.mapInArrow(join, SPAN), -(-most // fan)
    return tree.mapInArrow(last, "conv string, cost bigint, audit string")


def zip_lists(batch: pa.RecordBatch) -> list[dict]:
    return batch.select(["costs", "audits"]).to_pylist()


def packed(found: list[Cells]) -> list[pa.Array]:
    """Costs (null where there is no cell) and audits as columns."""
    return [pa.array([[None if x is None else x[0] for x in c] for c in found], pa.list_(pa.int64())), pa.array([[None if x is None else x[1] for x in c] for c in found], pa.list_(pa.string()))]


def unpacked(costs: list, letters: list) -> Cells:
    return tuple(None if c is None else (c, a) for c, a in zip(costs, letters, strict=True))


class Repair:
    """One conversation's rows in order, against its audit: the repaired rows, and what is counted on the way."""

    def __init__(self, audit: str):
        self.audit, self.at, self.place = audit, 0, START
        self.count = dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        self.illegal, self.before = 0, None
        self.low = self.high = None
        self.turns, self.rows = 0, 0

    def inserted(self) -> list[tuple[str, str]]:
        out = []
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            out.append((self.next_role(), ""))
            self.at += 1
        return out

    def next_role(self) -> str:
        """The role that must come at this place, which it then leaves."""
        role = "assistant" if self.place == USER else "user"
        self.place = STEPS[role[0]][self.place]
        return role

    def row(self, turn: int | None, role: str, text: str, fault: str | None) -> list[tuple[str, str]]:
        if fault:
            self.count[fault] += 1
        initial = role[:1]
        if self.before is not None and self.before + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = initial
        if turn is not None and turn != self.high:  # sorted by turn
            self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + 1
        out = self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.place = STEPS[initial][self.place]
            out.append((role, text))
        elif edit == "R":
            out.append((self.next_role(), text))
        return out

    def gaps(self) -> int:
        return 0 if self.high is None else self.high - self.low + 1 - self.turns


def in_order(rows: DataFrame, judged: DataFrame, repairs: DataFrame) -> DataFrame:
    """A stream of each conversation in one partition: its head with the audit, then each row after its fault, if it has one."""
    fields = {"pos": "bigint", "what": "int", "turn": "bigint", "role": "string", "text": "string", "fault": "string", "audit": "string", "cost": "bigint", "conv_id": "bigint"}

    def like(df, **known):
        return df.select("conv", *[known.get(c, F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in fields.items()])

    heads = like(repairs, pos=F.lit(-1), what=F.lit(0))
    faults = like(judged.where(F.col("fault").isNotNull()), what=F.lit(0))
    body = like(rows, what=F.lit(1))
    return heads.unionByName(faults).unionByName(body).repartition("conv").sortWithinPartitions("conv", "pos", "what")


def streamed(batches, size: int = 256):
    """(head, repair, rows) of each part of a conversation, and whether it is its last part."""
    head, repair, fault = None, None, None
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            out: list = []
            for row in batch.slice(at, size).to_pylist():
                if row["pos"] < 0:
                    if repair:
                        yield head, repair, out + repair.inserted(), True
                    head, repair, out = row, Repair(row["audit"] or ""), []
                elif row["what"] == 0:
                    fault = row["fault"]
                else:
                    out += repair.row(row["turn"], row["role"], row["text"], fault)
                    fault = None
            if repair:
                yield head, repair, out, False
    if repair:
        yield head, repair, repair.inserted(), True


DIGEST = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"


def digests(ordered: DataFrame) -> DataFrame:
    def work(batches):
        names = [x.split()[0] for x in DIGEST.split(", ")]
        schema = pa.schema([(n, pa.string() if n in ("audit", "repaired_sha256") else pa.int64()) for n in names])
        digest, some, found = hashlib.sha256(), False, []
        for head, repair, rows, over in streamed(batches):
            for role, text in rows:
                digest.update(f"{chr(10) if some else ''}{role}:{text}".encode())
                some = True
            if over:
                found.append({"conv_id": head["conv_id"], "gaps": repair.gaps(), **repair.count, "illegal": repair.illegal, "cost": head["cost"] or 0, "audit": repair.audit, "repaired_sha256": digest.hexdigest()})
                digest, some = hashlib.sha256(), False
                if len(found) == 1000:
                    yield pa.RecordBatch.from_pylist(found, schema=schema)
                    found = []
        yield pa.RecordBatch.from_pylist(found, schema=schema)

    return ordered.mapInArrow(work, DIGEST)


def repaired_rows(ordered: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, place (from 0), role, text."""

    def work(batches):
        place = 0
        for head, _, rows, over in streamed(batches):
            n = len(rows)
            yield pa.RecordBatch.from_arrays([pa.array([head["conv_id"]] * n, pa.int64()), pa.array(range(place, place + n), pa.int64()), pa.array([r for r, _ in rows], pa.string()), pa.array([t for _, t in rows], pa.string())], names=["conv_id", "place", "role", "text"])
            place = 0 if over else place + n

    return ordered.mapInArrow(work, "conv_id bigint, place bigint, role string, text string")


def repair(rows: DataFrame, ids: DataFrame, segment: int = SEGMENT, fan: int = FAN) -> DataFrame:
    """Rows (conv_id, turn, role, text) in order under the cheapest repair of each conversation of ``ids`` (conv_id, those of rows or more).

    ``digests`` and ``repaired_rows`` read what this gives.
    """
    held = numbered(rows)
    judged = materialise(kinds(held), "repair-kinds")
    found = audits(judged, segment, fan)
    every = ids.select("conv_id", named_id().alias("conv")).distinct()
    return in_order(held, judged, every.join(found, "conv", "left"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return digests(repair(damage(rows), rows))


QUERIES = {"op12_conversation_repair": op12_conversation_repair}
#: Checksum, damage, faults, and a recursion over rows that keeps the least (cost, audit) of each place.
ORACLE = f"""
WITH RECURSIVE crc AS (SELECT {"list_transform(" * 8}range(256){", lambda x: xor(x >> 1, 3988292384 * (x & 1)))" * 8} AS t),
named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    list_prepend(4294967295, list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda c: CAST(ascii(c) AS BIGINT))) AS key
  FROM conversations),
marked AS (SELECT conv_id, turn, role, text, xor(list_reduce(key, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS how FROM named, crc),
damaged AS (
  SELECT conv_id, turn, CASE how WHEN 4 THEN 'user' ELSE role END AS role, CASE how WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM marked, range(2) AS copies(i) WHERE how <> 0 AND (i = 0 OR how = 3)),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos, right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS last FROM damaged),
judged AS (
  SELECT *, substr(role, 1, 1) AS initial, CASE WHEN last = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'd' WHEN last NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
    lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS before
  FROM placed),
steps(p, initial, q) AS (VALUES ('0', 's', 's'), ('0', 'u', 'u'), ('s', 'u', 'u'), ('u', 'a', 'a'), ('a', 'u', 'u')),
inserted(p, q, cost, letters, lines) AS (VALUES ('0', '0', 0, '', []), ('s', 's', 0, '', []), ('u', 'u', 0, '', []), ('a', 'a', 0, '', []), ('0', 'u', 2, 'I', ['user:']), ('s', 'u', 2, 'I', ['user:']), ('u', 'a', 2, 'I', ['assistant:']), ('a', 'u', 2, 'I', ['user:']), ('0', 'a', 4, 'II', ['user:', 'assistant:']), ('s', 'a', 4, 'II', ['user:', 'assistant:'])),
edits AS (
  SELECT conv_id, pos, p, p AS q, 3 AS cost, 'D' AS letter, [] AS lines FROM judged, (SELECT DISTINCT p FROM inserted)
  UNION ALL SELECT conv_id, pos, p, q, CASE fault WHEN 't' THEN 1 ELSE 0 END, 'K', [role || ':' || text] FROM judged JOIN steps USING (initial) WHERE fault NOT IN ('b', 'd')
  UNION ALL SELECT conv_id, pos, p, q, CASE fault WHEN 't' THEN 3 ELSE 2 END, 'R', [CASE s.initial WHEN 'u' THEN 'user:' ELSE 'assistant:' END || text] FROM judged, steps s WHERE fault NOT IN ('b', 'd') AND s.initial <> 's'),
walk AS (
  SELECT c.conv_id, CAST(0 AS BIGINT) AS pos, q AS place, struct_pack(cost := cost, audit := letters, lines := CAST(lines AS VARCHAR[])) AS best FROM (SELECT DISTINCT conv_id FROM conversations) c, inserted WHERE p = '0'
  UNION ALL
  SELECT w.conv_id, e.pos, i.q, min(struct_pack(cost := w.best.cost + e.cost + i.cost, audit := w.best.audit || e.letter || i.letters, lines := list_concat(list_concat(w.best.lines, CAST(e.lines AS VARCHAR[])), CAST(i.lines AS VARCHAR[]))))
  FROM walk w JOIN edits e ON e.conv_id IS NOT DISTINCT FROM w.conv_id AND e.pos = w.pos + 1 AND e.p = w.place JOIN inserted i ON i.p = e.q
  GROUP BY w.conv_id, e.pos, i.q),
ends AS (SELECT conv_id, arg_min(best, (-pos, best)) AS best FROM walk WHERE place IN ('0', 'a') GROUP BY conv_id),
counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
    count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM judged GROUP BY conv_id)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(best.cost AS BIGINT) AS cost, best.audit AS audit, sha256(array_to_string(best.lines, chr(10))) AS repaired_sha256
FROM ends e LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM e.conv_id
"""
ORACLES = {"op12_conversation_repair": ORACLE}
