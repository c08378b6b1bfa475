r"""Conversation repair: the cheapest edits by a grammar-compressed dynamic programme.

Each row of a conversation is one of nine symbols: its role (system, user, assistant, other), whether its text is
cut off, or that it has to go (blank or repeated). A well-formed conversation is ``(s?(ua)+)?`` in role
initials, a machine of four states. A symbol is a min-plus matrix over these states: the cheapest way from
state to state that consumes the row, inserted rows before it included, with the audit of its
edits: Keep 0, Rerole 2, Insert 2, Delete 3, and 1 for a cut-off row that stays.

The distinct symbol sequences of a block of conversations are compressed by Re-Pair: the most frequent
pair of neighbours becomes a rule, again and again. The matrix of a rule is the product of the matrices of its
two sides, made once, bottom-up, and used by all conversations that hold the rule; a
worker keeps the matrices for later blocks. A conversation then costs one product a symbol that is left.

Audits are ropes: an entry of a product refers to the audits of its two sides, and letters are laid out
only to settle a tie or to report the result. Of equally cheap edits the one whose audit
is least in ASCII order wins. Products respect that order: two audits of the same rows and cost are never
one the beginning of the other, as the longer one would only add insertions, which cost. An
audit and the rows determine the repaired conversation: after a user row comes
an assistant, otherwise a user.

Rows: null role and null text count as one blank; the order is (turn, nulls first; role; text), so ties have
one order and repeated rows are duplicates; a null conv_id is a conversation of its own; a role whose initial is not
s, u or a (the empty role too) has to be rerolled or deleted; empty tables give empty results;
texts of any length are only looked at from their end; further columns are ignored. A conversation must fit into one row, as its repaired text is one value; rows
are grouped by one shuffle and never gathered elsewhere.
"""

from __future__ import annotations

import heapq
import itertools
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom.llm.common import query, read

#: Symbols that are compressed together.
BLOCK = 50_000
#: Matrices a worker remembers.
CACHE_RULES = 20_000

KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 2, 3, 2, 1
_WHITE = " \t\n\x0b\x0c\r"
#: Machine of role initials: 0 nothing yet, 1 after the system row, 2 after a user, 3 after an assistant.
_MOVES = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
_STATES = range(4)
_ACCEPTING = (0, 3)
_FAIR_PAIRS = ("su", "ua", "au")
_GONE = "x"

Rope = str | tuple
Matrix = list[list[tuple[int, Rope] | None]]


def letters(rope: Rope) -> str:
    """The audit that a rope stands for."""
    out, todo = [], [rope]
    while todo:
        part = todo.pop()
        if isinstance(part, str):
            out.append(part)
        else:
            todo += (part[1], part[0])
    return "".join(out)


def _tied(a: Rope, b: Rope) -> str:
    """Join of two audits; short ones are laid out at once."""
    if isinstance(a, str) and isinstance(b, str) and len(a) + len(b) <= 64:
        return a + b
    return (a, b)


def _better(new: tuple[int, Rope], old: tuple[int, Rope] | None) -> bool:
    if old is None or new[0] != old[0]:
        return old is None or new[0] < old[0]
    return letters(new[1]) < letters(old[1])


def product(a: Matrix, b: Matrix) -> Matrix:
    """Min-plus product with audits; ``a`` may have fewer rows than states."""
    out: Matrix = []
    for row in a:
        line: list[tuple[int, Rope] | None] = [None] * len(_STATES)
        for via, head in enumerate(row):
            if head is None:
                continue
            for to, tail in enumerate(b[via]):
                if tail is None or (line[to] is not None and head[0] + tail[0] > line[to][0]):
                    continue
                new = (head[0] + tail[0], _tied(head[1], tail[1]))
                if _better(new, line[to]):
                    line[to] = new
        out.append(line)
    return out


def _insertions() -> Matrix:
    """Cheapest insertions from state to state, none included."""
    out: Matrix = [[(0, "") if i == j else None for j in _STATES] for i in _STATES]
    for start in _STATES:
        at, cost, audit = start, 0, ""
        while True:
            at = next(to for (state, role), to in _MOVES.items() if state == at and role != "s")
            cost, audit = cost + INSERT, audit + "I"
            if out[start][at] is not None:
                break
            out[start][at] = (cost, audit)
    return out


def _symbol(symbol: str) -> Matrix:
    """Ways over one row: insertions, then one edit."""
    out: Matrix = [[None] * len(_STATES) for _ in _STATES]
    role, cut = symbol.lower(), CUT_OFF * symbol.isupper()
    for state in _STATES:
        ways = [(DELETE, "D", state)]
        if symbol != _GONE:
            ways += [(KEEP + cut, "K", _MOVES.get((state, role))), *((REROLE + cut, "R", _MOVES.get((state, r))) for r in "ua")]
        for cost, letter, to in ways:
            if to is not None and _better((cost, letter), out[state][to]):
                out[state][to] = (cost, letter)
    return product(_BETWEEN, out)


_BETWEEN = _insertions()
SYMBOLS = {s: _symbol(s) for s in "suaoSUAO" + _GONE}


def re_pair(sequences: list[list]) -> tuple[list[tuple], list[list]]:
    """Rules (left, right), named 0, 1, ... in their order, and the sequences in terms of them.

    Replaces the most frequent pair of neighbours by a new name while one occurs twice.
    Symbols of the given sequences must not be whole numbers.
    """
    symbols: list = []
    for sequence in sequences:
        symbols += [*sequence, None]
    n = len(symbols)
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    places: dict[tuple, set[int]] = defaultdict(set)
    for k in range(n - 1):
        if symbols[k] is not None and symbols[k + 1] is not None:
            places[symbols[k], symbols[k + 1]].add(k)
    # Equal counts go by the first place, so that a block always gives one grammar.
    order = itertools.count()
    heap = [(-len(p), min(p), next(order), pair) for pair, p in places.items() if len(p) > 1]
    heapq.heapify(heap)
    rules: list[tuple] = []

    def pair_at(k: int) -> tuple | None:
        to = after[k] if 0 <= k < n else n
        return (symbols[k], symbols[to]) if to < n and symbols[k] is not None and symbols[to] is not None else None

    while heap:
        count, _, _, pair = heapq.heappop(heap)
        now = places.get(pair, ())
        if len(now) < 2:
            continue
        if -count != len(now):
            heapq.heappush(heap, (-len(now), min(now), next(order), pair))
            continue
        name = len(rules)
        rules.append(pair)
        touched: dict[tuple, None] = {}
        for k in sorted(places.pop(pair)):
            if pair_at(k) != pair:
                continue
            to = after[k]
            for at in (before[k], to):
                if at >= 0 and (old := pair_at(at)) is not None and old in places:
                    places[old].discard(at)
            symbols[k], symbols[to] = name, None
            after[k] = after[to]
            if after[k] < n:
                before[after[k]] = k
            for at in (before[k], k):
                if at >= 0 and (new := pair_at(at)) is not None:
                    places[new].add(at)
                    touched[new] = None
        for new in touched:
            if new != pair and len(places[new]) > 1:
                heapq.heappush(heap, (-len(places[new]), min(places[new]), next(order), new))
        places.pop(pair, None)
    out, k = [], 0
    for sequence in sequences:
        end, line = k + len(sequence), []
        while k < end:
            line.append(symbols[k])
            k = after[k]
        out.append(line)
        k = end + 1
    return rules, out


class Repairer:
    """Solves blocks of symbol sequences; rule matrices are kept by what they stand for."""

    def __init__(self):
        self.known: dict[tuple, tuple[Matrix, Matrix, Matrix]] = {}

    def _rule(self, left: Matrix, right: Matrix) -> Matrix:
        key = (id(left), id(right))
        found = self.known.get(key)
        if found is None:
            if len(self.known) >= CACHE_RULES:
                self.known.clear()
            # The sides are kept with the product, so that their identities stay taken.
            found = self.known[key] = (product(left, right), left, right)
        return found[0]

    def solve(self, sequences: list[str]) -> dict[str, tuple[int, str]]:
        """Cost and audit of each sequence."""
        different = sorted(set(sequences))
        rules, lines = re_pair([list(s) for s in different])
        matrices: list[Matrix] = []
        for left, right in rules:
            a, b = (matrices[s] if isinstance(s, int) else SYMBOLS[s] for s in (left, right))
            matrices.append(self._rule(a, b))
        out = {}
        for sequence, line in zip(different, lines, strict=True):
            ways: Matrix = [[(0, ""), None, None, None]]
            for s in line:
                ways = product(ways, matrices[s] if isinstance(s, int) else SYMBOLS[s])
            ends = [way for state in _ACCEPTING if (way := product(ways, _BETWEEN)[0][state]) is not None]
            best = None
            for way in ends:
                if _better(way, best):
                    best = way
            out[sequence] = (best[0], letters(best[1]))
        return out


def faults(rows: list[tuple[str, str]]) -> str:
    """Symbols of the (role, text) rows of a conversation: each row's first fault, or its role."""
    seen: set[tuple[str, str]] = set()
    out = []
    for role, text in rows:
        said = text.rstrip(_WHITE)
        if not said:
            out.append("b")
        elif (role, text) in seen:
            out.append("d")
        else:
            kind = role[:1] if role[:1] in ("s", "u", "a") else "o"
            out.append(kind if said[-1] in ".!?" else kind.upper())
        seen.add((role, text))
    return "".join(out)


def repaired(rows: list[tuple[str, str]], audit: str) -> list[tuple[str, str]]:
    """The rows after the edits of an audit."""
    out, left, state = [], iter(rows), 0
    for letter in audit:
        role, text = ("", "") if letter == "I" else next(left)
        if letter == "D":
            continue
        if letter != "K":
            role = "assistant" if state == 2 else "user"
        state = _MOVES[state, role[0]]
        out.append((role, text))
    return out


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """(conv_id, turns) rows, cut into blocks of about ``BLOCK`` turns."""
    held, size = [], 0
    for batch in batches:
        turns = batch.column("turns")
        ends = turns.offsets.to_pylist()
        inner = turns.values
        numbers, roles, texts = (inner.field(k).to_pylist() for k in range(3))
        for conv, lo, hi in zip(batch.column("conv_id").to_pylist(), ends, ends[1:], strict=False):
            held.append((conv, numbers[lo:hi], list(zip(roles[lo:hi], texts[lo:hi], strict=True))))
            size += hi - lo
            if size >= BLOCK:
                yield held
                held, size = [], 0
    if held:
        yield held


def repair_conversations(chats: DataFrame, present: Column | None = None) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired (array of role and text).

    ``gaps`` are turn numbers missing between the first and the last; ``illegal`` counts adjacent
    rows whose role initials do not follow one another. Rows for which ``present`` is not true only name their conversation.
    """
    row = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    kept = row if present is None else F.when(present, row)
    turns = chats.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(kept)).alias("turns"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repairer = Repairer()
        for block in _blocks(batches):
            signs = [faults(rows) for _, _, rows in block]
            symbols = [s.translate(_FORCED) for s in signs]
            solved = repairer.solve(symbols)
            yield _report(block, signs, [solved[s] for s in symbols])

    return turns.mapInArrow(work, _SCHEMA)


_FORCED = str.maketrans("bd", _GONE * 2)
_SCHEMA = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
    "repaired array<struct<role: string, text: string>>"
)


def _report(block: list[tuple], signs: list[str], solved: list[tuple[int, str]]) -> pa.RecordBatch:
    out: dict[str, list] = defaultdict(list)
    for (conv, numbers, rows), sign, (cost, audit) in zip(block, signs, solved, strict=True):
        known = {t for t in numbers if t is not None}
        out["conv_id"].append(conv)
        out["gaps"].append(max(known) - min(known) + 1 - len(known) if known else 0)
        out["blank"].append(sign.count("b"))
        out["duplicate"].append(sign.count("d"))
        out["truncated"].append(sum(map(str.isupper, sign)))
        out["illegal"].append(sum(a[0][:1] + b[0][:1] not in _FAIR_PAIRS for a, b in itertools.pairwise(rows)))
        out["cost"].append(cost)
        out["audit"].append(audit)
        out["repaired"].append([{"role": r, "text": t} for r, t in repaired(rows, audit)])
    kinds = {"conv_id": pa.int64(), "audit": pa.string(), "repaired": pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))}
    return pa.RecordBatch.from_arrays([pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items()], list(out))


def damaged(chats: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, present: rows damaged by their digest, as the contract of the query says; dropped rows are not ``present``."""
    blank = F.lit(" ")
    named = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    kind = F.crc32(named) % 20
    text, role = F.coalesce("text", blank), F.coalesce("role", blank)
    return chats.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        (kind != 0).alias("present"), F.explode(F.array_repeat(F.lit(1), F.when(kind == 3, 2).otherwise(1))).alias("copy"),
    ).drop("copy")


_SQL = r"""
WITH RECURSIVE bits(i, k, c) AS (
  SELECT range, 0, range FROM range(256)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8
), folded AS (SELECT list(c ORDER BY i) AS tab FROM bits WHERE k = 8),
named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT) AS name
  FROM conversations
), kinds AS (
  SELECT conv_id, turn, role, text,
    xor(list_reduce(list_prepend(4294967295::BIGINT, name), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS kind
  FROM named, folded
), damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM kinds, range(2) AS copies(n) WHERE kind <> 0 AND (n = 0 OR kind = 3)
), named_convs AS (SELECT conv_id, row_number() OVER (ORDER BY conv_id) AS c FROM (SELECT DISTINCT conv_id FROM conversations)),
placed AS (
  SELECT c, turn, role, text, substr(role, 1, 1) AS ini, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text) AS i
  FROM damaged JOIN named_convs n ON n.conv_id IS NOT DISTINCT FROM damaged.conv_id
), judged AS (
  SELECT *, lag(ini) OVER (PARTITION BY c ORDER BY i) AS was,
    CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
      WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 THEN 'duplicate'
      WHEN regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
  FROM placed
), inserts(f, t, cost, audit, out) AS (
  SELECT * FROM (VALUES (0, 0, 0, '', []::VARCHAR[]), (1, 1, 0, '', []), (2, 2, 0, '', []), (3, 3, 0, '', []),
    (0, 2, 2, 'I', ['user:']), (1, 2, 2, 'I', ['user:']), (3, 2, 2, 'I', ['user:']), (2, 3, 2, 'I', ['assistant:']),
    (0, 3, 4, 'II', ['user:', 'assistant:']), (1, 3, 4, 'II', ['user:', 'assistant:']))
), edits(state, letter, ini, t, cost, role) AS (
  VALUES (0, 'D', '', 0, 3, ''), (1, 'D', '', 1, 3, ''), (2, 'D', '', 2, 3, ''), (3, 'D', '', 3, 3, ''),
    (0, 'K', 's', 1, 0, ''), (0, 'K', 'u', 2, 0, ''), (1, 'K', 'u', 2, 0, ''), (3, 'K', 'u', 2, 0, ''), (2, 'K', 'a', 3, 0, ''),
    (0, 'R', '', 2, 2, 'user'), (1, 'R', '', 2, 2, 'user'), (3, 'R', '', 2, 2, 'user'), (2, 'R', '', 3, 2, 'assistant')
), best(c, i, state, way) AS (
  SELECT c, 0::BIGINT, 0, {'cost': 0::BIGINT, 'audit': '', 'out': []::VARCHAR[]} FROM named_convs
  UNION ALL
  SELECT b.c, r.i, d.t, min({
    'cost': b.way.cost + e.cost + d.cost + CASE WHEN r.fault = 'truncated' AND d.letter <> 'D' THEN 1 ELSE 0 END,
    'audit': b.way.audit || e.audit || d.letter,
    'out': b.way.out || e.out || CASE d.letter WHEN 'D' THEN [] WHEN 'K' THEN [r.role || ':' || r.text] ELSE [d.role || ':' || r.text] END})
  FROM best b JOIN inserts e ON e.f = b.state JOIN judged r ON r.c = b.c AND r.i = b.i + 1
    JOIN edits d ON d.state = e.t AND (d.letter = 'D' OR (r.fault NOT IN ('blank', 'duplicate') AND (d.letter = 'R' OR d.ini = r.ini)))
  GROUP BY b.c, r.i, d.t
), ends AS (
  SELECT b.c, min({'cost': b.way.cost + e.cost, 'audit': b.way.audit || e.audit, 'out': b.way.out || e.out}) AS way
  FROM best b JOIN inserts e ON e.f = b.state AND e.t IN (0, 3)
  WHERE b.i = coalesce((SELECT max(i) FROM judged j WHERE j.c = b.c), 0) GROUP BY b.c
), counted AS (
  SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank,
    count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
    count(*) FILTER (WHERE i > 1 AND was || ini NOT IN ('su', 'ua', 'au')) AS illegal
  FROM judged GROUP BY c
)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, way.cost AS cost, way.audit AS audit,
  sha256(array_to_string(way.out, chr(10))) AS repaired_sha256
FROM named_convs JOIN ends USING (c) LEFT JOIN counted USING (c)
"""


@query("op13_conversation_repair", _SQL)
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repair_conversations(damaged(read(spark, sf_dir, "conversations")), F.col("present"))
    said = F.array_join(F.transform("repaired", lambda r: F.concat(r["role"], F.lit(":"), r["text"])), "\n")
    return found.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.sha2(said, 256).alias("repaired_sha256"))
