"""Periodic runs, SentencePiece encoding and conversation repair against brute force, the library and SQL."""

import hashlib
import itertools
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import compare, connect
from pyspark.sql import functions as F

from creditloom.llm import conversation_repair, periodic_runs, queries, sentence_pieces, textops

ODD = [(1, None), (2, ""), (3, " \n\t "), (None, "alone here"), (5, "twice"), (5, "twice"), (6, "É ß 日本 \x1c 😀 </s> <|endoftext|>"), (7, "word " * 30_000)]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- periodic runs


def all_runs(words, least=24, repeats=3):
    """Every maximal stretch of every period, without those that lie in a stretch of a smaller period."""
    n, found = len(words), []
    for q in range(1, n // repeats + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, repeats * q) and j > i:
                found.append((i, j + q - i, q))
            i = max(j, i + 1)
    return sorted(((s, m, q) for s, m, q in found if not any(a <= s and a + b >= s + m and p < q for a, b, p in found)), key=lambda r: (r[0], r[2]))


def found_runs(texts, least, repeats=3):
    words = textops.split_words(pa.array(texts, pa.string()))
    first = words.first.astype(np.int64)
    runs = periodic_runs.runs_of(textops.word_numbers(words)[0], first, least, repeats)
    return [[(s - lo, m, q) for s, m, q in runs.tolist() if lo <= s < hi] for lo, hi in itertools.pairwise(first.tolist())]


@given(st.lists(st.lists(st.sampled_from("ab"), max_size=60), max_size=4), st.integers(1, 12), st.integers(3, 4))
@settings(max_examples=300, deadline=None)
def test_runs_over_two_words(texts, least, repeats):
    assert found_runs([" ".join(t) for t in texts], least, repeats) == [all_runs(t, least, repeats) for t in texts]


@given(st.lists(st.tuples(st.lists(st.sampled_from(["a", "b", "ab"]), min_size=1, max_size=9), st.integers(1, 9)), max_size=8))
@settings(max_examples=200, deadline=None)
def test_runs_of_runs(blocks):
    words = [w for block, times in blocks for w in block * times]
    assert found_runs([" ".join(words)], 5) == [all_runs(words, 5)]


def test_fibonacci_and_unary_words():
    a, b = ["x"], ["x", "y"]
    while len(b) < 800:
        a, b = b, b + a
    assert found_runs([" ".join(b)], 24) == [all_runs(b)]
    assert found_runs(["same " * 5000], 24) == [[(0, 5000, 1)]]
    long = [str(k) for k in range(700)] * 3
    assert found_runs([" ".join(long)], 24) == [[(0, 2100, 700)]]


def op11_brute(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = all_runs(w)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    row = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *row, sha(lines), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_periodic_runs_query(spark, sf_dir, texts):
    short = [(i, t) for i, t in texts if len(t or "") < 8000]
    found = {r.doc_id: tuple(r) for r in queries.QUERIES["op11_periodic_runs"](spark, sf_dir).collect()}
    assert len(found) == len(texts)
    want = {i: op11_brute(i, t) for i, t in short}
    assert {i: found[i] for i in want} == want
    assert sum(r[1] > 0 for r in want.values()) > 10


def test_periodic_runs_of_odd_rows(frame):
    found = sorted((tuple(r) for r in periodic_runs.find_runs(frame(ODD)).collect()), key=repr)
    assert len(found) == len(ODD)
    by_id = {r[0]: r for r in found}
    assert by_id[1] == (1, 0, [], "") and by_id[3] == (3, 0, [], "")
    assert by_id[7][1:3] == (30_000, [(0, 30_000, 1)]) and by_id[7][3] == "word"
    assert by_id[6][3] == "É ß 日本 \x1c 😀 </s> <|endoftext|>"
    assert [r for r in found if r[0] == 5] == [(5, 1, [], "twice")] * 2
    assert periodic_runs.find_runs(frame([])).count() == 0
    with pytest.raises(ValueError):
        periodic_runs.runs_of(np.zeros(3, np.int64), np.array([0, 3]), min_repeats=2)


def test_tail_leaves_rows_without_id_or_words(frame):
    marked = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 10 == 0)
    rows = [(None, "a  b"), (marked, None), (marked, " \n"), (marked, "one")]
    assert sorted((tuple(r) for r in periodic_runs.with_periodic_tails(frame(rows)).collect()), key=repr) == sorted([(None, "a  b"), (marked, None), (marked, " \n"), (marked, "one")], key=repr)


# --- sentence pieces


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def codec():
    return sentence_pieces.PieceCodec(public_tokenizers.path("piece_bpe_32k.model"))


pieces_of_text = st.text(alphabet=" \n\tabcdeths.,'-|(){}éñß日😀▁<>/01\x00\x1c\u0085̈", max_size=60)
runs_of_blanks = st.lists(st.sampled_from([" ", "  ", "   ", "    ", "a", "un", "▁", "\n"]), max_size=30).map("".join)


def encoded(codec, texts):
    ids, offsets = codec.encode(pa.array(texts, pa.string()))
    return [ids[a:b].tolist() for a, b in itertools.pairwise(offsets.tolist())]


@given(st.lists(st.one_of(pieces_of_text, runs_of_blanks), max_size=5))
@settings(max_examples=200, deadline=None)
def test_encoding_is_the_librarys(codec, library, texts):
    ids = encoded(codec, texts)
    assert ids == library.encode(texts)
    flat, offsets = np.array([i for x in ids for i in x], dtype=np.int32), np.append(0, np.cumsum([len(x) for x in ids])).astype(np.int64)
    assert codec.decode(flat, offsets).to_pylist() == [library.decode(x) for x in ids]


@given(st.lists(st.lists(st.integers(0, 31_999) | st.integers(3, 258) | st.sampled_from([0, 1, 2, 259, 260, 29871]), max_size=12), max_size=5))
@settings(max_examples=200, deadline=None)
def test_decoding_any_ids_is_the_librarys(codec, library, lists):
    flat, offsets = np.array([i for x in lists for i in x], dtype=np.int32), np.append(0, np.cumsum([len(x) for x in lists])).astype(np.int64)
    assert codec.decode(flat, offsets).to_pylist() == [library.decode(x) for x in lists]


def test_long_unbroken_texts(codec, library):
    rng = random.Random(5)
    texts = ["".join(rng.choices("abcdefgh", k=20_000)), "un" * 5000, "日本語" * 3000, "=" * 3001, " " * 4097, "\u0085\x00" * 500]
    assert encoded(codec, texts) == library.encode(texts)


def test_full_memories_change_nothing(library, texts):
    small = sentence_pieces.PieceCodec(public_tokenizers.path("piece_bpe_32k.model"))
    for memory in (small._apart, small._parts):
        memory.limit = 3
    some = [t for _, t in texts[:40]]
    for _ in range(2):
        assert [encoded(small, [t])[0] for t in some] == library.encode(some)
    assert len(small._parts.old) < 5000


def test_sentence_piece_query(spark, sf_dir, texts, library):
    found = {r.doc_id: tuple(r)[1:] for r in queries.QUERIES["op12_sentence_pieces"](spark, sf_dir).collect()}
    ids = {i: library.encode(t or "", add_eos=True) for i, t in texts}
    assert found == {i: (len(x), sha(" ".join(map(str, x))), sha(library.decode(x))) for i, x in ids.items()}


def test_round_trip_of_odd_rows(frame, library):
    docs = sentence_pieces.encode_documents(frame(ODD))
    found = sorted(((r.doc_id, r.ids) for r in docs.collect()), key=repr)
    assert found == sorted(((i, library.encode(t or "", add_eos=True)) for i, t in ODD), key=repr)
    read = sorted((tuple(r) for r in sentence_pieces.decode_documents(docs).collect()), key=repr)
    assert read == sorted(((i, t or "") for i, t in ODD), key=repr)
    assert sentence_pieces.encode_documents(frame([])).count() == 0
    nothing = docs.limit(1).select("doc_id", F.lit(None).cast("array<int>").alias("ids"))
    assert [r.text for r in sentence_pieces.decode_documents(nothing).collect()] == [""]


# --- conversation repair


def cheapest(rows):
    """All edit scripts with up to two insertions a gap, tried out."""
    signs = conversation_repair.faults(rows)
    gaps = [("",), ("u",), ("a",), ("u", "a"), ("a", "u")]
    gaps[0] = ()
    best = None
    choices = []
    for sign, (role, text) in zip(signs, rows, strict=True):
        ways = [("D", 3, None)]
        if sign not in "bd":
            cut = int(sign.isupper())
            ways += [("K", cut, (role, text)), ("R", 2 + cut, ("user", text)), ("R", 2 + cut, ("assistant", text))]
        choices.append(ways)
    for edits in itertools.product(*choices):
        for inserted in itertools.product(gaps, repeat=len(rows) + 1):
            cost = sum(e[1] for e in edits) + 2 * sum(map(len, inserted))
            if best is not None and cost > best[0]:
                continue
            audit, out = "", []
            for k, gap in enumerate(inserted):
                audit += "I" * len(gap)
                out += [("user" if g == "u" else "assistant", "") for g in gap]
                if k < len(edits):
                    audit += edits[k][0]
                    out += [edits[k][2]] if edits[k][2] else []
            if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "?" for r, _ in out)) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, out)
    return best


turn_texts = st.tuples(st.sampled_from(["system", "user", "assistant", "tool", " "]), st.sampled_from(["Yes.", "cut", " ", "Why? \n"]))


@given(st.lists(turn_texts, max_size=3))
@settings(max_examples=60, deadline=None)
def test_repair_is_the_cheapest(rows):
    sign = conversation_repair.faults(rows).translate(conversation_repair._FORCED)
    cost, audit = conversation_repair.Repairer().solve([sign])[sign]
    want = cheapest(rows)
    assert (cost, audit, conversation_repair.repaired(rows, audit)) == want


@given(st.lists(st.text(alphabet="suaoSUx", max_size=14), max_size=8))
@settings(max_examples=150, deadline=None)
def test_grammar_keeps_sequences_and_results(sequences):
    rules, lines = conversation_repair.re_pair([list(s) for s in sequences])

    def spelt(symbol):
        return "".join(map(spelt, rules[symbol])) if isinstance(symbol, int) else symbol

    assert ["".join(map(spelt, line)) for line in lines] == sequences
    pairs = [p for line in lines for p in itertools.pairwise(line)]
    loose = {p for p in pairs if pairs.count(p) > 1 and p[0] != p[1]}
    assert not loose
    alone = {s: conversation_repair.Repairer().solve([s])[s] for s in sequences}
    assert conversation_repair.Repairer().solve(sequences) == alone


def test_long_conversations_share_rules():
    repairer = conversation_repair.Repairer()
    sequence = "s" + "ua" * 4000 + "uxa" * 50
    cost, audit = repairer.solve([sequence, sequence[:5000]])[sequence]
    assert (cost, audit) == (150, "K" * 8001 + "KDK" * 50)
    assert len(repairer.known) < 60


def test_small_rule_memory_changes_nothing(monkeypatch):
    rng = random.Random(1)
    sequences = ["".join(rng.choices("suaUAx", k=rng.randrange(30))) for _ in range(200)]
    want = conversation_repair.Repairer().solve(sequences)
    monkeypatch.setattr(conversation_repair, "CACHE_RULES", 3)
    assert conversation_repair.Repairer().solve(sequences) == want


def test_repair_query_agrees_with_sql(spark, sf_dir):
    name = "op13_conversation_repair"
    assert compare(queries.QUERIES[name](spark, sf_dir), connect(sf_dir), queries.ORACLES[name]) is None


def test_repair_of_odd_conversations(spark, monkeypatch):
    monkeypatch.setattr(conversation_repair, "BLOCK", 2)
    rows = [
        (1, None, "user", "Hi there.", 0), (1, 2, "assistant", "cut off", 0), (1, 2, "assistant", "cut off", 0),
        (2, 0, None, None, 0), (None, 5, "", "What is it?", 0), (None, 9, "User", "Mind the case.", 0),
        (4, 3, "system", "word " * 30_000 + ".", 0),
    ]
    chats = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, cost int")
    found = {r.conv_id: r for r in conversation_repair.repair_conversations(chats).collect()}
    assert set(found) == {1, 2, None, 4}
    one = found[1]
    assert (one.gaps, one.blank, one.duplicate, one.truncated, one.illegal, one.cost, one.audit) == (0, 0, 1, 1, 1, 4, "KKD")
    assert [tuple(r) for r in one.repaired] == [("user", "Hi there."), ("assistant", "cut off")]
    assert (found[2].blank, found[2].cost, found[2].audit, found[2].repaired) == (1, 3, "D", [])
    assert (found[None].gaps, found[None].illegal, found[None].cost, found[None].audit) == (3, 1, 4, "RR")
    assert found[4].cost == 3 and found[4].audit == "D"
    none = conversation_repair.repair_conversations(chats, F.col("conv_id") == 1)
    empty = next(r for r in none.collect() if r.conv_id == 2)
    assert (empty.gaps, empty.cost, empty.audit, empty.repaired) == (0, 0, "", [])
    assert conversation_repair.repair_conversations(chats.limit(0)).count() == 0


def test_damage_follows_the_digest(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()
    want = []
    for r in rows:
        kind = zlib.crc32(f"{r.conv_id}:{r.turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", r.text) if kind == 2 else r.text
        want += [(r.conv_id, r.turn, "user" if kind == 4 else r.role, text, kind != 0)] * (2 if kind == 3 else 1)
    found = conversation_repair.damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")).collect()
    assert sorted(map(tuple, found)) == sorted(want)
