"""Operators on texts against brute force and the tokenizers' own libraries."""

import hashlib
import itertools
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from creditloom.llm import decontamination, language_id, license_scan, packing, queries, quality, substring_dedup, textops, token_counts

ODD = [(1, None), (2, ""), (3, " \n\t "), (None, "alone here"), (5, "twice"), (5, "twice"), (6, "É ß 日本 \x1c 😀 </s> <|endoftext|>"), (7, "word " * 30_000)]
alphabet = st.text(alphabet=" \n\tabcdeths.,'-|(){}éñß日😀▁<>/01\x00\x1c\u0085", max_size=60)


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


# --- words


@given(st.lists(alphabet, max_size=6))
@settings(max_examples=80, deadline=None)
def test_words_are_runs_without_white_space(texts):
    words = textops.split_words(pa.array(texts, pa.string()))
    data = words.text.tobytes()
    found = [data[s:e] for s, e in zip(words.start, words.end, strict=True)]
    want = [re.findall(rb"[^\x20\x09-\x0D]+", t.encode()) for t in texts]
    assert found == [w for t in want for w in t]
    assert np.diff(words.first).tolist() == [len(t) for t in want]
    by_word = {}
    for word, h in zip(found, words.hashes().tolist(), strict=True):
        assert by_word.setdefault(word, h) == h
    assert len(set(by_word.values())) == len(by_word)


def test_chunks_keep_every_row():
    batch = pa.RecordBatch.from_pydict({"text": ["a" * 10, None, "b" * 100, "", "c"]})
    assert sum((c.column("text").to_pylist() for c in textops.chunks([batch], limit=12)), []) == batch.column("text").to_pylist()


# --- token counts


@pytest.fixture(scope="module")
def prefix_encoder():
    return token_counts.PrefixEncoder(public_tokenizers.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def pieces():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


@given(alphabet)
@settings(max_examples=150, deadline=None)
def test_every_prefix_has_the_librarys_count(prefix_encoder, pieces, text):
    counts = token_counts.prefix_counts(prefix_encoder.steps(text))
    assert counts.tolist() == [len(pieces.encode(text[:i])) for i in range(len(text) + 1)]


def test_budget_cut_is_the_longest_fitting_prefix(prefix_encoder, pieces):
    text = "Tokens of every prefix, ununununbreakable " * 4
    for budget in (0, 1, 7, 20, 10_000):
        cut = token_counts.cut_for_budget(prefix_encoder.steps(text), budget)
        fits = [i for i in range(len(text) + 1) if len(pieces.encode(text[:i])) <= budget]
        assert cut == max(fits)


def test_token_counts_of_a_table(spark, frame, sf_dir, texts, pieces):
    found = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in queries.QUERIES["op2_token_counts"](spark, sf_dir).collect()}
    assert found == {i: (len(t.encode()), len(pieces.encode(t)), len(pieces.encode(t)) > 4096) for i, t in texts}
    odd = token_counts.count_tokens(frame(ODD), max_tokens=10)
    got = rows(odd, "doc_id", "n_tokens")
    assert got == sorted([(i, len(pieces.encode(t or ""))) for i, t in ODD], key=repr)
    long = odd.where("doc_id = 7").first()
    assert long.over_limit and len(long.prefix_steps) == long.n_bytes + 1
    assert token_counts.count_tokens(frame(ODD).limit(0)).count() == 0


# --- language


def test_held_out_languages_are_right(spark, sf_dir, documents):
    found = queries.QUERIES["op3_language_id"](spark, sf_dir).join(documents.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in found if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in found)
    assert sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in found)


def test_mixed_texts_get_spans(spark, documents, frame):
    model = language_id.fit(documents)
    words = {x: next(r.text for r in documents.where(f"lang = '{x}' and length(text) > 800").take(1)).split()[:40] for x in ("en", "de", "fr")}
    mixed = " ".join(words["en"] + words["de"] + words["fr"])
    found = {r.doc_id: r for r in language_id.identify(frame([*ODD, (20, mixed), (21, "12 34 ?!")]), model).collect()}
    spans = [(s.lang, s.first_word, s.last_word) for s in found[20].spans]
    assert spans == [("en", 0, 39), ("de", 40, 79), ("fr", 80, 119)]
    for i in (1, 2, 3, 21):
        assert (found[i].lang_pred, found[i].score, found[i].spans) == ("und", 0.0, [])
    assert found[None].lang_pred in model.languages


def test_viterbi_equals_search_over_all_paths():
    rng = np.random.default_rng(0)
    model = language_id.Model(["a", "b", "c"], np.zeros((language_id.SLOTS, 3), np.float32), np.ones((len(language_id.SCRIPT_NAMES), 3), bool))
    labeller = language_id.Labeller(model, switch=1.5)
    labeller.scores = rng.normal(size=(20, 3)).astype(np.float32)
    for size in (1, 4, 6):
        tokens = rng.integers(0, 20, size)
        label = labeller.paths(tokens, np.array([0, size]))

        def value(path, tokens=tokens):
            return sum(labeller.scores[t][s] for t, s in zip(tokens, path, strict=True)) - 1.5 * sum(a != b for a, b in zip(path, path[1:], strict=False))

        best = max(value(p) for p in np.ndindex(*[3] * size))
        assert value(tuple(label)) == pytest.approx(best, abs=1e-5)


def test_words_are_cut_alike_in_learning_and_scoring(spark):
    rows = [(1, "l'eau d'or l'air", "fr"), (2, "l'eau pure", "fr"), (3, "the water is gold", "en"), (4, "air and water", "en")]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    labeller = language_id.Labeller(model)
    found, _ = labeller.tokens(["l'eau", "l eau", "(Water)", "water", "12", "L'EAU!"])
    whole, left, right, signed, plain, none, loud = labeller.scores[found]
    np.testing.assert_allclose(whole, left + right)
    np.testing.assert_allclose(loud, whole)
    np.testing.assert_allclose(signed, plain)
    assert not none.any() and labeller.letters[found].tolist() == [4, 1, 3, 5, 5, 0, 4]
    # Weights by direct counting of the words that each language taught.
    taught = {"en": "the water is gold air and water".split(), "fr": "l eau d or l air l eau pure".split()}
    total = {k: sum(len(language_id.slots_of(w)) for w in words) for k, words in taught.items()}
    for word in ("eau", "water", "or"):
        log = {k: sum(np.log((sum(s in language_id.slots_of(w) and language_id.slots_of(w).count(s) for w in words) + language_id.SMOOTHING)
                             / (total[k] + language_id.SMOOTHING * language_id.SLOTS)) for s in language_id.slots_of(word)) for k, words in taught.items()}
        en, fr = model.word_scores([word])[0]
        assert en - fr == pytest.approx(np.clip(log["en"] - log["fr"], -language_id.CLIP, language_id.CLIP), abs=1e-3)
    assert language_id.identify(spark.createDataFrame([(9, "l'eau")], "doc_id long, text string"), model).first().lang_pred == "fr"


def test_nothing_to_learn(frame, documents):
    model = language_id.fit(documents.where("lang IS NULL"))
    assert {r.lang_pred for r in language_id.identify(frame(ODD), model).collect()} == {"und"}
    kept = language_id.keep_identified(frame(ODD), language_id.fit(documents), 0.4)
    assert kept.columns == frame(ODD).columns and rows(kept, "doc_id") == [(5,), (5,), (6,), (7,), (None,)]


# --- licences


def _scan(texts):
    phrases = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
    for i, text in texts:
        words = [w.decode() for w in license_scan._WORD.findall((text or "").encode().lower())]
        at, labels, own = [], set(), set()
        for phrase, label in phrases.items():
            parts = phrase.split()
            hits = [k for k in range(len(words)) if words[k : k + len(parts)] == parts]
            at += hits
            labels |= {label} if hits else set()
        for t in license_scan.NOTICES:
            if any(len(set(t.words()) & set(words[k : k + t.span()])) >= t.needed() for k in range(len(words))):
                own.add(t.label)
        yield i, len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | own))


def test_license_scan_finds_every_block(spark, tmp_path, sf_dir, texts):
    columns = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels")
    assert rows(queries.QUERIES["op4_license_scan"](spark, sf_dir), *columns) == sorted(_scan(texts), key=repr)
    rng = np.random.default_rng(1)
    vocabulary = [w for t in license_scan.BASE + license_scan.NOTICES for w in t.words()] + ["x", "CC", "MIT"]
    made = [(i, " ".join(rng.choice(vocabulary, rng.integers(0, 60)))) for i in range(150)]
    for i, t in enumerate(license_scan.NOTICES * 5):
        words = t.words()
        for _ in range(rng.integers(0, 4)):
            words[rng.integers(len(words))] = str(rng.choice(vocabulary))
        made.append((500 + i, "x. " + "\n".join(words) + " x"))
    made += [*ODD[:6], (900, "cc-by cc by cc cc by MIT\nLICENSE gnu general public license")]
    spark.createDataFrame(made, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert rows(queries.QUERIES["op4_license_scan"](spark, str(tmp_path)), *columns) == sorted(_scan(made), key=repr)


def _every_block(text, templates):
    words = [w.decode() for w in license_scan._WORD.findall((text or "").encode().lower())]
    for number, t in enumerate(templates):
        kinds = set(t.words())
        for k, w in enumerate(words):
            run = words[k : k + t.span()]
            if w in kinds and (run == t.words() if t.phrase else len(kinds & set(run)) >= t.needed()):
                last = max(m for m, x in enumerate(run) if x in kinds)
                yield number, k, k + last, len(kinds & set(run)) / len(kinds)


def test_license_scan_reports_overlapping_blocks(frame):
    notice = "licensed under the apache license version 2 0"
    templates = license_scan.BASE + license_scan.NOTICES
    rng = np.random.default_rng(3)
    vocabulary = [w for t in license_scan.NOTICES for w in t.words()]
    bsd = templates[[t.label for t in templates].index("bsd")].text
    made = [(1, f"{notice} {notice}"), (2, f"under the terms {notice}"), (3, f"source and use {bsd} {bsd}")]
    made += [(10 + i, " ".join(rng.choice(vocabulary[:30], 80))) for i in range(30)]
    found = {r.doc_id: sorted(map(tuple, r.blocks)) for r in license_scan.scan(frame(made), templates).collect()}
    assert found == {i: sorted(_every_block(t, templates)) for i, t in made}
    apache = [b for b in found[1] if templates[b[0]].label == "apache-2.0"]
    assert (8, 15) in [b[1:3] for b in apache] and max(b[3] for b in found[2]) == max(b[3] for b in found[3]) == 1.0


def test_license_templates_need_words(frame):
    with pytest.raises(ValueError):
        license_scan.scan(frame(ODD), [license_scan.Template("none", " .,")])
    assert license_scan.scan(frame(ODD).limit(0)).count() == 0


# --- substring dedup


def _kept(texts, window):
    cut = [(i, re.findall("[^\x20\x09-\x0D]+", t or "")) for i, t in texts]
    seen = Counter(tuple(w[k : k + window]) for _, w in cut for k in range(len(w) - window + 1))
    for i, w in cut:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                gone[k : k + window] = [True] * window
        left = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        yield i, len(w), sum(gone), hashlib.sha256(left.encode()).hexdigest()


def test_substring_dedup_of_documents(spark, sf_dir, texts):
    found = rows(queries.QUERIES["op6_substring_dedup"](spark, sf_dir), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert found == sorted(_kept(texts, 35), key=repr)


@pytest.mark.parametrize("heavy", [3, 0.2])
def test_substring_dedup_in_whole_and_in_sharded_buckets(frame, monkeypatch, heavy):
    monkeypatch.setattr(substring_dedup, "HEAVY", heavy)
    rng = np.random.default_rng(2)
    made = [(i, " ".join(rng.choice(list("abc"), rng.integers(0, 60)))) for i in range(40)]
    made += [(i, "one passage that many texts share word for word " * 2 + str(i)) for i in range(40, 90)] + ODD
    found = substring_dedup.remove_repeats(frame(made), window=5, gram=2).selectExpr("doc_id", "n_words", "n_removed", "sha2(kept_text, 256) h")
    assert rows(found, "doc_id", "n_words", "n_removed", "h") == sorted(_kept(made, 5), key=repr)


def test_strip_repeats_keeps_other_columns(frame):
    passage = " ".join(f"w{k}" for k in range(40))
    df = frame([(1, f"a\n{passage} b"), (2, passage), (3, f"{passage} c"), (4, "as it  was"), (None, None)])
    out = substring_dedup.strip_repeats(df)
    assert out.columns == df.columns
    assert rows(out, "doc_id", "text") == sorted([(1, "a b"), (3, "c"), (4, "as it  was"), (None, None)], key=repr)
    assert substring_dedup.strip_repeats(df.limit(0)).count() == 0


# --- packing


@pytest.fixture(scope="module")
def word_ids():
    return packing.WordIds(public_tokenizers.path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


@given(st.lists(st.one_of(st.none(), alphabet), max_size=4))
@settings(max_examples=100, deadline=None)
def test_word_ids_are_the_librarys(word_ids, library, texts):
    ids, offsets = word_ids.encode(pa.array(texts, pa.string()))
    found = [ids[a:b].tolist() for a, b in itertools.pairwise(offsets.tolist())]
    assert found == [library.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_cache_that_fills_up_changes_nothing(monkeypatch, library):
    monkeypatch.setattr(packing, "CACHE_PARTS", 5)
    coder = packing.WordIds(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["one two, three", "four five six seven eight nine ten", "one ten."]
    for text in texts * 2:
        ids, offsets = coder.encode(pa.array([text, text]))
        want = library.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == want * 2 and offsets.tolist() == [0, len(want), 2 * len(want)]
        assert len(coder.known) <= 20


def test_placement_minimises_the_sum_of_squares():
    rng = np.random.default_rng(3)
    packer = packing.LevelPacker(16)
    for n in range(200):
        size = int(rng.integers(1, 16))

        def cost(h, size=size):
            level = packer.level.copy()
            if h:
                level[h] -= 1
            if h + size < 16:
                level[h + size] += 1
            return int((level[1:16] ** 2).sum())

        options = [0, *(h for h in range(1, 17 - size) if packer.level[h])]
        assert cost(packer.choose(size)) == min(map(cost, options))
        packer.place((n, 0, b"\0" * 4 * size, size), size)


def test_packed_sequences_hold_each_token_once(spark, documents, frame, library):
    for df in (documents, frame(ODD), frame(ODD).limit(0)):
        pieces = packing.pack_documents(df).toPandas()
        for _, group in pieces.groupby("sequence_id"):
            group = group.sort_values("offset")
            total = int(group.length.sum())
            assert group.offset.tolist() == np.append(0, np.cumsum(group.length))[:-1].tolist()
            assert total == 4096 or total & (total - 1) == 0
        want = Counter()
        for r in df.select("doc_id", "text").collect():
            ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 2]
            want[r.doc_id, tuple(ids)] += 1
        for key, group in pieces.groupby("doc_id", dropna=False):
            doc = None if key != key else int(key)
            if sum(n for (i, _), n in want.items() if i == doc) == 1:
                ids = np.frombuffer(b"".join(group.sort_values("start").ids), "<u4")
                assert (doc, tuple(ids.tolist())) in want


# --- decontamination


def _greedy(a, b, least):
    free_a, free_b, covered = [True] * len(a), [True] * len(b), 0
    while True:
        best, found = least - 1, []
        for i in range(len(a)):
            for d in range(len(b)):
                k = 0
                while i + k < len(a) and d + k < len(b) and free_a[i + k] and free_b[d + k] and a[i + k] == b[d + k]:
                    k += 1
                if k > best:
                    best, found = k, [(i, d)]
                elif k == best and k >= least:
                    found.append((i, d))
        if best < least:
            return covered
        for i, d in found:
            if all(free_a[i : i + best]) and all(free_b[d : d + best]):
                free_a[i : i + best] = free_b[d : d + best] = [False] * best
                covered += best


@given(st.text("abc", min_size=1, max_size=14), st.text("abc", max_size=30), st.integers(2, 4))
@settings(max_examples=150, deadline=None)
def test_tiling_is_greedy(a, b, least):
    numbers = [np.array([ord(c) * 7919 for c in x], np.uint64) for x in (a, b)]
    assert sum(t[2] for t in decontamination.tile(*numbers, least)) == _greedy(a, b, least)


def test_leaks_are_all_found(spark, sf_dir, texts):
    found = {r.doc_id: r.item_ids for r in queries.QUERIES["op10_decontamination"](spark, sf_dir).collect() if r.contaminated}
    items = {r.item_id: re.findall(r"[0-9a-z\x80-\U0010ffff]+", r.text.lower()) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    want = {}
    for i, text in texts:
        words = re.findall(r"[0-9a-z\x80-\U0010ffff]+", text.lower())
        grams = {tuple(words[k : k + 4]) for k in range(len(words))}
        for item, b in items.items():
            if any(tuple(b[k : k + 4]) in grams for k in range(len(b) - 3)) and _greedy(b, words, 4) >= 0.6 * len(b) - 1e-9:
                want.setdefault(i, []).append(item)
    assert found == want and want


def test_reordered_and_short_items(spark, frame):
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "Hello, world"), (4, "a b c d e f g h i j")], "item_id long, text string")
    df = frame([*ODD, (30, "x F G H I J y A B C D E z"), (31, "hello World"), (32, "a b c x d e f y g h i j")])
    tagged = decontamination.tag_leaks(df, bench, name="found")
    found = {r.doc_id: [(x.item_id, round(x.coverage, 3)) for x in r.found] for r in tagged.collect() if r.found}
    assert found == {30: [(4, 1.0)], 31: [(3, 1.0)]}
    tile = tagged.where("doc_id = 30").first().found[0].tiles
    assert sorted((t.item_word, t.doc_word, t.length) for t in tile) == [(0, 7, 5), (5, 1, 5)]
    kept = decontamination.keep_clean(df, bench)
    assert kept.columns == df.columns and kept.count() == df.count() - 2
    assert decontamination.keep_clean(df, bench.limit(0)).count() == df.count()
    assert decontamination.keep_clean(df.limit(0), bench).count() == 0


# --- quality


def test_gradient_is_the_slope_of_the_loss():
    rng = np.random.default_rng(4)
    bounds, slots, values = np.array([0, 2, 4, 7]), rng.integers(0, 5, 7), rng.normal(size=7)
    y, weight = np.array([0, 1, 2]), np.array([1.0, 2.0, 0.5])
    params = rng.normal(size=7)
    _, grad = quality.loss_and_gradient(params, 5, 3, bounds, slots, values, y, weight)
    for k in range(7):
        step = np.eye(7)[k] * 1e-6
        slope = (quality.loss_and_gradient(params + step, 5, 3, bounds, slots, values, y, weight)[0]
                 - quality.loss_and_gradient(params - step, 5, 3, bounds, slots, values, y, weight)[0]) / 2e-6
        assert grad[k] == pytest.approx(slope, rel=1e-4, abs=1e-6)


def test_grades_of_planted_words_are_learned(spark, frame):
    rng = np.random.default_rng(5)
    kinds = [["bad"], ["soso"], ["fine"]]
    made = [(i, " ".join([*rng.choice(["w1", "w2", "w3", "w4"], 20), *kinds[i % 3] * 2])) for i in range(300)]
    df = frame(made)
    graded = spark.createDataFrame([(i, i % 3) for i in range(200)] + [(None, 1), (5000, 2)], "doc_id long, grade int")
    model = quality.fit(df, graded, grades=3, steps=25)
    assert model.thresholds[0] < model.thresholds[1]
    found = quality.score(df, model, tail=2).where("doc_id >= 200").collect()
    assert all(round(r.expected_grade) == r.doc_id % 3 and (r.tail_probability >= 0.5) == (r.doc_id % 3 == 2) for r in found)
    odd = quality.score(frame(ODD), model, tail=2).collect()
    assert len(odd) == len(ODD) and all(0 <= r.tail_probability <= 1 for r in odd)
    nothing = quality.score(frame(ODD), quality.fit(df, graded.limit(0), grades=3), tail=2).collect()
    assert {(r.expected_grade, r.tail_probability) for r in nothing} == {(0.0, 0.0)}
    assert quality.score(df.limit(0), model, tail=2).count() == 0


def test_labels_with_nulls_teach_nothing(spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, 1, 1), (4, None, 0), (None, 1, 0), (5, 1, None)], "doc_id long, quality int, toxic int")
    assert rows(quality.grades_of(labels), "doc_id", "grade") == [(1, 2), (2, 0), (3, 1)]
