"""Near-duplicates, search, chats and the pipeline."""

import math
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from creditloom.llm import chat_format, components, queries, simhash_dedup, vector_search
from creditloom.sources.tables import stage
from oracle import compare, connect


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


# --- SimHash


def _groups(texts, shingle, radius):
    prints = []
    for _, text in texts:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        words = re.findall("[^\x20\x09-\x0D]+", low)
        grams = [" ".join(words[k : k + shingle]) for k in range(len(words) - shingle + 1)] or ([" ".join(words)] if words else [])
        hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(texts):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return sorted([(i, f"{prints[k]:016x}", least.get(find(k))) for k, (i, _) in enumerate(texts)], key=repr)


def _found(df):
    return rows(df.select("doc_id", F.lpad(F.lower(F.hex("f0")), 16, "0").alias("fingerprint"), "component_id"), "doc_id", "fingerprint", "component_id")


def test_simhash_groups_of_documents(spark, sf_dir, texts):
    assert rows(queries.QUERIES["op7_simhash_dedup"](spark, sf_dir), "doc_id", "fingerprint", "component_id") == _groups(texts, 3, 2)


@pytest.mark.parametrize("tile", [4, 2048])
def test_tiles_lose_no_link(frame, monkeypatch, tile):
    monkeypatch.setattr(simhash_dedup, "TILE", tile)
    rng = np.random.default_rng(1)
    base = [f"w{k}" for k in range(120)]
    made = []
    for i in range(120):
        words = list(base)
        words[rng.integers(120)] = f"z{rng.integers(9)}"
        made.append((i, " ".join(words if i % 2 else rng.choice(base, 40))))
    made += [(200, None), (201, ""), (202, " \n"), (203, "A"), (204, "a"), (204, "a"), (None, "a"), (None, "quite alone here")]
    assert _found(simhash_dedup.near_duplicates(frame(made), radius=4)) == _groups(made, 3, 4)
    assert simhash_dedup.near_duplicates(frame(made).limit(0)).count() == 0


def test_one_of_each_group_stays(frame):
    text = " ".join(f"word{k}" for k in range(200))
    made = [(1, "quite another text that is alone"), (3, text), (2, text.replace("word100", "other")), (2, text.replace("word100", "other")), (None, "nobody")]
    df = frame(made)
    kept = simhash_dedup.keep_one(df, **corpus_pipeline.NEAR)
    assert kept.columns == df.columns and rows(kept, "doc_id") == [(1,), (2,), (None,)]


def test_near_dedup_leaves_only_its_keys_on_disk(frame, tmp_path, monkeypatch):
    monkeypatch.setattr("creditloom.sources.tables.shared_folder", lambda spark: str(tmp_path))
    text = " ".join(f"word{k}" for k in range(200))
    kept = simhash_dedup.keep_one(frame([(1, text), (2, text.replace("word100", "other")), (3, "alone")]), **corpus_pipeline.NEAR)
    assert [p.name.rsplit("-", 1)[0] for p in tmp_path.iterdir()] == ["first-rows"]
    assert rows(kept, "doc_id") == [(1,), (3,)]


def test_one_row_stays_whatever_the_ids(frame):
    text = " ".join(f"word{k}" for k in range(200))
    near = text.replace("word100", "other")
    made = [(1, "one text under this id"), (1, "and a wholly different one"), (None, text), (None, near), (None, near), (None, "alone"), (None, None), (7, ""), (5, near + " end"), (6, "x y")]
    kept = rows(simhash_dedup.keep_one(frame(made), **corpus_pipeline.NEAR), "doc_id", "text")
    assert kept == sorted([made[0], made[1], made[5], made[7], made[8], made[9]], key=repr)
    unnamed = simhash_dedup.keep_one(frame([(None, text), (None, near), (None, near)]), **corpus_pipeline.NEAR)
    assert unnamed.count() == 1


def test_near_copies_of_similarity_eight_tenths_link(frame):
    rng = np.random.default_rng(6)
    made = []
    for i in range(30):
        words = [f"w{rng.integers(10**6)}" for _ in range(200)]
        made.append((2 * i, " ".join(words)))
        for k in (40, 90, 140, 190):  # 20 of 196 five-word shingles change: similarity 0.81
            words[k] = f"x{rng.integers(10**6)}"
        made.append((2 * i + 1, " ".join(words)))
    kept = simhash_dedup.keep_one(frame(made), **corpus_pipeline.NEAR)
    assert kept.where("doc_id % 2 = 0").count() == 30 and kept.where("doc_id % 2 = 1").count() <= 1


def _alike(texts, least=0.8):
    """Ids that stay: the smallest of each group of texts linked by brute-force Jaccard."""
    sets = []
    for _, text in texts:
        words = re.findall("[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({" ".join(words[k : k + 5]) for k in range(max(len(words) - 4, 1))} if words else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if min(len(x), len(y)) >= least * max(len(x), len(y)) and len(x & y) >= least * len(x | y) - 1e-9:
                root[find(a)] = find(b)
    groups = {}
    for k, (i, _) in enumerate(texts):
        groups.setdefault(find(k), []).append(i)
    return sorted(min(g) for g in groups.values())


@pytest.mark.parametrize("hot, tile", [(2, 2048), (2, 3), (10**9, 4)])
def test_frequent_shingles_lose_no_link(frame, monkeypatch, hot, tile):
    monkeypatch.setattr(simhash_dedup, "HOT", hot)
    monkeypatch.setattr(simhash_dedup, "TILE", tile)
    rng = np.random.default_rng(21)
    passages = [" ".join(f"p{k}x{j}" for j in range(n)) for k, n in enumerate((12, 40, 90))]
    made = []
    for group in range(25):  # texts that share a passage, with near copies, and texts that are little but passages
        own = [f"v{rng.integers(10**6)}" for _ in range(int(rng.integers(1, 60)))]
        for k in range(4):
            words = list(own)
            words[rng.integers(len(words))] = f"y{rng.integers(10**6)}"
            made.append((len(made), passages[group % 3] + " " + " ".join(words)))
    made += [(1000, passages[2]), (1001, passages[2] + " tail"), (1002, None), (1003, " "), (1004, "one"), (1005, "ONE")]
    kept = simhash_dedup.keep_one(frame(made), **corpus_pipeline.NEAR)
    assert sorted(r.doc_id for r in kept.collect()) == _alike(made)


def test_candidates_follow_the_text_and_not_its_square(frame):
    """A passage that all texts hold brings no two of them together."""
    rng = np.random.default_rng(22)
    passage = " ".join(f"p{j}" for j in range(60))
    counts = []
    for n in (150, 300):
        made = [(i, passage + " " + " ".join(f"w{rng.integers(10**7)}" for _ in range(120))) for i in range(n)]
        prints = stage(simhash_dedup.fingerprints(frame(made), 5, 4, True, similarity=0.8).withColumn("row", F.monotonically_increasing_id()), "prints")
        names = ["f0", "f1", "f2", "f3"]
        least = F.min(F.struct("doc_id", "row_key", "row_key2", "row")).alias("least")
        classes = stage(prints.groupBy("set_key", *names, "n_shingles").agg(least).withColumn("node", F.monotonically_increasing_id()), "classes")
        postings, hot = simhash_dedup._prefixes(frame(made), prints, classes, names, 5, 0.8)
        shared = [r["count"] for r in postings.groupBy("s").count().where("count > 1").collect()]
        # Of the 56 shingles of the passage at most a few stay in a prefix: those that came first in few texts.
        assert len(shared) <= 3 and all(n <= simhash_dedup.HOT for n in shared)
        counts.append(simhash_dedup._candidates(postings, hot, classes, names, 72, 0.8).count())
    assert counts == [0, 0]


def test_prefixes_are_joined_with_frequent_shingles_once(frame, monkeypatch):
    """What the candidates read needs no further join or shuffle, however large the table of frequent shingles is."""
    monkeypatch.setattr(simhash_dedup, "HOT", 3)
    made = [(i, " ".join(f"w{i * 7 % 40 + k}" for k in range(30)) + f" own{i} end{i}") for i in range(40)]
    names = ["f0"]
    docs = frame(made)
    spark = docs.sparkSession
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        prints = stage(simhash_dedup.fingerprints(docs, 5, 1, True, similarity=0.8).withColumn("row", F.monotonically_increasing_id()), "prints")
        classes = prints.select(F.struct("row", "row_key", "row_key2").alias("least"), "f0", "n_shingles", F.monotonically_increasing_id().alias("node"))
        postings, often = simhash_dedup._prefixes(docs, prints, stage(classes, "classes"), names, 5, 0.8)
        assert often is not None
        for df in (postings, often):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "Join" not in plan and "Exchange" not in plan
        lengths = prints.select((F.col("n_shingles") - F.ceil(F.col("n_shingles") * 0.8 - 1e-9) + 1).alias("n")).agg(F.sum("n")).first()[0]
        assert postings.count() + often.count() == lengths and often.where(F.col("c") <= 3).count() == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


@pytest.mark.parametrize("tile", [3, 1024])
def test_near_copies_are_those_of_brute_force(frame, texts, monkeypatch, tile):
    monkeypatch.setattr(simhash_dedup, "VERIFY_TILE", tile)
    rng = np.random.default_rng(11)
    made = list(texts)
    for n in (6, 9, 14, 60, 300):  # words changed one after the other: similarities from 1 down to below 0.5
        for group in range(4):
            words = [f"v{rng.integers(10**6)}" for _ in range(n)]
            for k in range(12):
                made.append((10**6 + len(made), " ".join(words)))
                words[rng.integers(n)] = f"y{rng.integers(10**6)}"
    made += [(5 * 10**6, ""), (5 * 10**6 + 1, None), (5 * 10**6 + 2, " ".join(texts[0][1].split() * 2))]
    assert [r.doc_id for r in simhash_dedup.keep_one(frame(made), **corpus_pipeline.NEAR).orderBy("doc_id").collect()] == _alike(made)


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    assert rows(components.smallest_reachable(links, "a", "b"), "node", "root") == sorted([(k, 0) for k in range(61)] + [(100, 100), (101, 100)], key=repr)


# --- search


def _best(made, k):
    whole = [(i, tuple(math.floor(256 * float(np.float32(x))) for x in e)) for i, e in made
             if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    for place, (i, e) in enumerate(whole):
        if i % 50 == 0:  # every other row is a candidate, equal ones too
            scored = sorted((-sum(a * b for a, b in zip(e, g, strict=False)), j) for other, (j, g) in enumerate(whole) if other != place)[:k]
            yield from ((i, r + 1, j, -s) for r, (s, j) in enumerate(scored))


@pytest.mark.parametrize("slab", [16, 4096])
def test_search_is_exact(spark, monkeypatch, slab):
    monkeypatch.setattr(vector_search, "SLAB", slab)
    monkeypatch.setattr(vector_search, "ANNULUS", 4)
    rng = np.random.default_rng(7)
    made = [(i, rng.choice([0.5, -1.0, 2.25, 0.1], 3).tolist()) for i in range(200)] + [(i, rng.normal(size=3).tolist()) for i in range(200, 400)]
    made += [(1000, None), (1050, [float("nan"), 1.0, 1.0]), (1051, [None, 1.0, 1.0]), (None, [9.0, 9.0, 9.0]), (1100, [1.0]), (1150, []), (1200, [0.5] * 3), (1200, [0.5] * 3)]
    df = spark.createDataFrame([(*r, "x") for r in made], "vec_id long, embedding array<float>, score string")
    vectors = vector_search.quantise(df)
    found = vector_search.search(vectors, vectors.where("vec_id % 50 = 0"), k=5, pivots=6)
    assert rows(found, "query_id", "rank", "vec_id", "score") == sorted(_best(made, 5), key=repr)
    few = vector_search.quantise(df.where("vec_id < 3"))
    assert vector_search.search(few, few.where("vec_id = 0"), k=5).count() == 2
    assert vector_search.search(few.limit(0), few).count() == 0 and vector_search.search(few, few.limit(0)).count() == 0


def test_search_fills_up_when_an_id_has_many_vectors(spark):
    made = [(50, [9.0, 1.0 + k]) for k in range(8)] + [(100, [9.0, 1.0])] + [(k, [1.0, k / 8]) for k in range(1, 20)]
    vectors = vector_search.quantise(spark.createDataFrame(made, "vec_id long, embedding array<float>"))
    found = rows(vector_search.search(vectors, vectors.where("vec_id % 50 = 0"), k=5), "query_id", "rank", "vec_id", "score")
    assert found == sorted(_best(made, 5), key=repr) and len(found) == 9 * 5


def test_repeated_rows_and_ids_agree_with_sql(spark, tmp_path):
    import duckdb

    rng = np.random.default_rng(17)
    made = [(i, rng.choice([0.5, -1.0, 2.25], 3).tolist()) for i in range(120)]
    made += made[:4] * 3 + [(50, [2.25, 2.25, 2.25]), (50, [2.25, 2.25, 2.25]), (50, [0.5, 2.25, -1.0]), (100, [2.25, 2.25, 2.25]), (7, [2.25, 2.25, 2.25])]
    df = spark.createDataFrame(made, "vec_id long, embedding array<float>")
    df.coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    found = rows(queries.QUERIES["op9_topk_search"](spark, str(tmp_path)), "query_id", "rank", "vec_id", "score")
    assert found == sorted(_best(made, 5), key=repr)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert sorted(con.execute(queries.ORACLES["op9_topk_search"]).fetchall(), key=repr) == found


@pytest.mark.parametrize("name", ["op5_chat_format", "op9_topk_search"])
def test_matches_sql(spark, sf_dir, name):
    assert compare(queries.QUERIES[name](spark, sf_dir), connect(sf_dir), queries.ORACLES[name]) is None


# --- chats

CHATS = "conv_id long, turn long, role string, text string, segments string"


def test_chats_read_back_as_they_were(spark):
    said = ["a\\b### </turn>### ####  </turn>\n", "", "\\", "<", "</turn>\n### User: x", "\\### Assistant: \\</turn>", "long " * 50_000]
    made = [(1, k, ("user", "assistant")[k % 2], t, "x") for k, t in enumerate(said)] + [(2, 0, "to:ol<\\b>", "t", "x"), (2, 1, None, None, "x")]
    out = chat_format.format_chats(spark.createDataFrame(made, CHATS))
    back = {r.conv_id: [tuple(t) for t in r.turns] for r in out.select("conv_id", chat_format.read_back(F.col("formatted")).alias("turns")).collect()}
    assert back == {1: [(r[2], r[3]) for r in made if r[0] == 1], 2: [("to:ol<\\b>", "t"), ("", "")]}
    trained = out.where("conv_id = 1").select(chat_format.trained_text(F.col("segments"))).first()[0]
    assert trained == "".join(said[1::2])
    whole = out.select("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("joined")).collect()
    assert all(r.formatted == r.joined for r in whole)


def test_machine_accepts_turn_orders(spark):
    orders = {1: "user", 2: "user assistant", 3: "system user assistant user", 4: "system", 5: "assistant user", 6: "user user", 7: "user tool", 8: "user system"}
    made = [(c, k, r, "t", "x") for c, order in orders.items() for k, r in enumerate(order.split())]
    out = chat_format.format_chats(spark.createDataFrame(made, CHATS))
    assert {r.conv_id for r in out.where("valid").collect()} == {1, 2, 3}


def test_chats_with_ties_nulls_and_no_rows(spark):
    df = spark.createDataFrame([(1, 0, "user", "b", "x"), (1, 0, "user", "a", "x"), (1, None, "user", "c", "x"), (1, 0, "user", "a", "x"), (None, 1, "user", "d", "x")], CHATS)
    out = chat_format.format_chats(df).select("conv_id", chat_format.read_back(F.col("formatted"))["text"].alias("t"))
    assert {r.conv_id: r.t for r in out.collect()} == {1: ["c", "a", "a", "b"], None: ["d"]}
    assert chat_format.format_chats(df.limit(0)).count() == 0


def test_chat_plan_has_no_python(spark, sf_dir):
    plan = queries.QUERIES["op5_chat_format"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# --- pipeline


def test_pipeline_stages_keep_their_promises(spark, sf_dir, documents):
    columns, docs, seen = documents.columns, documents, {}
    for name, step in corpus_pipeline.STAGES:
        before, docs = docs, stage(step(spark, docs, sf_dir), name)
        seen[name] = docs
        if name != "packing":
            assert docs.columns == columns
            assert docs.join(before, "doc_id", "left_anti").count() == 0
            assert docs.groupBy("doc_id").count().where("count > 1").count() == 0
    near = simhash_dedup.near_duplicates(seen["simhash_dedup"], **corpus_pipeline.NEAR)
    assert near.select("component_id").distinct().count() == seen["simhash_dedup"].count()
    windows = Counter()
    for r in seen["substring_dedup"].select("text").collect():
        words = r.text.split()
        windows.update({" ".join(words[k : k + 35]) for k in range(len(words) - 34)})
    assert max(windows.values()) == 1
    packed = {r.doc_id for r in docs.select("doc_id").distinct().collect()}
    assert packed == {r.doc_id for r in seen["decontamination"].select("doc_id").collect()}
    assert entry.queries()["pipeline"](spark, sf_dir).count() == docs.count()
    assert rows(entry.queries()["pipeline"](spark, sf_dir), "doc_id", "start", "length") == rows(docs, "doc_id", "start", "length")


def test_pipeline_of_an_empty_table(spark, sf_dir, documents):
    docs = documents.limit(0)
    for name, step in corpus_pipeline.STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
        assert docs.count() == 0


def test_operators_are_registered():
    found = entry.queries()
    assert all(any(re.match(f"op{n}_", name) for name in found) for n in range(1, 11))
