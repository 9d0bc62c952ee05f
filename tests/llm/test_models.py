"""Decontamination, scoring and the pipeline against plain re-computation."""

import math
import re
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pytest

import corpus_pipeline
from fleetgauge.llm import decontaminate, gru, scoring

from .brute import SF, ascii_lower, documents, linked, odd_docs, quality, simhash, words
from .test_documents import check_packing


def items(spark):
    return [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]


def holding(spark):
    """(doc_id, item_id) of whole items inside documents, by their words."""
    plain = lambda t: " " + " ".join(re.findall(r"\w+", (t or "").lower())) + " "
    wanted = [(i, plain(t)) for i, t in items(spark)]
    return {(d, i) for d, t in documents(spark) for p in [plain(t)] for i, w in wanted if w in p}


def test_contaminated_finds_all_whole_items(spark):
    docs, bench = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    found = {(r["doc_id"], r["item_id"]): r for r in decontaminate.contaminated(docs, bench).collect()}
    want = holding(spark)
    assert want and want <= set(found)
    assert all(r["subsequence"] >= 0.7 for r in found.values())
    blocks = decontaminate.contaminated(docs, bench, block=15).collect()
    assert {(r["doc_id"], r["item_id"]) for r in blocks} >= want


def test_paraphrase_is_found_and_clean_text_is_not(spark):
    (item, text), rng = items(spark)[1], np.random.default_rng(3)
    said = text.split()
    changed = [("other" if rng.random() < 0.12 else w).upper() for w in said]
    filler = [w for _, t in documents(spark)[:4] for w in t.split()]
    rows = [(1, " ".join(filler[:400] + changed + filler[400:700]), 5), (2, " ".join(filler), 5), (3, None, 5), (None, "", 5),
            (4, " ".join(rng.permutation(filler)), 5)]
    rows += [(i, " ".join(rng.permutation(filler)[:200]), 5) for i in range(10, 40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, item_id int")
    bench = spark.createDataFrame([(item, text), (item, text), (900, None), (901, " ... "), (None, "")], "item_id bigint, text string")
    found = decontaminate.contaminated(docs, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == {(1, item)} and len(found) == 1
    kept = decontaminate.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 1
    assert decontaminate.contaminated(docs.where("false"), bench).count() == 0
    assert decontaminate.contaminated(docs, bench.where("false")).count() == 0


@pytest.mark.parametrize("holders, others", [(2, 1), (40, 40), (60, 0)])
def test_an_item_is_found_however_many_documents_hold_it(spark, holders, others):
    rng = np.random.default_rng(8)
    word = lambda n: " ".join(f"w{k}" for k in rng.integers(0, 3000, n))
    bench = {1: "what is the name of the river that runs through the old town of verona in the north of italy",
             2: "short one", 3: word(30), 4: "nobody holds this " + word(20)}
    held = [f"{word(53 + i)} {bench[1]} {word(21)} {bench[2]} {bench[3]} {word(40)}" for i in range(holders)]
    texts = held + [word(200) for _ in range(others)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = decontaminate.contaminated(docs, spark.createDataFrame(list(bench.items()), "item_id bigint, text string")).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in found) == [(d, i) for d in range(holders) for i in (1, 2, 3)]
    assert all(r["subsequence"] == 1 for r in found)


def test_a_long_item_is_found_whole_and_paraphrased(spark):
    rng = np.random.default_rng(9)
    word = lambda n: [f"w{k}" for k in rng.integers(0, 20000, n)]
    item = [f"v{k}" for k in rng.permutation(1500)]               # every word once, all weigh alike
    changed = [w if i % 6 else "other" for i, w in enumerate(item)]        # no run of eight words is left
    rows = [(1, word(100) + item + word(50)), (2, word(300) + changed + word(30)), (3, item[:700] + word(800))]
    rows += [(4, rng.permutation(item[::6]).tolist())] + [(i, word(300)) for i in range(5, 30)]     # in 4: as frequent as the words that stay
    docs = spark.createDataFrame([(d, " ".join(t)) for d, t in rows], "doc_id bigint, text string")
    bench = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(word(40)))], "item_id bigint, text string")
    for block in (200, 10):
        found = decontaminate.contaminated(docs, bench, block=block).collect()
        assert {(r["doc_id"], r["item_id"]): round(r["subsequence"], 4) for r in found} == {(1, 1): 1.0, (2, 1): round(1250 / 1500, 4)}


def test_only_passages_with_the_rare_words_are_compared_whole(spark, monkeypatch):
    rng = np.random.default_rng(3)
    common, rare = [f"c{k}" for k in range(20)], [f"r{k}" for k in range(10)]
    item = " ".join(common + rare)
    texts = [" ".join(rng.choice(common, 300)) + f" r{i % 10} r{(i + 1) % 10}" for i in range(60)] + [f"before it {item} and after it"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    calls, scans, index, real = [], [], decontaminate.build_index, decontaminate.common_subsequence
    monkeypatch.setattr(decontaminate, "common_subsequence", lambda a, b: calls.append(1) or real(a, b))
    monkeypatch.setattr(decontaminate, "build_index", lambda _, *rest: index(docs, *rest))
    stub = SimpleNamespace(sparkSession=docs.sparkSession, mapInArrow=lambda scan, schema: scans.append(scan))
    words = decontaminate.plain_words(item)
    decontaminate._search(stub, [(7, words, words)], len(texts), 256, 0.0, 0.7, 10, 0.5, "")      # every passage is a candidate
    found = [r for b in scans[0](iter(docs.toArrow().to_batches())) for r in b.to_pylist()]
    assert [(r["doc_id"], r["item_id"], r["subsequence"], r["answer"]) for r in found] == [(60, 7, 1.0, 1.0)]
    assert 1 <= len(calls) < 20                                                                     # of some 2,300


def test_places_of_rare_words():
    rng = np.random.default_rng(4)
    vocabulary = {f"w{k}".encode(): k for k in range(30)}
    rarest = [[f"w{k}".encode() for k in rng.choice(30, n, replace=False)] for n in (1, 4, 10)]
    texts = [[f"w{k}".encode() for k in rng.integers(0, 40, n)] for n in (0, 50, 1, 200)]
    words = decontaminate.numbered(texts, vocabulary)
    flat = [w for t in texts for w in t]
    item, low = rng.integers(0, 3, 300), rng.integers(0, len(flat), 300)
    high = np.minimum(len(flat), low + rng.integers(0, 80, 300))
    got = decontaminate.rare_places(words, decontaminate._telling(rarest, vocabulary), item, low, high)
    assert got.tolist() == [sum(w in rarest[i] for w in flat[a:b]) for i, a, b in zip(item, low, high)]


def test_products_of_rare_words_are_summed_like_those_of_frequent_ones(spark):
    rng = np.random.default_rng(6)
    texts = [" ".join(f"w{k}" for k in (12 * rng.random(90) ** 2).astype(int)) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    vocabulary = {f"w{k}".encode(): k for k in range(12)}
    square, keys = ({(r["a"], r["b"]): r["n"] for r in decontaminate.corpus_counts(docs, vocabulary, often=often).collect()} for often in (12, 3))
    assert square == keys and len(square) == 12 + 78


def test_randomised_svd_is_close_to_the_exact_one(spark):
    rng = np.random.default_rng(1)
    dense = rng.standard_normal((60, 6)) @ rng.standard_normal((6, 25)) + 0.01 * rng.standard_normal((60, 25))
    rows = [(list(range(25)), r.tolist()) for r in dense]
    got = decontaminate.randomised_svd(spark.createDataFrame(rows, "at array<int>, value array<double>").repartition(3), 25, 6)
    exact = np.linalg.svd(dense)[2][:6].T
    assert np.allclose(np.abs(np.linalg.svd(exact.T @ got)[1]), 1, atol=1e-3)


def test_svd_sends_the_driver_some_words_at_a_time(spark, monkeypatch):
    rng = np.random.default_rng(5)
    dense = rng.standard_normal((150, 4)) @ rng.standard_normal((4, 200))
    rows = spark.createDataFrame([(list(range(200)), r) for r in dense.tolist()], "at array<int>, value array<double>").repartition(3)
    sent, frame, real = [], type(rows), type(rows).toLocalIterator

    def watched(self, *args):
        parts = self.rdd.glom().map(lambda p: [len(r["part"]) for r in p]).collect()
        sent.extend(parts)
        return real(self, *args)

    monkeypatch.setattr(frame, "toLocalIterator", watched)
    got = decontaminate.randomised_svd(rows, 200, 4)
    exact = np.linalg.svd(dense)[2][:4].T
    assert np.abs(np.abs(got.T @ exact) - np.eye(4)).max() < 1e-6
    # 2 tasks, each 64 words of 12 numbers a row, in each of 3 rounds
    assert max(max(p, default=0) for p in sent) == 64 * 12 * 8 and sum(map(sum, sent)) == 3 * 2 * 200 * 12 * 8


def test_common_subsequence():
    rng = np.random.default_rng(2)
    for _ in range(50):
        a, b = (rng.integers(0, 5, rng.integers(0, 30)).tolist() for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert decontaminate.common_subsequence(a, b) == table[-1][-1]


def test_gradients():
    rng = np.random.default_rng(0)
    w = {k: v.astype(np.float64) for k, v in gru.new_weights(12, 3, 4, 5).items()}
    x, y, h = rng.integers(0, 12, (4, 2)), rng.integers(0, 12, (4, 2)), rng.standard_normal((2, 5)) * 0.1

    def loss():
        return -gru.log_probabilities(w, gru.run_window(w, x, h)[0].reshape(-1, 5).astype(np.float64), y.reshape(-1)).mean()

    g, value, _ = gru.gradients(w, x, y, h)
    assert math.isclose(value, loss(), rel_tol=1e-6)
    for k, v in w.items():
        flat = v.reshape(-1)
        for i in rng.choice(flat.size, min(8, flat.size), replace=False):
            old = flat[i]
            flat[i] = old + 1e-3
            up = loss()
            flat[i] = old - 1e-3
            down = loss()
            flat[i] = old
            assert abs((up - down) / 2e-3 - g[k].reshape(-1)[i]) < 1e-5


def test_model_is_a_distribution_and_windows_do_not_matter():
    w, rng = gru.new_weights(64, 8, 4, 6, seed=2), np.random.default_rng(1)
    start = rng.integers(0, 64, 20)
    each = gru.score_texts(w, [np.append(start, k) for k in range(64)]) - gru.score_texts(w, [start])[0]
    assert abs(np.exp(each).sum() - 1) < 1e-4
    texts = [rng.integers(0, 64, n) for n in (0, 1, 5, 90, 33, 32)]
    assert np.allclose(gru.score_texts(w, texts), gru.score_texts(w, texts, lanes=2, window=5), atol=1e-3)


def test_lanes_stay_full_while_texts_of_all_lengths_are_scored(monkeypatch):
    w, rng = gru.new_weights(64, 8, 4, 6, seed=2), np.random.default_rng(5)
    texts = [rng.integers(0, 64, n) for n in [10] * 20 + [0, 100, 1] + [10] * 9]
    alone = [float(gru.score_texts(w, [t])[0]) for t in texts]
    real, steps = gru._run, []
    monkeypatch.setattr(gru, "_run", lambda w, tokens, *rest: steps.append(len(tokens)) or real(w, tokens, *rest))
    assert np.allclose(gru.score_texts(w, texts, lanes=4, window=7), alone, atol=1e-3)
    assert sum(steps) == 100                                        # 391 tokens; four texts at a time would take 170 steps


@pytest.mark.parametrize("head_words", [200_000, 50])
def test_base_scores(spark, head_words):
    docs = odd_docs(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    out = {d: zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 1 for d, _ in rows}
    token = lambda t: words(ascii_lower(t)) + [" "]
    c = Counter(w for d, t in rows if not out[d] for w in token(t))
    n, v = sum(c.values()), len(c)
    want = sorted((str(d), out[d], len(token(t)), sum(c[w] > 0 for w in token(t)), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in token(t)), 4))
                  for d, t in rows)
    got = scoring.score_documents(docs, head_words=head_words, classes=4, width=8, sample_docs=50, tasks=2, rounds=1).collect()
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got) == want
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)
    assert scoring.score_documents(docs.where("false"), classes=4, width=8, tasks=2, rounds=1).count() == 0


def test_model_beats_the_unigram_base_on_held_out_documents(spark):
    got = scoring.score_documents(spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet")).where("held_out").collect()
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got)


def test_pipeline(spark):
    docs = [(d, t) for d, t in documents(spark) if quality(t)["kept"]]
    fps = [(d, simhash(t)) for d, t in docs]
    roots = linked(fps)
    docs = [(d, t) for (d, t), (_, f) in zip(docs, fps) if roots[d, f] == d]
    held = {d for d, _ in holding(spark)}
    stages, frame = dict(corpus_pipeline.STAGES), spark.read.parquet(f"{SF}/documents.parquet")
    columns = frame.columns
    for name in ("quality_rules", "near_duplicates", "decontamination"):
        frame = stages[name](spark, frame, SF)
        assert frame.columns == columns
        frame = corpus_pipeline.stored(frame, "test-pipeline")
    kept = {r["doc_id"] for r in frame.collect()}
    clean = {d for d, _ in docs} - held
    assert kept <= clean and len(clean - kept) <= 0.02 * len(clean)
    used, bound = check_packing(stages["packing"](spark, frame, SF).collect(), frame, 4096)
    assert bound <= used <= bound + 1
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, SF).collect()} == kept


def test_rows_without_an_id_or_with_the_same_id_are_kept_apart(spark):
    rng = np.random.default_rng(4)
    text = [" ".join(f"w{k}" for k in rng.integers(0, 5000, 80)) for _ in range(7)]
    item = " ".join(f"v{k}" for k in range(30))
    rows = [(None, text[0]), (None, text[1]), (None, text[1]), (5, text[2]), (5, text[3]), (7, text[4]), (8, text[4]), (8, text[5]), (4, text[3])]
    docs = spark.createDataFrame([(d, t, i) for i, (d, t) in enumerate(rows)], "doc_id bigint, text string, place int")
    got = Counter((r["doc_id"], r["text"]) for r in simhash_rows(docs))
    assert got == Counter([(None, text[0]), (None, text[1]), (5, text[2]), (4, text[3]), (7, text[4]), (8, text[5])])
    rows = [(None, text[0]), (None, f"{text[1]} {item}"), (5, text[2]), (5, f"{item} {text[3]}"), (6, text[4])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = decontaminate.drop_contaminated(docs, spark.createDataFrame([(1, item)], "item_id bigint, text string"))
    assert Counter(map(tuple, kept.collect())) == Counter([rows[0], rows[2], rows[4]])


def simhash_rows(docs):
    from fleetgauge.llm.simhash import drop_near_duplicates
    kept = drop_near_duplicates(docs, 3, 2)
    assert kept.columns == docs.columns
    return kept.collect()


def test_the_latent_space_is_fitted_on_every_passage(spark):
    rng = np.random.default_rng(8)
    item = [f"v{k}" for k in range(12)]
    texts = [" ".join(rng.choice(item[i % 2 * 6:][:6] + ["x", "y", "z"], int(n))) for i, n in enumerate(rng.integers(0, 150, 2500))] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    vocabulary = {w.encode(): i for i, w in enumerate(item)}
    frequency, products = np.zeros(12), np.zeros((12, 12))
    for t in texts:
        all_words = (t or "").split()
        frequency += [w in all_words for w in item]
        for k in range(0, len(all_words), 32):
            n = np.array([all_words[k:k + 32].count(w) for w in item])
            products += np.outer(n, n)
    for most in (10, 4_000_000):
        got = {(r["a"], r["b"]): r["n"] for r in decontaminate.corpus_counts(docs, vocabulary, most).collect()}
        assert [got[-1, i] for i in range(12)] == frequency.tolist()
        assert all(got.get((i, j), 0) == products[i, j] for i in range(12) for j in range(i, 12))
    parts = [b"v0 v1 v2 v3 v4 v5".split(), b"v6 v7 v8 v9 v10 v11".split()]
    index = decontaminate.build_index(docs, parts, {w.encode() for w in item}, len(texts), 2)
    order = [index.vocabulary[w.encode()] for w in item]
    own = np.array([[float(w.encode() in p) for w in item] for p in parts])
    weight = np.log((len(texts) + 1) / (frequency + 1)) + 0.1
    values, vectors = np.linalg.eigh(weight[:, None] * (products + 100 * own.T @ own) * weight)
    latent = weight[:, None] * vectors[:, -2:]
    unit = own @ latent
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    assert np.allclose(index.groups[0][2][order], latent @ unit.T, atol=1e-3)


def test_the_model_learns_from_every_training_document(spark, monkeypatch):
    texts = [f"start {' '.join(f'w{i % 7}' for _ in range(40))} t{i}" for i in range(4000)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").repartition(3)
    train = [i for i in range(4000) if not scoring.held_out(i)]
    seen = []
    monkeypatch.setattr(scoring.pickle, "loads", lambda b, load=scoring.pickle.loads: seen.append(load(b)) or seen[-1])
    rows = []
    real = scoring.stored
    monkeypatch.setattr(scoring, "stored", lambda df, purpose: rows.append(real(df, purpose)) or rows[-1])
    counts = Counter(w for i in train for w in [*texts[i].split(), scoring.END])
    head = scoring.Head(dict(counts), {scoring.END: 0, **{f"w{k}": k + 2 for k in range(7)}}, sum(counts.values()), len(counts), 1.0)
    model = scoring.train_model(docs, head, 4, 8, 4, 4, None, None, 2, lanes=4, stream=10_000)
    tokens = sum(r["tokens"] for df in rows for r in df.collect())
    whole = sum(len(texts[i].split()) + 2 for i in train)          # each text begins after an end
    assert len(rows) == 2 and tokens == whole - len(seen)            # but for the first end of each task
    assert len(train) > 3000 and all(np.isfinite(v).all() for v in model.values())
