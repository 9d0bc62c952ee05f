"""Ranked search, rank BPE and whitening against plain re-computation."""

import hashlib
import math
import random
import re
import string
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from fleetgauge.llm import lexical_search, rank_bpe, whitening
from fleetgauge.llm.ball_tree import BallTree, Best

from .brute import SF, ODD_TEXTS, ascii_lower, odd_docs

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


# ---- ranked search
def terms(text):
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", ascii_lower(text))


def plain_ranks(docs, items, top):
    held = [(d, Counter(terms(t))) for d, t in docs]
    held = [(d, c, sum(c.values())) for d, c in held if c]
    total, df = sum(n for _, _, n in held), Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c, n in held:
            m = 50 + 50 * n * len(held) // total
            score = sum(math.floor(1000 * math.log((2 * len(held) + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m))
                        for t in set(terms(text)) if c[t])
            if score > 0:
                scores.append((-score, d is None, d or 0, d))
        out += [(item, i, d, -s) for i, (s, _, _, d) in enumerate(sorted(scores)[:top], 1)]
    return Counter(out)


ITEMS = [(1, "One two THREE four"), (2, None), (3, ""), (1, "one 日本 語"), (None, "long words here"), (5, "..."), (6, "zebra"), (7, "é line q other 123 one one")]


@pytest.mark.parametrize("blocks", [{}, {"block_items": 2, "chunk": 3, "seed_share": 0.5}, {"block_chars": 5}])
def test_ranks_of_awkward_rows(spark, blocks):
    docs = odd_docs(spark)
    items = spark.createDataFrame([(i, t, 0, "x") for i, t in ITEMS], "item_id bigint, text string, rank int, doc_id string")
    got = lexical_search.rank_documents(docs, items, top=4, **blocks)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    want = plain_ranks([(r["doc_id"], r["text"]) for r in docs.collect()], ITEMS, 4)
    assert Counter(tuple(r) for r in got.collect()) == want


def test_ranks_of_the_table(spark):
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    copies = docs.unionByName(docs.where("doc_id < 20").withColumn("doc_id", F.col("doc_id") + 1000))   # ties
    got = Counter(tuple(r) for r in lexical_search.rank_documents(copies, items, chunk=64).collect())
    assert got == plain_ranks([(r["doc_id"], r["text"]) for r in copies.collect()], [(r["item_id"], r["text"]) for r in items.collect()], 50)


def test_ranks_of_empty_tables(spark):
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    assert lexical_search.rank_documents(docs.limit(0), items).count() == 0
    none = lexical_search.rank_documents(docs, items.limit(0))
    assert none.count() == 0 and none.columns == ["item_id", "rank", "doc_id", "score"]


def topics(rng, points=3000, per_topic=40):
    """Points of 30 topics with terms of their own and some that all share; every tenth is a copy."""
    rows = []
    for i in range(points):
        own = rng.choice(per_topic, 12, replace=False) + 50 + per_topic * (i % 30)
        held = np.unique(np.concatenate([rng.choice(50, 10, replace=False), own]))
        rows.append(rows[-1] if i % 10 == 9 else (held, rng.integers(1, 10**6, len(held))))
    starts = np.concatenate([[0], np.cumsum([len(t) for t, _ in rows])])
    return starts, np.concatenate([t for t, _ in rows]), np.concatenate([v for _, v in rows]), 50 + 30 * per_topic


def test_tree_bounds_hold_and_prune():
    rng = np.random.default_rng(1)
    starts, held, values, size = topics(rng)
    weights = np.concatenate([rng.integers(1, 300, 50), rng.integers(3000, 9000, size - 50)])
    scale = np.sqrt(weights.astype(float))
    tree = BallTree(starts.copy(), held.copy(), values.copy(), scale)
    ids = list(range(len(starts) - 1))
    scored = []
    for q in range(20):
        query = np.sort(np.concatenate([rng.choice(50, 4, replace=False), rng.choice(40, 8, replace=False) + 50 + 40 * q]))
        exact = np.array([sum(int(weights[t]) * int(v) for t, v in zip(held[a:b], values[a:b]) if t in set(query.tolist())) for a, b in zip(starts, starts[1:])])
        bound = tree.bounds(query, weights[query] / scale[query])
        assert all(bound[k] >= exact[tree.order[lo:hi]].max() for k, (lo, hi, _, _) in enumerate(tree.nodes))
        best = Best(10)
        scored.append(tree.search(query, weights[query], scale, ids, best))
        want = sorted(((-s, i) for i, s in enumerate(exact.tolist()) if s > 0))[:10]
        assert sorted((-s, i) for i, s in best.rows()) == want
        loose = Best(10, floor=int(want[-1][0]) * -1)                       # a floor that the answer just reaches
        assert tree.search(query, weights[query], scale, ids, loose) <= scored[-1] and sorted(loose.rows()) == sorted(best.rows())
    assert sum(scored) < 0.2 * len(ids) * len(scored)                       # whole subtrees are left out


# ---- rank BPE
def library(path=RANKS):
    return tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=rank_bpe.read_ranks(path), special_tokens={})


LONG = ["a" * 5000, "ab" * 3000 + " " * 700, "漢字" * 900, "".join(random.Random(5).choice("abcdé") for _ in range(4000)), "\n\n  \t\t " * 50 + "x"]


def test_bpe_equals_the_library(spark):
    small = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    more = spark.createDataFrame(list(enumerate(ODD_TEXTS + LONG, 10_000)) + [(None, "no id")], "doc_id bigint, text string")
    docs = small.unionByName(more).withColumn("ids", F.lit(1)).withColumn("content", F.lit("x"))      # clashing names
    lib, texts = library(), [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    coded = rank_bpe.encode_bpe(docs, RANKS, public_tokenizers.PATTERN)
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in rank_bpe.id_array(coded).collect()) == Counter((d, tuple(lib.encode_ordinary(t))) for d, t in texts)
    decoded = rank_bpe.decode_bpe(coded, RANKS).collect()
    assert Counter((r["doc_id"], bytes(r["content"]).decode()) for r in decoded) == Counter(texts)
    got = Counter(tuple(r) for r in rank_bpe.bpe_digests(docs, RANKS, public_tokenizers.PATTERN).collect())
    digest = lambda b: hashlib.sha256(b).hexdigest()
    assert got == Counter((d, len(i), digest(np.array(i, "<u4").tobytes()), digest(t.encode())) for d, t in texts for i in [lib.encode_ordinary(t)])
    assert rank_bpe.bpe_digests(docs.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


@pytest.mark.parametrize("seed", range(40))
def test_any_order_of_ranks(seed, monkeypatch):
    """Vocabularies whose tokens can rank before their parts, by the short and by the long way."""
    rng = random.Random(seed)
    tokens = [bytes([i]) for i in range(256)] + sorted({"".join(rng.choice("abc") for _ in range(rng.randint(2, 5))).encode() for _ in range(30)})
    order = list(range(len(tokens)))
    rng.shuffle(order)
    ranks = dict(zip(tokens, order))
    lib = tiktoken.Encoding("any", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["".join(rng.choice("abc ") for _ in range(80)) for _ in range(8)] + ["a" * 50, "ab" * 25]
    for short in (64, 1):
        monkeypatch.setattr(rank_bpe, "SHORT", short)
        coder = rank_bpe.RankCoder(ranks, public_tokenizers.PATTERN, limit=5)
        for _ in range(2):                                                  # with an empty and with a full table
            assert [np.frombuffer(x, "<u4").tolist() for x in coder.encode(texts)] == [lib.encode_ordinary(t) for t in texts]


def test_queue_finds_the_lowest_rank():
    queue, rng, held = rank_bpe.RankQueue(50_000), random.Random(2), set()
    for _ in range(3000):
        rank = rng.randrange(50_000)
        if rng.random() < 0.6:
            if rank not in held:
                queue.mark(rank)
                held.add(rank)
        elif held:
            assert queue.lowest() == min(held)
            queue.unmark(min(held))
            held.discard(min(held))
        assert queue.lowest() == min(held, default=-1)


# ---- whitening
def plain_whiten(vectors, count=4):
    x = [tuple(math.floor(256 * float(np.float32(c))) for c in v) for v in vectors]
    fit = np.array(sorted(set(x)), np.int64)
    n, total = len(fit), fit.sum(0)
    centred = fit - total / n
    cov = centred.T @ centred / n
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1][:count], u[:, ::-1][:, :count]
    white = (np.array(x) - total / n) @ u / np.sqrt(e)
    deviation = [sum((n * int(c) - int(s)) ** 2 for c, s in zip(v, total)) for v in x]
    return n, deviation, white, e / np.trace(cov)


def check_whitened(spark, vectors, extra=(), partitions=5):
    rows = [(i, list(map(float, v))) for i, v in enumerate(vectors)] + list(extra)
    df = spark.createDataFrame([(i, v, 9, 1.0) for i, v in rows], "vec_id bigint, embedding array<float>, component int, whitened double").repartition(partitions)
    got = whitening.whiten(df).collect()
    n, deviation, white, explained = plain_whiten(vectors)
    assert len(got) == 4 * len(vectors)
    at = {(r["vec_id"], r["component"]): r for r in got}
    for c in range(4):
        mine = np.array([at[i, c + 1]["whitened"] for i in range(len(vectors))])
        assert np.allclose(mine * np.sign(mine @ white[:, c]), white[:, c], atol=1e-8)
        assert all(at[i, c + 1]["deviation"] == deviation[i] and at[i, c + 1]["n"] == n for i in range(len(vectors)))
        assert abs(at[0, c + 1]["explained"] - explained[c]) < 1e-12 and at[0, c + 1]["identity_error"] < 1e-9


def test_whitening(spark):
    rng = np.random.default_rng(3)
    vectors = (rng.standard_normal((400, 12)) * np.linspace(0.3, 1.4, 12)).astype(np.float32)
    vectors = np.vstack([vectors, vectors[:100], vectors[:1], vectors[:1]])          # copies do not count in the fit
    odd = [(900, None), (901, [1.0] * 11 + [None]), (902, [float("nan")] * 12), (903, [1.0] * 11 + [float("inf")]), (904, [1.0]), (905, [])]
    check_whitened(spark, vectors, odd)


def test_whitening_of_low_rank(spark):
    """Five directions in twelve dimensions, of quite different size: the process ends early and begins again."""
    rng = np.random.default_rng(4)
    steps = rng.integers(-3, 4, (300, 5)) * np.array([4, 3, 2, 1, 1])
    axes = np.zeros((5, 12))
    axes[range(5), [0, 3, 5, 8, 11]] = 1
    check_whitened(spark, (steps @ axes).astype(np.float32))


def test_repeated_deviations(spark):
    """All four components have one deviation: any basis of theirs will do, but there have to be four."""
    cube = [[(i >> b & 1) * 2.0 - 1 for b in range(4)] + [0.0, 0.0] for i in range(16)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(cube)] + [(None, cube[0])], "vec_id bigint, embedding array<double>")
    got = whitening.whiten(df).collect()
    assert len(got) == 4 * 17 and all(abs(r["explained"] - 0.25) < 1e-12 and r["identity_error"] < 1e-9 for r in got)
    white = np.array([[r["whitened"] for r in sorted((r for r in got if r["vec_id"] == i), key=lambda r: r["component"])] for i in range(16)])
    assert np.allclose(white.T @ white / 16, np.eye(4))


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [])], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]])
def test_whitening_without_variance(spark, rows):
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>"))
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and got.count() == 0


def test_bidiagonalisation_against_svd():
    rng = np.random.default_rng(5)
    for shape, rank in [((50, 8), 8), ((50, 8), 3), ((6, 9), 6)]:
        x = rng.standard_normal((shape[0], rank)) @ rng.standard_normal((rank, shape[1])) * 10 ** rng.uniform(-2, 2)
        values, right = whitening.bidiagonalise(lambda p: (x @ p) @ x, shape[1], float(np.linalg.norm(x)))
        _, want, vt = np.linalg.svd(x)
        kept = min(rank, len(want))
        assert np.allclose(values[:kept], want[:kept], rtol=1e-10) and np.allclose(np.abs((right[:kept] * vt[:kept]).sum(1)), 1, atol=1e-9)
