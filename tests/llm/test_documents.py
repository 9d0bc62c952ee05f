"""Operators over documents against plain re-computation, on the smallest table and on awkward rows."""

import itertools
import os
import random
import zlib
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from fleetgauge.llm import decontaminate, packing, quality, sharding, simhash, token_counts, token_files
from fleetgauge.llm.graph import components
from fleetgauge.session import shared_dir

from .brute import SF, crc_ids, documents, library, linked, odd_docs, quality as plain_quality, simhash as plain_simhash

WORD, BYTE = "word_bpe_49k.json", "byte_bpe_50k.json"


@pytest.fixture(params=["small", "odd", "empty"])
def docs(request, spark):
    if request.param == "small":
        return spark.read.parquet(f"{SF}/documents.parquet")
    return odd_docs(spark).where("true" if request.param == "odd" else "false")


def pairs(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


def test_token_files(spark, docs):
    path = shared_dir(spark, "test-tokens")
    token_files.write_token_files(docs, path, public_tokenizers.path(WORD), 2)
    lib, want, start = library(WORD), [], 0
    for d, t in sorted(pairs(docs), key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or "")):
        ids = lib.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((d, start, len(ids), crc_ids(ids)))
        start += len(ids)
    got = [tuple(r) for r in token_files.token_index(spark, path).collect()]
    assert sorted(got, key=lambda r: r[1]) == want
    stored = {r["doc_id"]: r["ids"] for r in token_files.read_token_files(spark, path, [7, 8]).collect()}
    assert all(v == lib.encode(dict(pairs(docs))[d] or "", add_special_tokens=False).ids + [2] for d, v in stored.items())


def test_read_prunes_by_id(spark):
    path = shared_dir(spark, "test-tokens")
    token_files.write_token_files(odd_docs(spark), path, public_tokenizers.path(WORD), 2)
    plan = token_files.read_token_files(spark, path, [7])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(doc_id" in plan or "EqualTo(doc_id,7)" in plan


def test_token_counts(spark, docs):
    lib, cache = library(BYTE), shared_dir(spark, "test-counts")
    want = sorted(((d, len((t or "").encode()), len(lib.encode(t or "", add_special_tokens=False).ids)) for d, t in pairs(docs)), key=str)

    def run(rows):
        got = token_counts.count_tokens(rows, cache, public_tokenizers.path(BYTE), BYTE).collect()
        assert all(r["over_limit"] == (r["n_tokens"] > 512) for r in got)
        return sorted(((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got), key=str)

    assert run(docs.where("doc_id % 2 = 0")) == [w for w in want if w[0] is not None and w[0] % 2 == 0]
    stored = token_counts.cached_counts(spark, cache, BYTE).count()
    assert run(docs) == want
    texts = {t or "" for _, t in pairs(docs)}
    rows = spark.read.option("recursiveFileLookup", "true").schema(token_counts.CACHE_SCHEMA).parquet(cache).count()
    assert rows == len(texts) >= stored                       # no text was encoded twice
    assert token_counts.cached_counts(spark, cache, "another").count() == 0


def test_simhash(spark, docs):
    got = [tuple(r) for r in simhash.near_duplicates(docs, 3, 2).collect()]
    fps = [(d, plain_simhash(t)) for d, t in pairs(docs)]
    roots = linked(fps)
    assert Counter((d, f % 2**64, c) for d, f, c in got) == Counter((d, f, roots[d, f]) for d, f in fps)
    kept = simhash.drop_near_duplicates(docs, 3, 2)
    assert kept.columns == docs.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(set(roots.values()))


@pytest.mark.parametrize("bits", [0, 1, 2, 3, 4])
def test_near_pairs_are_complete(spark, bits):
    rng = random.Random(bits)
    centre = [rng.getrandbits(64) for _ in range(12)]
    fps = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for c in centre for _ in range(25)}
    signed = [f - 2**64 if f >> 63 else f for f in fps]
    got = simhash.near_pairs(spark.createDataFrame([(f,) for f in signed], "fp bigint"), bits).collect()
    want = {frozenset(p) for p in itertools.combinations(signed, 2) if ((p[0] ^ p[1]) % 2**64).bit_count() <= bits}
    assert {frozenset((r["a"], r["b"])) for r in got} == want


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(300, 300), (201, 200), (200, 201)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}, 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_quality(spark, docs):
    got = quality.quality_report(docs).collect()
    assert Counter(tuple(r) for r in got) == Counter((d, *plain_quality(t).values()) for d, t in pairs(docs))
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    assert Counter(map(tuple, kept.select("doc_id", "text").collect())) == Counter((d, t) for d, t in pairs(docs) if plain_quality(t)["kept"])


def test_rule_order_does_not_change_the_verdict(spark):
    docs = odd_docs(spark).select("doc_id", "text")
    one = quality.cascade(docs, quality.RULES).select("doc_id", "text", "kept")
    other = quality.cascade(docs, quality.RULES[::-1]).select("doc_id", "text", "kept")
    assert Counter(map(tuple, one.collect())) == Counter(map(tuple, other.collect()))


@pytest.mark.parametrize("shards", [1, 7, 40])
def test_sharding(spark, docs, shards):
    got = sharding.shard_documents(docs, shards, seed=3).collect()
    want = Counter((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in pairs(docs))
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    slots = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(slots.get(i, [])) for i in range(shards)]
    assert max(sizes) - min(sizes) <= 1 and set(slots) <= set(range(shards))


def test_communication_matrix():
    blocks, shards = [5, 0, 17, 100, 3], [32, 31, 31, 31]
    total = [[0] * 4 for _ in blocks]
    for seed in range(400):
        m = sharding.communication_matrix(blocks, shards, seed)
        assert [sum(r) for r in m] == blocks and [sum(c) for c in zip(*m)] == shards
        total = [[a + b for a, b in zip(x, y)] for x, y in zip(total, m)]
    for b, row in zip(blocks, total):
        for s, n in zip(shards, row):
            assert abs(n / 400 - b * s / 125) < 0.5           # the hypergeometric mean


def test_hypergeometric_of_large_numbers():
    rng = random.Random(1)
    draws = [sharding.hypergeometric(rng, 10**9, 39 * 10**9, 10**6) for _ in range(300)]
    assert abs(sum(draws) / 300 - 25000) < 60


def check_packing(got, docs, capacity):
    lib, want = library(WORD), Counter()
    for d, t in pairs(docs):
        ids = lib.encode(t or "", add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), capacity):
            want[d, k // capacity, k, len(ids[k:k + capacity]), crc_ids(ids[k:k + capacity])] += 1
    assert Counter(tuple(r)[:5] for r in got) == want
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in sequences.values():
        places.sort()
        assert [o for o, _ in places] == [0, *itertools.accumulate(n for _, n in places)][:-1]
        assert sum(n for _, n in places) <= capacity
    return len(sequences), packing.bin_bound([n for (_, _, _, n, _), k in want.items() for _ in range(k)], capacity)


@pytest.mark.parametrize("capacity, group_rows", [(4096, 100_000), (64, 50)])
def test_packing(spark, docs, capacity, group_rows):
    pieces = packing.token_pieces(docs, public_tokenizers.path(WORD), 1, capacity)
    used, bound = check_packing(packing.pack(pieces, capacity, group_rows).collect(), docs, capacity)
    assert bound <= used <= 1.03 * bound + 1


def test_bound_is_below_the_optimum():
    rng = random.Random(5)
    for _ in range(200):
        lengths = [rng.randint(1, 12) for _ in range(rng.randint(0, 7))]
        best = next((k for k in range(len(lengths) + 1) if fits(sorted(lengths, reverse=True), [12] * k)), 0)
        assert packing.bin_bound(lengths, 12) <= best <= len(set(packing.best_fit(lengths, 12)))


def fits(lengths, room):
    if not lengths:
        return True
    for i in {r: i for i, r in enumerate(room) if r >= lengths[0]}.values():
        if fits(lengths[1:], [r - lengths[0] * (j == i) for j, r in enumerate(room)]):
            return True
    return False


def test_columns_with_names_of_their_own(spark):
    """Input columns named like working columns keep their values, or are refused."""
    rows = spark.createDataFrame([(1, "some text of a few words", 77, 5, "a"), (2, "quite another text stands here", 78, 6, "b"),
                                  (3, "some text of a few words", 79, 7, "c")], "doc_id bigint, text string, __row int, component_id int, doc string")
    kept = simhash.drop_near_duplicates(rows, 3, 2)
    assert kept.columns == rows.columns and sorted(map(tuple, kept.collect())) == sorted(map(tuple, rows.where("doc_id < 3").collect()))
    bench = spark.createDataFrame([(1, "quite another text stands here")], "item_id bigint, text string")
    clean = decontaminate.drop_contaminated(rows, bench)
    assert clean.columns == rows.columns and sorted(map(tuple, clean.collect())) == sorted(map(tuple, rows.where("doc_id <> 2").collect()))
    pieces = spark.createDataFrame([(i, 3, i * 10, "x") for i in range(9)], "id int, length int, gap int, open string")
    packed = packing.pack(pieces, 9)
    assert sorted((r["id"], r["gap"], r["open"]) for r in packed.collect()) == [(i, i * 10, "x") for i in range(9)]
    for taken in ("offset", "__GAP"):
        with pytest.raises(ValueError):
            packing.pack(pieces.withColumnRenamed("gap", taken), 9)
    for taken in ("shard", "__place"):
        with pytest.raises(ValueError):
            sharding.shuffle_shards(pieces.withColumnRenamed("gap", taken), 3)
