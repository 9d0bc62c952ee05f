"""Benchmark decontamination by latent semantic retrieval and a common-subsequence check."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .encoding import portions
from .storage import stored

_STEP = 8                       # passages begin at every eighth word
_SPANS = (2, 4, 8)              # and have 16, 32 or 64 words
_FITTED = 32                    # words of the passages the latent space is fitted on
_GRAM = 8                       # a run of so many words of an item (all of a shorter one) makes a candidate
_SENT = 64                      # words whose part of a product is sent as one row
_PLAIN = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def plain_words(text: str | None) -> list[bytes]:
    """Lower-cased runs of letters and digits (all of non-ASCII counts as letters)."""
    return text.lower().encode().translate(_PLAIN).split() if text else []


@dataclass(frozen=True)
class Index:
    """What a task needs to search one block of segments of benchmark items."""

    vocabulary: dict[bytes, int]
    weight: np.ndarray              # idf of each word; positive for all
    segments: list[list[bytes]]
    groups: list[tuple[int, np.ndarray, np.ndarray]]     # steps in a passage, its segments, each word's product with them
    grams: list[tuple[int, np.ndarray, np.ndarray]]      # words in a run, sorted hashes of the segments' runs, their segments


def segments(words: list[bytes]) -> list[list[bytes]]:
    """An item as it is compared with passages: cut into pieces as long as the longest passage, the last one
    reaching back into the one before; a shorter item is one piece."""
    most = _SPANS[-1] * _STEP
    return [words[min(k, max(0, len(words) - most)):][:most] for k in range(0, len(words), most)]


def _span(words: int) -> int:
    """Steps in the passages a segment is compared with: the longest not longer than the segment."""
    return max([s for s in _SPANS if s * _STEP <= words], default=_SPANS[0])


def _pairs(passage: np.ndarray, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each two words of a passage (first <= second) and the product of their counts in it.

    ``passage``, ``at``, ``n`` are the entries of a sparse matrix of counts, ordered by passage and word.
    """
    first = np.flatnonzero(np.diff(passage, prepend=-1))
    end = np.append(first, len(passage))[1:]
    left = np.repeat(end, end - first) - np.arange(len(passage))
    a = np.repeat(np.arange(len(passage)), left)
    b = a + np.arange(len(a)) - np.repeat(np.cumsum(left) - left, left)
    return at[a], at[b], n[a] * n[b]


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order and their sums."""
    keys, where = np.unique(keys, return_inverse=True)
    return keys, np.bincount(where, weights=n, minlength=len(keys)).astype(np.int64)


def corpus_counts(docs: DataFrame, vocabulary: dict[bytes, int], most: int = 4_000_000, often: int = 2_048) -> DataFrame:
    """a, b, n: over the passages of 32 words of all ``docs``, the sum of the products of the counts of the words a <= b;
    and, with a = -1, in how many of ``docs`` word b occurs. Whole numbers, so their order does not matter.

    One reading of the texts serves both. A task numbers the words by their frequency in the first texts it reads and adds
    the products of the ``often`` first ones up in a square array, the others' by key; it sends these on when it holds ``most``."""
    size = len(vocabulary)
    side = min(size, often)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, found = vocabulary.get, np.zeros(size, np.int64)
        square = np.zeros(side * side, np.int64)
        keys, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
        order = rank = None

        def rows(key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], names=["key", "n"])

        def pairs(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            a, b = order[a], order[b]
            return rows(np.minimum(a, b) * size + np.maximum(a, b), n)

        for batch in batches:
            for part in portions(batch, most=500_000):
                texts = [plain_words(t) for t in part.column("text").to_numpy(zero_copy_only=False)]
                sizes = np.array([len(t) for t in texts], np.int64)
                at = np.fromiter(map(get, chain.from_iterable(texts), repeat(-1)), np.int64, int(sizes.sum()))
                text = np.repeat(np.arange(len(texts)), sizes)
                word = np.arange(len(at)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                passages = -(-sizes // _FITTED)
                passage = np.repeat(np.cumsum(passages) - passages, sizes) + word // _FITTED
                known = at >= 0
                at, text, passage = at[known], text[known], passage[known]
                if order is None:
                    order = np.argsort(-np.bincount(at, minlength=size), kind="stable")
                    rank = np.argsort(order)
                found += np.bincount(np.unique(text * size + at) % size, minlength=size)
                entry = passage * size + rank[at]
                entry = np.sort(entry.astype(np.int32) if int(passages.sum()) * size < 2 ** 31 else entry)
                first = np.flatnonzero(np.diff(entry, prepend=-1))
                a, b, n = _pairs(*np.divmod(entry[first].astype(np.int64), size), np.diff(first, append=len(entry)))
                low = b < side
                np.add.at(square, a[low] * side + b[low], n[low])
                if not low.all():
                    keys, sums = _summed(np.concatenate([keys, a[~low] * size + b[~low]]), np.concatenate([sums, n[~low]]))
                if len(keys) >= most:
                    yield pairs(keys // size, keys % size, sums)
                    keys, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
        seen = np.flatnonzero(found)
        yield rows(seen - size, found[seen])
        if order is not None:
            held = np.flatnonzero(square)
            yield pairs(held // side, held % side, square[held])
            yield pairs(keys // size, keys % size, sums)

    # one number for a and b: a * size + b
    found = docs.select("text").mapInArrow(count, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))
    return found.select(F.floor(F.col("key") / size).alias("a"), F.pmod("key", F.lit(size)).cast("bigint").alias("b"), "n")


def randomised_svd(passages: DataFrame, words: int, rank: int, rounds: int = 2, seed: int = 4) -> np.ndarray:
    """The leading right singular vectors (words x rank) of a sparse matrix stored as rows (at, value).

    Each round multiplies the matrix and its transpose with a thin basis, some rows at a time: tasks send their partial
    products of words x (rank + 8) numbers, whose size does not depend on the number of rows. There are at most two tasks.
    The driver takes the products some words at a time and holds a round's basis no longer than the round.
    """
    context = passages.sparkSession.sparkContext
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((words, min(words, rank + 8))))[0]
    rows = passages.coalesce(2)

    def product(basis: np.ndarray) -> np.ndarray:
        shared = context.broadcast(basis)

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            basis = shared.value
            out = np.zeros(basis.shape)
            for batch in batches:
                for k in range(0, batch.num_rows, 256):
                    at, value = (batch.column(c).slice(k, 256) for c in ("at", "value"))
                    n = pc.list_value_length(at).to_numpy(zero_copy_only=False)
                    dense = np.zeros((len(n), words))
                    dense[np.repeat(np.arange(len(n)), n), at.flatten().to_numpy()] = value.flatten().to_numpy()
                    out += dense.T @ (dense @ basis)
            for k in range(0, words, _SENT):
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([out[k:k + _SENT].tobytes()], pa.binary())], names=["first", "part"])

        # dealt to partitions of some 2 MB, since a partition's rows reach the driver at once
        parts = rows.mapInArrow(partial, "first bigint, part binary").repartition(-(-words // (8 * _SENT)))
        total = np.zeros(basis.shape)
        for first, part in parts.toLocalIterator():
            total[first:first + _SENT] += np.frombuffer(part).reshape(-1, basis.shape[1])
        shared.destroy()
        return total

    for _ in range(rounds):
        image = product(basis)
        del basis
        basis = np.linalg.qr(image)[0]
        del image
    image = product(basis)                                # A'A basis
    values, vectors = np.linalg.eigh(basis.T @ image)
    del image
    return basis @ vectors[:, np.argsort(-values)[:rank]]


def _runs(at: np.ndarray, words: int) -> np.ndarray:
    """A hash of the run of ``words`` words that begins at each place (the last ones have none)."""
    n = max(0, len(at) - words + 1)
    out = np.zeros(n, np.uint64)
    for k in range(words):
        out = out * np.uint64(0x9E3779B97F4A7C15) + (at[k:k + n] + 2).astype(np.uint64)
        out ^= out >> np.uint64(29)
    return out


def _grams(parts: list[list[bytes]], vocabulary: dict[bytes, int]) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """For each length of run its distinct (hash, segment), ordered by hash."""
    out = []
    for words in sorted({min(_GRAM, len(part)) for part in parts}):
        pairs = {(h, i) for i, part in enumerate(parts) if min(_GRAM, len(part)) == words
                 for h in _runs(np.array([vocabulary[w] for w in part], np.int64), words).tolist()}
        hashes, owners = zip(*sorted(pairs))
        out.append((words, np.array(hashes, np.uint64), np.array(owners, np.int64)))
    return out


def build_index(docs: DataFrame, parts: list[list[bytes]], words: set[bytes], total: int, rank: int, emphasis: float = 10.0) -> Index:
    """Fit the latent space on the segments and all passages of all documents; document frequencies of ``words`` (all
    of the items') count all documents. Segment rows weigh ``emphasis`` times as much, so that none falls outside the space.

    The tf-idf matrix of all passages is never written: its product with its transpose, a word's row with the other
    words of its passages, has the same singular vectors in the same order and is summed from whole numbers.
    """
    vocabulary = {w: i for i, w in enumerate(sorted(words))}
    counts = stored(corpus_counts(docs, vocabulary), "word-pairs")
    found = np.zeros(len(vocabulary))
    for word, n in counts.where("a < 0").select("b", "n").collect():
        found[word] = n
    weight = np.log((total + 1) / (found + 1)) + 0.1
    items = [np.unique([vocabulary[w] for w in part], return_counts=True) for part in parts]
    a, b, n = _pairs(np.repeat(np.arange(len(parts)), [len(at) for at, _ in items]), *(np.concatenate(x) for x in zip(*items)))
    own = _summed(a * len(vocabulary) + b, n)

    emphasised = docs.sparkSession.createDataFrame(list(zip((own[0] // len(vocabulary)).tolist(), (own[0] % len(vocabulary)).tolist(), own[1].tolist())),
                                                   "a bigint, b bigint, n bigint")
    sums = counts.where("a >= 0").withColumn("n", F.col("n").cast("double")).unionByName(
        emphasised.withColumn("n", F.col("n") * emphasis ** 2)).groupBy("a", "b").agg(F.sum("n").alias("n"))
    both = F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("other"), "n"), F.when(F.col("a") != F.col("b"), F.struct(F.col("b").alias("word"), F.col("a").alias("other"), "n")))
    pairs = sums.select(F.inline(F.filter(both, lambda p: p.isNotNull())))
    row = F.array_sort(F.collect_list(F.struct(F.col("other").cast("int").alias("other"), "n")))

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("row")
            at, n = (pc.struct_field(rows.flatten(), k) for k in (0, 1))
            word = np.repeat(batch.column("word").to_numpy(), pc.list_value_length(rows).to_numpy(zero_copy_only=False))
            value = weight[word] * weight[at.to_numpy()] * n.to_numpy()
            sizes = np.cumsum(np.append(0, pc.list_value_length(rows).to_numpy(zero_copy_only=False))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(sizes), at), pa.ListArray.from_arrays(pa.array(sizes), pa.array(value))], names=["at", "value"])

    grams = pairs.groupBy("word").agg(row.alias("row")).mapInArrow(weighed, "at array<int>, value array<double>")
    latent = weight[:, None] * randomised_svd(stored(grams, "word-products"), len(vocabulary), rank)
    groups = []
    for span in _SPANS:
        members = np.array([i for i, part in enumerate(parts) if _span(len(part)) == span], np.int64)
        if len(members):
            vectors = np.stack([latent[[vocabulary[w] for w in parts[i]]].sum(axis=0) for i in members])
            unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
            groups.append((span, members, (latent @ unit.T).astype(np.float32)))
    return Index(vocabulary, weight.astype(np.float32), parts, groups, _grams(parts, vocabulary))


def common_subsequence(a: list[bytes], b: list[bytes]) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    places: dict[bytes, int] = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << i
    row = (1 << len(a)) - 1
    full = row
    for w in b:
        if m := places.get(w):
            u = row & m
            row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


@dataclass(frozen=True)
class Words:
    """Some texts, one after the other, as the numbers of their words in a vocabulary (-1 for others)."""

    at: np.ndarray
    begin: np.ndarray
    sizes: np.ndarray


def numbered(texts: list[list[bytes]], vocabulary: dict[bytes, int]) -> Words:
    sizes = np.array([len(t) for t in texts], np.int64)
    at = np.fromiter(map(vocabulary.get, chain.from_iterable(texts), repeat(-1)), np.int64, int(sizes.sum()))
    return Words(at, np.cumsum(sizes) - sizes, sizes)


def candidates(texts: Words, index: Index, cosine: float) -> tuple[np.ndarray, ...]:
    """text, first word, words, segment, cosine (an array each) of every passage whose cosine with a segment is high
    enough, and of those that begin with the step of a run of words of a segment, whatever their cosine.

    The product with a segment is a sum over words, so each word's products with all segments are looked up and summed
    over the passage's steps.
    """
    pad, at, sizes = max(_SPANS) - 1, texts.at, texts.sizes
    steps = -(-sizes // _STEP) + pad
    begin = np.cumsum(steps) - steps
    text = np.repeat(np.arange(len(sizes)), sizes)
    word = np.arange(len(at)) - np.repeat(texts.begin, sizes)
    telling = at >= 0
    none = np.zeros(0, np.int64)
    runs = [np.zeros((0, 2), np.int64)]                       # step, segment
    for length, hashes, owners in index.grams:
        unknown = np.cumsum(np.append(0, ~telling))
        where = np.flatnonzero(unknown[length:] == unknown[:-length]) if len(at) >= length else none      # all words known
        where = where[text[where] == text[where + length - 1]]
        found = _runs(at, length)[where]
        low = np.searchsorted(hashes, found)
        same = hashes[np.minimum(low, len(hashes) - 1)] == found
        where, low = where[same], low[same]
        times = np.searchsorted(hashes, found[same], "right") - low
        nth = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
        step = begin[text[where]] + word[where] // _STEP
        runs.append(np.stack([np.repeat(step, times), owners[np.repeat(low, times) + nth]], axis=1))
    runs = np.unique(np.concatenate(runs), axis=0)
    at, text, word = at[telling], text[telling], word[telling]
    out = [(none, none, none, none, np.zeros(0))]
    if not len(at):
        return out[0]
    step = begin[text] + word // _STEP
    first = np.flatnonzero(np.diff(step, prepend=-1))
    told = np.diff(first, append=len(step))                   # telling words of each step that has one
    most = np.argsort(-told, kind="stable")
    heads, held = first[most], np.bincount(told).tolist()
    total = int(steps.sum())
    mass = np.zeros(total + 1)
    mass[step[first] + 1] = np.add.reduceat(index.weight[at].astype(np.float64) ** 2, first)
    mass = np.cumsum(mass)
    owner = np.repeat(np.arange(len(sizes)), steps)
    inside = np.arange(len(owner)) - begin[owner] < (steps - pad)[owner]
    starts = np.flatnonzero(inside)
    for span, members, products in index.groups:
        each, live = products[at[heads]], len(heads)
        for k in range(1, len(held)):                         # the k-th telling word, where there is one
            live -= held[k]
            each[:live] += products[at[heads[:live] + k]]
        sums = np.zeros((total, len(members)), np.float32)
        sums[step[heads]] = each
        width = 1
        while width < span:                                   # spans are powers of two
            sums = sums[:-width] + sums[width:]
            width *= 2
        # the passage's length is that of its tf-idf vector (words repeated in it counted apart), so that what it
        # has outside the latent space speaks against it
        size = np.zeros(total)
        size[starts] = np.sqrt(np.maximum(mass[starts + span] - mass[starts], 0))
        least = np.full(total, np.inf, np.float32)            # the least 32-bit number that is high enough
        some = size > 0.05                                    # no word weighs less than 0.1
        exact = cosine * size[some]
        near = exact.astype(np.float32)
        least[some] = np.where(near < exact, np.nextafter(near, np.float32(np.inf)), near)
        high = sums >= least[:len(sums), None]
        own = runs[np.isin(runs[:, 1], members)]
        high[own[:, 0], np.searchsorted(members, own[:, 1])] = True
        i, j = np.divmod(np.flatnonzero(high), len(members))
        t = owner[i]
        out.append((t, (i - begin[t]) * _STEP, np.full(len(t), span * _STEP), members[j], sums[i, j] / size[i]))
    return tuple(np.concatenate(c) for c in zip(*out))


def _telling(rarest: list[list[bytes]], vocabulary: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each word of the vocabulary the items it is one of the ``rarest`` words of: where they begin in the list, how
    many they are; the list."""
    pairs = sorted((vocabulary[w], i) for i, words in enumerate(rarest) for w in words)
    n = np.bincount(np.array([w for w, _ in pairs], np.int64), minlength=len(vocabulary) + 1)      # the last one stands for all others
    return np.cumsum(n) - n, n, np.array([i for _, i in pairs], np.int64)


def rare_places(texts: Words, telling: tuple[np.ndarray, np.ndarray, np.ndarray], item: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """How many places from ``low`` to before ``high`` in the texts hold a rarest word of ``item`` (an array each)."""
    first, n, items = telling
    times = n[texts.at]
    place = np.repeat(np.arange(len(times)), times)
    nth = np.arange(len(place)) - np.repeat(np.cumsum(times) - times, times)
    stride = len(times) + 1
    held = np.sort(items[first[texts.at[place]] + nth] * stride + place)
    return np.searchsorted(held, item * stride + high) - np.searchsorted(held, item * stride + low)


def contaminated(docs: DataFrame, benchmark: DataFrame, rank: int = 256, cosine: float = 0.35, subsequence: float = 0.7,
                 answer_words: int = 10, answer: float = 0.5, block: int = 200) -> DataFrame:
    """doc_id, item_id, cosine, subsequence, answer: which of ``docs`` (doc_id, text) hold which ``benchmark`` items
    (item_id, text), exactly or paraphrased.

    1. Word weights come from all documents; a randomised SVD of tf-idf passages (all items and all documents) gives
       ``rank`` latent dimensions.
    2. Every passage of 16, 32 or 64 words, at every eighth word of every whole text, is compared with the items of its
       size; those at ``cosine`` or more are candidates. So is, whatever its words weigh, every passage with a run of
       eight words of an item (all words of a shorter one): a whole item is found however many documents hold it.
       An item of more than 64 words is compared piece by piece, each piece of 64 words a query of its own.
    3. A candidate counts if the longest common subsequence of the item and the passage with its surroundings has a
       share ``subsequence`` of the item's words, and a share ``answer`` of the item's ``answer_words`` rarest
       words (what is asked for) is there too.

    The benchmark is the stated query set: it is searched ``block`` pieces at a time against all documents. Each
    (doc_id, item_id) has one row, the best one, also if a row or an item is repeated. Null or
    empty texts match nothing; no items or no documents give no rows.
    """
    spark = docs.sparkSession
    out = "doc_id bigint, item_id bigint, cosine double, subsequence double, answer double"
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = docs.count()
    asked = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    asked = asked.where("text rlike '[0-9A-Za-z\\\\x{80}-\\\\x{10ffff}]'").distinct()
    found, held = [], []
    for row in asked.orderBy("item_id", "text").toLocalIterator():
        words = plain_words(row["text"])
        for part in segments(words):
            held.append((row["item_id"], words, part))
            if len(held) == block:
                found.append(_search(docs, held, total, rank, cosine, subsequence, answer_words, answer, out))
                held = []
    if held:
        found.append(_search(docs, held, total, rank, cosine, subsequence, answer_words, answer, out))
    rows = spark.createDataFrame([], out)
    for f in found:
        rows = rows.union(f)
    best = F.max(F.struct("subsequence", "cosine", "answer")).alias("best")
    return rows.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.cosine", "best.subsequence", "best.answer")


def _search(docs, held, total, rank, cosine, subsequence, answer_words, answer, out) -> DataFrame:
    # the pieces of an item follow each other, and two items may share an id
    items, item_ids, item_of = [], [], []
    for item_id, words, _ in held:
        if not items or items[-1] is not words:
            items.append(words)
            item_ids.append(item_id)
        item_of.append(len(items) - 1)
    index = build_index(docs, [part for _, _, part in held], {w for words in items for w in words}, total, rank)
    rarest = [sorted(set(words), key=lambda w: (-index.weight[index.vocabulary[w]], w))[:answer_words] for words in items]
    shared = docs.sparkSession.sparkContext.broadcast((index, _telling(rarest, index.vocabulary)))
    sizes, asked, owner = (np.array(x, np.int64) for x in ([len(words) for words in items], [len(words) for words in rarest], item_of))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, telling = shared.value
        for batch in batches:
            for part in portions(batch, most=500_000):         # what is summed per step then stays in the cache
                ids = part.column("doc_id").to_pylist()
                words = [plain_words(t) for t in part.column("text").to_numpy(zero_copy_only=False)]
                texts = numbered(words, index.vocabulary)
                text, first, length, segment, cosines = candidates(texts, index, cosine)
                item = owner[segment]
                low, high = np.maximum(0, first - sizes[item]), np.minimum(texts.sizes[text], first + length + sizes[item])
                # a place is no more than a word, so what fails here fails below
                able = rare_places(texts, telling, item, texts.begin[text] + low, texts.begin[text] + high) / asked[item] >= answer
                best: dict[tuple[int, int], tuple] = {}
                for t, i, a, b, close in zip(*(x[able].tolist() for x in (text, item, low, high, cosines))):
                    if best.get((t, i), (0,))[0] == 1:
                        continue
                    near = words[t][a:b]
                    told = len(set(rarest[i]) & set(near)) / len(rarest[i])
                    if told < answer:
                        continue
                    share = common_subsequence(items[i], near) / len(items[i])
                    if share >= subsequence:
                        best[t, i] = max(best.get((t, i), (0,)), (share, close, told))
                rows = [(ids[t], item_ids[i], c, s, a) for (t, i), (s, c, a) in best.items()]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows), [pa.int64()] * 2 + [pa.float64()] * 3)],
                                                     names=["doc_id", "item_id", "cosine", "subsequence", "answer"])

    return docs.mapInArrow(scan, out)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **limits: float) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item; all columns. Rows are told apart by numbers of their
    own, so a clean row stays whatever its id."""
    rows = stored(docs.select(F.struct("*").alias("doc"), F.monotonically_increasing_id().alias("__row")), "rows")
    found = contaminated(rows.select(F.col("__row").alias("doc_id"), F.col("doc.text").alias("text")), benchmark, **limits)
    bad = stored(found.select(F.col("doc_id").alias("__row")).distinct(), "contaminated")
    return rows.join(bad, "__row", "left_anti").select("doc.*")
