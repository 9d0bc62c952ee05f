"""Language-model scores of whole documents: corpus counts on Spark, a gated recurrent model on top."""

from __future__ import annotations

import pickle
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from . import gru
from .encoding import portions
from .storage import stored

END = " "                       # no word can be a blank, so it stands for the end of a text


def _pieces(texts: pa.Array) -> pa.ListArray:
    """The words of each text (A-Z lower-cased), some of them empty at its edges."""
    return pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), "")))


def held_out(doc_id: int | None, folds: int = 5, fold: int = 1) -> bool:
    """Whether crc32 of the id as text has remainder ``fold``; a null id counts as an empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % folds == fold


def training_counts(docs: DataFrame, most: int = 400_000) -> DataFrame:
    """word, c over the training documents, the end of each text included. A task adds up what it has
    read and sends its sums on when it holds ``most`` words."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def sums() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for part in portions(batch):
                train = pa.array([not held_out(d) for d in part.column("doc_id").to_pylist()], pa.bool_())
                words = pc.value_counts(_pieces(part.column("text").filter(train)).flatten())
                held.update(dict(zip(words.field("values").to_numpy(zero_copy_only=False), words.field("counts").to_numpy().tolist())))
                held[END] += pc.sum(train).as_py() or 0
                held.pop("", None)
                if len(held) >= most:
                    yield sums()
        yield sums()

    found = docs.select("doc_id", "text").mapInArrow(count, "word string, n bigint")
    return found.groupBy("word").agg(F.sum("n").alias("c")).where("c > 0")


@dataclass(frozen=True)
class Head:
    """The most frequent training words: their counts, and their numbers in the model (the first ones)."""

    counts: dict[str, int]
    places: dict[str, int]
    total: int
    distinct: int
    rare_mass: float              # smoothed counts of all words that are not in the model

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.5) / (self.total + 0.5 * (self.distinct + 1)))


def _model_tokens(head: Head, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray]:
    """Model word of each token (1 stands for every word not in the model), and per text the tokens' end; also
    the dictionary's words and each token's place in it. Ends of texts are appended as tokens."""
    pieces = _pieces(texts)
    coded = pieces.flatten().dictionary_encode()
    words = [*coded.dictionary.to_numpy(zero_copy_only=False).tolist(), END]
    at = coded.indices.to_numpy().astype(np.int64)
    ends = np.cumsum(pc.list_value_length(pieces).to_numpy(zero_copy_only=False).astype(np.int64))
    at = np.insert(at, ends, len(words) - 1)
    ends = ends + np.arange(1, len(ends) + 1)
    real = np.array([w != "" for w in words], bool)[at]
    ends = np.cumsum(real)[ends - 1] if len(ends) else ends
    at = at[real]
    model = np.fromiter((head.places.get(w, 1) for w in words), np.int64, len(words))
    return model[at], ends, words, at


def train_model(docs: DataFrame, head: Head, classes: int, width: int, embed: int, hidden: int, sample_docs: int | None, tasks: int | None, rounds: int,
                lanes: int = 128, stream: int = 500_000) -> gru.Weights:
    """Train the recurrent part on all training documents, each learnt from once (``sample_docs`` bounds them for a trial).

    The documents are dealt to ``rounds`` rounds by their content, and in a round each partition is a task (``tasks`` deals
    them anew): it runs truncated backpropagation over its documents from the round's weights, about ``stream`` tokens in
    memory at a time, and the weights are averaged by the tokens seen.
    """
    weights = gru.new_weights(classes * width, classes, embed, hidden)
    share = 1.0 if sample_docs is None else min(1.0, sample_docs / max(1, docs.count()))
    dealt = docs if share == 1 else docs.sample(share, 7)
    dealt = dealt if tasks is None else stored(dealt.repartition(tasks, F.xxhash64("doc_id", "text")), "lm-dealt").repartition(tasks, F.xxhash64("doc_id", "text"))
    shared = docs.sparkSession.sparkContext.broadcast(head)
    for turn in range(rounds):
        def learn(batches: Iterator[pa.RecordBatch], weights: gru.Weights = weights, turn: int = turn) -> Iterator[pa.RecordBatch]:
            texts, held, tokens, moments = [], 0, 0, {}

            def fit(lanes: int) -> list[np.ndarray]:
                """Learn from the texts held; the tokens that fill no whole row of lanes are given back."""
                nonlocal weights, tokens
                weights, n, _ = gru.train(weights, texts, lanes, rate=0.01 / (1 + turn), moments=moments)
                tokens += n
                rest = np.concatenate([np.zeros(0, np.int64), *[np.append(0, t) for t in texts]])[n + 1:]
                return [rest] if len(rest) else []

            for batch in batches:
                for part in portions(batch, most=4_000_000):
                    keep = pa.array([not held_out(d) for d in part.column("doc_id").to_pylist()], pa.bool_())
                    model, ends, _, _ = _model_tokens(shared.value, part.column("text").filter(keep))
                    texts += np.split(model, ends[:-1]) if len(ends) else []
                    held += len(model) + len(ends)
                    if held >= stream:
                        texts, held = fit(lanes), 0
            texts = fit(lanes)
            fit(1)
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(weights)], pa.binary()), pa.array([tokens], pa.int64())], names=["weights", "tokens"])

        mine = dealt.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(rounds)) == turn)
        learnt = stored(mine.mapInArrow(learn, "weights binary, tokens bigint"), "lm-weights")
        mean, seen = {k: np.zeros(v.shape) for k, v in weights.items()}, 0
        for row in learnt.toLocalIterator():
            seen += row["tokens"]
            for k, v in pickle.loads(row["weights"]).items():
                mean[k] += v * float(row["tokens"])
        if seen:
            weights = {k: (v / seen).astype(np.float32) for k, v in mean.items()}
    return weights


def score_documents(docs: DataFrame, head_words: int = 200_000, classes: int = 32, width: int = 32, embed: int = 16, hidden: int = 16,
                    sample_docs: int | None = None, tasks: int | None = None, rounds: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each of ``docs`` (doc_id, text).

    base_score is the smoothed unigram log10 probability of the whole text under the counts of all
    training documents. score is the recurrent model's: classes * width - 2 frequent words have a number of their own;
    all others share one, times the smoothed unigram share of the word among them. The state runs through a whole
    text, window after window. The model learns from all training documents (see ``train_model``).

    Words beyond the ``head_words`` most frequent (the only counts sent to all tasks) are folded per document and
    meet their counts in a join. A null text has no words, only its end. Repeated rows are scored each;
    a null id counts as an empty id. An empty table gives no rows.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counts = stored(training_counts(docs), "word-counts")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    first = counts.orderBy(F.col("c").desc(), "word").limit(head_words).collect()
    frequent = [r["word"] for r in first if r["word"] != END][:classes * width - 3]
    places = {END: 0, **{w: i + 2 for i, w in enumerate(frequent)}}
    known = {r["word"]: r["c"] for r in first}
    modelled = sum(known.get(w, 0) + 0.5 for w in places)
    head = Head(known, places, total, distinct, total + 0.5 * (distinct + 1) - modelled)
    model = train_model(docs, head, classes, width, embed, hidden, sample_docs, tasks, rounds)
    shared = spark.sparkContext.broadcast((head, model))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, model = shared.value
        rare = float(np.log10((head.total + 0.5 * (head.distinct + 1)) / max(head.rare_mass, 0.5)))
        for batch in batches:
            for part in portions(batch, most=4_000_000):
                tokens, ends, words, at = _model_tokens(head, part.column("text"))
                n = np.diff(ends, prepend=0)
                row = np.repeat(np.arange(len(n)), n)
                c = np.fromiter((head.counts.get(w, 0) for w in words), np.int64, len(words))
                listed = (c > 0)[at]
                base = np.bincount(row, weights=np.where(listed, head.base(c)[at], 0.0), minlength=len(n))
                unigram = np.bincount(row, weights=np.where(tokens == 1, rare + np.where(listed, head.base(c)[at], 0.0), 0.0), minlength=len(n))
                score = gru.score_texts(model, np.split(tokens, ends[:-1]) if len(n) else []) / np.log(10) + unigram
                tail_row, tail_word = row[~listed], at[~listed]
                pair, times = np.unique(tail_row * len(words) + tail_word, return_counts=True)
                offsets = np.searchsorted(pair // len(words), np.arange(len(n) + 1)).astype(np.int32)
                tail = pa.StructArray.from_arrays([pa.array(words, pa.string()).take(pa.array(pair % len(words))), pa.array(times, pa.int64())], names=["word", "n"])
                ids = part.column("doc_id")
                yield pa.RecordBatch.from_arrays([
                    ids, pa.array([held_out(d) for d in ids.to_pylist()], pa.bool_()), pa.array(n, pa.int64()),
                    pa.array(np.bincount(row, weights=listed, minlength=len(n)).astype(np.int64)), pa.array(base), pa.array(score),
                    pa.ListArray.from_arrays(pa.array(offsets), tail)], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "tail"])

    schema = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double, tail array<struct<word:string,n:bigint>>"
    scored = stored(docs.mapInArrow(score, schema).withColumn("uid", F.monotonically_increasing_id()), "lm-scores")
    met = scored.select("uid", F.inline("tail")).join(counts, "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    log = F.log10((F.col("c") + 0.5) / F.lit(total + 0.5 * (distinct + 1)))
    rest = met.groupBy("uid").agg(F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("more"), F.sum(F.col("n") * log).alias("low"))
    joined = scored.drop("tail").join(rest, "uid", "left").withColumn("low", F.coalesce("low", F.lit(0.0)))
    return joined.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"),
                         F.lit(total).cast("long").alias("train_tokens"), (F.col("base_score") + F.col("low")).alias("base_score"),
                         (F.col("score") + F.col("low")).alias("score"))
