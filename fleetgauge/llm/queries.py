"""Registered queries of the operators, with production parameters, and their checking SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import shared_dir
from .decontaminate import contaminated
from .html_text import extract_text
from .lexical_search import rank_documents
from .packing import pack, token_pieces
from .quality import quality_report
from .rank_bpe import bpe_digests
from .scoring import score_documents
from .sharding import shard_documents
from .simhash import near_duplicates
from .storage import session, table
from .token_counts import count_tokens
from .token_files import token_index, write_token_files
from .url_rules import judge_urls
from .whitening import whiten

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def tokenizer_file(name: str) -> str:
    """A public vocabulary file; ``LLM_TOKENIZERS`` names another folder."""
    folder = os.environ.get("LLM_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers
    return public_tokenizers.path(name)


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(session(spark), sf_dir)

    QUERIES[fn.__name__] = run
    return fn


@query
def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), path, tokenizer_file("word_bpe_49k.json"), end_id=2)
    return token_index(spark, path)


@query
def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


#: The explicit rules of the URL filter.
URL_RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]


@query
def op3_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page shows the document whose id ends its path; it is bad if that document's label is."""
    pages, labels = table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")
    shown = pages.select("url", F.expr("try_cast(regexp_extract(url, '/([0-9]{1,18})([./?#][^/]*)?$', 1) as bigint)").alias("doc_id"))
    labelled = shown.join(labels, "doc_id").select("url", ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("blocked"))
    return judge_urls(pages, labelled, URL_RULES)


@query
def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), shingle=3, max_bits=2)
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")


@query
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = "byte_bpe_50k.json"
    return count_tokens(table(spark, sf_dir, "documents"), shared_dir(spark, "token-counts"), tokenizer_file(name), name)


@query
def op7_gru_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))


@query
def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), shards=40, seed=8)


@query
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(table(spark, sf_dir, "documents"))


CHECKS["op9_quality"] = r"""
    with docs as (select row_number() over () as rid, doc_id, coalesce(text, '') as text,
                         [w for w in string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+') if w <> ''] as words,
                         [x for x in string_split(coalesce(text, ''), chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')] as lines from documents),
    tokens as (select rid, unnest(words) as a, generate_subscripts(words, 1) as i from docs),
    windows as (select rid, i, a, lead(a, 1) over along as b, lead(a, 2) over along as c from tokens window along as (partition by rid order by i)),
    repeated as (select rid, i, count(*) over (partition by rid, a, b, c) as times from windows where c is not null),
    covered as (select rid, count(distinct p) as n from (select rid, unnest([i, i + 1, i + 2]) as p from repeated where times > 1) group by rid),
    counts as (select doc_id, len(words) as n_words, length(array_to_string(words, '')) as word_chars,
                      length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as n_symbols, len(lines) - len(list_distinct(lines)) as n_dup_lines,
                      coalesce(n, 0) as n_repeat_words, len(lines) as n_lines, length(regexp_replace(text, '[^!]', '', 'g')) as n_shouts
               from docs left join covered using (rid)),
    failed as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from counts)
    select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           not (base_failed or 100 * n_symbols > 10 * n_words or 2 * n_dup_lines > n_lines or word_chars < 2 * n_words
                or word_chars > 12 * n_words or 100 * n_shouts > 50 * n_words) as kept from failed"""


@query
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = token_pieces(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), end_id=1, capacity=4096)
    return pack(pieces, 4096)


@query
def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), top=50)


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
CHECKS["op11_lexical_search"] = f"""
    with docs as (select row_number() over () as rid, doc_id, {_TERMS} as terms from documents),
    items as (select row_number() over () as iid, item_id, {_TERMS} as terms from benchmark),
    counted as (select *, len(terms) as n from docs where len(terms) > 0),
    totals as (select cast(count(*) as bigint) as total_docs, cast(sum(n) as bigint) as total_terms from counted),
    tfs as (select rid, term, count(*) as tf from (select rid, unnest(terms) as term from counted) group by rid, term),
    weights as (select term, cast(floor(1000 * ln((2.0 * max(total_docs) + 2) / (2 * count(*) + 1))) as bigint) as w from tfs, totals group by term),
    asked as (select distinct iid, term from (select iid, unnest(terms) as term from items)),
    scores as (select iid, rid, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * total_docs) // total_terms)))) as bigint) as score
               from asked join weights using (term) join tfs using (term) join counted using (rid), totals group by iid, rid),
    ranked as (select iid, doc_id, score, cast(row_number() over (partition by iid order by score desc, doc_id nulls last) as int) as rank
               from scores join docs using (rid) where score > 0)
    select item_id, rank, doc_id, score from ranked join items using (iid) where rank <= 50"""


@query
def op12_rank_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return bpe_digests(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@query
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"), components=4)
