"""Quality rules as a short-circuit cascade, ordered by rejection per cost. Built-in functions only."""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .storage import stored

_SPACE = "[\\x20\\x09-\\x0D]+"


@dataclass(frozen=True)
class Rule:
    """Rejects a document where ``reject`` (SQL over the measures named in ``uses``) holds."""

    name: str
    reject: str
    uses: tuple[str, ...]


#: A clean text passes all of them with a wide margin; each catches one kind of junk.
RULES = (
    Rule("few_words", "n_words < 50", ("n_words",)),
    Rule("repeated_passages", "100 * n_repeat_words > 50 * n_words", ("n_words", "n_repeat_words")),
    Rule("symbols", "100 * n_symbols > 10 * n_words", ("n_words", "n_symbols")),
    Rule("repeated_lines", "2 * n_dup_lines > n_lines", ("n_dup_lines", "n_lines")),
    Rule("word_length", "word_chars < 2 * n_words OR word_chars > 12 * n_words", ("n_words", "word_chars")),
    Rule("shouting", "100 * n_shouts > 50 * n_words", ("n_words", "n_shouts")),
)
BASE_RULES = ("few_words", "repeated_passages")


def _shift_right(x: Column, bits: Column) -> Column:
    return F.call_function("shiftright", x, bits)


def _measures() -> dict[str, tuple[tuple[str, ...], Column]]:
    """Measure -> (measures it builds on, expression). Names that begin with __ are scratch.

    __windows holds one long for each 3-word window: the high bits of its hash above its position.
    Sorted, equal windows are neighbours in text order; neighbours with equal hash bits also compare their words.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    n, bits = F.col("n_words").cast("int"), F.col("__bits")

    def word(i: Column) -> Column:
        return F.get("__words", i)

    def place(x: Column) -> Column:
        return x.bitwiseAND(F.col("__mask")).cast("int")

    def same(x: Column, y: Column) -> Column:
        p, q = place(x), place(y)
        words = (word(p) == word(q)) & (word(p + 1) == word(q + 1)) & (word(p + 2) == word(q + 2))
        return (_shift_right(x, bits) == _shift_right(y, bits)) & words

    window = lambda i: F.call_function(
        "shiftleft", _shift_right(F.xxhash64(word(i), word(i + 1), word(i + 2)), bits), bits).bitwiseOR(i.cast("long"))
    windows = F.when(n >= 3, F.sort_array(F.transform(F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0))), window)))
    repeated = F.filter("__windows", lambda x, i: F.coalesce(
        ((i > 0) & same(x, F.get("__windows", i - 1))) | same(x, F.get("__windows", i + 1)), F.lit(False)))
    covered = F.aggregate("__repeated", F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")), lambda s, x: F.struct(
        x.alias("last"), (s["n"] + F.least(F.lit(3), x - s["last"])).alias("n")), lambda s: s["n"])
    return {
        "__words": ((), F.filter(F.split(text, _SPACE), lambda w: w != "")),
        "n_words": (("__words",), F.size("__words").cast("long")),
        "word_chars": (("__words",), F.length(F.array_join("__words", "")).cast("long")),
        "n_symbols": ((), F.length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).cast("long")),
        "n_shouts": ((), F.length(F.regexp_replace(text, "[^!]+", "")).cast("long")),
        "__lines": ((), F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))),
        "n_lines": (("__lines",), F.size("__lines").cast("long")),
        "n_dup_lines": (("__lines",), (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long")),
        "__bits": (("n_words",), F.ceil(F.log2(n + F.lit(1.0))).cast("int")),
        "__mask": (("__bits",), F.call_function("shiftleft", F.lit(1).cast("long"), bits) - F.lit(1).cast("long")),
        "__windows": (("__words", "__bits"), windows),
        "__repeated": (("__windows", "__mask"), F.sort_array(F.transform(repeated, place))),
        "n_repeat_words": (("__repeated",), F.coalesce(covered, F.lit(0)).cast("long")),
    }


def _order(names: Sequence[str], measures: dict) -> list[str]:
    """``names`` and what they build on, each after its needs."""
    out: list[str] = []

    def visit(name: str) -> None:
        if name not in out:
            for need in measures[name][0]:
                visit(need)
            out.append(name)

    for name in names:
        visit(name)
    return out


def measure(docs: DataFrame, names: Sequence[str], alive: Column | None = None) -> DataFrame:
    """Add measures (and scratch columns) not yet there; null on rows where ``alive`` is false."""
    measures = _measures()
    for name in _order(names, measures):
        if name not in docs.columns:
            value = measures[name][1]
            docs = docs.withColumn(name, value if alive is None else F.when(alive, value))
    return docs


def rank_rules(docs: DataFrame, rules: Sequence[Rule] = RULES, sample_rows: int = 2000, seed: int = 7) -> list[Rule]:
    """The rules by falling rejection per cost, both measured on a sample of about ``sample_rows`` rows.

    The order only decides how early a document is dropped, never whether.
    """
    total = docs.count()
    sample = stored(docs.select("text").sample(min(1.0, sample_rows / max(1, total)), seed), "quality-sample")

    def timed(rule: Rule | None) -> tuple[float, int]:
        begin = time.perf_counter()
        rejected = F.lit(0) if rule is None else F.expr(rule.reject).cast("int")
        got = measure(sample, rule.uses if rule else ()).agg(F.sum(rejected), F.sum(F.length("text"))).first()[0]
        return time.perf_counter() - begin, got or 0

    timed(None)
    idle = timed(None)[0]
    worth = []
    for rule in rules:
        seconds, rejected = timed(rule)
        worth.append((-rejected / max(seconds - idle, 1e-3), rule.name, rule))
    return [rule for _, _, rule in sorted(worth, key=lambda w: w[:2])]


def cascade(docs: DataFrame, rules: Sequence[Rule], report: Sequence[str] = ()) -> DataFrame:
    """``docs`` with kept, rejected_by (the first rule that rejects; null if kept) and the ``report`` measures.

    Rules apply in the given order. Once one rejects a document, the measures of later rules are not computed for
    it, unless ``report`` asks for them. ``docs`` may not have columns of the measures' names, kept or rejected_by. A null
    text has no words. Rows are independent: ties, repeats and null ids need no care.
    """
    given = docs.columns
    docs = measure(docs, report).withColumn("rejected_by", F.lit(None).cast("string"))
    for rule in rules:
        docs = measure(docs, rule.uses, F.col("rejected_by").isNull())
        docs = docs.withColumn("rejected_by", F.when(F.col("rejected_by").isNotNull(), F.col("rejected_by"))
                               .when(F.expr(rule.reject), F.lit(rule.name)))
    # the generator keeps a caller's filter above the measures, which would else be repeated inside it
    verdict = F.struct(F.col("rejected_by").isNull().alias("kept"), "rejected_by", *report)
    return docs.select(*given, F.inline(F.array(verdict)))


def quality_report(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept."""
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    judged = cascade(docs.select("doc_id", "text"), rank_rules(docs, rules), counts)
    base = " OR ".join(f"({r.reject})" for r in rules if r.name in BASE_RULES)
    return judged.select("doc_id", *counts, F.expr(base).alias("base_failed"), "kept")


def keep_good(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """The documents no rule rejects, with their columns as they were."""
    inner = docs.select(F.struct(*docs.columns).alias("__row"), "text")
    return cascade(inner, rank_rules(docs, rules)).where("kept").select("__row.*")
