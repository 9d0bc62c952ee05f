"""URL filters: explicit host-and-path rules first, then token rules mined from labelled URLs by FP-growth."""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, functions as F

from .storage import stored

_BAD = "label:block"
_RULES = "antecedent array<string>, confidence double, support double, anchor string"


def url_host(url: Column) -> Column:
    """Between the first :// and the next /, ?, # or end, with A-Z lower-cased; empty without a ://."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return F.coalesce(F.translate(host, string.ascii_uppercase, string.ascii_lowercase), F.lit(""))


def url_path(url: Column) -> Column:
    """Between the host and the next ?, # or end; empty without a ://."""
    return F.coalesce(F.regexp_extract(F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def url_tokens(url: Column) -> Column:
    """The distinct parts a rule can speak of: host labels, path parts with their numbers folded, query and
    fragment parts, and the scheme."""
    rest = F.coalesce(url, F.lit(""))
    query = F.regexp_extract(rest, r"\?([^#]*)", 1)
    fragment = F.regexp_extract(rest, r"#(.*)$", 1)
    scheme = F.regexp_extract(rest, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)

    def part(kind: str, values: Column) -> Column:
        return F.transform(F.filter(values, lambda v: v != ""), lambda v: F.concat(F.lit(kind), v))

    path = F.regexp_replace(url_path(url), "[0-9]+", "0")
    return F.array_sort(F.array_distinct(F.concat(
        part("host:", F.split(url_host(url), "[.]")), part("path:", F.split(path, "/")), part("query:", F.split(query, "&")),
        part("fragment:", F.array(fragment)), part("scheme:", F.array(F.lower(scheme))))))


def mine_rules(labelled: DataFrame, min_support: float, min_confidence: float) -> DataFrame:
    """Token combinations that imply a blocked label, from ``labelled`` (url, blocked): antecedent, confidence,
    support, anchor (the antecedent's rarest token).

    A rule with a part of its tokens that is as confident is pruned; rules have any number of tokens. Null labels
    are left out. No labels give no rules.
    """
    spark = labelled.sparkSession
    baskets = labelled.where(F.col("blocked").isNotNull()).select(
        F.concat(url_tokens(F.col("url")), F.when(F.col("blocked"), F.array(F.lit(_BAD))).otherwise(F.array().cast("array<string>"))).alias("items"))
    baskets = stored(baskets.where(F.size("items") > 0), "baskets")
    if baskets.isEmpty():
        return spark.createDataFrame([], _RULES)
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(baskets)
    rules = model.associationRules.where(F.col("consequent")[0] == _BAD)
    rules = rules.select(F.array_sort("antecedent").alias("antecedent"), "confidence", "support")
    # every part of a rule is frequent together with the label, though not always a rule itself
    sets = model.freqItemsets.where(F.array_contains("items", _BAD) & (F.size("items") > 1)).select(
        F.array_sort(F.array_remove("items", _BAD)).alias("antecedent"))
    sets = stored(sets.join(rules, "antecedent", "left").withColumn("n", F.size("antecedent")), "sets")
    kept = _unpruned(sets)
    single = model.freqItemsets.where(F.size("items") == 1).select(F.col("items")[0].alias("token"), "freq")
    rarest = kept.select("antecedent", F.explode("antecedent").alias("token")).join(single, "token").groupBy("antecedent").agg(
        F.min(F.struct("freq", "token")).getField("token").alias("anchor"))
    return stored(kept.join(rarest, "antecedent").select("antecedent", "confidence", "support", "anchor"), "mined")


def _unpruned(sets: DataFrame) -> DataFrame:
    """antecedent, confidence, support of the rules among ``sets`` (confidence null: no rule) without a part that is
    as confident. Each level hands the best confidence within its sets to those of one token more."""
    levels = sorted(r["n"] for r in sets.select("n").distinct().collect())
    out, below = sets.where("false").select("antecedent", "confidence", "support"), None
    for n in levels:
        level = sets.where(F.col("n") == n).withColumn("other", F.lit(None).cast("double"))
        if below is not None:
            parts = level.select("antecedent", F.explode("antecedent").alias("token")).select(
                "antecedent", F.array_remove("antecedent", F.col("token")).alias("part"))
            best = parts.join(below, "part").groupBy("antecedent").agg(F.max("top").alias("other"))
            level = level.drop("other").join(best, "antecedent", "left")
        level = stored(level, "level")
        out = out.union(level.where("confidence is not null and (other is null or other < confidence)").select("antecedent", "confidence", "support"))
        below = level.select(F.col("antecedent").alias("part"), F.greatest("confidence", "other").alias("top"))
    return out


def matched_urls(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The distinct ``urls`` (url) that hold all tokens of some rule, with the best confidence.

    The rules are indexed by their rarest token, so a URL meets only rules whose anchor it has.
    """
    tokens = urls.select("url").distinct().withColumn("tokens", url_tokens(F.col("url")))
    probes = tokens.select("url", "tokens", F.explode("tokens").alias("anchor"))
    hits = probes.join(rules, "anchor").where(F.size(F.array_except("antecedent", "tokens")) == 0)
    return hits.groupBy("url").agg(F.max("confidence").alias("confidence"))


def explicit_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule (``host/path``, verdict) that fits, and its verdict; null where none does."""
    rule = verdict = F.lit(None).cast("string")
    for text, decision in sorted(rules, key=lambda r: len(r[0])):
        at = text.index("/")
        fits = ((host == text[:at]) | host.endswith("." + text[:at])) & path.startswith(text[at:])
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, decision).otherwise(verdict)
    return rule, verdict


def judge_urls(pages: DataFrame, labelled: DataFrame, rules: Sequence[tuple[str, str]], min_support: float = 0.002,
               min_confidence: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict, confidence for each of ``pages`` (page_id, url).

    verdict is that of the longest explicit rule that fits; where none fits, ``block`` if a mined rule matches and
    else ``allow``. A null url has an empty host and path. Repeated rows stay; an empty table gives no rows.
    """
    rows = pages.select("page_id", "url")
    hits = matched_urls(rows.where(F.col("url").isNotNull()), mine_rules(labelled, min_support, min_confidence))
    rows = rows.join(hits, "url", "left")
    rows = rows.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"), "confidence")
    rule, verdict = explicit_rule(F.col("host"), F.col("path"), rules)
    mined = F.when(F.col("confidence").isNotNull(), "block").otherwise("allow")
    return rows.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, mined).alias("verdict"), "confidence")
