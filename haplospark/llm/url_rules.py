"""URL filters: explicit host and path rules, and association rules mined by FP-growth for the rest."""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import store

#: (verdict, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
MIN_SUPPORT, MIN_CONFIDENCE, MAX_TOKENS = 0.01, 0.8, 3
#: Rows with more frequent tokens are counted by combination: FP-growth would make all their parts.
GROWN_TOKENS = 9
DEFAULT = "allow"
_LABEL = "label="


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens: host labels from the right (top level, domain, others), path segments, suffix, query keys, fragment."""
    labels = F.reverse(F.split(host, r"\."))
    tagged = F.transform(labels, lambda x, i: F.concat(F.when(i == 0, "tld:").when(i == 1, "domain:").otherwise("sub:"), x))
    segments = F.transform(
        F.filter(F.split(path, "/"), lambda x: x != ""), lambda x, i: F.concat(F.when(i == 0, "top:").otherwise("dir:"), F.regexp_replace(x, "[0-9]+", "0"))
    )
    suffix = F.regexp_extract(path, r"\.([A-Za-z0-9]{1,5})$", 1)
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^[^#?]*\?([^#]*)", 1)
    keys = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("key:"), F.element_at(F.split(x, "="), 1)))
    more = F.filter(
        F.array(F.when(suffix != "", F.concat(F.lit("suffix:"), suffix)), F.when(F.coalesce(url, F.lit("")).contains("#"), F.lit("fragment"))), lambda x: x.isNotNull()
    )
    return F.array_distinct(F.concat(tagged, segments, keys, more))


def explicit_rule(host: Column, path: Column, rules=RULES) -> Column:
    """struct(length, rule, verdict) of the longest rule that fits, or null. Of equal lengths the last by code point wins."""
    fits = [
        F.when(
            ((host == h) | host.endswith(f".{h}")) & path.startswith(p), F.struct(F.lit(len(h + p)).alias("length"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))
        )
        for v, h, p in rules
    ]
    return F.array_max(F.array(*fits)) if fits else F.lit(None).cast("struct<length:int,rule:string,verdict:string>")


def mine_rules(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """labelled (tokens, label) -> rule_id, tokens, label, confidence, support.

    FP-growth mines token combinations that go with a label in at least min_support of the rows; rules below
    min_confidence or above max_tokens go, and so does a rule of which a part says the same at least as surely. Rows
    without a label are left out; null tokens are none.
    """
    rules, named = mine_classes(labelled, min_support, min_confidence, max_tokens)
    if not named:
        return rules
    members = F.create_map(*[x for name, tokens in sorted(_members(named).items()) for x in (F.lit(name), F.array(*map(F.lit, tokens)))])
    out = rules.withColumn("named", F.array().cast("array<string>"))
    for i in range(max_tokens):
        out = out.withColumn("one", F.explode_outer(members[F.get("tokens", F.lit(i))]))
        out = out.withColumn("named", F.when(F.col("one").isNull(), F.col("named")).otherwise(F.array_append("named", F.col("one"))))
    out = out.withColumn("tokens", F.array_sort("named"))
    return out.select(F.array_join("tokens", " ").alias("rule_id"), "tokens", "label", "confidence", "support")


def mine_classes(labelled: DataFrame, min_support: float, min_confidence: float, max_tokens: int) -> tuple[DataFrame, dict[str, str]]:
    """(the rules of mine_rules over classes of tokens, token -> name of its class, which is its first token by code point).

    Before FP-growth two steps change no rule. Tokens that go with no label often enough are left out: at most tokens per
    row / min_support are frequent, whatever the number of rows. Tokens that occur in just the same rows are one class: a
    rule holds for each of them alike, and one with two of a class has a part that says the same. FP-growth makes all 2**n
    parts of a row of n classes, so where one has more than GROWN_TOKENS of them, combinations of up to max_tokens are
    counted instead.
    """
    rows = labelled.filter("label is not null").select(F.coalesce(F.array_distinct("tokens"), F.array()).alias("tokens"), "label")
    total = rows.count()
    least = max(1, math.ceil(min_support * total - 1e-9))
    frequent = rows.select(F.explode("tokens").alias("token"), "label").groupBy("token", "label").count().filter(F.col("count") >= least)
    known = F.array(*map(F.lit, sorted(r.token for r in frequent.select("token").distinct().collect()))).cast("array<string>")
    rows = store(rows.select(F.array_sort(F.array_intersect("tokens", known)).alias("tokens"), "label"), "frequent_sets")
    named = _classes(rows)
    names = F.array(*map(F.lit, sorted(set(named.values())))).cast("array<string>")
    rows = rows.withColumn("tokens", F.array_sort(F.array_intersect("tokens", names)))
    if rows.filter(F.size("tokens") > GROWN_TOKENS).isEmpty():
        items = rows.select(F.array_append("tokens", F.concat(F.lit(_LABEL), "label")).alias("items"))
        model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(items)
        rules = model.associationRules.withColumn("label", F.element_at("consequent", 1)).filter(F.col("label").startswith(_LABEL))
        rules = rules.filter((F.size("antecedent") <= max_tokens) & ~F.exists("antecedent", lambda x: x.startswith(_LABEL)))
        rules = rules.select(F.array_sort("antecedent").alias("tokens"), F.substring("label", len(_LABEL) + 1, 100).alias("label"), "confidence", "support")
    else:
        rules = _counted_rules(rows, least, total, min_confidence, max_tokens)
    rules = rules.withColumn("confidence", F.round("confidence", 9)).withColumn("support", F.round("support", 9))
    rules = store(rules.withColumn("rule_id", F.array_join("tokens", " ")), "rules")
    if max_tokens < 2:
        return rules, named
    # each rule asks for its few parts by name
    parts = F.filter(_combinations("tokens", max_tokens - 1), lambda c: F.size(c) < F.size("tokens"))
    asked = rules.filter(F.size("tokens") > 1).select("rule_id", "label", "confidence", F.explode(parts).alias("part"))
    said = rules.select(F.col("tokens").alias("part"), "label", F.col("confidence").alias("surely"))
    weaker = asked.join(said, ["part", "label"]).filter("surely >= confidence").select("rule_id", "label").distinct()
    return store(rules.join(weaker, ["rule_id", "label"], "left_anti"), "pruned_rules"), named


def _classes(rows: DataFrame) -> dict[str, str]:
    """rows (tokens) -> token -> the first of the tokens that occur in just the same rows, told by two 64-bit hashes and a count over distinct sets."""
    sets = rows.select("tokens").distinct().select("tokens", F.xxhash64("tokens").alias("a"), F.xxhash64(F.lit(1), "tokens").alias("b"))
    seen = sets.select(F.explode("tokens").alias("token"), "a", "b").groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))
    first: dict[tuple, str] = {}
    return {r.token: first.setdefault((r.n, r.a, r.b), r.token) for r in sorted(seen.collect(), key=lambda r: r.token)}


def _members(named: dict[str, str]) -> dict[str, list[str]]:
    members: dict[str, list[str]] = {}
    for token, name in named.items():
        members.setdefault(name, []).append(token)
    return members


def _combinations(tokens: str, upto: int) -> Column:
    """All combinations of 1 to upto of the tokens of a sorted array, each sorted."""
    grown = F.transform(tokens, lambda x: F.array(x))
    parts = grown
    for _ in range(upto - 1):
        # each combination goes on with the tokens after its last one
        longer = F.flatten(F.transform(grown, lambda c: F.transform(F.filter(tokens, lambda x: x > F.element_at(c, -1)), lambda x: F.array_append(c, x))))
        parts, grown = F.concat(parts, longer), longer
    return parts


def _counted_rules(rows: DataFrame, least: int, total: int, min_confidence: float, max_tokens: int) -> DataFrame:
    """rows (tokens, label) -> tokens, label, confidence, support of all combinations of up to max_tokens that reach both bounds."""
    rows = rows.groupBy("tokens", "label").agg(F.count(F.lit(1)).alias("n"))
    counts = rows.select(F.explode(_combinations("tokens", max_tokens)).alias("tokens"), "label", "n").groupBy("tokens", "label").agg(F.sum("n").alias("n"))
    whole = counts.groupBy("tokens").agg(F.sum("n").alias("all"), F.collect_list(F.struct("label", "n")).alias("by"))
    rules = whole.select("tokens", "all", F.explode("by").alias("x")).select("tokens", "x.label", (F.col("x.n") / F.col("all")).alias("confidence"), (F.col("x.n") / total).alias("support"), "x.n")
    return rules.filter((F.col("n") >= least) & (F.col("confidence") >= min_confidence)).drop("n")


def match_rules(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """sets (tokens) -> tokens, label of the surest rule whose tokens they all have; sets that fit none are left out.

    The inverted index has a row per token of a rule; a rule fits when as many of its tokens are found as it has. Surer
    rules go first, then those with more tokens, more support, and the first by code point.
    """
    index = rules.select("rule_id", "label", "confidence", "support", F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
    found = sets.select("tokens", F.explode("tokens").alias("token")).join(index, "token")
    found = found.groupBy("tokens", "rule_id", "label", "confidence", "support", "n").agg(F.count(F.lit(1)).alias("hits")).filter("hits = n")
    order = F.struct(-F.col("confidence"), -F.col("n"), -F.col("support"), F.col("label"), F.col("rule_id"))
    return found.groupBy("tokens").agg(F.min_by("label", order).alias("label"))


def judge_urls(pages: DataFrame, labelled: DataFrame | None = None, rules=RULES, **mining) -> DataFrame:
    """pages (page_id, url, ...) -> page_id, host, path, rule, verdict.

    The longest explicit rule decides. Other urls are judged by association rules, mined from labelled (url, label), or, if
    that isn't given, from those urls of pages that an explicit rule decides. A url that no mined rule fits is allowed.

    Urls are cut down to the classes of tokens that occur in rules and grouped before they are matched, so the index is asked once for
    each distinct set. Null urls and urls without ``://`` have empty host and path and are judged like any other. Repeated
    rows are judged alike. An empty table gives no rows; without any label nothing is mined.
    """
    spark = pages.sparkSession
    url, host, path = F.col("url"), F.col("host"), F.col("path")
    parts = lambda df: df.withColumn("host", host_of(url)).withColumn("path", path_of(url))
    rows = parts(pages.select("page_id", "url")).withColumn("fit", explicit_rule(host, path, rules))
    rows = store(rows.select("page_id", "host", "path", "fit", url_tokens(url, host, path).alias("all_tokens")), "urls")
    if labelled is None:
        labels = rows.filter("fit is not null").select(F.col("all_tokens").alias("tokens"), F.col("fit.verdict").alias("label"))
    else:
        labels = parts(labelled.select("url", "label")).select(url_tokens(url, host, path).alias("tokens"), "label")
    decided = rows.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.col("fit.verdict").alias("said"), "all_tokens")
    if labels.isEmpty():
        return decided.select("page_id", "host", "path", "rule", F.coalesce("said", F.lit(DEFAULT)).alias("verdict"))
    mined, named = mine_classes(labels, **({"min_support": MIN_SUPPORT, "min_confidence": MIN_CONFIDENCE, "max_tokens": MAX_TOKENS} | mining))
    asked = {r[0] for r in mined.select(F.explode("tokens")).distinct().collect()}
    known = sorted(token for token, name in named.items() if name in asked)
    tokens = F.array().cast("array<string>")
    if known:
        name_of = F.create_map(*[F.lit(x) for token in known for x in (token, named[token])])
        tokens = F.array_sort(F.array_distinct(F.transform(F.array_intersect("all_tokens", F.array(*map(F.lit, known))), lambda x: name_of[x])))
    columns = ["page_id", "host", "path", "rule"]
    others = decided.filter("said is null").select(*columns, tokens.alias("tokens"))
    fits = others.filter(F.size("tokens") > 0)
    verdicts = match_rules(fits.select("tokens").distinct(), mined)
    judged = fits.join(verdicts, "tokens", "left").select(*columns, F.coalesce("label", F.lit(DEFAULT)).alias("verdict"))
    # what a rule says, and what has no token of any rule, needs no join
    plain = decided.filter("said is not null").select(*columns, F.col("said").alias("verdict"))
    return plain.unionByName(others.filter(F.size("tokens") == 0).select(*columns, F.lit(DEFAULT).alias("verdict"))).unionByName(judged)
