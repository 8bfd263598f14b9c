"""URL verdicts by rules, and by a character language-model ratio where no rule fits.

Rules name a host and the start of a path; they fit the host and all its subdomains, and the longest
rule that fits decides. The URLs that rules accept and reject train one smoothed variable-order Markov model
each. A model gives the probability of a character after the ``ORDER`` characters before it, interpolated
over all shorter contexts by how many different characters were seen after each (Witten-Bell):

    P_k(c | ctx) = (n(ctx c) + T(ctx) P_(k-1)(c | ctx without its first character)) / (N(ctx) + T(ctx))

down to a uniform distribution. A URL's score is the log-likelihood difference of the two models per
character of host and path. URLs of a fifth of the md5 space are left out of the counts; the threshold is the one with the
largest sum of accepted and rejected rates on those.

Only DataFrame functions are used. The models are tables with one row per distinct string of
``ORDER + 1`` characters, made order by order: every join there meets at most as many rows of a key as there are different
characters. Strings that most URLs contain are frequent keys in scoring; the weights are broadcast if they measure
small, otherwise their frequent part is. Logarithms are whole millionths, so sums do not depend on order.

Defined results: null URLs and URLs without ``://`` have an empty host and path, fit no rule and
score 0; without accepted or rejected URLs all scores are 0 and the threshold is 0, so they are allowed; repeated
rows get equal results; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.skew import left_join_by_frequency, table_bytes
from ..session import materialise

ORDER = 4
START = "\u0002"
ALPHABET = 256
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MOST_RULES = 1000
BIN = 10_000  # millionths of a nat per threshold candidate
BINS = 2000  # candidates on either side of 0

#: verdict, host, path
Rule = tuple[str, str, str]


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def best_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Struct ``(size, rule, verdict)`` of the longest rule that fits, else null."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    found = [F.lit(None).cast("struct<size: int, rule: string, verdict: string>")]
    for verdict, name, start in rules:
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(start)
        own = F.struct(
            F.lit(len(name) + len(start)).alias("size"), F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict")
        )
        found.append(F.when(fits, own))
    return F.array_max(F.array_compact(F.array(*found)))


def _strings(text: Column) -> Column:
    """All strings of ``ORDER + 1`` characters, each the end of a prefix of the text."""
    padded = F.concat(F.lit(START * ORDER), text)
    n = F.length(text)
    return F.when(
        n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.substr(padded, i, F.lit(ORDER + 1)))
    )


def _weights(strings: DataFrame) -> DataFrame:
    """``(string, n, weight)``: log P(accepted) - log P(rejected) of the last character, in millionths.

    ``strings(string, n, allow, block)`` are distinct, with how often they occur in all and in the training URLs.
    """
    known = None
    for k in range(ORDER + 1):
        string = F.right("string", F.lit(k + 1))
        own = strings.groupBy(string.alias("own")).agg(F.sum("allow").alias("allow"), F.sum("block").alias("block"))
        context = F.left("own", F.lit(k))
        facts = [
            *[F.coalesce(F.sum(c), F.lit(0)).alias(f"n_{c}") for c in ("allow", "block")],
            *[F.count_if(F.col(c) > 0).alias(f"t_{c}") for c in ("allow", "block")],
        ]
        if k == 0:
            total = own.agg(*facts).first().asDict()
            both = own.withColumns({name: F.lit(value) for name, value in total.items()})
            shorter = {c: F.lit(1.0 / ALPHABET) for c in ("allow", "block")}
        else:
            after = own.groupBy(context.alias("context")).agg(*facts)
            both = own.withColumn("context", context).join(after, "context").drop("context")
            both = both.withColumn("suffix", F.right("own", F.lit(k))).join(known, "suffix").drop("suffix")
            shorter = {c: F.col(f"p_{c}") for c in ("allow", "block")}
        p = {
            c: F.when(
                F.col(f"n_{c}") > 0,
                (F.col(c) + F.col(f"t_{c}") * shorter[c]) / (F.col(f"n_{c}") + F.col(f"t_{c}")),
            ).otherwise(shorter[c])
            for c in ("allow", "block")
        }
        known = both.select(F.col("own").alias("suffix"), *[p[c].alias(f"p_{c}") for c in p])
    ratio = F.round((F.log("p_allow") - F.log("p_block")) * 1e6).cast("long")
    return strings.join(known.withColumnRenamed("suffix", "string"), "string").select(
        "string", "n", ratio.alias("weight")
    )


def _threshold(scored: DataFrame) -> int:
    """Least score in bins that allows, from the URLs left out of training."""
    held = scored.filter("held AND rule_verdict IS NOT NULL")
    place = F.greatest(F.lit(-BINS), F.least(F.lit(BINS), F.floor(F.col("score") / BIN)))
    counts = held.groupBy(place.alias("bin")).agg(
        F.count_if(F.col("rule_verdict") == "allow").alias("allow"), F.count_if(F.col("rule_verdict") == "block").alias("block")
    )
    # At most 2 * BINS + 1 rows.
    rows = sorted((r["bin"], r["allow"], r["block"]) for r in counts.collect())
    allowed, blocked = sum(r[1] for r in rows), sum(r[2] for r in rows)
    if not allowed or not blocked:
        return 0
    best, threshold, below_allow, below_block = -1, 0, 0, 0
    for bin_, allow, block in rows:
        # Allow from this bin on; whole numbers, so that ties are ties.
        gain = (allowed - below_allow) * blocked + below_block * allowed
        if gain > best:
            best, threshold = gain, bin_
        below_allow, below_block = below_allow + allow, below_block + block
    return int(threshold)


def judge(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``(page, host, path, rule, verdict, score)`` per row; ``score`` is in nats per character."""
    host, path = host_and_path(F.col(url_col))
    rule = best_rule(F.col("host"), F.col("path"), rules)
    text = F.concat("host", "path")
    base = (
        pages.select(F.col(id_col).alias("page"), host.alias("host"), path.alias("path"))
        .withColumn("best", rule)
        .select(
            F.monotonically_increasing_id().alias("row"), "page", "host", "path",
            F.col("best.rule").alias("rule"), F.col("best.verdict").alias("rule_verdict"),
            text.alias("text"), F.substring(F.md5(text), 1, 1).isin("0", "1", "2").alias("held"),
        )
    )
    # The row numbers are read from a written table, so they can't change.
    base = materialise(base, "urls")
    spelled = base.withColumn("string", F.explode_outer(_strings(F.col("text"))))
    counted = spelled.filter("string IS NOT NULL").groupBy("string").agg(
        F.count("*").alias("n"),
        *[F.count_if(~F.col("held") & (F.col("rule_verdict") == c)).alias(c) for c in ("allow", "block")],
    )
    strings = materialise(counted, "url-strings")
    weights = materialise(_weights(strings), "url-weights")
    sums = strings.agg(F.sum("allow"), F.sum("block")).first()
    both_known = all(sums[i] for i in range(2))
    joined = left_join_by_frequency(spelled, weights, "string", "n", table_bytes(weights, 48, "string"), 48)
    names = ["row", "page", "host", "path", "rule", "rule_verdict", "held"]
    total = F.sum("weight") if both_known else F.lit(0)
    score = F.coalesce(F.round(F.try_divide(total, F.count("string"))).cast("long"), F.lit(0).cast("long"))
    scored = materialise(joined.groupBy(*names).agg(score.alias("score")), "url-scores")
    from_ = _threshold(scored)
    own = F.when(F.floor(F.col("score") / BIN) >= from_, "allow").otherwise("block")
    return scored.select(
        "page", "host", "path", "rule", F.coalesce("rule_verdict", own).alias("verdict"), (F.col("score") / 1e6).alias("score")
    )


def parsed_rules(lines: list[str]) -> list[Rule]:
    """Rules written as ``block example.com/de/``."""
    split = [line.split(" ", 1) for line in lines]
    return [(verdict, *_host_first(rest)) for verdict, rest in split]


def _host_first(rule: str) -> tuple[str, str]:
    host, slash, path = rule.partition("/")
    return host, slash + path
