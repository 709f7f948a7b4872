"""Quality rules whose cutoffs carry a bound on false rejection.

Every rule is a ratio computed from a text; a document is rejected when a ratio
exceeds the cutoff of its stratum (language). Cutoffs are chosen on labelled
documents only. For each stratum, rule and candidate cutoff the exact binomial
tail gives the probability of seeing so few good documents rejected if the true
rate were the rule's share of the permitted one. A cutoff may be used only if
that probability is below the significance level divided by the number of all
tests (Bonferroni over strata, rules and candidates), and the strictest such
cutoff is taken. Strata without enough labels get no cutoff and reject nothing.
The pipeline's stage tests nested cutoffs and the rules' combined rejection
instead, which takes far fewer labels (``certified_paths``); the query keeps the
tests its SQL states. All of it is DataFrame operations; counts per stratum, rule and candidate are
the only rows that leave the documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, WS, packed_row, written

#: A good document of any stratum is rejected with at most this probability ...
FALSE_REJECTION = 0.02
#: ... with this probability that the statement fails for any stratum.
SIGNIFICANCE = 0.05
# Candidate cutoffs, in hundredths, per rule.
CANDIDATES = (10, 25, 50, 75)
RULES = ("symbols", "shouts", "capitals", "dup_lines")
#: Stratum of a null language.
NO_LANGUAGE = ""


def repeated_words(words: Column, window: int = 5) -> Column:
    """Words inside windows that occur twice or more in the same array.

    Windows are compared by 64-bit hash. Only arrays with an equal pair go on:
    (hash, start) pairs are sorted, equal neighbours give the starts, and the
    starts' gaps give the words covered, so the work is n log n for any text.
    """
    n = F.size(words) - (window - 1)
    starts = F.sequence(F.lit(0), n - 1)
    at = lambda p: F.xxhash64(*[F.get(words, p + i) for i in range(window)])
    hashes = F.transform(starts, at)
    pairs = F.array_sort(F.transform(starts, lambda p: F.struct(at(p).alias("h"), p.alias("p"))))

    def covered(sorted_pairs: Column) -> Column:
        near = F.filter(
            F.transform(
                sorted_pairs,
                lambda x, i: F.when(
                    F.coalesce(x["h"] == F.get(sorted_pairs, i + 1)["h"], F.lit(False))
                    | F.coalesce(x["h"] == F.get(sorted_pairs, i - 1)["h"], F.lit(False)),
                    x["p"],
                ),
            ),
            lambda p: p.isNotNull(),
        )
        return F.aggregate(
            F.array_sort(near),
            F.struct(F.lit(0).cast("long").alias("sum"), F.lit(-window).alias("last")),
            lambda s, p: F.struct(
                (s["sum"] + F.least(F.lit(window), p - s["last"])).alias("sum"), p.cast("int").alias("last")
            ),
            lambda s: s["sum"],
        )

    some = F.size(F.array_distinct(hashes)) < n
    # transform over a one-element array binds the sorted pairs once.
    whole = F.get(F.transform(F.array(pairs), covered), F.lit(0))
    return F.when(n < 2, F.lit(0).cast("long")).when(some, whole).otherwise(F.lit(0).cast("long"))


def text_statistics(docs: DataFrame, carry: bool = False) -> DataFrame:
    """The counts of every row's whole text; a null text has no words.

    With ``carry`` each row keeps all of its columns in the struct ``row``.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANGUAGE)).alias("stratum"),
        text.alias("text"),
        F.filter(F.split(text, WS + "+"), lambda w: w != "").alias("words"),
        *([packed_row(docs)] if carry else []),
    )
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD))
    gone = lambda chars: F.length("text") - F.length(F.translate("text", chars, ""))
    return rows.select(
        "doc_id",
        "stratum",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.regexp_replace("text", WS + "+", "")).cast("long").alias("word_chars"),
        gone("#*$%&|<>").cast("long").alias("n_symbols"),
        gone("!").cast("long").alias("n_shouts"),
        F.length(F.regexp_replace("text", "[^A-Z]+", "")).cast("long").alias("n_capitals"),
        F.size(lines).cast("long").alias("n_lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        *(["row"] if carry else []),
    )


def rule_values() -> dict[str, Column]:
    """Each rule's ratio in hundredths; 0 for a text without words."""
    ratio = lambda a, b: F.coalesce(F.try_divide(F.lit(100.0) * F.col(a), F.col(b)), F.lit(0.0))
    return {
        "symbols": ratio("n_symbols", "n_words"),
        "shouts": ratio("n_shouts", "n_words"),
        "capitals": ratio("n_capitals", "word_chars"),
        "dup_lines": ratio("n_dup_lines", "n_lines"),
    }


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X binomial(n, p), summed exactly term by term in logarithms."""
    first = n * F.log(F.lit(1.0 - p))
    return F.aggregate(
        F.sequence(F.lit(0).cast("long"), k),
        F.struct(first.alias("t"), F.lit(0.0).alias("s")),
        lambda a, i: F.struct(
            (a["t"] + F.log(F.greatest(F.lit(0.0), n - i) / (i + 1.0)) + F.log(F.lit(p / (1.0 - p)))).alias("t"),
            (a["s"] + F.exp(a["t"])).alias("s"),
        ),
        lambda a: F.least(F.lit(1.0), a["s"]),
    )


def cutoffs(statistics: DataFrame, labels: DataFrame) -> DataFrame:
    """Strictest certified cutoff per stratum and rule (``stratum``, ``rule``, ``cutoff``).

    The holdout is every labelled document with quality 1 that passes the base
    rule. Labels repeated for one id count once per distinct quality; labels
    with a null id or quality and labels of unknown documents are ignored.
    """
    good = (
        labels.select(F.col("doc_id").cast("long").alias("labelled"), F.col("quality").cast("int").alias("quality"))
        .filter("labelled IS NOT NULL AND quality = 1")
        .distinct()
    )
    held = statistics.filter(~base_failed()).join(good, F.col("doc_id") == F.col("labelled"))
    rules = F.array(*[F.struct(F.lit(k).alias("rule"), v.alias("value")) for k, v in rule_values().items()])
    counts = (
        held.select("stratum", F.explode(rules).alias("r"))
        .groupBy("stratum", F.col("r.rule").alias("rule"))
        .agg(F.count("*").alias("n"), *[F.count_if(F.col("r.value") > c).alias(f"over_{c}") for c in CANDIDATES])
    )
    tested = counts.select(
        "stratum",
        "rule",
        "n",
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("cutoff"), F.col(f"over_{c}").alias("k")) for c in CANDIDATES])
        ).alias("c"),
    ).select("stratum", "rule", "n", "c.cutoff", "c.k")
    strata = F.max(F.dense_rank().over(Window.orderBy("stratum"))).over(Window.partitionBy(F.lit(0)))
    tested = tested.withColumn("tests", strata * len(RULES) * len(CANDIDATES))
    share = FALSE_REJECTION / len(RULES)
    # Beyond the expected count the tail is near a half or more: no need to sum it.
    tail = F.when(F.col("k") > F.col("n") * share, F.lit(1.0)).otherwise(binomial_tail(F.col("k"), F.col("n"), share))
    passed = tested.filter(tail <= F.lit(SIGNIFICANCE) / F.col("tests"))
    return passed.groupBy("stratum", "rule").agg(F.min("cutoff").alias("cutoff"))


def base_failed() -> Column:
    """The fixed rule: fewer than 10 words, or over 20 % of them in repeated windows."""
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def judged(statistics: DataFrame, labels: DataFrame) -> DataFrame:
    """``statistics`` with ``base_failed`` and ``kept``."""
    found = written(
        cutoffs(statistics, labels)
        .groupBy("stratum")
        .agg(*[F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"cut_{r}") for r in RULES]),
        "cutoffs",
    ).withColumnRenamed("stratum", "of")
    rows = statistics.join(found, F.col("stratum") == F.col("of"), "left")
    bad = [F.coalesce(v > F.col(f"cut_{k}"), F.lit(False)) for k, v in rule_values().items()]
    rejected = bad[0] | bad[1] | bad[2] | bad[3]
    return rows.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~rejected)


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts, ``base_failed`` and ``kept`` of every row of ``docs``.

    Null and empty texts have no words and fail the base rule; a null language
    is a stratum of its own; repeated rows and ids are judged one by one; an
    empty table gives no rows, empty labels give no cutoffs. Only ``doc_id``,
    ``text`` and ``lang`` are read.
    """
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return judged(written(text_statistics(docs), "statistics"), labels).select(*columns)


def paths() -> list[list[tuple[str, int]]]:
    """Orders in which cutoffs are tightened one step (rule, cutoff) at a time.

    One path per rule takes that rule to its strictest cutoff and then the
    others; the last tightens all rules in turns.
    """
    loosest_first = sorted(CANDIDATES, reverse=True)
    turned = [RULES[i:] + RULES[:i] for i in range(len(RULES))]
    return [[(r, c) for r in rules for c in loosest_first] for rules in turned] + [[(r, c) for c in loosest_first for r in RULES]]


def first_steps() -> Column:
    """For every path the first step at which a row is rejected, or the path's length."""
    values = rule_values()
    return F.array(
        *[
            F.least(F.lit(len(path)), *[F.when(values[r] > c, i).otherwise(len(path)) for i, (r, c) in enumerate(path)])
            for path in paths()
        ]
    )


def certified_paths(statistics: DataFrame, labels: DataFrame) -> DataFrame:
    """``of`` (stratum), ``path``, ``depth``: the steps by which rows of the stratum may be rejected.

    Each step is tested for the combined rejection by all rules, at the whole
    permitted rate, and a path ends before its first failure (fixed sequence),
    so the level is only divided by strata and paths. Strata with too few
    labels for any step are pooled and tested together; the bound then holds
    for the pool. Of a stratum's certified paths, the one that rejects most
    rows is taken. Strata without a good label get none.
    """
    good = (
        labels.select(F.col("doc_id").cast("long").alias("labelled"), F.col("quality").cast("int").alias("quality"))
        .filter("labelled IS NOT NULL AND quality = 1")
        .distinct()
    )
    passed = statistics.filter(~base_failed()).select("doc_id", "stratum", first_steps().alias("steps"))
    held = written(passed.join(good, F.col("doc_id") == F.col("labelled")).select("stratum", "steps"), "held")
    sizes = held.groupBy("stratum").agg(F.count("*").alias("labels"))
    tests = F.count("*").over(Window.partitionBy(F.lit(0))) * len(paths())
    sizes = sizes.withColumn("level", F.lit(SIGNIFICANCE) / tests)
    few = F.col("labels") * F.log(F.lit(1.0 - FALSE_REJECTION)) > F.log("level")
    groups = written(sizes.select(F.col("stratum").alias("of"), F.when(~few, F.col("stratum")).alias("group"), "level"), "groups")

    steps = range(len(RULES) * len(CANDIDATES))
    counts = (
        held.join(groups, F.col("stratum") == F.col("of"))
        .select("group", "level", F.posexplode("steps").alias("path", "step"))
        .groupBy("group", "level", "path")
        .agg(F.count("*").alias("n"), F.array(*[F.count_if(F.col("step") <= i) for i in steps]).alias("over"))
        .select("group", "level", "path", "n", F.posexplode("over").alias("step", "k"))
    )
    n, k = F.col("n"), F.col("k")
    tail = F.when(k > n * FALSE_REJECTION, F.lit(1.0)).otherwise(binomial_tail(k, n, FALSE_REJECTION))
    certified = (
        counts.withColumn("failed", tail > F.col("level"))
        .groupBy(F.col("group").alias("tested"), "path")
        .agg(F.coalesce(F.min(F.when(F.col("failed"), F.col("step"))), F.lit(len(steps))).alias("depth"))
        .filter("depth > 0")
    )
    certified = written(groups.join(certified, F.col("group").eqNullSafe(F.col("tested"))).select("of", "group", "path", "depth"), "paths")
    rejected = (
        passed.join(certified, F.col("stratum") == F.col("of"))
        .groupBy("group", "path", "depth")
        .agg(F.count_if(F.get("steps", F.col("path")) < F.col("depth")).alias("rejected"))
        .groupBy("group")
        .agg(F.max(F.struct("rejected", (-F.col("path")).alias("turn"), "depth")).alias("best"))
        .select(F.col("group").alias("taken"), (-F.col("best.turn")).alias("path"), "best.depth")
    )
    return groups.join(rejected, F.col("group").eqNullSafe(F.col("taken"))).select("of", "path", "depth")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that neither the base rule nor a certified path rejects, with all their columns."""
    statistics = written(text_statistics(docs, carry=True), "statistics")
    found = written(certified_paths(statistics, labels), "cutoffs")
    rows = statistics.filter(~base_failed()).join(found, F.col("stratum") == F.col("of"), "left")
    rejected = F.coalesce(F.get(first_steps(), F.col("path")) < F.col("depth"), F.lit(False))
    return rows.filter(~rejected).select("row.*")


#: The same in DuckDB, with the binomial tail from lgamma.
ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t, row_number() OVER () AS u FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT u, p, list_slice(words, p, p + 4) AS gram FROM (SELECT u, words, unnest(range(1, len(words) - 3)) AS p FROM w)),
r AS (SELECT u, p FROM (SELECT u, p, count(*) OVER (PARTITION BY u, gram) AS c FROM g) WHERE c > 1),
v AS (SELECT u, count(DISTINCT p + i)::BIGINT AS n FROM r, (SELECT unnest(range(0, 5)) AS i) GROUP BY u),
s AS (SELECT doc_id, stratum, len(words)::BIGINT AS n_words,
        length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
        len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
        len(regexp_extract_all(t, '!'))::BIGINT AS n_shouts,
        len(regexp_extract_all(t, '[A-Z]'))::BIGINT AS n_capitals,
        len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
        coalesce(v.n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN v USING (u)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
        CASE WHEN n_words > 0 THEN 100.0::DOUBLE * n_symbols / n_words ELSE 0 END AS symbols,
        CASE WHEN n_words > 0 THEN 100.0::DOUBLE * n_shouts / n_words ELSE 0 END AS shouts,
        CASE WHEN word_chars > 0 THEN 100.0::DOUBLE * n_capitals / word_chars ELSE 0 END AS capitals,
        CASE WHEN n_lines > 0 THEN 100.0::DOUBLE * n_dup_lines / n_lines ELSE 0 END AS dup_lines FROM s),
h AS (SELECT f.* FROM f JOIN (SELECT DISTINCT doc_id FROM labels WHERE quality = 1) USING (doc_id) WHERE NOT base_failed),
o AS (SELECT stratum, rule, value FROM h UNPIVOT (value FOR rule IN (symbols, shouts, capitals, dup_lines))),
c AS (SELECT stratum, rule, cutoff, count(*) AS n, count(*) FILTER (value > cutoff) AS k
      FROM o, (SELECT unnest([10, 25, 50, 75]) AS cutoff) GROUP BY ALL),
p AS (SELECT stratum, rule, cutoff, n, k, (SELECT count(DISTINCT stratum) FROM c) * 16 AS tests,
        CASE WHEN k > n * 0.005::DOUBLE THEN 1.0 ELSE list_sum(list_transform(range(0, k + 1),
          lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.005::DOUBLE) + (n - i) * ln(0.995::DOUBLE)))) END AS tail FROM c),
q AS (SELECT stratum, rule, min(cutoff) AS cutoff FROM p WHERE tail <= 0.05::DOUBLE / tests GROUP BY ALL),
z AS (SELECT f.*, coalesce(symbols > (SELECT cutoff FROM q WHERE q.stratum = f.stratum AND rule = 'symbols'), false)
          OR coalesce(shouts > (SELECT cutoff FROM q WHERE q.stratum = f.stratum AND rule = 'shouts'), false)
          OR coalesce(capitals > (SELECT cutoff FROM q WHERE q.stratum = f.stratum AND rule = 'capitals'), false)
          OR coalesce(dup_lines > (SELECT cutoff FROM q WHERE q.stratum = f.stratum AND rule = 'dup_lines'), false) AS rejected FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT rejected AS kept FROM z
"""
