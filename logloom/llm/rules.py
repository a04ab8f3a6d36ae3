"""Quality rules with risk-controlled cutoffs (operator 1).

Built-in functions only.  Each rule rejects a document whose count reaches a
cutoff (percent of its words or lines).  Cutoffs come from fixed grids and are
chosen on labelled documents.  For each stratum and rule the cutoffs are tested
in a fixed sequence, from the one that rejects least to the strictest: the
exact binomial test must refute "more than ALPHA / rules of the good documents
of this stratum are lost", and the first failure ends the sequence.  The
sequences (rules x strata) share DELTA by Holm's steps: one whose tests all
pass hands its part on to the others.  So with probability 1 - DELTA every
stratum loses at most ALPHA of its good documents.  Of the allowed cutoffs the
one that rejects most bad documents is taken, of equal ones the largest.  A
stratum with too few labels gets none.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logloom.llm.common import durable, table

ALPHA, DELTA = 0.02, 0.05
WINDOW = 8
#: rule -> (count, base of the percentage, cutoffs in percent)
RULES = {"symbols": ("n_symbols", "n_words", (5, 10, 20, 30, 50, 100)),
         "bangs": ("n_bangs", "n_words", (5, 10, 20, 50, 100)),
         "repeats": ("n_repeat_words", "n_words", (5, 10, 20, 30)),
         "lines": ("n_dup_lines", "n_lines", (20, 30, 40, 50))}
SPACE = r"[\x20\x09-\x0D]+"


def _n(c) -> F.Column:
    return F.size(c).cast("long")


def _pairs(c: str, lag: int) -> F.Column:
    """Hashes of the elements ``lag`` apart."""
    n = F.greatest(F.size(c) - lag, F.lit(0))
    return F.zip_with(F.slice(c, 1, n), F.slice(c, F.lit(lag + 1), n), lambda a, b: F.xxhash64(a, b))


def _repeated_words(df: DataFrame) -> DataFrame:
    """Adds n_repeat_words: words in WINDOW-word windows that occur twice or more in the text.

    Windows are compared by 64-bit hashes; covered words are counted from the
    sorted starts of the repeated windows.  All steps are linear or n log n.
    """
    df = df.withColumn("h1", F.transform("words", lambda w: F.xxhash64(w)))
    df = df.withColumn("h2", _pairs("h1", 1))
    df = df.withColumn("h4", _pairs("h2", 2))
    df = df.withColumn("h8", _pairs("h4", 4))
    some = F.size(F.array_distinct("h8")) < F.size("h8")
    places = F.sequence(F.lit(0), F.size("h8") - 1)
    df = df.withColumn("s", F.when(some, F.sort_array(F.arrays_zip(F.col("h8").alias("h"), places.alias("i")))))
    m = F.size("s") - 1
    df = df.withColumn("same", F.when(F.col("s").isNotNull(), F.zip_with(
        F.slice("s", 1, m), F.slice("s", F.lit(2), m), lambda a, b: a["h"] == b["h"])))
    either = F.zip_with(F.concat(F.array(F.lit(False)), F.col("same")), F.concat(F.col("same"), F.array(F.lit(False))), lambda a, b: a | b)
    hit = F.filter(F.arrays_zip(F.col("s").alias("s"), either.alias("d")), lambda r: r["d"])
    df = df.withColumn("at", F.when(F.col("s").isNotNull(), F.sort_array(F.transform(hit, lambda r: r["s"]["i"]))))
    k = F.size("at") - 1
    gaps = F.zip_with(F.slice("at", 1, k), F.slice("at", F.lit(2), k), lambda a, b: F.least(b - a, F.lit(WINDOW)))
    covered = F.aggregate(gaps, F.lit(WINDOW).cast("long"), lambda a, g: a + g)
    return df.withColumn("n_repeat_words", F.when(F.col("at").isNotNull(), covered).otherwise(F.lit(0).cast("long")))


def features(docs: DataFrame, stratum: str = "lang") -> DataFrame:
    """Counts of every row of ``docs(doc_id, text, <stratum>, ...)``; null text has no words, a null stratum is ''."""
    group = F.coalesce(F.col(stratum).cast("string"), F.lit("")) if stratum in docs.columns else F.lit("")
    df = docs.select("doc_id", group.alias("stratum"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    df = df.withColumn("words", F.filter(F.split("text", SPACE), lambda w: w != ""))
    df = df.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    df = df.select("doc_id", "stratum", "words", _n("words").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
                   F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
                   (F.length("text") - F.length(F.replace("text", F.lit("!"), F.lit("")))).cast("long").alias("n_bangs"),
                   _n("lines").alias("n_lines"), (_n("lines") - _n(F.array_distinct("lines"))).alias("n_dup_lines"))
    names = ["doc_id", "stratum", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_bangs", "n_lines"]
    return _repeated_words(df).select(*names)


def _lgamma(x: F.Column) -> F.Column:
    """ln(gamma(x)) for x >= 1: Stirling's series at x + 8, taken back by eight steps."""
    z = x + 8
    series = 1 / (12 * z) - 1 / (360 * F.pow(z, 3)) + 1 / (1260 * F.pow(z, 5)) - 1 / (1680 * F.pow(z, 7))
    steps = reduce(lambda a, b: a + b, [F.log(x + i) for i in range(8)])
    return (z - 0.5) * F.log(z) - z + F.lit(0.9189385332046727) + series - steps


def binomial_p(k: F.Column, n: F.Column, share: float) -> F.Column:
    """P(Bin(n, share) <= k), exact up to rounding; 1 where k is not below the mean.

    Terms are added downwards from k; what is left after 40 standard deviations
    is bounded by a geometric series and added too, so the value is never low.
    """
    k, n = k.cast("double"), n.cast("double")
    first = F.exp(_lgamma(n + 1) - _lgamma(k + 1) - _lgamma(n - k + 1)
                  + k * F.log(F.lit(share)) + (n - k) * F.log(F.lit(1 - share)))
    steps = F.least(k, F.ceil(40 * F.sqrt(n * share)) + 100).cast("int")
    odds = (1 - share) / share
    state = F.aggregate(
        F.when(steps > 0, F.sequence(F.lit(1), steps)).otherwise(F.array().cast("array<int>")),
        F.struct(first.alias("term"), first.alias("total")),
        lambda a, j: F.struct((a["term"] * (k - j + 1) / (n - k + j) * odds).alias("term"),
                              (a["total"] + a["term"] * (k - j + 1) / (n - k + j) * odds).alias("total")))
    ratio = (k - steps) / (n - k + steps + 1) * odds
    tail = state["term"] * ratio / (1 - ratio)
    return F.when(k >= n * share, F.lit(1.0)).otherwise(F.least(F.lit(1.0), state["total"] + tail))


def cutoffs(feats: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """One row per stratum with labels: stratum and the chosen cutoff of each rule (null: none is allowed)."""
    marks = labels.where("quality IS NOT NULL").select("doc_id", F.col("quality").alias("q")).distinct()
    known = feats.join(marks, "doc_id").dropDuplicates()
    counts = [F.count_if(F.col("q") > 0).alias("n")]
    for rule, (count, base, grid) in RULES.items():
        for c in grid:
            hit = (F.col(base) > 0) & (100 * F.col(count) >= c * F.col(base))
            counts += [F.count_if(hit & (F.col("q") > 0)).alias(f"{rule}_{c}_good"), F.count_if(hit & (F.col("q") <= 0)).alias(f"{rule}_{c}_bad")]
    table_ = durable(known.groupBy("stratum").agg(*counts))
    tried = F.array(*[F.struct(F.lit(rule).alias("rule"), F.lit(c).alias("cutoff"), F.col(f"{rule}_{c}_good").alias("k"), F.col(f"{rule}_{c}_bad").alias("bad"))
                      for rule, (_, _, grid) in RULES.items() for c in grid])
    rows = table_.select("stratum", "n", F.explode(tried).alias("t")).select("stratum", "n", "t.*")
    one = Window.partitionBy("stratum", "rule")
    rows = rows.withColumn("p", F.max(binomial_p(F.col("k"), F.col("n"), alpha / len(RULES))).over(one.orderBy(F.desc("cutoff"))))
    # A few rows per stratum: the sequences in the order of their largest p; those before the first failing step pass whole.
    whole = rows.groupBy("stratum", "rule").agg(F.max("p").alias("p"))
    every = Window.partitionBy(F.lit(0))
    steps = whole.withColumn("m", F.count(F.lit(1)).over(every)).withColumn("j", F.row_number().over(every.orderBy("p", "stratum", "rule")))
    left = steps.groupBy().agg(F.coalesce(F.max(F.when(F.col("p") > delta / (F.col("m") - F.col("j") + 1), F.col("m") - F.col("j") + 1)), F.lit(1)).alias("left"))
    passed = rows.where((F.col("p") <= delta / left.first()["left"]) & (F.col("bad") > 0))
    best = lambda rule: F.max(F.when(F.col("rule") == rule, F.struct("bad", "cutoff")))["cutoff"]
    return passed.groupBy("stratum").agg(*[best(rule).alias(f"cut_{rule}") for rule in RULES])


def apply_rules(docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """Counts, base_failed and kept for every row of ``docs``.

    Null text has no words (and fails the base); labels may repeat; without
    labels, or in a stratum with too few, no cutoff is set and only the base
    decides.  Empty table: no rows.
    """
    feats = durable(features(docs, stratum))
    cuts = cutoffs(feats, labels, alpha, delta)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    hit = reduce(lambda a, b: a | b, [
        F.coalesce((F.col(base) > 0) & (100 * F.col(count) >= F.col(f"cut_{rule}") * F.col(base)), F.lit(False))
        for rule, (count, base, _) in RULES.items()])
    return feats.join(cuts, "stratum", "left").withColumn("base_failed", failed).withColumn("kept", ~failed & ~hit)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdicts of every row of documents."""
    out = apply_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _sql() -> str:
    tests = [(r, c) for r, (_, _, g) in RULES.items() for c in g]
    share = ALPHA / len(RULES)
    tried = " UNION ALL ".join(
        f"""SELECT stratum, '{r}' AS rule, {c} AS cutoff, count(*) FILTER (q > 0) AS n,
            count(*) FILTER (q > 0 AND {b} > 0 AND 100 * {n} >= {c} * {b}) AS k,
            count(*) FILTER (q <= 0 AND {b} > 0 AND 100 * {n} >= {c} * {b}) AS bad FROM known GROUP BY stratum"""
        for r, (n, b, g) in RULES.items() for c in g)
    pick = ", ".join(f"max(row(bad, cutoff)) FILTER (rule = '{r}') AS c_{r}" for r in RULES)
    hit = " OR ".join(f"coalesce({b} > 0 AND 100 * {n} >= c_{r}[2] * {b}, false)" for r, (n, b, _) in RULES.items())
    return rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS text FROM documents),
w AS MATERIALIZED (SELECT r, doc_id, stratum, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT r, i, array_to_string(words[i:i + 7], ' ') AS g FROM (SELECT r, words, unnest(range(1, len(words) - 6)) AS i FROM w)),
rep AS (SELECT r, count(DISTINCT p) AS n_rep FROM (SELECT r, unnest(range(i, i + 8)) AS p
  FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM g) WHERE c > 1) GROUP BY r),
f AS MATERIALIZED (SELECT w.r, doc_id, stratum, CAST(len(words) AS BIGINT) AS n_words,
  CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
  length(text) - length(replace(text, '!', '')) AS n_bangs, CAST(len(lines) AS BIGINT) AS n_lines,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(n_rep, 0) AS n_repeat_words
  FROM w LEFT JOIN rep USING (r)),
known AS MATERIALIZED (SELECT DISTINCT f.* EXCLUDE (r), q FROM f JOIN (SELECT DISTINCT doc_id, quality AS q FROM labels WHERE quality IS NOT NULL) USING (doc_id)),
tried AS ({tried}),
ps AS MATERIALIZED (SELECT *, max(CASE WHEN k >= n * {share} THEN 1 ELSE list_sum(list_transform(range(0, k + 1), lambda j:
  exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({share}) + (n - j) * ln(1 - {share})))) END)
  OVER (PARTITION BY stratum, rule ORDER BY cutoff DESC) AS p FROM tried),
steps AS (SELECT p, count(*) OVER () - row_number() OVER (ORDER BY p, stratum, rule) + 1 AS l FROM
  (SELECT stratum, rule, max(p) AS p FROM ps GROUP BY ALL)),
passed AS (SELECT * FROM ps WHERE bad > 0 AND p <= {DELTA} / (SELECT coalesce(max(l) FILTER (p > {DELTA} / l), 1) FROM steps)),
cuts AS (SELECT stratum, {pick} FROM passed GROUP BY stratum)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND NOT ({hit}) AS kept
FROM f LEFT JOIN cuts USING (stratum)
"""


OP1_SQL = _sql()
