"""T9/T10 tokenize jobs, C0 vocabulary, C1-C7 token classes, G1 static keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.masking import WILDCARD
from ..functions.tokenizer import tokenize_expr
from ..session import written

# Tokens that always count as vocabulary words (the guard in the
# template-match test assumes these punctuation marks are words).
VOCAB_PUNCT = [",", ".", ";", ":"]
# Previous tokens after which a vocabulary word is not static.
NOT_AFTER = ["=", ":", "for", "user", "to"]
# Vocabulary words that are never static.
NEVER_STATIC = ["true", "false"]

SNAKE_RE = r"^[a-zA-Z]+(_[a-zA-Z]+)+$"
CAMEL_RE = r"^[a-zA-Z]+([A-Z][a-z0-9]+)+(\(\))?$"
CAMEL_PART_RE = r"[a-z]+|[A-Z][a-z0-9]*"
NON_UPPER_LETTER = r"[\p{Ll}\p{Lt}\p{Lm}\p{Lo}]"
SCOPED_RE = r"^[^:]+::[^:]+$"
LOWER_SNAKE_RE = r"^[a-z]+(_[a-z]+)+$"
PLAIN_CAMEL_RE = r"^[a-zA-Z]+([A-Z][a-z0-9]+)+$"


def tokenize(contents: DataFrame, content_col="content") -> DataFrame:
    """Add ``tokens`` and the canonical ``canon`` text (tokens joined by one space)."""
    return (contents.withColumn("tokens", tokenize_expr(content_col))
            .withColumn("canon", F.array_join("tokens", " ")))


def canonical_contents(distinct_masked: DataFrame) -> DataFrame:
    """Tokenize distinct masked contents and collapse again on the canonical text.

    Different masked texts can share one canonical form (e.g. ``a,b`` and
    ``a , b``); weights and line spans add up.
    """
    return collapse_canonical(tokenize(distinct_masked))


def collapse_canonical(tokenized: DataFrame) -> DataFrame:
    """One row per canonical text of a tokenized table of distinct contents."""
    return with_tokens(canonical_texts(tokenized))


def canonical_texts(tokenized: DataFrame) -> DataFrame:
    """The canonical texts with their weights and line spans, without the tokens."""
    return (tokenized.groupBy("canon")
            .agg(F.sum("n").cast("bigint").alias("n"), F.min("min_line").alias("min_line"), F.max("max_line").alias("max_line")))


def with_tokens(texts: DataFrame) -> DataFrame:
    """``tokens`` of canonical texts: the tokenizer leaves no blank in a token and no empty one."""
    tokens = F.when(F.col("canon") == "", F.array().cast("array<string>")).otherwise(F.split("canon", " "))
    return texts.select("canon", tokens.alias("tokens"), "n", "min_line", "max_line")


def token_table(contents: DataFrame, key_col="canon", keep=("n", "min_line")) -> DataFrame:
    """(content, pos, token) rows plus neighbours and length."""
    cols = [key_col, *keep]
    return (contents.select(*cols, F.posexplode("tokens").alias("pos", "token"), F.size("tokens").alias("len"),
                            "tokens")
            .withColumn("prev", F.expr("CASE WHEN pos > 0 THEN element_at(tokens, pos) END"))
            .withColumn("next", F.expr("CASE WHEN pos + 1 < len THEN element_at(tokens, pos + 2) END"))
            .withColumn("prev_wrap", F.expr("CASE WHEN pos = 0 THEN element_at(tokens, len) ELSE prev END"))
            .drop("tokens"))


def build_vocabulary(contents: DataFrame, min_df: int = 2) -> DataFrame:
    """Alphabetic tokens found in at least ``min_df`` lines, plus ``, . ; :``.

    Stands in for a word model used only as a membership set.  Distinct
    tokens per content first, then a weighted count: partial aggregation
    keeps a token seen in every line to one row per task.
    """
    words = (contents.select(F.explode(F.array_distinct("tokens")).alias("token"), "n")
             .where(F.col("token").rlike(r"(?U)^\p{L}+$"))
             .groupBy("token").agg(F.sum("n").alias("df"))
             .where(F.col("df") >= min_df).select("token"))
    punct = contents.sparkSession.createDataFrame([(p,) for p in VOCAB_PUNCT], "token string")
    return words.unionByName(punct).distinct()


def vocabulary_from_list(spark, words) -> DataFrame:
    return spark.createDataFrame([(w,) for w in sorted(set(words) | set(VOCAB_PUNCT))], "token string")


def materialize_vocab(vocab: DataFrame) -> DataFrame:
    """Checkpoint the distinct vocabulary once; it is joined several times."""
    return vocab.select("token").distinct().checkpoint()


def token_flags(tokens: DataFrame, vocab: DataFrame, token_col="token") -> DataFrame:
    """Per distinct token: ``is_vocab`` and ``camel_ok`` (C4 vocabulary part).

    Works on distinct tokens, so the vocabulary joins see each token once.
    """
    v = vocab.withColumn("is_vocab", F.lit(True))
    dt = tokens.select(F.col(token_col).alias("token")).distinct()
    flagged = dt.join(v, "token", "left").select("token", F.coalesce("is_vocab", F.lit(False)).alias("is_vocab"))
    camel = (dt.where(F.col("token").rlike(CAMEL_RE))
             .select("token", F.expr(f"regexp_extract_all(token, r'{CAMEL_PART_RE}', 0)").alias("parts")))
    camel_ok = (camel.where(F.size("parts") >= 2)
                .select("token", F.explode("parts").alias("part"))
                .where((F.length("part") > 1) & ~F.col("part").rlike(r"(?U)\p{Nd}"))
                .join(v.withColumnRenamed("token", "part"), "part")
                .select("token").distinct().withColumn("camel_ok", F.lit(True)))
    return (flagged.join(camel_ok, "token", "left")
            .withColumn("camel_ok", F.coalesce("camel_ok", F.lit(False))))


def all_capital(tok: Column) -> Column:
    """Not ``<*>``, no digit, and every letter upper case (true for pure punctuation)."""
    return (tok != WILDCARD) & ~tok.rlike(r"(?U)\p{Nd}") & ~tok.rlike(NON_UPPER_LETTER)


def static_flag(t: DataFrame) -> Column:
    """C1-C6 in the reference's precedence (first rule that applies wins)."""
    tok, pos, ln = F.col("token"), F.col("pos"), F.col("len")
    c1 = F.col("is_vocab") & ((pos == 0) | ~F.coalesce(F.col("prev").isin(NOT_AFTER), F.lit(False))) \
        & ~tok.isin(NEVER_STATIC)
    c2 = all_capital(tok)
    skip = ((pos > 0) & (pos < ln - 1) & F.col("prev").isin("=", ":") & (F.col("next") == ",")) | \
           ((pos == ln - 1) & (F.col("prev_wrap") == "="))
    c345 = ((pos == 0) & tok.rlike(SNAKE_RE)) | F.col("camel_ok") | tok.rlike(SCOPED_RE)
    c6 = (pos > 0) & (pos < ln - 1) & F.col("is_vocab") & F.coalesce(F.col("next").isin("=", ":"), F.lit(False))
    return F.when(c1, True).when(c2, ~skip).otherwise(c345 | c6)


def classified_tokens(contents: DataFrame, vocab: DataFrame, key_col="canon") -> DataFrame:
    """Token table with flags and the ``is_static`` decision."""
    tt = token_table(contents, key_col)
    flags = token_flags(tt, vocab)
    return tt.join(flags, "token", "left").withColumn("is_static", static_flag(tt))


def static_keys(contents: DataFrame, vocab: DataFrame, key_col="canon") -> DataFrame:
    """G1: ``pos||token`` of static tokens in order, ``<*>`` when none.

    A token row holds the 96-bit hash of its content, never its text, and the
    rows of a content are made, flagged and grouped back in the task that its
    tokens are sent to (as lines of one text: no token holds white space, T1),
    so nothing that grows with the square of a text's length is shuffled.
    Flags are those of vocabulary and camel tokens only, written once, so that
    the engine knows their size.
    """
    ids = [F.xxhash64(key_col).alias("_h1"), F.hash(key_col).alias("_h2")]
    every = contents.select(F.explode("tokens").alias("token"))
    flags = written(token_flags(every, vocab).where("is_vocab OR camel_ok"))
    sent = contents.where(F.size("tokens") > 0).select(*ids, F.array_join("tokens", "\n").alias("lines")).repartition("_h1", "_h2")
    tt = token_table(sent.withColumn("tokens", F.split("lines", "\n")), "_h1", keep=("_h2",)).join(flags, "token", "left")
    tt = tt.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("is_vocab", "camel_ok")})
    keys = (tt.where(static_flag(tt))
            .groupBy("_h1", "_h2")
            .agg(F.expr("array_join(transform(array_sort(collect_list(struct(pos, token))), "
                        "s -> concat(CAST(s.pos AS STRING), s.token)), '')").alias("static_key")))
    return (contents.withColumns(dict(zip(("_h1", "_h2"), ids))).join(keys, ["_h1", "_h2"], "left").drop("_h1", "_h2")
            .withColumn("static_key", F.coalesce("static_key", F.lit(WILDCARD))))


def identifier_tokens(contents: DataFrame, key_col="canon") -> DataFrame:
    """Lower snake_case or camelCase tokens (no vocabulary involved)."""
    tt = contents.select(key_col, F.posexplode("tokens").alias("pos", "token"))
    return tt.where(F.col("token").rlike(LOWER_SNAKE_RE) | F.col("token").rlike(PLAIN_CAMEL_RE))
