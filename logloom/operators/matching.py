"""H1-H3: template match predicate, catalog matching, matched/unmatched split.

A template ``a <*> b`` becomes ``^a\\ (.*?)\\ b$`` (literal parts escaped,
lazy groups).  A match is rejected when a captured token is a vocabulary word
that is alphabetic or one of ``, . ; :``.  Candidates come from equi-joins only, by
what every match must hold:

* a template without ``<*>`` is the content itself;
* a whole literal token of a template is a whole token of the content;
* a literal part of a token is a part of a content token, at its start or end
  if it is there in the template; runs of GRAM characters of it are the keys;
* a template of wildcards and spaces alone takes every content with as many
  spaces that holds no vocabulary word.

Of the keys of a template the rarest among the contents is taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.masking import WILDCARD, WS_CLASS
from .tokens import VOCAB_PUNCT

_ESCAPE = r"regexp_replace(p, '([\\\\.^$|?*+()\\[\\]{}])', '\\\\$1')"


def template_regex(template: Column | str) -> Column:
    """H1 pattern: escaped literal parts joined by ``(.*?)``, anchored."""
    t = template if isinstance(template, str) else None
    col = F.col(t) if t else template
    parts = F.split(col, r"<\*>", -1)
    return F.concat(F.lit("^"), F.array_join(F.transform(parts, lambda p: F.regexp_replace(
        p, r"([\\.^$|?*+()\[\]{}])", r"\\$1")), "(.*?)"), F.lit("$"))


def n_wild(template: Column) -> Column:
    return F.size(F.split(template, r"<\*>", -1)) - 1


def captures(content: str, pattern: str, k: str) -> Column:
    """The k captured groups of the first (leftmost, lazy) assignment.

    Arguments are SQL expressions; the pattern is a column, compiled by the
    JVM once per distinct value it sees in a row sequence.
    """
    return F.expr(f"CASE WHEN {k} > 0 THEN transform(sequence(1, {k}), i -> regexp_extract({content}, {pattern}, i)) "
                  f"ELSE CAST(array() AS array<string>) END")


def normalized(content: Column | str) -> Column:
    """The content as H1 reads it: runs of white space are one space, none at the ends."""
    return F.regexp_replace(F.regexp_replace(content, WS_CLASS + "+", " "), r"^ | $", "")


def _guarded(token: Column) -> Column:
    """Tokens that a wildcard may not take when they are vocabulary words."""
    return (token != "") & (token.rlike(r"(?U)^\p{L}+$") | token.isin(VOCAB_PUNCT))


def template_match(pairs: DataFrame, vocab: DataFrame, content_col="content", template_col="template",
                   id_cols=("content", "template")) -> DataFrame:
    """H1 over a pair table; returns the pairs that match."""
    ids = list(id_cols)
    p = (pairs.withColumn("_norm", normalized(content_col))
         .withColumn("_pat", template_regex(F.col(template_col)))
         .where(F.expr("_norm RLIKE _pat"))
         .withColumn("_k", n_wild(F.col(template_col)))).checkpoint()  # read twice; holds only what matches
    caps = (p.select(*ids, F.explode(F.flatten(F.transform(
        captures("_norm", "_pat", "_k"),
        lambda v: F.split(v, WS_CLASS + "+")))).alias("tok"))
        .where(_guarded(F.col("tok"))))
    bad = caps.join(vocab.withColumnRenamed("token", "tok"), "tok").select(*ids).distinct()
    return p.join(bad, ids, "left_anti").drop("_norm", "_pat", "_k")


GRAM = 4  # characters of a key from a part of a token, its marked ends included
START, END = "\x02", "\x03"  # ends of a token inside keys
OPEN_RE = r"^<\*>( ?<\*>)*$"  # wildcards and single spaces alone


def _grams(text: Column, size: Column) -> Column:
    """All runs of ``size`` characters of ``text``."""
    return F.when(F.length(text) >= size, F.transform(
        F.sequence(F.lit(1), F.length(text) - size + 1), lambda i: text.substr(i, size))).otherwise(F.array().cast("array<string>"))


def words(text: Column) -> Column:
    return F.filter(F.split(text, " "), lambda x: x != "")


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _template_keys(wild: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Templates once per key (``anchor``): their whole literal tokens, and the
    parts of tokens of those that have no whole one."""
    marked = F.transform(words(F.col("template")), lambda t: F.concat(F.lit(START), t, F.lit(END)))
    parts = F.filter(F.flatten(F.transform(marked, lambda t: F.split(t, r"<\*>", -1))), lambda p: ~p.isin("", START, END))
    t = wild.withColumn("parts", parts).withColumn("whole", F.filter("parts", lambda p: p.startswith(START) & p.endswith(END)))
    grams = F.flatten(F.transform("parts", lambda p: _grams(p, F.least(F.length(p), F.lit(GRAM)))))
    by_token = t.withColumn("anchor", F.explode(F.array_distinct("whole")))
    by_part = t.where(F.size("whole") == 0).withColumn("anchor", F.explode(F.array_distinct(grams)))
    return by_token.drop("parts", "whole"), by_part.drop("parts", "whole")


def _rarest(keys: DataFrame, held: DataFrame) -> DataFrame:
    """Every template with the one key that the fewest contents hold; none if a key is in no content."""
    freq = held.groupBy("anchor").agg(F.count(F.lit(1)).alias("held"))
    return (keys.join(freq, "anchor", "left")
            .groupBy(*[c for c in keys.columns if c != "anchor"])
            .agg(F.min(F.struct(F.coalesce("held", F.lit(0)).alias("held"), "anchor")).alias("k"))
            .where("k.held > 0").withColumn("anchor", F.col("k.anchor")).drop("k"))


def without_words(contents: DataFrame, vocab: DataFrame) -> DataFrame:
    """Contents without a vocabulary word that wildcards may not take."""
    toks = (contents.select("canon", F.explode(F.split(normalized("canon"), " ")).alias("token"))
            .where(_guarded(F.col("token"))))
    return contents.join(toks.join(vocab.select("token"), "token").select("canon").distinct(), "canon", "left_anti")


def candidates(contents: DataFrame, catalog: DataFrame, vocab: DataFrame | None = None, gaps=None,
               open_templates: bool = True) -> DataFrame:
    """Pairs (canon, catalog row) that may match, without losing one that does.

    With ``gaps`` only contents whose number of words differs from that of the
    template by one of them.  With ``vocab`` templates of wildcards alone meet
    only contents that they match.
    """
    cols = ["canon", *catalog.columns]
    fits = [] if gaps is None else ["c_words"]

    def near(t):
        return t if gaps is None else t.withColumn("c_words", F.explode(F.array(*[F.col("t_words") + g for g in gaps])))

    t = catalog.withColumn("t_words", F.size(words(F.col("template"))))
    c = contents.select("canon", normalized("canon").alias("norm"), F.size(words(F.col("canon"))).alias("c_words"))
    fixed = near(t.where(F.instr("template", WILDCARD) == 0)).withColumn("norm", F.col("template"))
    pairs = c.join(fixed, ["norm", *fits]).select(*cols)

    by_token, by_part = _template_keys(t.where(F.instr("template", WILDCARD) > 0))
    marked = F.transform(F.split("norm", " "), lambda x: F.concat(F.lit(START), x, F.lit(END)))
    in_words = c.select("canon", "c_words", F.size(F.split("norm", " ")).alias("n_words"), F.array_distinct(marked).alias("marked"))
    kinds = [(by_token, in_words.withColumn("anchor", F.explode("marked")))]
    sizes = [r[0] for r in by_part.select(F.length("anchor")).distinct().collect()]  # at most GRAM numbers
    if sizes:
        grams = F.flatten(F.transform("marked", lambda x: F.flatten(F.array(*[_grams(x, F.lit(n)) for n in sorted(sizes)]))))
        kinds.append((by_part, in_words.withColumn("anchor", F.explode(F.array_distinct(grams)))
                      .join(by_part.select("anchor").distinct(), "anchor", "left_semi")))
    for keys, held in kinds:
        meets = held.join(near(_rarest(keys, held)), ["anchor", *fits])
        pairs = pairs.unionByName(meets.where("n_words >= t_words").select(*cols))
    if not open_templates:
        return pairs

    free = near(t.where(F.col("template").rlike(OPEN_RE)))
    if free.isEmpty():
        return pairs
    some = c if vocab is None else without_words(c, vocab)
    if gaps is None:
        top = F.lit(c.agg(F.coalesce(F.max(_spaces(F.col("norm"))), F.lit(-1))).first()[0])
        free = (free.withColumn("spaces", _spaces(F.col("template"))).where(F.col("spaces") <= top)
                .withColumn("spaces", F.explode(F.sequence("spaces", top))))
        some = some.withColumn("spaces", _spaces(F.col("norm")))
        fits = ["spaces"]
    return pairs.unionByName(some.join(free, fits).select(*cols))


def _rank() -> Column:
    """Catalog order: lines, then the first line, then the key; the least is taken."""
    return F.struct((-F.col("n_lines")).alias("n"), "first_line", "template_key", "template")


def _match_open(contents: DataFrame, catalog: DataFrame, vocab: DataFrame) -> DataFrame:
    """The first template of wildcards alone for each content: one row a number
    of spaces, that of the best template with as many spaces or fewer."""
    free = catalog.where(F.col("template").rlike(OPEN_RE)).withColumn("spaces", _spaces(F.col("template")))
    most = free.agg(F.max("spaces")).first()[0]
    best = (free.withColumn("spaces", F.explode(F.sequence("spaces", F.lit(most))))
            .groupBy("spaces").agg(F.min(_rank()).alias("best")))
    return (without_words(contents.select("canon"), vocab)
            .withColumn("spaces", F.least(_spaces(normalized("canon")), F.lit(most))).join(best, "spaces").select("canon", "best"))


def match_catalog(contents: DataFrame, catalog: DataFrame, vocab: DataFrame) -> DataFrame:
    """H2: for each content, the first matching template in descending size,
    ties by first line (insertion order).  contents(canon, tokens),
    catalog(template_key, template, n_lines, first_line)."""
    # used several times below: materialise it once
    catalog = catalog.select("template_key", "template", "n_lines", "first_line").checkpoint()
    cand = candidates(contents, catalog, open_templates=False)
    m = template_match(cand, vocab, content_col="canon", id_cols=("canon", "template_key")).select("canon", _rank().alias("best"))
    if not catalog.where(F.col("template").rlike(OPEN_RE)).isEmpty():
        m = m.unionByName(_match_open(contents, catalog, vocab))
    return (m.groupBy("canon").agg(F.min("best").alias("best"))
            .select("canon", "best.template_key", "best.template"))


def unmatched(contents: DataFrame, matches: DataFrame) -> DataFrame:
    """H3: contents no catalog template answers."""
    return contents.join(matches.select("canon"), "canon", "left_anti")
