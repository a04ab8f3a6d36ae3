"""Mergeable template pairs, positional merge, hub merging to a fixpoint.

Works on the template catalog, whose size is the number of templates.  Pairs
come from equi-joins, never from all pairs of a length group: equal length ->
equal texts once both are generalised by the wildcards of the other; unequal
length -> the candidates of catalog matching, with the number of tokens as part
of the key.  The fixpoint needs no pairs of equal length at all, only the best of each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.masking import WILDCARD
from ..session import checkpoint_dir
from .matching import candidates, template_match, words
from .reduction import merge_lists


def _with_tokens(catalog: DataFrame) -> DataFrame:
    """Tokens of every template and, per position, whether it is ``<*>``."""
    return (catalog.withColumn("tokens", words(F.col("template")))
            .withColumn("wild", F.transform("tokens", lambda x: x == WILDCARD))
            .withColumn("n_wild", F.size(F.filter("wild", lambda x: x))))


def generalized(t: DataFrame) -> DataFrame:
    """Every template once per wildcard pattern of its length: ``common`` is its
    text with ``<*>`` also where the ``other`` pattern has one.

    Two templates of one length agree wherever both have a literal exactly if
    their texts, each generalised by the pattern of the other, are equal: an
    equi-join whose matches are the mergeable pairs and nothing else.  With a
    column ``settled`` settled templates meet the patterns of the others only.
    """
    settled = F.col("settled") if "settled" in t.columns else F.lit(False)
    patterns = t.groupBy("wild").agg(F.min(settled).alias("old")).withColumn("len", F.size("wild"))
    others = patterns.select("len", F.col("wild").alias("other"), F.col("old").alias("other_old"))
    both = patterns.select("len", "wild").join(others, "len").select("wild", "other", "other_old")
    common = F.zip_with("tokens", "other", lambda x, w: F.when(w, F.lit(WILDCARD)).otherwise(x))
    return t.join(both, "wild").where(~settled | ~F.col("other_old")).withColumn("common", F.array_join(common, " "))


def _unequal_pairs(catalog: DataFrame, vocab: DataFrame) -> DataFrame:
    """Pairs (p_key, x_key): template p matches the text of x, which has one or two tokens more or fewer.

    Of settled templates only pairs with others.
    """
    def directed_pairs(texts, templates):
        return candidates(texts.select(F.col("template").alias("canon")), templates.select("template_key", "template"), vocab, gaps=(-2, -1, 1, 2))

    if "settled" in catalog.columns:
        new = catalog.where("NOT settled")
        directed = directed_pairs(catalog, new).unionByName(directed_pairs(new, catalog.where("settled")))
    else:
        directed = directed_pairs(catalog, catalog)
    matched = template_match(directed, vocab, content_col="canon", id_cols=("template_key", "canon"))
    return matched.select(F.col("template_key").alias("p_key"), F.md5("canon").alias("x_key"))


def mergeable_pairs(catalog: DataFrame, vocab: DataFrame) -> DataFrame:
    """Undirected pairs (a_key < b_key) that may merge; keys are md5 of the template."""
    catalog = catalog.select("template_key", "template").checkpoint()
    g = generalized(_with_tokens(catalog))
    a = g.select(F.col("template_key").alias("a_key"), "wild", "other", "common")
    b = g.select(F.col("template_key").alias("b_key"), F.col("other").alias("wild"), F.col("wild").alias("other"), "common")
    equal = a.join(b, ["wild", "other", "common"]).where("a_key < b_key").select("a_key", "b_key")
    unequal = _unequal_pairs(catalog, vocab).select(F.least("p_key", "x_key").alias("a_key"), F.greatest("p_key", "x_key").alias("b_key"))
    return equal.unionByName(unequal.distinct())


def _standing() -> F.Column:
    """Order of hubs: most ``<*>``, then most lines, then the smallest key; the least is taken."""
    return F.struct((-F.col("n_wild")).alias("w"), (-F.col("n_lines")).alias("n"), F.col("template_key").alias("key"))


def hubs(catalog: DataFrame, vocab: DataFrame) -> DataFrame:
    """The most general template (template_key, hub_key) that each may merge with, itself included.

    Templates of equal length never meet in pairs: the first of all that share
    a generalised text is an aggregate.
    """
    t = _with_tokens(catalog)
    g = generalized(t)
    first = (g.groupBy(F.col("other").alias("wild"), F.col("wild").alias("other"), "common")
             .agg(F.min(_standing()).alias("hub")))
    equal = g.select("template_key", "wild", "other", "common").join(first, ["wild", "other", "common"])
    u = _unequal_pairs(catalog, vocab).checkpoint()
    sides = u.select(F.col("p_key").alias("k"), F.col("x_key").alias("template_key")).unionByName(
        u.select(F.col("x_key").alias("k"), F.col("p_key").alias("template_key")))
    unequal = (sides.join(t.select("template_key", "n_wild", "n_lines"), "template_key")
               .select(F.col("k").alias("template_key"), _standing().alias("hub")))
    return (equal.select("template_key", "hub").unionByName(unequal)
            .unionByName(t.select("template_key", _standing().alias("hub")))
            .groupBy("template_key").agg(F.min("hub").alias("hub")).select("template_key", F.col("hub.key").alias("hub_key")))


def merge_round(catalog: DataFrame, hub: DataFrame) -> DataFrame:
    """One hub round: alias(old_template, new_template) for templates that merge.

    A template joins its hub if that template is its own hub.
    """
    t = catalog.select("template_key", "template")
    roots = hub.where(F.col("template_key") == F.col("hub_key")).select("hub_key")
    members = hub.join(roots, "hub_key")
    active = members.groupBy("hub_key").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("hub_key")
    grp = members.join(active, "hub_key").join(t, "template_key")
    tokens = F.filter(F.split("template", r"\s+"), lambda x: x != "")
    merged = merge_lists(grp.select(F.col("hub_key").alias("key"), tokens.alias("tokens"))).select(
        F.col("key").alias("hub_key"), F.array_join("tokens", " ").alias("new_template"))
    return grp.join(merged, "hub_key").select(F.col("template").alias("old_template"), "new_template")


def merge_templates(catalog: DataFrame, vocab: DataFrame) -> DataFrame:
    """Repeat hub rounds until no pair is left; returns the final alias
    map (old_template -> new_template) for every template that changed.

    There is no round limit: a round with pairs turns at least two templates
    into one, and a round that does not is an error.  A column ``settled`` may
    mark templates of which no two can merge (a catalog merged before): only
    pairs with others are looked for, and what comes out of a merge is not settled."""
    spark = catalog.sparkSession
    checkpoint_dir(spark)
    keep = [c for c in ("settled",) if c in catalog.columns and not catalog.where("settled").isEmpty()]
    cat = catalog.select("template", "n_lines", "first_line", *keep).withColumn("template_key", F.md5("template"))
    alias = None
    while True:
        if keep and cat.where("NOT settled").isEmpty():
            break
        hub = hubs(cat, vocab).checkpoint()
        if hub.where("template_key <> hub_key").isEmpty():
            break
        step = merge_round(cat, hub).checkpoint()
        if step.isEmpty():
            raise RuntimeError("mergeable templates are left, but none of them was merged")
        if alias is None:
            alias = step
        else:
            onward = step.select(F.col("old_template").alias("new_template"), F.col("new_template").alias("next"))
            first_time = step.join(alias.select("old_template"), "old_template", "left_anti")
            alias = (alias.join(onward, "new_template", "left")
                     .select("old_template", F.coalesce("next", "new_template").alias("new_template"))
                     .unionByName(first_time)).checkpoint()
        cat = (cat.join(step, cat["template"] == step["old_template"], "left")
               .select(F.coalesce("new_template", "template").alias("template"), "n_lines", "first_line",
                       *[(F.col(c) & F.col("new_template").isNull()).alias(c) for c in keep])
               .groupBy("template").agg(F.sum("n_lines").alias("n_lines"), F.min("first_line").alias("first_line"),
                                        *[F.min(c).alias(c) for c in keep])
               .withColumn("template_key", F.md5("template"))).checkpoint()
    if alias is None:
        return spark.createDataFrame([], "old_template string, new_template string")
    return alias.where(F.col("old_template") != F.col("new_template"))


def apply_alias(contents: DataFrame, alias: DataFrame) -> DataFrame:
    """Z3-style rewrite of an assignment table's template through the alias map."""
    return (contents.join(alias.withColumnRenamed("old_template", "template"), "template", "left")
            .withColumn("template", F.coalesce("new_template", "template")).drop("new_template"))


def positional_merge_pairs(pairs: DataFrame) -> DataFrame:
    """X2 over a pair table (a_template, b_template): merged text or NULL."""
    a = F.split("a_template", " ")
    b = F.split("b_template", " ")
    z = F.zip_with(a, b, lambda x, y: F.when(x == y, x).when((x == WILDCARD) | (y == WILDCARD), F.lit(WILDCARD)))
    ok = (F.size(a) == F.size(b)) & F.forall(z, lambda v: v.isNotNull())
    return pairs.withColumn("merged", F.when(ok, F.array_join(z, " ")))
