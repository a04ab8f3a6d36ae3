"""Template induction per cluster as aggregations.

Input ``clusters``: (cluster_key, canon, tokens, n, min_line, max_line), one
row per distinct canonical content.  Every step aggregates on
(cluster, position[, token]) with partial aggregation, so a cluster holding
a third of all lines costs one row per (position, token) per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.masking import WILDCARD
from .reduction import align_lists
from .tokens import token_flags

ENTROPY_VARIABLE = 1.8  # fixed value: entropy above which a non-word column is a variable
QUEUE_SAMPLES = 5       # fixed value: samples sent to arbitration for a same-length cluster


def length_profile(clusters: DataFrame) -> DataFrame:
    """Per cluster, distinct contents, lines and token-count range."""
    return (clusters.groupBy("cluster_key")
            .agg(F.count(F.lit(1)).alias("n_contents"), F.sum("n").cast("bigint").alias("n_lines"),
                 F.min(F.size("tokens")).alias("min_len"), F.max(F.size("tokens")).alias("max_len"),
                 F.min("min_line").alias("first_line"))
            .withColumn("path", F.when(F.col("n_contents") == 1, "single")
                        .when(F.col("min_len") != F.col("max_len"), "mixed").otherwise("same")))


def position_entropy(clusters: DataFrame, vocab: DataFrame) -> DataFrame:
    """I3/I4 (+ inputs of I5): one row per (cluster, pos).

    ``has_wild``: some line has ``<*>`` here, so the column is all ``<*>``
    (I3).  ``entropy``: line-weighted Shannon entropy in bits after I3,
    computed as log2(T) - sum(c*log2 c)/T from per-token counts.
    ``tok0``/``prev0``: the first line's token here and one position left.
    """
    ptc = (clusters.select("cluster_key", F.posexplode("tokens").alias("pos", "token"), "n", "min_line")
           .groupBy("cluster_key", "pos", "token")
           .agg(F.sum("n").alias("cnt"), F.min("min_line").alias("first_seen")))
    flags = token_flags(ptc, vocab).select("token", "is_vocab")
    ptc = ptc.join(flags, "token", "left")
    col = (ptc.groupBy("cluster_key", "pos")
           .agg(F.count(F.lit(1)).alias("n_tok"), F.max(F.col("token") == WILDCARD).alias("has_wild"),
                F.sum("cnt").alias("tot"), F.sum(F.col("cnt") * F.log2("cnt")).alias("slog"),
                F.max(~F.col("is_vocab")).alias("any_nonvocab"),
                F.min_by("token", "first_seen").alias("tok0"), F.min_by("is_vocab", "first_seen").alias("tok0_vocab")))
    w = Window.partitionBy("cluster_key").orderBy("pos")
    return (col.withColumn("prev0", F.lag("tok0").over(w))
            .withColumn("entropy", F.when(F.col("has_wild") | (F.col("n_tok") == 1), F.lit(0.0))
                        .otherwise(F.log2("tot") - F.col("slog") / F.col("tot"))))


def position_decision(pos_stats: DataFrame, profile: str = "default") -> DataFrame:
    """I5 (default) or I13 (``profile='alt'``): token, ``<*>`` or NULL (undecided)."""
    pos, ent = F.col("pos"), F.col("entropy")
    if profile == "alt":
        dec = (F.when(F.col("has_wild"), F.lit(WILDCARD))
               .when(F.col("tok0_vocab") & (ent <= 1), F.col("tok0"))
               .when(~F.col("tok0_vocab") & (ent >= 3), F.lit(WILDCARD)))
    else:
        dec = (F.when(F.col("has_wild"), F.lit(WILDCARD))
               .when(F.col("n_tok") == 1, F.col("tok0"))
               .when(F.col("any_nonvocab") & (pos != 0) & (ent > ENTROPY_VARIABLE), F.lit(WILDCARD))
               .when((pos > 0) & F.col("tok0_vocab") & (F.col("prev0") == "="), F.lit(WILDCARD)))
    return pos_stats.withColumn("decision", dec)


def assemble(decisions: DataFrame) -> DataFrame:
    """Per cluster, the template when every position is decided, and the
    wildcard positions (I3) needed by the fallback."""
    return (decisions.groupBy("cluster_key")
            .agg(F.min(F.col("decision").isNotNull()).alias("all_decided"),
                 F.expr("array_join(transform(array_sort(collect_list(struct(pos, decision))), "
                        "x -> x.decision), ' ')").alias("template"),
                 F.collect_list(F.when(F.col("has_wild"), F.col("pos"))).alias("wild_pos")))


def wildcarded(clusters_with_wild: DataFrame) -> DataFrame:
    """Contents with the I3 wildcard columns applied (no run collapse)."""
    return clusters_with_wild.withColumn(
        "wcontent", F.expr("array_join(transform(tokens, (t, i) -> CASE WHEN array_contains(wild_pos, i) "
                           "THEN '<*>' ELSE t END), ' ')"))


def _first_of_length(clusters: DataFrame, col: str) -> DataFrame:
    """(cluster_key, len, min_line, col) of the first content of each length: a partial aggregate, no window."""
    return (clusters.groupBy("cluster_key", "len")
            .agg(F.min("min_line").alias("min_line"), F.min_by(col, F.struct("min_line", "tokens")).alias(col)))


def arbitration_queue(clusters: DataFrame, vocab: DataFrame) -> DataFrame:
    """I8: what an arbiter would be asked.

    Same-length undecided clusters: up to five distinct wildcarded contents
    in first-seen order (mode 1).  Mixed-length clusters: the first content
    of each length (mode 2).  Ranked filters, so no group is collected whole.
    """
    prof = length_profile(clusters)
    same = clusters.join(prof.where("path = 'same'").select("cluster_key"), "cluster_key", "left_semi")
    dec = assemble(position_decision(position_entropy(same, vocab))).where("NOT all_decided")
    wc = wildcarded(same.join(dec.select("cluster_key", "wild_pos"), "cluster_key"))
    w1 = (wc.groupBy("cluster_key", "wcontent").agg(F.min("min_line").alias("first_seen"))
          .withColumn("rank", F.row_number().over(Window.partitionBy("cluster_key").orderBy("first_seen", "wcontent")))
          .where(F.col("rank") <= QUEUE_SAMPLES)
          .select("cluster_key", F.lit(1).alias("mode"), "rank", F.col("wcontent").alias("sample")))
    mixed = clusters.join(prof.where("path = 'mixed'").select("cluster_key"), "cluster_key", "left_semi")
    w2 = (_first_of_length(mixed.withColumn("len", F.size("tokens")), "canon")
          .withColumn("rank", F.row_number().over(Window.partitionBy("cluster_key").orderBy("len")))
          .select("cluster_key", F.lit(2).alias("mode"), "rank", F.col("canon").alias("sample")))
    return w1.unionByName(w2)


def open_questions(clusters: DataFrame, vocab: DataFrame, decisions: DataFrame | None = None) -> DataFrame:
    """I8 without the clusters that have an answer, an empty one included."""
    queue = arbitration_queue(clusters, vocab).select("cluster_key", "mode", F.col("rank").cast("bigint").alias("rank"), "sample")
    return queue if decisions is None else queue.join(decisions.select("cluster_key"), "cluster_key", "left_anti")


def last_object(text) -> F.Column:
    """The last balanced top-level ``{...}`` of a text, NULL when there is none.

    One pass over the characters: a brace opens an object at depth 0, the one
    that takes the depth back to 0 ends it; closing braces outside are ignored.
    """
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("i"), F.lit(0).alias("open"), F.lit(0).alias("first"), F.lit(0).alias("last"))

    def step(s, ch):
        opens, closes = ch == "{", (ch == "}") & (s["depth"] > 0)
        ends = closes & (s["depth"] == 1)
        return F.struct(
            F.when(opens, s["depth"] + 1).when(closes, s["depth"] - 1).otherwise(s["depth"]).alias("depth"),
            (s["i"] + 1).alias("i"),
            F.when(opens & (s["depth"] == 0), s["i"] + 1).otherwise(s["open"]).alias("open"),
            F.when(ends, s["open"]).otherwise(s["first"]).alias("first"),
            F.when(ends, s["i"] + 1).otherwise(s["last"]).alias("last"))

    found = F.aggregate(F.split(text, ""), start, step, lambda s: F.struct(s["first"].alias("first"), s["last"].alias("last")))
    return F.when(found["first"] > 0, F.substring(text, found["first"], found["last"] - found["first"] + 1))


def read_decisions(answers: DataFrame, key_col="cluster_key", text_col="answer") -> DataFrame:
    """Last balanced object of an answer, its ``template`` field ('' when there is none)."""
    tmpl = F.get_json_object(last_object(F.col(text_col)), "$.template")
    return answers.select(key_col, F.coalesce(tmpl, F.lit("")).alias("template"))


def align_templates(mixed_clusters: DataFrame) -> DataFrame:
    """Per mixed-length cluster, align the first content of each length, from the shortest on.

    A few neighbours are folded at a time, so a cluster's lengths are spread over tasks.
    """
    samples = _first_of_length(mixed_clusters.withColumn("len", F.size("tokens")), "tokens")
    slot = F.row_number().over(Window.partitionBy("cluster_key").orderBy("len", "min_line")) - 1
    aligned = align_lists(samples.select(F.col("cluster_key").alias("key"), slot.alias("slot"), "tokens"))
    return aligned.select(F.col("key").alias("cluster_key"), F.array_join("tokens", " ").alias("template"))


def unique_fallback(clusters: DataFrame, content_col="canon") -> DataFrame:
    """Each distinct content is its own template."""
    return clusters.select("cluster_key", "canon", F.col(content_col).alias("template"))


def single_content(clusters: DataFrame, profile: DataFrame | None = None) -> DataFrame:
    """The content of a cluster that has one is its template."""
    prof = length_profile(clusters) if profile is None else profile
    return unique_fallback(clusters.join(prof.where("path = 'single'").select("cluster_key"), "cluster_key"))


def frequency_split(clusters: DataFrame) -> DataFrame:
    """Split a cluster by content when its top content's share >= 1/types."""
    size = clusters.groupBy("cluster_key").agg(F.count(F.lit(1)).alias("types"), F.sum("n").alias("tot"), F.max("n").alias("top"))
    split = size.where(F.col("top") * F.col("types") >= F.col("tot")).select("cluster_key")
    return unique_fallback(clusters.join(split, "cluster_key"))


def induce(clusters: DataFrame, vocab: DataFrame, decisions: DataFrame | None = None) -> DataFrame:
    """I1-I11 composed: (cluster_key, canon) -> template for every content."""
    prof = length_profile(clusters).select("cluster_key", "path")
    c = clusters.join(prof, "cluster_key")
    single = unique_fallback(c.where("path = 'single'"))

    same = c.where("path = 'same'")
    asm = assemble(position_decision(position_entropy(same, vocab)))
    same_j = same.join(asm, "cluster_key")
    if decisions is not None:
        same_j = same_j.join(decisions.select("cluster_key", F.col("template").alias("decided")), "cluster_key", "left")
    else:
        same_j = same_j.withColumn("decided", F.lit(None).cast("string"))
    same_j = wildcarded(same_j)
    same_t = same_j.select("cluster_key", "canon", F.when(F.col("all_decided"), F.col("template"))
                           .when(F.coalesce(F.col("decided"), F.lit("")) != "", F.col("decided"))
                           .otherwise(F.col("wcontent")).alias("template"))

    mixed = c.where("path = 'mixed'")
    aligned = align_templates(mixed)
    if decisions is not None:
        chosen = (aligned.join(decisions.select("cluster_key", F.col("template").alias("decided")), "cluster_key", "left")
                  .select("cluster_key", F.when(F.col("decided").isNull(), F.col("template"))
                          .when(F.col("decided") != "", F.col("decided")).alias("template")))
    else:
        chosen = aligned
    mixed_t = (mixed.join(chosen, "cluster_key", "left")
               .select("cluster_key", "canon", F.coalesce("template", "canon").alias("template")))
    return single.unionByName(same_t).unionByName(mixed_t)


def template_catalog(assigned: DataFrame) -> DataFrame:
    """template_key = md5(template), lines, distinct contents, first line."""
    return (assigned.groupBy("template")
            .agg(F.sum("n").cast("bigint").alias("n_lines"), F.count(F.lit(1)).alias("n_contents"),
                 F.min("min_line").alias("first_line"))
            .withColumn("template_key", F.md5("template"))
            .select("template_key", "template", "n_lines", "n_contents", "first_line"))
