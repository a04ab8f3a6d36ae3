"""The full miner as one DataFrame plan.

scan -> mask -> dedupe (D6) -> tokenize -> dedupe on canonical text ->
static key (G1) -> [catch-all: similarity components (L7/L8)] -> induce
(I1-I11) -> merge (X3) -> catalog (I14) -> per-line assignment (S6).

All text work happens on distinct contents; lines only meet the result in
the final equi-join on a 96-bit content hash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.masking import WILDCARD
from ..operators import induction, merging
from ..operators.preprocess import distinct_contents, masked_lines
from ..operators.forests import similarity_clusters
from ..operators.tokens import build_vocabulary, collapse_canonical, materialize_vocab, static_keys, tokenize
from ..session import checkpoint_dir, written


@dataclass
class MineResult:
    contents: DataFrame     # canon, tokens, n, min_line, max_line, static_key, cluster_key, template, template_key
    catalog: DataFrame      # template_key, template, n_lines, n_contents, first_line
    assignments: DataFrame  # line_id, template_key, template
    vocab: DataFrame
    queue: DataFrame        # cluster_key, mode, rank, sample: what an arbiter is asked (I8)


def _hash_cols(c: str):
    return [F.xxhash64(c).alias("h1"), F.hash(c).alias("h2")]


def cluster_contents(contents: DataFrame, vocab: DataFrame, measure="lcs", sim_th=0.0) -> DataFrame:
    """G1-G3 + L7/L8: attach ``cluster_key`` to every distinct content."""
    return cluster_keyed(static_keys(contents, vocab), measure, sim_th)


def cluster_keyed(keyed: DataFrame, measure="lcs", sim_th=0.0) -> DataFrame:
    """G2-G3 + L7/L8 on contents that have their static key; no content is left out."""
    normal = keyed.where(F.col("static_key") != WILDCARD).withColumn("cluster_key", F.col("static_key"))
    catch = keyed.where(F.col("static_key") == WILDCARD)
    empty = catch.where(F.size("tokens") == 0).withColumn("cluster_key", F.lit("<*>#empty"))
    rest = catch.where(F.size("tokens") > 0)
    if rest.isEmpty():
        return normal.unionByName(empty)
    comp = similarity_clusters(rest, measure, sim_th)
    return normal.unionByName(empty).unionByName(rest.join(comp, "canon"))


def mine_templates(lines: DataFrame, vocab: DataFrame | None = None, regex=(), drop=(), rules=None,
                   decisions: DataFrame | None = None, measure="lcs", sim_th=0.0, merge=True,
                   min_df: int = 2, text_col: str = "line") -> MineResult:
    checkpoint_dir(lines.sparkSession)
    # materialisation point 1: masked lines, so that the mask chain runs once per line; a null line is an empty one
    masked = written(masked_lines(lines.select("line_id", F.coalesce(text_col, F.lit("")).alias(text_col)), regex, drop, rules, text_col))
    tokenized = written(tokenize(distinct_contents(masked)))  # distinct contents (D6), tokenized once
    contents_m = collapse_canonical(tokenized)
    vocab = materialize_vocab(build_vocabulary(contents_m, min_df) if vocab is None else vocab)
    # materialisation point 2: contents with their cluster (after the L8 loop)
    clustered = cluster_contents(contents_m, vocab, measure, sim_th).checkpoint()
    assigned = induction.induce(clustered, vocab, decisions)
    contents = clustered.join(assigned.select("canon", "template"), "canon").checkpoint()
    if merge:
        alias = merging.merge_templates(induction.template_catalog(contents), vocab)
        contents = merging.apply_alias(contents, alias)
    contents = contents.withColumn("template_key", F.md5("template"))
    catalog = induction.template_catalog(contents)

    # masked text -> canonical text -> template, then one join with the lines
    content_template = (tokenized.select("content", "canon").join(contents.select("canon", "template_key", "template"), "canon")
                        .select(*_hash_cols("content"), "template_key", "template"))
    line_keys = masked.select("line_id", *_hash_cols("content"))
    assignments = line_keys.join(content_template, ["h1", "h2"]).select("line_id", "template_key", "template")
    return MineResult(contents, catalog, assignments, vocab, induction.open_questions(clustered, vocab, decisions))


def line_templates(result: MineResult) -> DataFrame:
    """One (line_id, event_id, template) per line; order only if asked."""
    return result.assignments.select("line_id", F.col("template_key").alias("event_id"), "template")
