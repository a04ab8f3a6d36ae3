"""The value-checked events pipeline on Spark (mirrors ``oracle.pipeline_ctes``).

events_log -> P2 dataset regexes (no lookaround, no default chain) ->
distinct -> tokenize -> canonical dedupe -> vocabulary -> static keys ->
static-key clusters, and similarity components of the catch-all contents.
Each stage is an operator from ``logloom.operators``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..operators.preprocess import distinct_contents, preprocess
from ..operators.tokens import build_vocabulary, canonical_contents, materialize_vocab, static_keys
from ..session import checkpoint_dir, written
from ..sources import tables
from .mine import cluster_keyed
from .settings import EVENTS_REGEX


@dataclass
class VPipe:
    lines: DataFrame
    masked: DataFrame
    dm: DataFrame
    cc: DataFrame
    vocab: DataFrame
    keyed: DataFrame
    truth: DataFrame

    @property
    def clusters(self) -> DataFrame:
        """All contents with their cluster, catch-all contents included."""
        return cluster_keyed(self.keyed).select("cluster_key", "canon", "tokens", "n", "min_line", "max_line").checkpoint()


def vpipe(spark: SparkSession, sf_dir: str, lines_sql: str = tables.EVENTS_LOG_SQL, truth_sql: str = tables.TRUTH_VALUES_SQL) -> VPipe:
    """Build the pipeline over a message view of the events; every query builds its own."""
    checkpoint_dir(spark)
    lines = tables.view(spark, sf_dir, lines_sql)
    # written once: the mask chain runs once per line, whatever reads the lines and their contents later
    masked = written(preprocess(lines.select("line_id", "event_id", "line"), regex=EVENTS_REGEX, rules=[]))
    dm = distinct_contents(masked).checkpoint()
    cc = canonical_contents(dm).checkpoint()  # materialisation point after dedupe (D6)
    vocab = materialize_vocab(build_vocabulary(cc))
    keyed = static_keys(cc, vocab).checkpoint()
    return VPipe(lines, masked, dm, cc, vocab, keyed,
                 lines.select("line_id", "event_id").join(spark.sql(f"SELECT * FROM {truth_sql}"), "event_id"))
