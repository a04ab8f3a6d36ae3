"""One job over many datasets, each with its own header layout, drop patterns and masks.

The rules are a table: one row per dataset with its header format, the regexes
masked with ``<*>`` (P2) and the patterns removed first (P1).  ``for_datasets``
folds the table into the expressions of one plan, in which every dataset's
patterns are literals that the JVM compiles once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.masking import WS_CLASS, preprocess_col
from .raw_logs import compile_header

RULES_SCHEMA = "dataset string, log_format string, masks array<string>, drops array<string>"

# Header layout, masks and drop patterns of the known datasets.
LAYOUTS = [
    ("HPC", "<LogId> <Node> <Component> <State> <Time> <Flag> <Content>", [], []),
    ("OpenStack", r"<Logrecord> <Date> <Time> <Pid> <Level> <Component> \[<ADDR>\] <Content>",
     [r"(\w+-\w+-\w+-\w+-\w+)", r"HTTP\/\d+\.\d+", r"(?:\d{1,3}\.){3}\d{1,3},(?:\d{1,3}\.){3}\d{1,3}"], [r"HTTP\/\d+\.\d+"]),
    ("BGL", "<Label> <Timestamp> <Date> <Node> <Time> <NodeRepeat> <Type> <Component> <Level> <Content>", [], []),
    ("HDFS", "<Date> <Time> <Pid> <Level> <Component>: <Content>", [r"blk_-?\d+"], []),
    ("Hadoop", r"<Date> <Time> <Level> \[<Process>\] <Component>: <Content>", [], []),
    ("Spark", "<Date> <Time> <Level> <Component>: <Content>", [], []),
    ("Zookeeper", r"<Date> <Time> - <Level>  \[<Node>:<Component>@<Id>\] - <Content>", [], []),
    ("Thunderbird", r"<Label> <Timestamp> <Date> <User> <Month> <Day> <Time> <Location> <Component>(\[<PID>\])?: <Content>",
     [r"(\d+\.){3}\d+", r"\bLOCAL\(\d+\)", r"_([A-Z]\d+)"], []),
    ("Windows", "<Date> <Time>, <Level>                  <Component>    <Content>", [], []),
    ("Linux", r"<Month> <Date> <Time> <Level> <Component>(\[<PID>\])?: <Content>", [], []),
    ("Android", "<Date> <Time>  <Pid>  <Tid> <Level> <Component>: <Content>",
     [r"(/[\w-]+)+", r"([\w-]+\.){2,}[\w-]+", r"\b(\-?\+?\d+)\b|\b0[Xx][a-fA-F\d]+\b|\b[a-fA-F\d]{4,}\b", r"-\<\*\>"], []),
    ("HealthApp", r"<Time>\|<Component>\|<Pid>\|<Content>", [], []),
    ("Apache", r"\[<Time>\] \[<Level>\] <Content>", [r"\/(?:\w+\/){2,}\w+\.\w+$"], []),
    ("Proxifier", r"\[<Time>\] <Program> - <Content>",
     [r"<\d+\ssec", r"([\w-]+\.)+[\w-]+(:\d+)?", r"\d{2}:\d{2}(:\d{2})*", r"[KGTM]B"], [r" \(\d+(\.\d+)?\s(?:K|M)B\)"]),
    ("OpenSSH", r"<Date> <Day> <Time> <Component> sshd\[<Pid>\]: <Content>", [r"(\d+\.){3}\d+", r"([\w-]+\.){2,}[\w-]+"], []),
    ("Mac", r"<Month>  <Date> <Time> <User> <Component>\[<PID>\]( \(<Address>\))?: <Content>", [r"([\w-]+\.){2,}[\w-]+"], []),
    ("Thunderbird_epd", r"<Label> <Timestamp> <Date> <User> <Month> <Day> <Time> <Location> <Component>(\[<PID>\])?: <Content>", [], []),
    ("Audit", r"type=<Type> msg=audit\(<Time>\): <Content>", [], []),
]
#: Rules are folded into the plan, so their number is bounded; more is an error, never a cut.
MAX_DATASETS = 1000


def layouts(spark: SparkSession) -> DataFrame:
    """The rules table of the known datasets."""
    return spark.createDataFrame(LAYOUTS, RULES_SCHEMA)


def for_datasets(lines: DataFrame, rules: DataFrame, fields: tuple[str, ...] = (), text_col: str = "line",
                 content_field: str = "Content", mask_rules=None) -> DataFrame:
    """``lines(dataset, <text_col>, ...)`` plus the header's ``fields`` (null where a layout has none) and ``content`` (P1, P2, then ``mask_rules``).

    A line that does not fit the header of its dataset, or whose dataset has no
    rules, is left out, as S2 does; a null line fits none.  A rules row without
    a format takes the whole line.  Datasets with equal rules share a branch.
    A dataset listed twice is an error.
    """
    rows = rules.select("dataset", "log_format", "masks", "drops").limit(MAX_DATASETS + 1).collect()
    if len(rows) > MAX_DATASETS:
        raise ValueError(f"more than {MAX_DATASETS} datasets in the rules")
    if len({r["dataset"] for r in rows}) < len(rows):
        raise ValueError("a dataset is listed twice in the rules")
    if not rows:
        return lines.drop(text_col).select("*", *[F.lit(None).cast("string").alias(f) for f in (*fields, "content")]).where("false")
    groups: dict = {}
    for r in rows:
        groups.setdefault((r["log_format"], tuple(r["masks"] or ()), tuple(r["drops"] or ())), []).append(r["dataset"])
    stripped = F.regexp_replace(F.regexp_replace(F.col(text_col), "^" + WS_CLASS + "+", ""), WS_CLASS + r"+\z", "")

    def parsed(s: Column, fmt: str | None, masks, drops) -> Column:
        header = compile_header(fmt or f"<{content_field}>")
        pattern = "(?U)" + header.regex

        def value(name):
            if name not in header.headers:
                return F.lit(None).cast("string")
            c = F.regexp_extract(s, pattern, header.group_of[name])
            return F.nullif(c, F.lit("")) if name in header.optional else c

        content = preprocess_col(value(content_field), masks, drops, rules=[] if mask_rules is None else mask_rules)
        return F.when(s.rlike(pattern), F.struct(*[value(f).alias(f) for f in fields], content.alias("content")))

    def by_dataset(s: Column) -> Column:
        cases = [(F.col("dataset").isin(*names), parsed(s, *rule)) for rule, names in groups.items()]
        return reduce(lambda c, w: c.when(*w), cases[1:], F.when(*cases[0]))

    # One generator: no filter on the parsed row can be pushed below it, which would evaluate every pattern twice.
    found = F.filter(F.transform(F.array(stripped), by_dataset), lambda r: r.isNotNull())
    keep = [F.col(f"`{c}`") for c in lines.columns if c != text_col]
    return lines.select(*keep, F.explode(found).alias("__row")).select(*keep, "__row.*")
