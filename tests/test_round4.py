import random

from logloom.functions.masking import DEFAULT_MASK_RULES
from logloom.operators import preprocess as P
from logloom.operators import tokens as tk
from logloom.plans.mine import mine_templates
from pyspark.sql import functions as F

CONTENT = "canon string, tokens array<string>, n long, min_line long, max_line long"


def shape_lines():
    """Lines of few shapes: digits that every mask takes, that none takes, and hexadecimal prefixes."""
    rnd = random.Random(7)
    forms = ["job {a} of user {b} took {a} sec", "from 10.{a}.0.{b}:80{a}", "x{a}z at R{a} ", "ptr 0x{a} and 0X{b} end", "code {a}x0 0x{a}g",
             "Mon Jan {a} 10:11:{b} UTC 2020 up", "id {a}{a}{a}{b} DEAD{a}{b}EF", 'executed cmd "ls {a}" x{b}', "fe80:0:0:0:{a}:2:3:4", "٣ {a} -{b} +{a}",
             "<*> <*> {a}", "/var/log/a{b}.log {a}", "", "  \t"]
    rows = [(i, rnd.choice(forms).format(a=rnd.randint(0, 9), b=rnd.randint(0, 9))) for i in range(3000)]
    return rows + [(5, rows[5][1]), (None, "job 1 of user 2 took 1 sec"), (7, None)]


def test_masked_lines_are_the_lines_masked_one_by_one(spark, monkeypatch):
    df = spark.createDataFrame(shape_lines(), "line_id long, line string")
    want = sorted(map(repr, P.preprocess(df).select("line_id", "content").collect()))
    for least in (0, P.LINES_A_SHAPE, 10_000):
        monkeypatch.setattr(P, "LINES_A_SHAPE", least)
        assert sorted(map(repr, P.masked_lines(df).collect())) == want
    rules = [(DEFAULT_MASK_RULES[10][0], "*"), ("x3", "three")]
    got = P.masked_lines(df, rules=rules).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, P.preprocess(df, rules=rules).select("line_id", "content").collect()))


def test_lines_of_a_shape_are_masked_once(spark, monkeypatch):
    """Every text that is masked is a shape: no line of a known one is."""
    lines = spark.createDataFrame([(i, f"Shipped {i % 50} units of part {i}") for i in range(2000)], "line_id long, line string")
    held, mask = [], P.preprocess
    monkeypatch.setattr(P, "preprocess", lambda df, *a, **k: (held.append(df), mask(df, *a, **k))[1])
    assert {(r.template, r.n_lines) for r in mine_templates(lines).catalog.collect()} == {("Shipped <*> units of part <*>", 2000)}
    assert [df.count() for df in held if "shape" in df.columns] == [7]


def test_no_token_row_holds_a_text(spark):
    """What static keys send between tasks grows with the texts, not with tokens times texts."""
    texts = [" ".join(["Alpha", "beta", f"x{i}y", "=", "gamma"] * 200) for i in range(20)]
    rows = [(t, t.split(), 1, i, i) for i, t in enumerate(texts)] + [("", [], 1, 99, 99), (None, None, 1, 98, 98), ("zz", ["zz"], 2, 97, 97), ("zz", ["zz"], 1, 96, 97)]
    vocab = tk.vocabulary_from_list(spark, ["Alpha", "beta", "gamma"])
    keyed = tk.static_keys(spark.createDataFrame(rows, CONTENT), vocab)
    plan = keyed._jdf.queryExecution().executedPlan().toString()
    sent = [line for line in plan.splitlines() if "Generate posexplode" in line]
    assert sent and not any("canon" in line for line in sent)
    got = sorted((r.min_line, r.static_key) for r in keyed.collect())
    key = "".join(f"{5 * i}Alpha{5 * i + 1}beta{5 * i + 3}=" for i in range(200))
    assert got == [(i, key) for i in range(20)] + [(96, "<*>"), (97, "<*>"), (98, "<*>"), (99, "<*>")]


def test_tokens_come_back_from_the_canonical_text(spark):
    texts = ["a=1,b=2", "...x y", "foo(bar) done", "(order <*>)", "", "   ", "x__DASH__ y", "a\x00b c", "one two", None, "a,b", "a , b"]
    df = spark.createDataFrame([(t, 1, i, i) for i, t in enumerate(texts)], "content string, n long, min_line long, max_line long")
    made = tk.tokenize(df)
    want = {r.canon: r.tokens for r in made.collect()}
    got = tk.collapse_canonical(made)
    assert got.columns == ["canon", "tokens", "n", "min_line", "max_line"]
    assert {r.canon: r.tokens for r in got.collect()} == want and got.agg(F.sum("n")).first()[0] == len(texts)
