"""Catalog matching and mergeable pairs against every pair compared in Python."""

import random
import re

from pyspark.sql import functions as F

from logloom.operators import matching, merging
from logloom.operators.tokens import VOCAB_PUNCT, vocabulary_from_list

VOCAB = ["user", "open", "port"]


def h1(content, template):
    norm = " ".join(content.split())
    pattern = "(.*?)".join(re.escape(p) for p in template.split("<*>"))
    m = re.fullmatch(pattern, norm)
    if not m:
        return False
    taken = [t for g in m.groups() for t in g.split()]
    return not any(t in VOCAB or t in VOCAB_PUNCT for t in taken)


def random_texts(rnd, n):
    parts = ["user", "open", "port", "a1", "b22", "id=7", "id=77", "x", "xy", "xyz", "(q)", "host1.net"]
    return sorted({" ".join(rnd.choice(parts) for _ in range(rnd.randint(0, 5))) for _ in range(n)})


def random_templates(rnd, n):
    parts = ["user", "open", "<*>", "<*>", "id=<*>", "x<*>", "<*>z", "b<*>2", "<*>.net", "<*><*>", "h<*>1<*>t", "xyz", "<*>y<*>"]
    out = {" ".join(rnd.choice(parts) for _ in range(rnd.randint(1, 4))) for _ in range(n)}
    return sorted(out | {"<*>", "<*> <*>", "<*> <*> <*>", "<*>  <*>", "user x", "", "<*>=7<*>", "<*>host1.ne<*>"})


def _tables(spark, texts, templates, rnd):
    contents = spark.createDataFrame([(t, t.split()) for t in texts], "canon string, tokens array<string>")
    rows = [(t, rnd.randint(1, 5), i) for i, t in enumerate(templates)]
    catalog = spark.createDataFrame(rows, "template string, n_lines long, first_line long").withColumn("template_key", F.md5("template"))
    return contents, catalog, rows


def test_matching_equals_brute_force(spark):
    rnd = random.Random(11)
    texts, templates = random_texts(rnd, 150), random_templates(rnd, 80)
    contents, catalog, rows = _tables(spark, texts, templates, rnd)
    vocab = vocabulary_from_list(spark, VOCAB)
    want = {(c, t) for c in texts for t in templates if h1(c, t)}
    for v in (None, vocab):
        pairs = matching.candidates(contents, catalog, v)
        got = [(r.canon, r.template) for r in matching.template_match(pairs, vocab, content_col="canon", id_cols=("canon", "template_key")).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    best = {c: min(((-n, i), t) for t, n, i in rows if (c, t) in want)[1] for c in {c for c, _ in want}}
    assert any("<*>" in t and matching.WILDCARD not in t.split() for t in best.values()) and "<*> <*>" in best.values()
    found = matching.match_catalog(contents, catalog, vocab)
    assert {r.canon: r.template for r in found.collect()} == best
    plan = matching.candidates(contents, catalog, vocab)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_matching_without_rows(spark):
    contents, catalog, _ = _tables(spark, ["a b"], ["a <*>"], random.Random(1))
    vocab = vocabulary_from_list(spark, VOCAB)
    assert matching.match_catalog(contents.limit(0), catalog, vocab).count() == 0
    assert matching.match_catalog(contents, catalog.limit(0), vocab).count() == 0
    assert merging.mergeable_pairs(catalog.limit(0), vocab).count() == 0


def mergeable(a, b):
    x, y = a.split(), b.split()
    if len(x) == len(y):
        return all(p == q or "<*>" in (p, q) for p, q in zip(x, y))
    return abs(len(x) - len(y)) <= 2 and (h1(a, b) or h1(b, a))


def templates_to_merge(rnd, n):
    parts = ["user", "a1", "b2", "c3", "<*>", "<*>", "id=<*>"]
    return sorted({" ".join(rnd.choice(parts) for _ in range(rnd.randint(1, 5))) for _ in range(n)})


def test_mergeable_pairs_equal_brute_force(spark):
    rnd = random.Random(5)
    templates = templates_to_merge(rnd, 150)
    _, catalog, _ = _tables(spark, [""], templates, rnd)
    name = {r.template_key: r.template for r in catalog.collect()}
    vocab = vocabulary_from_list(spark, VOCAB)
    got = [frozenset((name[r.a_key], name[r.b_key])) for r in merging.mergeable_pairs(catalog, vocab).collect()]
    want = {frozenset((a, b)) for i, a in enumerate(templates) for b in templates[i + 1:] if mergeable(a, b)}
    assert set(got) == want and len(got) == len(want)


def test_hubs_are_the_best_of_all_pairs(spark):
    rnd = random.Random(6)
    templates = templates_to_merge(rnd, 120)
    _, catalog, rows = _tables(spark, [""], templates, rnd)
    keys = {r.template: r.template_key for r in catalog.collect()}
    rank = {t: (-t.split().count("<*>"), -n, keys[t]) for t, n, _ in rows}
    got = {r.template_key: r.hub_key for r in merging.hubs(catalog, vocabulary_from_list(spark, VOCAB)).collect()}
    assert got == {keys[a]: min(rank[b] for b in templates if a == b or mergeable(a, b))[2] for a in templates}


def merged_to_fixpoint(rows, align):
    """X3 with every pair compared: template -> final template."""
    import hashlib
    now, final = {t: n for t, n, _ in rows}, {t: t for t, _, _ in rows}
    while True:
        rank = {t: (-t.split().count("<*>"), -n, hashlib.md5(t.encode()).hexdigest()) for t, n in now.items()}
        hub = {a: min((b for b in now if a == b or mergeable(a, b)), key=rank.get) for a in now}
        groups = {}
        for a, b in hub.items():
            if hub[b] == b:
                groups.setdefault(b, []).append(a)
        step = {a: align(m) for m in groups.values() if len(m) > 1 for a in m}
        if not step:
            return final
        final = {t: step.get(x, x) for t, x in final.items()}
        new = {}
        for t, n in now.items():
            new[step.get(t, t)] = new.get(step.get(t, t), 0) + n
        now = new


def test_merging_to_a_fixpoint_equals_brute_force(spark):
    from .test_reduction import merged
    rnd = random.Random(8)
    templates = templates_to_merge(rnd, 40)
    _, catalog, rows = _tables(spark, [""], templates, rnd)
    alias = {r.old_template: r.new_template for r in merging.merge_templates(catalog, vocabulary_from_list(spark, VOCAB)).collect()}
    want = merged_to_fixpoint(rows, lambda m: " ".join(merged([t.split() for t in m])))
    assert {t: alias.get(t, t) for t in templates} == want
