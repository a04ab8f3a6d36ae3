import random

from hypothesis import given, settings
from hypothesis import strategies as st

from logloom.operators import align as A
from logloom.operators import reduction as R


def table_walk(a, b):
    """The alignment by the full table of lengths."""
    rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            rows[i + 1][j + 1] = rows[i][j] + 1 if x == y else max(rows[i + 1][j], rows[i][j + 1])
    i, j, back = len(a), len(b), []
    while i and j:
        if rows[i][j] == rows[i - 1][j]:
            i, step = i - 1, "<*>"
        elif rows[i][j] == rows[i][j - 1]:
            j, step = j - 1, "<*>"
        else:
            i, j, step = i - 1, j - 1, a[i - 1]
        back.append(step)
    back += ["<*>"] if i or j else []
    return [t for k, t in enumerate(back[::-1]) if not (t == "<*>" and k and back[::-1][k - 1] == "<*>")]


TOKENS = st.lists(st.sampled_from(["a", "b", "c", "<*>"]), max_size=40)


@settings(max_examples=400, deadline=None)
@given(TOKENS, TOKENS)
def test_alignment_by_bits_equals_the_table(a, b):
    assert A.align_pair(a, b) == table_walk(a, b)


def merged(lists):
    """Brute force of merge_lists for one key, by position and then by length."""
    by_length = {}
    for t in lists:
        by_length.setdefault(len(t), []).append(t)
    rows = [[c[0] if len(set(c)) == 1 else "<*>" for c in zip(*by_length[n])] for n in sorted(by_length)]
    return A.align_all(rows)


def test_merging_is_order_free_and_equals_brute_force(spark):
    rnd = random.Random(3)
    groups = {f"k{i}": [[rnd.choice("abx") for _ in range(rnd.randint(1, 5))] for _ in range(rnd.randint(1, 9))] for i in range(30)}
    rows = [(k, t) for k, lists in groups.items() for t in lists] + [("hub", ["user", f"u{i}", "left"]) for i in range(3000)]
    groups["hub"] = [["user", f"u{i}", "left"] for i in range(3000)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "key string, tokens array<string>").repartition(7)
    assert {r.key: r.tokens for r in R.merge_lists(df).collect()} == {k: merged(v) for k, v in groups.items()}


def test_rounds_of_alignment(spark):
    lists = [["start", *(["x"] * i), "end"] for i in range(40)]
    df = spark.createDataFrame([("a", i, t) for i, t in enumerate(lists)] + [("b", 0, ["only"])], "key string, slot int, tokens array<string>")
    for fan_in in (2, 16, 64):
        assert {r.key: r.tokens for r in R.align_lists(df, fan_in).collect()} == {"a": ["start", "<*>", "end"], "b": ["only"]}
    few = df.where("slot < 16")  # one round: the plain fold
    assert {r.key: r.tokens for r in R.align_lists(few).collect()}["a"] == A.align_all(lists[:16])
    assert R.align_lists(df.limit(0)).count() == 0
