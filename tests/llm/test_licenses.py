import math
import os
import random
import re

from logloom.llm import licenses as L

DOC = "doc_id long, text string, h string, unit string, a long"


def grams(t):
    w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t))
    return {(a, b) for a, b in zip(w, w[1:])}


WANT = [(name, grams(t)) for name, t in L.TEMPLATES]


def best_of(text):
    """Best (dice, name), ties: the first template."""
    have, best = grams(text), None
    for name, want in WANT:
        dice = 2 * len(have & want) / (len(have) + len(want)) if have else 0
        if dice >= L.THRESHOLD - 1e-12 and (best is None or dice > best[0]):
            best = (dice, name)
    return best


def brute(text, inside=False):
    text, out = text or "", []
    pieces = text.split("\n") + [p for p in re.split(r"\n[ \t\r]*\n[ \t\n\v\f\r]*", text) if "\n" in p]
    for u, p in enumerate(pieces):
        best = best_of(p)
        if inside and not best:
            cut = re.split(r"(?<=[.;:!?])(?=[ \t\n\v\f\r])", p)
            parts = cut + [a + b for a, b in zip(cut, cut[1:])] if len(cut) > 1 else []
            if "\n" in p:
                parts = [x for x in parts if "\n" in x.strip(" \t\r\n")]
            best = max((b for b in map(best_of, parts) if b), key=lambda b: (b[0], -[n for n, _ in WANT].index(b[1])), default=None)
        if best:
            out.append((u, best[1], round(best[0], 9)))
    return out


def test_scan_equals_brute_force(spark):
    rnd = random.Random(8)
    rows = [(0, None), (1, ""), (2, "\n\n"), (3, "a b " * 60_000), (4, "mit"), (5, "Released### under&&& the*** MIT$$$ License.")]
    for i in range(200):
        lines = []
        for _ in range(rnd.randint(0, 6)):
            w = rnd.choice(L.TEMPLATES)[1].split()
            for _ in range(rnd.randint(0, 3)):
                w[rnd.randrange(len(w))] = rnd.choice(["", "x", "The", "license"])
            t = " ".join(w)
            lines.append(t if rnd.random() < 0.7 else t.replace(" ", "\n", 2))
            lines.append(rnd.choice(["", "", "other é text", " \t"]))
        rows.append((10 + i, "\n".join(lines)))
        if i % 3 == 0:  # notices inside lines and over line ends
            a, b = rnd.choice(L.TEMPLATES)[1], rnd.choice(L.TEMPLATES)[1]
            rows.append((300 + i, f"Words of ours! {a} And more of them\n\nFirst. {b.replace(' ', chr(10), 1)} Then: others;\tlast."))
    rows += rows[-2:] + [(None, rows[-1][1])]
    df = spark.createDataFrame([(i, t, "h", "u", 1) for i, t in rows], DOC)
    got = sorted((str(r.doc_id), [(f.unit, f.license, round(f.dice, 9)) for f in r.found]) for r in L.license_scan(df).collect())
    assert got == sorted((str(i), brute(t)) for i, t in rows)
    got = sorted((str(r.doc_id), [(f.unit, f.license, round(f.dice, 9)) for f in r.found]) for r in L.license_scan(df, inside=True).collect())
    assert got == sorted((str(i), brute(t, inside=True)) for i, t in rows)


def test_templates_recognise_themselves(spark):
    df = spark.createDataFrame([(k, t, "", "", 0) for k, (_, t) in enumerate(L.TEMPLATES)], DOC)
    assert all(r.found[0].license == L.TEMPLATES[r.doc_id][0] and r.found[0].dice == 1 for r in L.license_scan(df).collect())


def test_units_at_the_threshold_share_a_mark():
    for b in range(1, 400):
        for a in range(1, 700):
            least = math.ceil(L.THRESHOLD * (a + b) / 2 - 1e-9)  # bigrams in common that the threshold asks for
            if least <= min(a, b):
                assert least >= L.need(b, L.THRESHOLD) >= 1


def test_empty_table(spark):
    assert L.license_scan(spark.createDataFrame([], DOC)).count() == 0
    one = spark.createDataFrame([(1, "MIT License", "", "", 0)], DOC)
    assert [r.found for r in L.license_scan(one, templates=()).collect()] == [[]]


def test_no_words_are_needed(spark):
    df = spark.createDataFrame([(1, "A page. Offered under CC BY 4.0. The end."), (2, "x = 1  # SPDX-License-Identifier: GPL-2.0-or-later")], "doc_id long, text string")
    assert [[f.license for f in r.found] for r in L.license_scan(df, inside=True).orderBy("doc_id").collect()] == [["CC-BY-4.0"], ["GPL-2.0-or-later"]]
    tag = spark.createDataFrame([(1, "// SPDX-License-Identifier: MIT")], "doc_id long, text string")
    assert [f.license for f in L.license_scan(tag).first().found] == ["MIT"]


def test_full_texts_and_notices_inside_lines(spark, tmp_path):
    base = "/usr/share/common-licenses/"
    names = {"BSD": "BSD-3-Clause", "GPL-1": "GPL-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2": "LGPL-2.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0",
             "GFDL-1.2": "GFDL-1.2", "GFDL-1.3": "GFDL-1.3", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0", "Artistic": "Artistic-1.0", "CC0-1.0": "CC0-1.0", "Apache-2.0": "Apache-2.0"}
    names = {f: n for f, n in names.items() if os.path.exists(base + f)}
    texts = [open(base + f, encoding="utf-8", errors="replace").read() for f in names]
    lines = ["Copyright 2019 Foo Inc. Licensed under the MIT License. See LICENSE for details.",
             "Some words of ours here. This work is licensed under\nthe GNU General Public License, version 2. And other words.",
             "A page. Nothing about terms; no permission is given here. End."]
    spark.createDataFrame(list(enumerate(texts + lines)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = [r.licenses for r in L.op9_license_scan(spark, str(tmp_path)).orderBy("doc_id").collect()]
    assert dict(zip(names, got)) == names
    assert got[len(texts):] == ["MIT", "GPL-2.0", ""]
