import corpus_pipeline as C
from logloom.llm import quality, secrets, simhash
from logloom.llm.common import table
from tests.llm.test_decontaminate import brute as contaminated
from tests.llm.test_secrets import brute as secret_spans
from tests.llm.test_simhash import brute as components

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    cols, rows = docs.columns, {r.doc_id: r for r in docs.collect()}
    good = C.quality_stage(spark, docs, SF)
    want = {r.doc_id for r in quality.score_documents(docs, labels).collect() if r.predicted}
    assert good.columns == cols and {r.doc_id for r in good.collect()} == want
    one = C.simhash_stage(spark, docs, SF)
    want = {c for _, _, c in components([(i, r.text) for i, r in rows.items()])}
    assert one.columns == cols and sorted(r.doc_id for r in one.collect()) == sorted(want)
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    hit = {d for d, _, n, _ in contaminated([(i, r.text) for i, r in rows.items()], items) if n}
    clean = C.decontamination_stage(spark, docs, SF)
    assert clean.columns == cols and {r.doc_id for r in clean.collect()} == rows.keys() - hit
    safe = C.secrets_stage(spark, docs, SF)
    assert safe.columns == cols and {r.doc_id for r in safe.collect()} == {i for i, r in rows.items() if not secret_spans(r.text)}


def test_run(spark):
    out = C.run(spark, SF)
    got = out.collect()
    assert out.columns[:5] != [] and set(table(spark, SF, "documents").columns) <= set(out.columns)
    texts = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    assert got and all(r.parity and r.round_trip and texts[r.doc_id] == r.text for r in got)
    assert len({simhash.fingerprint_of(r.text) for r in got}) == len(got)
    assert not any(secret_spans(r.text) for r in got) and secrets.RULES


def test_stages_on_odd_rows(spark):
    kind = "doc_id long, text string, lang string, source string, n_chars long, __h long, token_ids string"
    rows = [(None, None, None, None, None, None, None), (1, "", "", "", 0, 1, ""), (1, "", "", "", 0, 1, ""), (2, "plain words here", "en", "s", 16, 2, "x")]
    for data in ([], rows):
        df = spark.createDataFrame(data, kind)
        for _, stage in C.STAGES[:-1]:
            df2 = stage(spark, df, SF)
            assert df2.columns == df.columns and df2.count() <= len(data)
        assert C.token_stage(spark, df, SF).count() == len(data)
