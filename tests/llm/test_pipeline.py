import corpus_pipeline
from tests.conftest import DATA
from tests.llm.test_operators import brute_components, brute_repeats, check_packing, tokens

SF = str(DATA / "sf0.001")


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "n-gram Jaccard join", "substring dedup", "mixing sources to target weights", "best-fit packing"]
    seen = [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen.append(docs.collect())
        if name != names[-1]:
            assert docs.columns == corpus_pipeline.COLUMNS
    start, good, single, cut, mixed, packed = seen
    bad = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 0").collect()}
    assert len({r.doc_id for r in good} & bad) <= 0.2 * len(bad) and len(good) > 0.7 * len(start)
    comps = {d: c for _, d, _, c in brute_components([(r.doc_id, r.text) for r in good])}
    assert {r.doc_id for r in single} == {r.doc_id for r in good if comps[r.doc_id] == r.doc_id or not tokens(r.text)}
    want = {d: (n, k, h) for _, d, n, k, h in brute_repeats([(r.doc_id, r.text) for r in single])}
    import hashlib

    texts = {r.doc_id: r.text for r in cut}
    for r in single:
        n, k, h = want[r.doc_id]
        if n and k == n:
            assert r.doc_id not in texts
        elif k:
            assert hashlib.sha256(texts[r.doc_id].encode()).hexdigest() == h
        else:
            assert texts[r.doc_id] == r.text
    times = {}
    for r in mixed:
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
        assert r.text == texts[r.doc_id]
    assert set(times) == set(texts)
    check_packing(packed, [(d, texts[d], n) for d, n in times.items()])


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
