import corpus_pipeline
from tidewater.llm import mixing

LABELS = "doc_id long, quality int, toxic int"
DOCS = "doc_id long, text string, lang string, source string, n_chars int, `_nth` int, row string"


def put(spark, path, docs, labels):
    spark.createDataFrame(docs, DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{path}/labels.parquet")
    return str(path)


def pieces(spark, d):
    return corpus_pipeline.run(spark, d).collect()


def test_columns_of_any_name_are_mixed(spark):
    df = spark.createDataFrame([(i, f"some words {i}", "a" if i % 3 else None, i, "r") for i in range(40)], "doc_id long, text string, source string, `_nth` int, row string")
    got = mixing.mix(df, repetition_limit=1.5, keep_all=True)
    assert got.columns == df.columns and {r.doc_id for r in got.collect()} == set(range(40)) and all(r._nth == r.doc_id for r in got.collect())


def test_no_documents(spark, tmp_path):
    assert pieces(spark, put(spark, tmp_path, [], [])) == []


def test_nulls_repeated_rows_and_odd_texts(spark, tmp_path):
    text = lambda i: " ".join(f"word{(i * 7919 + j * 31) % 9973}" for j in range(60 + i))
    docs = [(i, text(i), "en", f"s{i % 3}", 5, 1, "x") for i in range(30)]
    docs += [(100, None, None, None, None, None, None), (None, text(50), None, None, None, None, None), (None, None, "en", "s1", 0, None, None), (101, "", "en", "s0", 0, 1, "x"), (102, " \n\t ", "en", None, 3, 1, "x"), (103, "ok", "de", "s9", 2, 1, "x")]
    docs += [docs[3], docs[3], (7, text(70), "en", "s0", 1, 1, "x"), (104, text(4), "en", "s0", 1, 1, "x"), (105, text(5) + " and some words more", "fr", "s2", 1, 1, "x"), (106, "long " * 1 + text(3000), "en", "s1", 1, 1, "x")]
    got = pieces(spark, put(spark, tmp_path, docs, [(i, 1, 0) for i in range(6)] + [(None, 0, 1), (7, None, None)]))
    ids = {r.doc_id for r in got}
    assert set(range(30)) - {3, 4, 5, 7} <= ids  # labels of one class: nothing is rejected; copies are
    assert {100, 101, 102, 103, 106, None} <= ids and len({4, 104} & ids) == 1 and len({5, 105} & ids) == 1 and 3 in ids and 7 in ids
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for placed in by.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= 1024
