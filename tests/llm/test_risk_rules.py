import random
from math import comb

import pytest

from tests.conftest import DATA, same_as_sql
from tidewater.llm import risk_rules as rr

LABELS = "doc_id long, quality int, toxic int"


def windows(text: str) -> int:
    """The words inside a 3-word window that occurs twice, place by place."""
    w = [x for x in text.replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if x]
    runs = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    return len({i + j for i, r in enumerate(runs) if runs.count(r) > 1 for j in range(3)})


@pytest.mark.parametrize("text", ["", "a", "a b c", "a b c a b c", "a a a a", "a a a", "x a b c y a b c", "a b c a b c a b c", "a b\tc\r\na b c d\x0be", "a b c d a b"])
def test_repeated_words_by_hand(text):
    assert rr.counts(text.encode())[4] == windows(text)


def test_counts():
    assert rr.counts("É a#\n\n \na#\nÉ a#\na#  ".encode()) == (6, 10, 4, 1, 6, 4, 0)
    assert rr.counts(b"") == (0,) * 7
    assert rr.counts(b"AB c\nAB c\rAB c\nAB c")[3:] == (1, 8, 3, 8)
    many = rr.counts(b"lorem " * 300_000)
    assert many[0] == many[4] == 300_000


def test_tail_is_exact():
    for n, p in ((1, 0.3), (20, 0.05), (200, 0.05), (200, 0.5)):
        for k in range(0, n + 1, max(1, n // 9)):
            want = sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
            assert rr.tail(k, n, p) == pytest.approx(want, rel=1e-9)
    assert rr.holds(0, 59, 0.05, 0.05) and not rr.holds(0, 58, 0.05, 0.05) and not rr.holds(0, 0, 0.05, 0.05)
    assert 0.4 < rr.tail(50_000_000, 1_000_000_000, 0.05) < 0.6


def test_false_rejection_is_limited(spark):
    """Many corpora whose good documents fail a rule as often as allowed: few of them get that rule."""
    rnd, rows = random.Random(5), []
    for stratum in range(200):
        for i in range(600):
            good = i % 3 > 0
            high = rnd.random() < (0.05 if good else 0.9)
            rows.append((str(stratum), int(good), [100 if high else 1, 0, 0, 0, 0]))
    seen = spark.createDataFrame(rows, "stratum string, good int, v array<int>")
    rules = spark.createDataFrame([(str(s), [(1, 0, 50)]) for s in range(200)], "stratum string, rules array<struct<rank:int,i:int,cutoff:int>>")
    alone = rr.certified(seen, rules, 0.05, 0.05 * 200).where("held > 0").count()  # each stratum at 0.05
    together = rr.certified(seen, rules, 0.05, 0.05).where("held > 0").count()
    assert alone <= 20 and together <= 1


def test_proposals_and_order(spark):
    rows = [("x", 1, [v, 0, 0, 3, 0]) for v in (0, 5, 10)] * 10 + [("x", 0, [v, 0, 0, 2, 0]) for v in (31, 40)] * 10 + [("one", 1, [0] * 5)]
    got = rr.proposals(spark.createDataFrame(rows, "stratum string, good int, v array<int>")).collect()
    assert [(r.stratum, [tuple(x) for x in r.rules]) for r in got] == [("x", [(1, 0, 20)])]


def test_edges(spark):
    good, bad = " ".join(f"w{i}" for i in range(60)), " ".join(f"w{i}##" for i in range(60))
    docs = [(i, good + f" {i}" if i % 2 else bad + f" {i}", "en" if i % 4 < 2 else None) for i in range(2000)]
    docs += [(None, bad, "en"), (None, None, None), (7, good, "zz"), (7, bad, "zz"), (5000, "", "en"), (5001, good + " new#line\n" * 20_000, None)]
    labels = [(i, i % 2, 0) for i in range(2000)] + [(None, 1, 1), (6, 1, 0), (5000, None, 0), (1, 1, 1)]
    d = spark.createDataFrame([(*r, "s", 1, True, [3]) for r in docs], "doc_id long, text string, lang string, stratum string, n_words int, kept boolean, v array<int>")
    got = rr.judge(d, spark.createDataFrame(labels, LABELS)).collect()
    assert len(got) == len(docs)
    by = {(r.doc_id, r.n_symbols): r for r in got}
    for i, t, lang in docs[:2000]:
        r = by[i, t.count("#")]
        assert r.kept == bool(i % 2) and not r.base_failed and r.failed_rule == (None if i % 2 else "symbols")
    assert by[7, 120].kept and by[7, 0].kept  # no labels in that stratum
    assert not by[None, 120].kept and by[None, 0].base_failed and by[5000, 0].base_failed and by[5001, 20_000].base_failed


def test_nothing_to_learn_from(spark):
    none = spark.createDataFrame([], LABELS)
    d = spark.createDataFrame([(1, "## " * 100 + " ".join(map(str, range(300))), "en")], "doc_id long, text string, lang string")
    assert [r.kept for r in rr.judge(d, none).collect()] == [True]
    assert rr.judge(d.limit(0), none).count() == 0


def test_same_as_sql(spark):
    same_as_sql(spark, "op12_risk_controlled_rules", "sf0.01")


def test_good_documents_stay(spark):
    got = rr.judge(spark.read.parquet(str(DATA / "sf0.1/documents.parquet")), spark.read.parquet(str(DATA / "sf0.1/labels.parquet")))
    told = got.join(spark.read.parquet(str(DATA / "sf0.1/labels.parquet")), "doc_id").where("not base_failed").groupBy("quality").agg({"kept": "count"})
    kept = {r.quality: r[1] for r in got.where("kept").join(spark.read.parquet(str(DATA / "sf0.1/labels.parquet")), "doc_id").groupBy("quality").count().collect()}
    all_ = {r.quality: r[1] for r in told.collect()}
    assert kept[1] >= 0.99 * all_[1] and kept.get(0, 0) <= 0.1 * all_[0]
