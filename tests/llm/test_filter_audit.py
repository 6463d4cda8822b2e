from itertools import permutations

from tests.conftest import DATA, same_as_sql
from tidewater.llm import filter_audit

COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def by_hand(docs, labels):
    """Every order applied to every document."""
    rows = []
    for i, text, lang in docs:
        t = text or ""
        w = t.encode().split()
        rows.append((i, t, lang or "", {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t), "D": any(c in "#$%&*|" for c in t)}))
    for i, t, _, f in rows:
        f["E"] = i is not None and any(j is not None and j < i and t == u for j, u, _, _ in rows)
    good, toxic = ({i for i, q, x in labels if (q, x)[k] == 1 and i is not None} for k in (0, 1))
    out = {}
    for part in {r[2] for r in rows}:
        own = [(r[0], r[3]) for r in rows if r[2] == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                gone, left = [d for d in left if d[1][f]], [d for d in left if not d[1][f]]
                total[f] += len(gone)
                alone = sum(d[1][f] and sum(d[1].values()) == 1 for d in own)
                out[part, order, step] = [f, len(left), len(gone), sum(d[1][f] for d in own) - len(gone), alone, sum(d[0] in good for d in gone), sum(d[0] in toxic for d in gone)]
        for key, v in out.items():
            if key[0] == part:
                v.append(total[v[0]])
    return sorted((*k, *v[1:]) for k, v in out.items())


def test_same_as_every_order_by_hand(spark):
    long = " ".join(f"w{i}" for i in range(120))
    docs = [
        (1, long, "en"), (2, long, "en"), (2, long, "en"), (3, "A B C", "en"), (4, "x | y", "en"), (5, None, "en"), (6, "", None), (7, "", ""), (None, "", "de"), (None, long, "de"), (8, " \x0b\x0cw w \t", "de"),
        (9, "word " * 500, "de"), (10, "WORD*" + "É" * 40, "de"), (11, long.upper(), "fr"), (12, long + " #", "fr"), (11, long.upper(), "fr"), (-4, "A B C", "fr"), (13, "a b" * 40_000, "fr"),
    ]
    labels = [(1, 1, 0), (2, 1, 1), (2, 0, None), (3, None, 1), (None, 1, 1), (5, 1, 0), (99, 1, 1), (9, 0, 1), (11, 1, 1), (11, 1, 1), (13, 1, None)]
    d = spark.createDataFrame([(*r, 0, True, "z") for r in docs], "doc_id long, text string, lang string, n int, E boolean, digest string")
    got = filter_audit.audit(d, spark.createDataFrame([(*r, 7) for r in labels], "doc_id long, quality int, toxic int, n int"))
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect())) == by_hand(docs, labels)


def test_no_documents_and_no_labels(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(spark.createDataFrame([], "doc_id long, text string, lang string"), labels).count() == 0
    one = filter_audit.audit(spark.createDataFrame([(None, None, None)], "doc_id long, text string, lang string"), labels).collect()
    assert len(one) == 600 and {r.part for r in one} == {""}
    assert {(r.kept, r.removed + r.redundant, r.shapley) for r in one if r.filter_order[r.step - 1] == "A"} == {(0, 1, 120)}


def test_identities(spark):
    rows = filter_audit.op11_filter_interaction(spark, str(DATA / "sf0.001")).collect()
    total = {(r.part, r.filter_order): r.kept + r.removed for r in rows if r.step == 1}
    for part in {r.part for r in rows}:
        own = [r for r in rows if r.part == part]
        last = {r.kept for r in own if r.step == 5}
        assert len(last) == 1 and len({total[part, r.filter_order] for r in own}) == 1  # the order moves losses, not the end
        shares = {r.filter_order[r.step - 1]: r.shapley for r in own}
        assert sum(shares.values()) == 120 * (total[part, "ABCDE"] - last.pop())


def test_same_as_sql(spark):
    same_as_sql(spark, "op11_filter_interaction", "sf0.01")
