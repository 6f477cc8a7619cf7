import zlib

import numpy as np

from roadrisk.llm import toxicity
from roadrisk.llm.queries import QUERIES
from roadrisk.llm.tables import table

FOLDER = "/root/testdata/sf0.1"


def test_held_out_documents(spark):
    got = QUERIES["op11_toxicity"](spark, FOLDER).join(table(spark, FOLDER, "labels"), "doc_id").collect()
    texts = {r["doc_id"]: toxicity.words(r["text"]) for r in table(spark, FOLDER, "documents").select("doc_id", "text").collect()}
    held = [r for r in got if r["held_out"]]
    # some toxic texts of these small tables (other languages, junk) bear no sign of it
    signs = {"loser", "idiot", "pathetic", "scum", "worthless", "moron", "trash", "clown", "disgusting", "stupid"}
    caught = [r["predicted"] for r in held if r["toxic"] == 1 and texts[r["doc_id"]] & signs]
    clean = [r["predicted"] for r in held if r["toxic"] == 0]
    assert len(caught) > 50 and np.mean(caught) > 0.94 and np.mean(clean) < 0.005
    for r in got[:100]:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and r["predicted"] == (r["score"] >= 0.7)


def test_odd_rows(spark, odd, no_docs):
    docs, labels = table(spark, FOLDER, "documents"), table(spark, FOLDER, "labels")
    model = toxicity.fit(docs, toxicity.training_labels(labels))
    got = toxicity.with_toxicity(odd, model)
    rows = got.collect()
    assert len(rows) == odd.count() and set(odd.columns) <= set(got.columns)
    assert all(0 <= r["toxicity"] < 0.5 for r in rows)
    by = {r["doc_id"]: r["toxicity"] for r in rows if r["doc_id"]}
    assert by[1] == by[2] == by[3] == by[4]
    assert toxicity.with_toxicity(no_docs, model).count() == 0
    assert {r["toxicity"] for r in toxicity.with_toxicity(odd, toxicity.fit(docs, labels.where("toxic = 1"))).collect()} == {1.0}
    assert {r["toxicity"] for r in toxicity.with_toxicity(odd, toxicity.fit(no_docs, labels)).collect()} == {0.5}
    few = toxicity.fit(docs, labels.where("doc_id < 40"))
    assert toxicity.with_toxicity(odd, few).count() == odd.count()
    assert model.score("x " * (2 << 20) + "idiot scum") > 0.7  # the end of a long text counts


def planted(spark):
    """Insults name one group much more often than calm texts do; calm texts name it, too."""
    rng = np.random.default_rng(5)
    fill = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]
    rows = []
    for i in range(3000):
        toxic = i % 3 == 0
        body = list(rng.choice(fill, 20))
        if rng.random() < (0.9 if toxic else 0.12):
            body[3] = "immigrants"
        elif rng.random() < 0.5:
            body[3] = "natives"
        if toxic and rng.random() < 0.8:
            body[7] = str(rng.choice(["vermin", "filth"]))
        rows.append((i, " ".join(body) + ".", int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def test_swaps_take_weight_off_names(spark):
    rows = planted(spark)
    plain, fair = (toxicity.fit(rows.select("doc_id", "text"), rows.select("doc_id", "toxic"), swap_weight=w) for w in (0.0, 1e5))
    neutral = ["the immigrants wab came home.", "immigrants", "many immigrants live here"]
    assert all(fair.score(t) < plain.score(t) for t in neutral)
    assert min(plain.score(t) for t in neutral) > 2 * max(fair.score(t) for t in neutral)
    assert abs(fair.score("the natives came") - fair.score("the immigrants came")) < 0.02
    assert fair.score("immigrants are vermin") > 0.7 and fair.score("natives are vermin") > 0.7


def test_swaps():
    got = list(toxicity.swaps("The women came. Nobody else! Muslims, and old men"))
    assert ({"the", "women", "came"}, {"the", "men", "came"}) in got and ({"the", "women", "came"}, {"the", "people", "came"}) in got
    assert len(got) == 2 + 6 + 2 + 2 and not list(toxicity.swaps(None))


def test_solve_matches_gradient():
    rng = np.random.default_rng(2)
    x, y = rng.integers(0, 2, (80, 5)).astype(float), rng.integers(0, 2, 80).astype(float)
    d, times, weight = rng.integers(-1, 2, (4, 5)).astype(float), np.array([1.0, 2, 3, 4]), rng.random(80) + 0.5
    w = toxicity.solve(x, y, weight, d, times, ridge=0.5, swap_weight=7.0)
    p = 1 / (1 + np.exp(-(x @ w[:-1] + w[-1])))
    grad = x.T @ (weight * (p - y)) + 0.5 * w[:-1] + 7.0 * (d.T * (times / times.sum())) @ (d @ w[:-1])
    assert np.abs(grad).max() < 1e-3
    assert abs((weight * (p - y)).sum()) < 1e-3
