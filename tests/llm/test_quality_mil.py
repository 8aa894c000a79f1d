import numpy as np

from latticework.llm import quality_mil


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    x, bag, y = rng.normal(size=(9, 5)), np.array([0, 0, 0, 1, 2, 2, 2, 2, 3]), np.array([1.0, 0, 1, 0])
    model = quality_mil.Model.start(x)
    loss = lambda: float(-np.mean(y * np.log(p := model.forward(x, bag, 4)["p"]) + (1 - y) * np.log(1 - p)))
    grads = model.gradients(model.forward(x, bag, 4), bag, y)
    for name, value in model.weights.items():
        for at in [tuple(rng.integers(0, n) for n in value.shape) for _ in range(4)]:
            value[at] += 1e-6
            up = loss()
            value[at] -= 2e-6
            down = loss()
            value[at] += 1e-6
            assert abs((up - down) / 2e-6 - grads[name][at]) < 1e-5


def test_attention_finds_the_passage_that_matters():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 8, 600)
    bag, y = np.repeat(np.arange(600), sizes), (np.arange(600) % 2).astype(float)
    x = rng.normal(size=(len(bag), 4))
    starts = np.searchsorted(bag, np.arange(600))
    key = starts + rng.integers(0, sizes)
    x[key, 0] = 4.0  # every bag has one telling passage
    x[key, 1] = np.where(y == 1, 2.0, -2.0)
    model = quality_mil.train(x, bag, y, epochs=30)
    f = model.forward(x, bag, 600)
    assert ((f["p"] > 0.5) == (y == 1)).mean() > 0.97
    assert f["weight"][key].mean() > 0.6


def test_edges(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(3, 1), (4, 0), (5, 1), (None, 1)], "doc_id long, quality int")
    for docs in (edge_docs, no_docs):
        for known in (labels, labels.limit(0)):
            got = quality_mil.score(docs, quality_mil.fit(docs, known)).collect()
            assert len(got) == docs.count() and all(0 <= r.quality_score <= 1 for r in got)
