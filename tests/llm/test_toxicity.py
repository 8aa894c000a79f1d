import random

from pyspark.sql import functions as F

from latticework.llm import toxicity, transducers as fst


def test_grammar():
    best = fst.grammar(denied=0.25, quoted=0.5, bonus=1.0).best
    insult, target = (fst.INSULT, 4.0), (fst.TARGET, 1.0)
    assert best([insult]) == 4.0
    assert best([insult, target]) == best([target, insult]) == 5.0
    assert best([(fst.NEGATION, 1.0), insult]) == 1.0
    assert best([(fst.NEGATION, 1.0), *[(fst.OTHER, 1.0)] * 3, insult]) == 4.0
    assert best([(fst.REPORT, 1.0), insult]) == 2.0
    assert best([(fst.THREAT, 1.0)]) == 0.0
    assert best([(fst.THREAT, 1.0), target]) == 2.0
    assert best([]) == 0.0


def corpus(make_docs, spark):
    rng = random.Random(1)
    word = lambda: rng.choice("abcdefgh") + rng.choice("xyz") + rng.choice("klmno")
    texts, toxic = [], []
    for i in range(400):
        words = [word() for _ in range(40)]
        toxic.append(int(i % 5 == 0))
        if toxic[-1]:
            for bad in rng.sample(["grobble", "snarfed", "wexling"], 2):
                words.insert(rng.randrange(40), bad)
        texts.append(" ".join(words) + ".")
    labels = spark.createDataFrame(list(enumerate(toxic)), "doc_id long, toxic int")
    return make_docs(texts), labels, toxic


def test_learns_lexemes_and_leaves_clean_texts(spark, make_docs):
    docs, labels, toxic = corpus(make_docs, spark)
    model = toxicity.fit(docs, labels, train=toxicity.remainder(F.col("doc_id"), 4) != 2)
    assert {"grobble", "snarfed", "wexling"} <= set(model.lexicon)
    got = {r.doc_id: r.toxic for r in toxicity.score(docs, model).collect()}
    assert all(got[i] for i, y in enumerate(toxic) if y)
    assert sum(got[i] for i, y in enumerate(toxic) if not y) <= 3


def test_edges(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(4, 1), (5, 0), (None, 1), (9, None)], "doc_id long, toxic int")
    for docs in (edge_docs, no_docs):
        model = toxicity.fit(docs, labels)
        got = toxicity.score(docs.withColumn("toxic_score", F.lit("mine")), model)
        assert got.count() == docs.count()
        assert all(0 <= r.toxic_score <= 1 for r in got.collect())
    empty = toxicity.fit(edge_docs, labels.limit(0))
    assert empty.lexicon == {} and not any(r.toxic for r in toxicity.score(edge_docs, empty).collect())
