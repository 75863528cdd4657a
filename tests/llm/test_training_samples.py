"""Training samples: long texts are learned from, and what is left out is replaced."""

from echofold.llm import language, toxicity


def test_toxicity_learns_from_long_texts(spark):
    """All toxic texts are long."""
    bad, good = "horrid vile nasty wretch ", "river stone morning glass "
    docs = [(i, (bad if i % 3 == 0 else good) * (900 if i % 3 == 0 else 5)) for i in range(90)]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in docs], "doc_id long, toxic int")
    assert len(docs[0][1]) > 20_000
    found = {r.doc_id: r.score for r in toxicity.score(table, toxicity.train(table, labels)).collect()}
    assert min(found[i] for i in range(0, 90, 3)) > max(found[i] for i in range(90) if i % 3)


def test_languages_learn_from_long_texts(spark):
    """All texts of one language are long."""
    docs = [(i, "der schnelle fuchs läuft über die straße " * 600 if i % 3 == 0 else "the quick river runs under a bridge ", "de" if i % 3 == 0 else "en") for i in range(30)]
    assert len(docs[0][1]) > 20_000
    model = language.train(spark.createDataFrame(docs, "doc_id long, text string, lang string"))
    assert model.predict(["über die straße läuft der fuchs", "the river runs under"])[0] == ["de", "en"]
