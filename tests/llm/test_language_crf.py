import numpy as np

from corpusq.llm import language_crf as c

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy_and_edges(spark, make):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = c.classify(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) > 100 and np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.97
    model = c.fit(docs)
    odd = make([(1, None), (2, ""), (3, "123 ## !!"), (4, "the " * 30_000), (None, "die und der"), (4, "the"), (5, "x" * 100_000), (2**53 + 1, "nicht ein auf")])
    found = c.predict(odd, model).collect()
    assert [(r["lang_pred"], r["score"]) for r in found if r["doc_id"] in (1, 2, 3)] == [("und", 0.0)] * 3
    assert all(0 <= r["score"] <= 1 for r in found) and {r["lang_pred"] for r in found if r["doc_id"] is None} == {"de"}
    assert 2**53 + 1 in {r["doc_id"] for r in found}
    mixed = make([(1, "the of and is that with from der die und ist nicht ein auf mit")])
    labelled = [(w["word"], w["lang"]) for w in c.label_words(mixed, model).first()["words"]]
    assert labelled[0] == ("the", "en") and labelled[-1] == ("mit", "de")


def test_marginals_equal_plain_forward_backward():
    sample = [("aa", "alpha able about above".split() * 20), ("bb", "zebra zone zulu zest".split() * 20)]
    tool = c.Tagger(c.train(sample))
    texts = [("alpha zone able zulu zest about " * n).split() for n in (1, 11, 40)] + [[], ["5"]]
    gamma, sizes = tool.marginals(texts)
    at = 0
    for words, size in zip(texts, sizes):
        e = [tool.table[tool.place[w]].astype(float) for w in words if tool.place[w] >= 0]
        if not e:
            assert size == 0
            continue
        alpha, beta = [tool.pi * e[0]], [np.ones(2)]
        for x in e[1:]:
            alpha.append((alpha[-1] / alpha[-1].sum() @ tool.a) * x)
        for x in reversed(e[1:]):
            beta.append(tool.a @ (x * beta[-1] / beta[-1].max()))
        expected = np.array(alpha) * np.array(beta[::-1])
        assert np.allclose(gamma[at : at + size], expected / expected.sum(axis=1, keepdims=True), atol=1e-6)
        at += size


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert [(r["lang_pred"], r["score"]) for r in c.classify(docs).collect()] == [("und", 0.0)]
    assert c.classify(docs.where("false")).collect() == []
