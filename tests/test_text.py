import random
import re
from urllib.parse import quote

import pytest
from pyspark.sql import functions as F

from corpusq.functions import text as tx


def apply(spark, values, function, schema="v string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, " + schema)
    return [r[0] for r in rows.orderBy("i").select(function(F.col("v"))).collect()]


def random_texts(alphabet, n=200, size=30, seed=1):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(size))) for _ in range(n)]


def test_strip_is_python_strip(spark):
    values = random_texts(" \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0 　abé")
    assert apply(spark, values, tx.strip) == [v.strip() for v in values]


def test_strip_equals_keeps_inner_spaces(spark):
    assert apply(spark, ["== A ==", "=== b c ===", "a=b", "=="], tx.strip_equals) == [" A ", " b c ", "a=b", ""]


def test_clean_and_word_count(spark):
    values = random_texts(" \t\n\rab.", seed=2)
    assert apply(spark, values, tx.clean) == [re.sub(r"[ \t\n\r\f]+", " ", v).strip(" ") for v in values]
    assert apply(spark, values, tx.word_count) == [len(v.split()) for v in values]


def numeric_model(text):
    kept = []
    for line in re.split(r"\r\n|\n|\r", text):
        parts = line.split()
        digits = [w for w in parts if any(c.isdigit() for c in w)]
        if parts and len(digits) / len(parts) > 0.4 and not line.strip().endswith("."):
            continue
        kept.append(line)
    return "\n".join(kept)


def test_drop_numeric_lines(spark):
    values = random_texts("1a 2. \nb", n=300, size=40, seed=3)
    assert apply(spark, values, tx.drop_numeric_lines) == [numeric_model(v) for v in values]


def test_sentences(spark):
    values = random_texts("a.!? b", seed=4)
    assert apply(spark, values, tx.sentences) == [re.split(r"(?<=[.!?]) ", v) for v in values]


def test_names(spark):
    values = ["http://x/Category:A:B", "Category:C", "none"]
    assert apply(spark, values, tx.category_name) == ["A:B", "C", None]
    assert apply(spark, values, tx.after_last_colon) == ["B", "C", "none"]


def test_percent_encode(spark):
    values = ["a b/c", "Ciudad_é(x)", "a+b&c=d", "x~y*z-._", "100%", "Category:A"]
    assert apply(spark, values, tx.percent_encode) == [quote(v) for v in values]


def test_answer_cuts(spark):
    values = ["[INST] q [/INST] yes\nmore", "a[/INST]b[/INST]c", "plain", "[INST]x[/INST]"]
    assert apply(spark, values, tx.answer_after) == [" yes\nmore", "b", None, ""]
    assert apply(spark, values, tx.answer_matched) == ["yes\nmore", "a[/INST]b[/INST]c", "plain", ""]
    assert apply(spark, ["SYSTEM ASSISTANT: hi"], lambda c: tx.answer_after(c, tx.ASSISTANT_MARK)) == [" hi"]


def display_model(text):
    text = text if len(text) == 1 else text[1:-1]
    text = re.sub(r"\\[uU]([0-9a-fA-F]{4})", lambda m: chr(int(m.group(1), 16)), text)
    return text.encode("utf-16", "surrogatepass").decode("utf-16").replace("\\n", "<br>")


def test_display(spark):
    values = [
        '"caf\\u00e9\\nnext"', '"say \\"hi\\""', "x", "", '" \\ud83d\\ude00 ok"', "[a\nb\tc]", '"tab\\t \\\\ end"',
        '"\\U00E9"', '"\\u12 short"',
    ]
    assert apply(spark, values, tx.display) == [display_model(v) for v in values]


def test_fill_template(spark):
    rows = spark.createDataFrame([("why {topic}?", "c")], "q string, c string")
    filled = tx.fill_template("{topic}|{context}|{topic}|{question}", topic=F.lit("T"), context=F.col("c"), question=F.col("q"))
    assert rows.select(filled).first()[0] == "T|c|T|why {topic}?"


def test_legacy_record(spark):
    values = [str({"split": "a finance nan", "n": None}), "{'split': \"it's\", 'n': nan}", str({"split": "a\xa0b", "n": 3})]
    found = apply(spark, values, lambda c: tx.legacy_record(c, "split string, n int"))
    assert [(r["split"], r["n"]) for r in found] == [("a finance nan", None), ("it's", None), ("a\xa0b", 3)]


def test_text_class(spark):
    values = ["What is CO2", "water is wet.", "really ?", "Is it", "Island life."]
    assert apply(spark, values, tx.text_class) == ["question", "statement", "question", "question", "statement"]


def test_texts_of_a_batch_are_counted_in_parts(monkeypatch):
    import pyarrow as pa

    from corpusq.functions import vectors as vx

    texts = pa.array(["a b", "", "b" * 90, *(["c d c"] * 40), "d"])
    whole, sizes, count = vx._count_words(texts, 8), [], vx._count_words
    monkeypatch.setattr(vx, "_count_words", lambda part, dim: sizes.append(sum(map(len, part.to_pylist()))) or count(part, dim))
    assert vx._in_parts(texts, 8, 50).equals(whole)
    assert len(sizes) > 3 and max(sizes) < 150
    assert len(vx._in_parts(texts.slice(0, 0), 8)) == 0


def test_vector_words_end_at_any_of_five_spaces():
    from hashlib import md5

    import pyarrow as pa

    from corpusq.functions import vectors as vx

    texts = ["a b\tc\nd\re\ff", "  two   words \n", "one\x0bword still", "", " \t\r\n\f", "é é ü"]
    found = vx._count_words(pa.array(texts), 16).to_pylist()
    for text, vector in zip(texts, found):
        counts = [0] * 16
        for word in text.translate(str.maketrans("\t\n\r\f", "    ")).split(" "):
            if word:
                counts[int(md5(word.encode()).hexdigest()[:8], 16) % 16] += 1
        size = sum(c * c for c in counts) ** 0.5
        assert vector == pytest.approx([c / size if size else 0.0 for c in counts])
