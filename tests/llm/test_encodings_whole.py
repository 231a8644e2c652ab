from tests.llm.test_encodings import samples
from tidemark.llm.encodings import Table, Texts, labelled, learnt, train, wrong_encodings


def rows_of(spark, texts):
    return spark.createDataFrame([(i, t, k) for i, (k, t) in enumerate((k, t) for k, v in texts.items() for t in v)], "doc_id bigint, text string, lang string")


def test_a_table_teaches_what_its_texts_teach(spark):
    texts = samples() | {"xx": ["too few"] * 2}
    assert learnt(Table(labelled(rows_of(spark, texts), "text", "lang"))) == train(texts)


def test_no_text_is_left_out_of_the_counts(spark):
    long = "слово " * 500 + "ключ"
    texts = {"ru": [f"Ошибка номер {i}" for i in range(900)] + [long] * 30}
    table = Table(labelled(rows_of(spark, texts), "text", "lang"))
    assert table.sizes == {"ru": 930}
    found = table.count(("word",), {"ru": 3}, {})["ru", "word"]
    assert found == Texts(texts).count(("word",), {"ru": 3}, {})["ru", "word"] and found["Ошибка"] == 900 and found["ключ"] == 30


def test_words_of_long_texts_and_of_many_languages_are_known(spark):
    langs = [a + b for a in "abcdefghij" for b in "klmnopqrst"][:66]
    texts = {k: [f"plain text {i}" for i in range(9)] for k in langs} | {"ru": ["слово " * 400 + "ключ"] * 8}
    df = rows_of(spark, texts)
    bad = spark.createDataFrame([(10_000, "see ключ".encode("koi8_r").decode("cp1251"), None)], df.schema)
    assert wrong_encodings(df.unionByName(bad)).where("doc_id = 10000").first()["restored"] == "see ключ"
