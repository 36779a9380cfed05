import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rulespark.llm import langid

SYLLABLES = {"aa": "ka to mi re su".split(), "bb": "sch ung lich für ein".split(), "cc": "ção lha nho uma que".split(), "dd": "the ing and of er".split()}


def sentence(rnd, lang, n):
    return " ".join("".join(rnd.choice(SYLLABLES[lang]) for _ in range(rnd.randrange(1, 4))) for _ in range(n))


def rows(seed, n):
    rnd = random.Random(seed)
    return [(i, sentence(rnd, lang, rnd.choice([3, 20, 200])), lang, "s", 0) for i in range(n) for lang in SYLLABLES]


SCHEMA = "doc_id long, text string, lang string, lang_pred string, score int"
NAMES = ("_p", "_s", "_a")


@pytest.mark.parametrize("n", [2, 3, 4, 6, 9, 40])
def test_codewords_are_far_apart(n):
    code = langid.codewords(n)
    assert set(np.unique(code)) == {-1, 1} and (abs(code.sum(axis=0)) < n).all()
    apart = [(code[i] != code[j]).sum() for i in range(n) for j in range(i)]
    assert min(apart) >= max(1, code.shape[1] // 4)


def test_held_out_accuracy(spark):
    model = langid.fit(spark.createDataFrame(rows(1, 30), SCHEMA), F.lit(True))
    assert model.languages == sorted(SYLLABLES)
    fresh = rows(2, 50)
    right = sum(model.predict(t)[0] == lang for _, t, lang, *_ in fresh)
    assert right >= 0.98 * len(fresh)


@pytest.mark.parametrize("size", [1, 2, 3, 97, 100])
def test_grams_of_chunks_are_those_of_the_whole(monkeypatch, size):
    text = sentence(random.Random(3), "bb", 400)
    whole = np.sort(np.concatenate(list(langid.grams(text))))
    monkeypatch.setattr(langid, "CHUNK", size)
    assert np.array_equal(np.sort(np.concatenate(list(langid.grams(text)))), whole)


def test_letters_are_those_of_unicode():
    assert all(langid.has_letter(t) for t in ("1 é", "ʰ", "ª", "字"))
    assert not any(langid.has_letter(t) for t in (None, "", "² ½ ③ Ⅷ _ 12 ! ̈"))


def test_many_languages_have_codes_apart():
    code = langid.codewords(300)
    assert min((code[i] != code[j]).sum() for i in range(300) for j in range(i)) >= code.shape[1] // 5


def test_names_that_clash_are_refused(spark):
    df = spark.createDataFrame(rows(1, 1), SCHEMA)
    model = langid.fit(df, F.lit(None).cast("boolean"))
    assert model.languages == []
    with pytest.raises(ValueError):
        langid.predict(df, model, ("LANG_pred", "a", "b"))


def test_a_very_long_text_is_read_whole(spark):
    model = langid.fit(spark.createDataFrame(rows(1, 30), SCHEMA), F.lit(True))
    rnd = random.Random(5)
    text = sentence(rnd, "aa", 200) + " " + sentence(rnd, "dd", 60_000)
    df = spark.createDataFrame([(1, text, None, None, None)], SCHEMA)
    assert langid.predict(df, model, NAMES).first()._p == "dd"


def test_odd_rows(spark):
    docs = [*rows(4, 12), (900, None, "aa", "s", 0), (901, "12 !!", None, "s", 0), (902, "", "bb", "s", 0), (None, "ka to mi", None, None, None)]
    df = spark.createDataFrame(docs + docs[:2], SCHEMA)
    model = langid.fit(df, F.lit(True))
    got = langid.predict(df, model, NAMES)
    assert got.columns == [*df.columns, *NAMES]
    for r in got.collect():
        assert 0 <= r._s <= 1
        assert (r._p == "und") == (r.doc_id in (900, 901, 902))
    assert langid.predict(df.limit(0), model, NAMES).collect() == []


def test_few_languages(spark):
    df = spark.createDataFrame(rows(1, 3), SCHEMA)
    none = langid.fit(df.limit(0), F.lit(True))
    assert none.predict("ka") == ("und", 0.0, True)
    one = langid.fit(df.where("lang = 'aa'"), F.lit(True))
    assert one.predict("ka") == ("aa", 1.0, False) and one.predict("1")[0] == "und"


def test_a_mixture_is_less_sure_than_its_parts(spark):
    model = langid.fit(spark.createDataFrame(rows(1, 30), SCHEMA), F.lit(True))
    rnd = random.Random(9)
    a, d = sentence(rnd, "aa", 100), sentence(rnd, "dd", 100)
    assert model.predict(a + " " + d)[1] < min(model.predict(a)[1], model.predict(d)[1])
