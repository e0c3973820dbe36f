"""The toxicity lexicon: folding, harmless phrases, what is learned, and held-out labels."""

import random

import pytest

from pulsegrid.llm import quality, toxicity
from pulsegrid.llm.queries import QUERIES, table


def plain_model(**terms):
    return toxicity.Model({toxicity.pattern(t.replace("_", " ")): w for t, w in (terms or {"idiot": 3.0}).items()},
                          tuple(map(toxicity.pattern, toxicity.HARMLESS)), toxicity.PLAIN_CURVE)


@pytest.mark.parametrize("text", ["idiot", "IDIOT!", "1d10t", "ïdïöt", "іdіоt", "ｉｄｉｏｔ", "id​iot", "!!idi0t!!", "𝐢𝐝𝐢𝐨𝐭", "ıdıοτ", "ld!ot", "(idiot)", "an_idiot_"])
def test_disguises(text):
    model = plain_model()
    weight, words = model.measure(text, model.automaton())
    assert weight == 3.0 and words >= 1


@pytest.mark.parametrize("text", ["idiotic", "videodiot", "1 2 3", "", " \n", "10", "patriot", "id iot", "2010 t"])
def test_no_hits(text):
    model = plain_model()
    assert model.measure(text, model.automaton())[0] == 0.0


def test_harmless_phrases_and_overlaps():
    model = plain_model(trash=1.0, **{"piece_of_trash": 4.0, "idiot*": 3.0})
    a = model.automaton()
    measure = lambda t: model.measure(t, a)[0]
    assert measure("the trash can, a trash-can and TRASH CANS") == 0.0
    assert measure("trash in the trash can") == 1.0
    assert measure("idiot-proof") == 0.0 and measure("idiots") == 3.0
    assert measure("piece of trash") == 5.0  # two terms that begin at two words


def test_numbers_and_signs_alone_are_no_letters():
    assert toxicity.folded("In 1984, 55% of x! | ! a|b") == " in of x aib "
    assert toxicity.folded("a@b") == " aab " and toxicity.folded("@home $hit") == " ahome shit "
    assert toxicity.folded("\t\n") == " " and toxicity.folded("Straße") == " strasse "


def test_score_of_nulls_empty_long_repeated_and_clashing(spark):
    model = plain_model()
    rows = [(1, None, 9.0, "x"), (2, "", 9.0, "x"), (3, "you idiot", 9.0, "x"), (3, "you idiot", 9.0, "x"), (None, "fine", None, None), (4, "word " * 200000, 9.0, "x"),
            (5, "word " * 200000 + "idiot", 9.0, "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, Score double, mark string")
    done = toxicity.score(frame, model)
    assert done.columns == ["doc_id", "text", "mark", "score"]
    got = sorted((r["doc_id"] or 0, round(r["score"], 9)) for r in done.collect())
    score = dict(got)
    assert len(got) == 7 and score[1] == score[2] == score[0] == score[4] < 0.1 < 0.9 < score[3] and score[4] < score[5] < 0.7
    assert toxicity.score(frame.limit(0), model).count() == 0


def labelled(spark, n=600, seed=1):
    rng = random.Random(seed)
    words = [f"{a}{b}{c}" for a in "bdfg" for b in "aeou" for c in "mnrs"]
    docs, marks = [], []
    for i in range(n):
        toxic = i % 3 == 0
        text = [rng.choice(words) for _ in range(rng.randint(30, 90))]
        if toxic:
            text += [f"zork{rng.choice(['', 'en', 'ish', 'um'])}" for _ in range(3)]
        rng.shuffle(text)
        docs.append((i, " ".join(text), "x"))
        marks.append((i, 1, int(toxic), "x"))
    docs += [(n + i, "copied passage quite unlike all others, word by word " + str(i), "x") for i in range(40)]
    marks += [(n + i, 1, 1, "x") for i in range(40)]
    return (spark.createDataFrame(docs, "doc_id long, text string, __text string"),
            spark.createDataFrame(marks, "doc_id long, quality int, toxic int, extra string"))


def test_learned_terms_are_the_stem_and_not_what_copies_share(spark):
    docs, labels = labelled(spark)
    model = toxicity.train(docs, labels, usable=quality.remainder("doc_id", 3) != 1)
    learned = set(model.terms) - {toxicity.pattern(t) for t in toxicity.LEXICON}
    assert learned == {" zork"}
    held = docs.where(quality.remainder("doc_id", 3) == 1).where("doc_id < 600")
    got = toxicity.score(held, model).collect()
    assert all((r["score"] >= 0.7) == (r["doc_id"] % 3 == 0) for r in got) and len(got) > 100


def test_nothing_to_learn_from(spark):
    docs, labels = labelled(spark, 30)
    for marks in (labels.limit(0), labels.where("toxic = 0"), labels.selectExpr("cast(null as long) as doc_id", "quality", "toxic"),
                  labels.selectExpr("doc_id", "quality", "cast(null as int) as toxic")):
        model = toxicity.train(docs, marks)
        assert model.curve == toxicity.PLAIN_CURVE
        assert toxicity.score(docs, model).count() == docs.count()
    assert toxicity.train(docs.limit(0), labels).curve == toxicity.PLAIN_CURVE
    odd = spark.createDataFrame([(1, None, "a"), (1, "b c", "a"), (1, "b a", "a"), (None, "x", "a")], docs.schema)
    assert toxicity.score(odd, toxicity.train(odd, labels)).count() == 4


def test_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    rows = QUERIES["op13_toxicity_lexicon"](spark, sf).where("held_out").join(table(spark, sf, "labels"), "doc_id").collect()
    toxic, clean = ([r["predicted"] for r in rows if r["toxic"] == c] for c in (1, 0))
    assert sum(toxic) >= 0.85 * len(toxic) and sum(clean) <= 0.01 * len(clean)
