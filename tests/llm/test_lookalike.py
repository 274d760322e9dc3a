import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm.lookalike import CLASS_OF, MEMBERS, Model, consistent, folded

TEXT = " the cat sat "
MODEL = Model([(0, a.strip(), b.strip(), 9) for a, b in sorted(set(zip(TEXT, TEXT[1:])))])


def seen(text):
    """What a reader sees: the class of each letter, everything else as it is."""
    return [("class", CLASS_OF[c]) if c in CLASS_OF else c for c in folded(text)]


@settings(max_examples=300, deadline=None)
@given(st.text("aаoоοpрcсxхyуAАΑBВ1l.é й​­　ｅﬁ", max_size=14), st.text("aаoоοpрcсxхyуAАΑBВ1l.é й​­　ｅﬁ", max_size=14))
def test_equal_just_when_they_look_the_same(a, b):
    assert (MODEL.text(a) == MODEL.text(b)) == (seen(a) == seen(b))


def test_forms():
    same = [("Ｔｈｅ cat", "The cat"), ("thе​ cаt", "the cat"), ("Ä", "Ä"), ("co­op  x", "coop x"), ("ﬁn", "fin"), ("с̧a", "ça"), (" a ", "a")]
    for a, b in same:
        assert MODEL.text(a) == MODEL.text(b)
    for a, b in [("a", "A"), ("resume", "résumé"), ("a,b", "a.b"), ("a b", "ab"), ("и", "й"), ("1", "l"), ("е", "ё")]:
        assert MODEL.text(a) != MODEL.text(b)
    assert MODEL.text("thе") == "the" and MODEL.text(None) is None and MODEL.text("​  ") == ""
    assert all(unicodedata.normalize("NFC", MODEL.text(t)) == MODEL.text(t) for t in ("é", "й"))
    assert all(len(m) == 3 for m in MEMBERS)


def test_table(spark):
    rows = [(1, "cаt", "cat", "x"), (2, None, "a", "y"), (3, "", "﻿", "z"), (3, "", "﻿", "z"), (4, "Привет мир", "Пpивeт миp", "w"), (5, "x" * 100_000, "x" * 99_999 + "х", "v")]
    df = spark.createDataFrame(rows, "id int, a string, b string, a_form string")
    got = {r.id: (r.a_form, r.b_form) for r in consistent(df, ["a", "b"]).collect()}
    assert all(got[i][0] == got[i][1] for i in (1, 3, 4, 5)) and got[2] == (None, got[2][1]) and got[4][0] == "Привет мир"
    assert consistent(df, ["a", "b"]).count() == 6 and consistent(df.where("false"), ["a", "b"]).collect() == []
