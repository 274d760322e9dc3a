from lectern.llm.canon import Index, Rules, edits, map_values, ordinal, stem

BOOKS = [(1, "Corvane", "Cor"), (2, "Corvanth", "Coh"), (3, "1 Keloth", "1Ke"), (4, "2 Keloth", "2Ke"), (5, "Song of Harvests", "SoH"), (6, "Mathorn", "Mat")]


def test_spellings():
    index = Index(BOOKS, Rules(codes=True))
    cases = {
        "corvane": 1, "corvaen": 1, "c0rvanth": 2, "coh": 2, "cor": 1, "corv": 0, "ii kelot": 4, "second keloth": 4, "1kleoth": 3, "keloth": 0, "4 keloth": 0, "song of h": 5, "songofharvests": 5, "the book of mathorn": 6, "math": 6,
        "mixdown": 0, "20230101": 0, "": 0, "?": 0,
    }
    assert {k: index.find(k)[0] for k in cases} == cases


def test_stems_and_ordinals():
    rules = Rules(filename=True)
    assert [stem(x, rules) for x in ("Cor_001.wav", "2 Kel-07_final.WAV", "Mathorn__12 (1).wav", "1Kel 3_v2.wav", "20230101_12.wav")] == ["cor", "2 kel", "mathorn", "1kel", "20230101"]
    assert [stem(x, Rules()) for x in ("Verse 12", "verse-#3", "Verse12", " Room  Tone ", "12")] == ["verse", "verse", "verse", "room tone", "12"]
    assert ordinal("ii keloth") == ("2", "keloth") and ordinal("1keloth") == ("1", "keloth") and ordinal("mathorn") == ("", "mathorn")
    assert (edits("abc", "acb"), edits("", "ab"), edits("kitten", "sitting")) == (1, 2, 3)


def test_rows_nulls_repeats_and_empty(spark):
    rows = [(1, "Corvane", 0), (2, None, 0), (3, "  ", 0), (4, "CORVANTH.", 0), (5, "nonsense", 0), (5, "nonsense", 0), (6, "x" * 5000, 0)]
    df = spark.createDataFrame(rows, "id long, book string, stem int")
    got = sorted((r.id, r.entry) for r in map_values(df, BOOKS, value="book", row_id="id", rules=Rules(codes=True)).collect())
    assert got == [(1, 1), (3, 0), (4, 2), (5, 0), (5, 0), (6, 0)]
    assert map_values(df.where("false"), BOOKS, value="book", row_id="id", rules=Rules()).collect() == []
    assert all(r.entry == 0 for r in map_values(df, [], value="book", row_id="id", rules=Rules()).collect())


def test_index_scores_equal_brute_force():
    """The inverted index gives the cosine of every spelling with a shared n-gram, as comparing them one by one does."""
    import math
    import random

    from lectern.llm.canon import grams

    rng = random.Random(2)
    index = Index(BOOKS, Rules(codes=True))
    for _ in range(300):
        text = "".join(rng.choice("corvanthkelmsg1 ") for _ in range(rng.randint(1, 14))).strip() or "c"
        weigh = lambda g: {p: w * index.rarity.get(p, index.unseen) for p, w in g.items()}
        a, got = weigh(grams(text)), index.cosines(text)
        for i, (_, _, body, _) in enumerate(index.spellings):
            b = weigh(grams(body))
            dot = sum(w * b[p] for p, w in a.items() if p in b)
            want = dot / (math.sqrt(sum(w * w for w in a.values())) * math.sqrt(sum(w * w for w in b.values())))
            assert math.isclose(got.get(i, 0.0), want, abs_tol=1e-9)
