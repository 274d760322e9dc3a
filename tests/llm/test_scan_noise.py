import random

from lectern.llm.scan_noise import Furniture, Lexicon, derivation, header_templates, page_number, repair, repair_scripts, split_numbers, strokes, word_counts

WORDS = "the river keeper stood near northern gate and nobody followed it children sun-dried hill-country orchard waiting tower for forty days many".split()
LEXICON = Lexicon({w: 500 for w in WORDS} | {"tbe": 3, "chapter": 90})
FURNITURE = Furniture(["◊ - Reader's Copy", "The Hill Edition ◊ 9"], ["Dathiel", "Wenthar"])


def noise(text):
    return sorted(repair(text, LEXICON, FURNITURE)[0])


def test_confusions_keep_their_strokes_and_are_found():
    from lectern.llm.scan_noise import CONFUSIONS

    assert all(strokes(a) == strokes(b) for a, b in CONFUSIONS)
    assert derivation("river", "iivei", 2) == [0, 4] and derivation("river", "giver", 2) is None and derivation("same", "same", 2) == []
    assert LEXICON.misread == {"tbe": "the"}
    assert LEXICON.decode("childrcn") == ("children", [6]) and LEXICON.decode("northem") == ("northern", [6]) and LEXICON.decode("zebra") is None


JOINT = Lexicon({w: 500 for w in WORDS + "valley people walked in morning a away way into to on chapter cold".split()} | {"tbe": 3, "the": 5000, "in": 2000, "a": 3000, "to": 3000})


def text_of(raw):
    return " / ".join(t for _, t in repair(raw, JOINT, Furniture([], []))[1])


def test_joint_decoding():
    """Splits, merges, misreadings and broken words in one stream."""
    expected = {
        "the val ley": "the valley", "many peo ple wal ked in the morning": "many people walked in the morning", "the riv er": "the river", "th e river": "the river",
        "inthe morning": "in the morning", "peoplewalkedinthemorning": "people walked in the morning", "the val\nley stood": "the valley stood", "ther1ver stood": "the river stood",
        "peo plewalked to": "people walked to", "in to the way": "in to the way", "a way to": "a way to", "the nor-\nthem gate": "the northern gate", "hill-\ncountry": "hill-country",
        "river-\ngate": "river-gate", "zelo-\nmar stood": "zelomar stood", "the chil\xad\nd\xad\nren stood": "the children stood", "the gate, stood! (near) \"the\" gate": "the gate, stood! (near) \"the\" gate",
        "Walked INTHE morning": "Walked IN THE morning", "forty d\nays": "forty days", "the Zelimar stood": "the Zelimar stood", "or-\nchard-\n": "orchard-",
    }
    assert {t: text_of(t) for t in expected} == expected
    assert sorted(repair("ther1ver stood near tbe nor-\nthem gate", JOINT, Furniture([], []))[0]) == [(1, "glyph"), (1, "hyphen"), (2, "glyph")]
    long = "people walked in the morning to the valley " * 300
    assert text_of(long.replace(" ", "").strip()) == long.strip()


def test_planted_noise_is_undone():
    """Clean verses, broken into lines and disturbed in every way, come back as they were."""
    rng, words = random.Random(5), [w for w in JOINT.counts if w.isalpha() and w not in ("tbe", "a", "to", "in", "on", "it", "chapter")]
    misread = {"o": "0", "m": "rn", "d": "cl", "e": "c", "w": "vv", "l": "1"}
    clean, raw, noise = [], ["Chapter 9"], []
    for verse in range(1, 60):
        body = [rng.choice(words) for _ in range(rng.randint(6, 40))]
        clean.append((verse, " ".join(body) + "."))
        line = str(verse)
        for k, w in enumerate(body):
            w += "." if k == len(body) - 1 else ""
            if rng.random() < 0.06 and (at := [i for i, c in enumerate(w) if c in misread]) and len(w) > 5:
                i = rng.choice(at)
                w = w[:i] + misread[w[i]] + w[i + 1 :]
                seen = True
            else:
                seen = False
            if rng.random() < 0.05 and len(w) > 6 and not seen:
                w = w[:3] + " " + w[3:]
            if len(line) + len(w) > 50:
                if rng.random() < 0.4 and len(w) > 6 and not seen and " " not in w:
                    raw.append(line + " " + w[:4] + "-")
                    noise.append((len(raw), "hyphen"))
                    line = w[4:]
                else:
                    raw.append(line)
                    line = w
                if rng.random() < 0.15:
                    raw.append(f"[{100 + verse}]")
                    noise.append((len(raw), "furniture"))
            else:
                line += " " + w
            if seen:
                noise.append((len(raw) + 1, "glyph"))
        raw.append(line)
    found, paras = repair("\n".join(raw), JOINT, Furniture([], []))
    assert sorted(found) == sorted(set(noise)) and paras == [(None, "Chapter 9"), *clean]


def test_headers_of_one_script_and_rare_templates(spark):
    body = [f"{v} the river keeper stood near the northern gate and nobody followed" + ("\nit to the tower." if v % 2 else ".") for v in range(1, 30)]
    for at in (5, 11, 17, 23):
        body.insert(at, f"Kestrel House Fair Copy\n\n{300 + at}" if at != 17 else f"Kestrel House Fair Copy\n{300 + at}")
    text = "\n".join(body)
    lines = text.split("\n")
    assert noise(text) == [(i, "furniture") for i, x in enumerate(lines, 1) if x.startswith(("Kestrel", "3")) and "the" not in x]
    rows = [(i, "\n".join(["the river stood", "Bookroom Proof, second pull", "[7]", f"many children {'a' * (i % 7)}"])) for i in range(4)] + [(9, "Waiting near the tower\n[3]\nthe river stood")] * 2
    rows += [(20 + i, "the gate\nWaiting near the tower\nand nobody followed it") for i in range(20)]
    df = spark.createDataFrame(rows, "script_id long, raw_text string")
    assert header_templates(df, []) == ["Bookroom Proof, second pull"]


def test_page_numbers():
    assert {t: page_number(t) for t in ("[471]", "- 12 -", "~ xi ~", "p. lO9", "Page 3", "viii", "314", "3l6", "12.", "word", "the", "Chapter 7", "")} == {
        "[471]": "form", "- 12 -": "form", "~ xi ~": "form", "p. lO9": "form", "Page 3": "form", "viii": "form", "314": "bare", "3l6": "bare", "12.": "bare", "word": None, "the": None, "Chapter 7": None, "": None,
    }
    assert split_numbers([1, 2, 311, 3, 4, 312, 5]) == [True, True, False, True, True, False, True]
    assert split_numbers([7, 1, 2, 8, 3]) == [False, True, True, False, True] and split_numbers([]) == []


def test_kinds_of_noise():
    text = "Chapter 7\n\n1 the river stood near the nor-\n[12]\nDathiel - Reader's Copy\nthern gate and nobody foll0wed the hill-\ncountry for forty days.\n2 tbe children stood wai‐\nting near the tower."
    assert noise(text) == [(3, "hyphen"), (4, "furniture"), (5, "furniture"), (6, "glyph"), (8, "glyph"), (8, "hyphen")]
    paras = repair(text, LEXICON, FURNITURE)[1]
    assert paras == [(None, "Chapter 7"), (1, "the river stood near the northern gate and nobody followed the hill-country for forty days."), (2, "the children stood waiting near the tower.")]


def test_numbers_alone_and_misread_headers():
    text = "Chapter 7\n1\nthe river stood\n311\nThc Hill Editi0n   Dath!el 7\nnear the gate.\n2\nmany children\n312\nThe Hill Edition   Dathiel 7"
    assert noise(text) == [(4, "furniture"), (5, "furniture"), (9, "furniture"), (10, "furniture")]
    assert repair(text, LEXICON, FURNITURE)[1] == [(None, "Chapter 7"), (1, "the river stood near the gate."), (2, "many children")]


def test_odd_texts():
    for t in ("", " ", "\n\n", "-", "word-", "a-\n", "1\n2\n3", "x" * 200_000, "­\n­"):
        repair(t, LEXICON, FURNITURE)
    assert noise("the river stood near the gate.\nmany children") == []


def test_tables(spark):
    body = "Chapter 1\n1 " + "the river keeper stood near the northern gate and nobody followed it\n" * 12 + "[3]\nDathiel - Reader's Copy\nthe river keep-\ner stood near tbe gate."
    rows = [(1, body, "x"), (2, None, "x"), (3, "", "x"), (4, body, "x"), (5, body, "x")]
    df = spark.createDataFrame(rows, "script_id long, raw_text string, key string")
    got = {r.script_id: r for r in repair_scripts(df, ["Dathiel"]).collect()}
    assert got[2].noise == got[3].noise == [] and got[3].paragraphs == []
    assert sorted((n.line_no, n.noise) for n in got[1].noise) == [(14, "furniture"), (15, "furniture"), (16, "hyphen"), (17, "glyph")] and got[1].noise == got[5].noise
    assert word_counts(df)["river"] == 3 * 13 and repair_scripts(df.where("false"), []).collect() == []
