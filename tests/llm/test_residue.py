from lectern.llm import residue_pages
from lectern.llm.residue import find_residue, slots
from lectern.llm.residue_pages import PageTemplates, page_cover, plain, tokens


def whole(text):
    return residue_pages.whole(text)[0]


GOOD = "The reader was tired before lunch, so only 12 verses were split. Nothing else to report."
PROSE = [GOOD, "Cue 404 was not found on the first pass, but Fenwick located it.", "Access was denied to the booth until Maruk found the key.", "An internal server error stopped the upload, yet the copy is complete.", "We used lorem ipsum on the old poster, Corwen said, and had to print new ones.", "The script is required before the session starts."]


def test_seeds_alone():
    pages = ["404 Not Found\n403", "Seite nicht gefunden. Zugriff verweigert", "पृष्ठ नहीं मिला (404)", "Доступ запрещён | Страница не найдена", "Please enable JavaScript to view this page.", "HTTP 500", "Code: 503", "Fatal error: memory limit exhausted at line 9"]
    nothing = PageTemplates({})
    assert all(page_cover(plain(p), nothing) == (True, []) for p in pages)
    assert [page_cover(plain(p), nothing) for p in PROSE] == [None] * len(PROSE)


def test_filler_and_stubs():
    assert whole("test test test test test test") == whole("sdf jkl fds asd kjl") == whole("line 1 sample; line 2 sample; line 3 sample") == whole("lorem ipsum dolor sit amet consectetur elit") == "filler"
    assert whole("(empty template).") == whole(plain(" \n")) == whole("notes pending - check back later.") == "stub"
    assert [whole(plain(p)) for p in PROSE] == [""] * len(PROSE)


def test_filler_and_stubs_are_decided_on_the_whole_text():
    heading = "chapter four of the second reading, recorded at the small booth by oshelle and checked twice before the long summer break began."
    for body in ("lorem ipsum dolor sit amet consectetur elit sed do eiusmod tempor. " * 50, "sdf jkl fds asd kjl " * 120, "test " * 400, "line 1 sample; line 2 sample; " * 80):
        assert whole(f"{heading}\n{body}") == whole(f"{body}\n{heading}") == "filler"
    late = GOOD.lower() * 120 + "lorem ipsum dolor sit amet consectetur elit sed do eiusmod tempor. " * 500
    assert len(GOOD) * 120 > 10_000 and whole(late) == "filler"
    assert whole(f"{heading} " + "lorem ipsum dolor sit amet " * 5) == whole(f"{GOOD * 2000} " + "lorem ipsum dolor sit amet " * 5000) == ""
    stubs = "notes pending - check back later. your text here. under construction. type the title here. coming soon. content to be added. no description available. write your notes here. "
    assert whole(stubs * 3) == whole(stubs + "replace this heading with your own name.") == "stub"
    assert whole(f"{heading * 4} " + "notes pending, coming soon. " * 10) == ""


def test_templates():
    t = PageTemplates({"back to the harbour": (9, True), "the ◊ never came": (9, True), "the ◊": (1, False), "word of ◊ came late": (30, False), "word of storms came late": (3, True)})
    assert tokens("Request-Id: 7f3a9b21!") == ("Request", "-", "Id", ":", "9")
    assert t.covered(tokens("the blue boat never came")) == (0, ["the ◊ never came"])
    assert t.covered(tokens("back to the harbour back to the harbour 7"))[0] == 1
    assert t.covered(tokens("word of storms came late"))[0] > 0  # the most frequent template that fits is one of prose


def test_slots():
    found = [f for _, f, _, _ in slots("Dear {{ name }},\nFile %BOOK% failed. XXXX, __DATE__ [INSERT DATE] <title here> (date to follow) #PHONE# @@X@@ ${a} [[b]] [your title here]")]
    assert len(found) == 12
    assert slots("[breath] and stay; 50% off; x__y; #1; a <b> c; (to be continued)") == []


def test_mentions_and_slots_in_tables(spark):
    rows = [(i, f"Dear {{{{name{i % 4}}}}}, we heard page rustle.", i) for i in range(8)]
    rows += [(100 + i, f"Before export Juneth replaced the {{reader_name}} field in the title template, take {i} and cue {'abcdefgh'[i]}.", i) for i in range(8)]
    rows += [(200, GOOD, 0), (201, None, 0), (202, "", 0), (203, "404 Not Found", 0), (203, "404 Not Found", 0), (204, GOOD * 500, 0), (205, "Approved by: [BOOK]\n" + GOOD, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kind int")
    got = {r.doc_id: r.kinds for r in find_residue(df).collect()}
    assert got == {**{i: ["slot"] for i in range(8)}, 202: ["stub"], 203: ["page"], 205: ["slot"]}
    assert find_residue(df.where("false")).collect() == []


def test_slots_and_mentions_at_any_size(spark):
    """Letters that all hold one variable, a one-off slot in a long sentence, mentions with a second string, quoted slots."""
    rows = [(i, f"Dear {{{{first_name}}}}, the reading number {'abcdefghijkl'[i]} begins on Monday in the large booth beside the old library.") for i in range(12)]
    rows += [(50, "The recording session for {{book}} will be held on Monday in the large booth")]
    rows += [(100 + i, f"Before export Juneth replaced the {'{book}' if i == 3 else '{reader_name}'} field in the title template, take {'abcdefgh'[i]}.") for i in range(8)]
    rows += [(200, 'The credit line of chapter two reads "{{reader}}" on the last page.'), (300, 'The opening words were "{{motto}}" in the old copy.')]
    rows += [(201 + i, f'The credit line of chapter two reads "{n}" on the last page.') for i, n in enumerate(["Oshelle", "Ilsabet Marr", "Tavish"])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    expected = {*range(12), 50, 200}
    assert {r.doc_id for r in find_residue(df).collect()} == expected
    few = df.where("doc_id IN (0, 1, 50, 100, 103, 200, 201, 300)")
    assert {r.doc_id for r in find_residue(few).collect()} == {0, 1, 50, 200}
    many = df.selectExpr("doc_id", "text", "explode(sequence(0, 9)) AS k").selectExpr("doc_id * 10 + k AS doc_id", "text")
    assert {r.doc_id // 10 for r in find_residue(many).collect()} == expected


def test_slots_left_with_names_defaults_or_nothing(spark):
    names = ["Oshelle", "Ilsabet Marr", "Tavish", "Juneth", "Perrit", "Maruk"]
    rows = [(i, f"Reader: {n}, recorded at the small booth.\nDear {n}, thank you for reading the {n} chapters.") for i, n in enumerate(names)]
    rows += [(50, "Dear first_name, thank you for reading."), (51, "Reader: , recorded at the small booth."), (52, "Dear Reader Name, thank you for reading."), (53, "Dear , thank you for reading.")]
    rows += [(60, "The desk keeps file_name apart from the rest."), (61, "Juneth filled the reader_name field, thank you."), (62, "Dear " + "{{" + "name of the reader as it stands in the contract or in the list of readers of this year" + "}}" + ", hello.")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in find_residue(df).collect()} == {50, 51, 52, 53, 62}


def test_pages_are_learned_from_what_recurs(spark):
    rows = [(i, f"404 Not Found\nZum Seitenanfang springen bitte {i}") for i in range(30)]
    rows += [(100 + i, f"Klangbibliothek Nordlicht, Verzeichnis {i}\n404 Not Found") for i in range(30)]
    rows += [(900, GOOD), (901, "Klangbibliothek Nordlicht, Verzeichnis 7\n" + GOOD)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in find_residue(df).collect()) == [*range(30), *range(100, 130)]


def test_unseen_wording_is_told_by_where_it_stands(spark):
    """Pages whose wording no list has, beside sentences of prose that hold the same phrases and recur as often."""
    things = ["kettle", "copper lamp", "long boat", "harbour map", "old ledger", "winter coat"]
    rows = [(i, f"Harbour Office\nRegrettably the {things[i % 6]} you summoned could not be found.\n{'Back to the quay' if i % 3 else '404 Not Found'}") for i in range(60)]
    rows += [(100 + i, f"Regrettably the {things[i % 6]} you summoned cannot be displayed.") for i in range(12)]
    rows += [(200 + i, "The teapot refused to brew.\nError 418\nBack to the quay") for i in range(9)] + [(220, "The teapot refused to brew."), (221, "Back to the quay\nThe teapot refused to brew.")]
    rows += [(300 + i, f"The key of the {things[i % 6]} could not be found on the second evening. {GOOD} {GOOD} We walked home in the rain number {i}.") for i in range(40)]
    rows += [(400 + i, f"The key of the {things[i % 6]} could not be found on the second evening.") for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id for r in find_residue(df).collect()}
    assert got == {*range(60), *range(100, 112), *range(200, 209), 220, 221}


def test_dummy_words_are_learned(spark):
    words = "lorem ipsum dolor amet magna brindle quorve astum nellis porvo".split()
    rows = [(i, " ".join(words[(i * 7 + k * (i % 3 + 1)) % 10] for k in range(40))) for i in range(12)]
    rows += [(50, "amet brindle quorve astum nellis porvo brindle astum porvo quorve"), (51, f"{PROSE[4]} Brindle, astum and porvo are villages.")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in find_residue(df).collect()} == {*range(12), 50}


def test_names_of_other_languages_in_slots(spark):
    names = ["Oshelle", "Ilsabet Marr", "Tavish", "Juneth", "Perrit", "Maruk"]
    rows = [(i, f"Read by {n} at dawn.\nProducer: {n}") for i, n in enumerate(names)]
    rows += [(50 + i, f"Read by {n} at dawn.") for i, n in enumerate([":firstname", "$name", "%(time)s", "*|NAME|*", "your name"])] + [(60, "Producer:\nThe rest is here.")]
    rows += [(70, "It costs $five or ~six~ at the gate."), (71, "Three things:\nsalt, rope and bread.")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in find_residue(df).collect()} == {*range(50, 55), 60}
