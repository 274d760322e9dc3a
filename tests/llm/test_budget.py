import os
from collections import Counter, defaultdict

import numpy as np
import pytest

from lectern.llm.mixing import mix, rake
from lectern.llm.packing import pack, sum_of_squares
from lectern.llm.queries_budget import QUERIES, VOCABULARY
from lectern.llm.tokens import token_sizes


def test_sum_of_squares_fills_containers():
    rng = np.random.default_rng(1)
    for sizes, capacity, slack in ((rng.integers(1, 60, 5000), 128, 0.02), (rng.integers(1, 128, 3000), 128, 0.04), (np.full(9, 128), 128, 0.0), (np.array([1]), 8, 1.0), (np.zeros(0, int), 8, 1.0)):
        where = sum_of_squares(sizes, capacity)
        filled = Counter()
        for c, s in zip(where.tolist(), sizes.tolist()):
            filled[c] += s
        assert max(filled.values(), default=0) <= capacity
        assert len(filled) * capacity <= max(sizes.sum() / (1 - slack) if slack < 1 else np.inf, capacity)


def test_packing_table(spark):
    rng = np.random.default_rng(2)
    sizes = [int(x) for x in rng.integers(1, 700, 1500)] + [5000, 0, None]
    df = spark.createDataFrame([(i, s, "q") for i, s in enumerate(sizes)], "doc_id long, n long, pack string")
    got = pack(df, [("small", 512), ("large", 2048), ("none", 0)], key="doc_id", size="n", shard_containers=64).collect()
    for name, capacity in (("small", 512), ("large", 2048)):
        rows = [r for r in got if r.pack == name]
        total, pieces, spots = defaultdict(int), Counter(), defaultdict(list)
        for r in rows:
            total[r.doc_id] += r.tokens
            pieces[r.doc_id] += 1
            spots[r.container].append((r.start, r.tokens))
        assert total == {i: s for i, s in enumerate(sizes) if s}
        assert all(pieces[i] == 1 for i, s in enumerate(sizes) if s and s <= capacity)
        for inside in spots.values():
            at = 0
            for start, n in sorted(inside):
                assert start == at
                at += n
            assert at <= capacity
        assert sum(total.values()) / (len(spots) * capacity) > 0.95
    assert pack(df.where("false"), [("small", 512)], key="doc_id", size="n").collect() == [] == pack(df, [], key="doc_id", size="n").collect()


def test_raking_meets_margins_and_limits():
    rng = np.random.default_rng(3)
    tokens = rng.integers(10, 1000, 24).astype(float)
    rows, columns = np.repeat(np.arange(4), 6), np.tile(np.arange(6), 4)
    goal = np.array([0.4, 0.3, 0.2, 0.1]) * tokens.sum()
    other = np.bincount(columns, tokens)
    x = rake(tokens, tokens * 8, [(columns, other), (rows, goal)])
    assert np.allclose(np.bincount(rows, x), goal) and np.allclose(np.bincount(columns, x), other, rtol=1e-3)
    x = rake(tokens, tokens * 1.2, [(columns, other), (rows, goal)])
    assert (x <= tokens * 1.2 + 1e-6).all() and np.bincount(rows, x)[3] == pytest.approx(goal[3])


def test_mixture(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(4000):
        source = ["big", "mid", "small", "other", None][int(rng.choice(5, p=[0.6, 0.25, 0.05, 0.05, 0.05]))]
        rows.append((i, source, ["en", "de", None][i % 3], f"t{i % 5}" if i % 7 else None, int(rng.integers(1, 200)) if i % 50 else 0, 1))
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, topic string, n long, copies int")
    targets = [("big", 0.5, 2), ("mid", 0.2, 2), ("small", 0.28, 4), ("absent", 0.02, 4)]
    drawn, report, margins = mix(df, targets, key="doc_id", source="source", language="lang", topic="topic", size="n", block_rows=500)
    got = {r.doc_id: r for r in drawn.collect()}
    cap = {"big": 2, "mid": 2, "small": 4}
    assert all(1 <= r.copies <= cap[r.source] for r in got.values()) and all(rows[i][4] > 0 for i in got)
    for r in margins.collect():
        assert r.actual_share == pytest.approx(r.target_share, abs=0.03) and r.value in ({"en", "de", ""} if r.margin == "language" else {"t0", "t1", "t2", "t3", "t4", ""})
        column = 2 if r.margin == "language" else 3
        assert r.tokens == sum(got[i].copies * rows[i][4] for i in got if (rows[i][column] or "") == r.value)
    rare = mix(df, targets, key="doc_id", source="source", language="lang", topic="doc_id", size="n").margins.collect()
    assert [r.value for r in rare if r.margin == "topic"] == [None]  # each topic is rare: one group
    shares = {r.source: r for r in report.collect()}
    for name, share, _ in targets[:3]:
        assert shares[name].actual_share == pytest.approx(share / 0.98, abs=0.01)
        assert shares[name].tokens == sum(got[i].copies * rows[i][4] for i in got if got[i].source == name)
    assert shares["absent"].tokens == 0 and shares["absent"].limited and shares["small"].limited
    more = {r.source: r for r in mix(df, targets, key="doc_id", source="source", language="lang", topic="topic", size="n", total_tokens=10**6)[1].collect()}
    assert more["small"].most_copies == 4 and more["small"].actual_share < 0.28
    empty, nothing, no_margins = mix(df.where("false"), targets, key="doc_id", source="source", language="lang", topic="topic", size="n")
    assert empty.count() == 0 and all(r.tokens == 0 for r in nothing.collect()) and no_margins.count() == 0


@pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary")
def test_whole_mixture_has_all_available_tokens(spark, tmp_path):
    text = "The reader was tired before lunch, so only a few verses were split. "
    rows = [(i, text * 5, "en", "big", "narration/a/b/c") for i in range(200)] + [(1000 + i, text, "en", "scarce", "narration/a/b/c") for i in range(3)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, path string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("big", 0.5, 3), ("scarce", 0.5, 4)], "source string, target_share double, max_repeat int").write.parquet(f"{tmp_path}/mix_target.parquet")
    got = {r.source: r for r in QUERIES["p7_whole_shares"](spark, str(tmp_path)).collect()}
    available = sum(r.available_tokens for r in got.values())
    assert got["scarce"].limited and got["scarce"].tokens == 4 * got["scarce"].available_tokens and not got["big"].limited
    assert sum(r.tokens for r in got.values()) == pytest.approx(available, rel=0.01)
    assert QUERIES["p7_whole_mixture"](spark, str(tmp_path)).count() == sum(r.documents for r in got.values())


@pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary")
def test_token_sizes(spark):
    df = spark.createDataFrame([(1, "hello world", 7), (2, None, 7), (3, "", 7), (4, "नमस्ते " * 1000, 7)], "id int, text string, n_tokens int")
    got = {r.id: r.n_tokens for r in token_sizes(df, ["id"], vocabulary=VOCABULARY).collect()}
    assert got[1] > 0 and got[2] == got[3] == 0 and got[4] > 1000 and token_sizes(df.where("false"), ["id"], vocabulary=VOCABULARY).collect() == []
    model = os.path.join(os.path.dirname(VOCABULARY), "piece_bpe_32k.model")
    if os.path.exists(model):
        assert {r.id: r.n_tokens for r in token_sizes(df, ["id"], vocabulary=model).collect()}[1] > 0


DATA = os.environ.get("LECTERN_TEST_DATA", "/root/testdata/sf0.001")
tables = pytest.mark.skipif(not os.path.isdir(DATA) or not os.path.exists(VOCABULARY), reason="no test tables or vocabulary")


@tables
def test_packed_tables_keep_every_document_whole(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    sizes = {r.doc_id: r.n_tokens for r in token_sizes(docs.select("doc_id", "text"), ["doc_id"], vocabulary=VOCABULARY).collect()}
    got = QUERIES["p6_packed"](spark, DATA).toPandas()
    packs = {r.pack: r.capacity_tokens for r in spark.read.parquet(f"{DATA}/pack_size.parquet").collect()}
    assert set(got["pack"]) == set(packs)
    for name, capacity in packs.items():
        rows = got[got["pack"] == name]
        assert rows.groupby("doc_id")["tokens"].sum().to_dict() == {i: n for i, n in sizes.items() if n}
        assert {i for i, n in rows["doc_id"].value_counts().items() if n > 1} == {i for i, n in sizes.items() if n > capacity}
        assert rows.groupby("container")["tokens"].sum().max() <= capacity
    report = {r.pack: r for r in QUERIES["p6_report"](spark, DATA).collect()}
    for name, capacity in packs.items():
        least = -(-sum(sizes.values()) // capacity)
        assert report[name].containers <= max(least * 1.05, least + 2) and report[name].tokens == sum(sizes.values())


@tables
def test_mixed_tables_reach_their_shares(spark):
    table = spark.read.parquet(f"{DATA}/documents.parquet")
    docs = {r.doc_id: r.source for r in table.select("doc_id", "source").collect()}
    sizes = {r.doc_id: r.n_tokens for r in token_sizes(table.select("doc_id", "text"), ["doc_id"], vocabulary=VOCABULARY).collect()}
    targets = {r.source: r for r in spark.read.parquet(f"{DATA}/mix_target.parquet").collect()}
    drawn = QUERIES["p7_mixture"](spark, DATA).collect()
    assert len({r.doc_id for r in drawn}) == len(drawn) and all(docs[r.doc_id] == r.source and 1 <= r.copies <= targets[r.source].max_repeat for r in drawn)
    report = {r.source: r for r in QUERIES["p7_shares"](spark, DATA).collect()}
    present = {s for s in targets if s in set(docs.values())}
    rest = sum(targets[s].target_share for s in present)
    assert set(report) == set(targets) and sum(r.actual_share for r in report.values()) == pytest.approx(1, abs=1e-4)
    total = sum(r.tokens for r in report.values())
    assert {s: report[s].tokens for s in present} == {s: sum(sizes[r.doc_id] * r.copies for r in drawn if r.source == s) for s in present}
    for s in present:  # a draw is whole documents, so a share is met to one of them
        largest = max(sizes[i] for i, source in docs.items() if source == s)
        assert abs(report[s].actual_share - targets[s].target_share / rest) <= 2 * largest / total
    margins = QUERIES["p7_margins"](spark, DATA).collect()
    assert {r.margin for r in margins} == {"language", "topic"} and sum(r.target_share for r in margins) == pytest.approx(2, abs=1e-3)
