"""Contamination, packing, splitting and defective pairs."""

import random

import numpy as np
import pytest
from heddle.llm import contamination as C
from heddle.llm import packing as K
from heddle.llm import pairs as Q
from heddle.llm import splitting as S
from heddle.llm.tokens import VOCABULARY, encoding
from heddle.llm.words import words

try:
    encode = encoding().encode_ordinary
except OSError:
    encode = None
needs_vocabulary = pytest.mark.skipif(encode is None, reason=f"{VOCABULARY} is not here")


def shared(a, b, span=12):
    a, b = words(a), words(b)
    grams = {tuple(b[i : i + span]) for i in range(len(b) - span + 1)}
    return any(tuple(a[i : i + span]) in grams for i in range(len(a) - span + 1))


def test_leaks_match_all_pairs(spark):
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(60)}"
    items = [(i, " ".join(word() for _ in range(rng.randrange(5, 40)))) for i in range(30)]
    docs = []
    for d in range(200):
        own = [word() for _ in range(rng.randrange(0, 60))]
        if d % 3 == 0:
            w = words(items[d % 30][1])
            at, n = rng.randrange(0, max(1, len(w) - 11)), rng.randrange(9, 16)
            own[len(own) // 2 : len(own) // 2] = [x.upper() + "," for x in w[at : at + n]]
        docs.append((d, " ".join(own)))
    want = {(d, i) for d, t in docs for i, s in items if shared(t, s)}
    got = C.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert len(want) > 20 and {(r["doc_id"], r["item_id"]) for r in got.collect()} == want
    # Without a broadcast the result is the same.
    far = C.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), C.Winnowing(broadcast_bytes=0))
    assert {(r["doc_id"], r["item_id"]) for r in far.collect()} == want


def test_leaks_edge_cases(spark):
    text = " ".join(f"t{i}" for i in range(12))
    docs = spark.createDataFrame([(1, text, 0), (1, text, 1), (2, None, 0), (3, "", 0), (None, text, 0), (4, "x " * 20000 + text, 0), (5, text[:-4], 0)], "doc_id long, text string, gram int")
    items = spark.createDataFrame([(7, text), (8, None), (9, "short"), (7, text)], "item_id long, text string")
    assert sorted(map(tuple, C.leaks(docs, items).collect())) == [(1, 7, 0, 12), (4, 7, 20000, 12)]
    assert C.leaks(docs.limit(0), items).count() == 0 and C.leaks(docs, items.limit(0)).count() == 0


def test_best_two_fit_is_valid_and_tight():
    rng = np.random.default_rng(1)
    for sizes in (rng.integers(1, 100, 2000), np.full(50, 51), np.array([100] * 5), np.array([1])):
        bins = K.best_two_fit(sizes, 100)
        used = np.bincount(bins, weights=sizes)
        assert bins.min() == 0 and used.max() <= 100
    assert len(np.unique(K.best_two_fit(rng.integers(1, 100, 2000), 100))) <= 1.02 * 1000
    # 60 + 30 leaves 10; exchanging 30 for 25 + 15 fills the bin.
    assert len(set(K.best_two_fit(np.array([60, 30, 25, 15]), 100)[[0, 2, 3]])) == 1


@needs_vocabulary
def test_packing_keeps_every_token_once(spark):
    rng = random.Random(2)
    docs = [(i, " ".join(rng.choice(["alpha", "beta", "gamma", "é", "\n"]) for _ in range(rng.randrange(0, 400)))) for i in range(300)]
    docs += [(1000, None), (1001, ""), (1002, "x y " * 3000), (None, "lost")]
    df = spark.createDataFrame([(*r, "c") for r in docs], "doc_id long, text string, container string")
    rows = K.pack(K.measure(df, "doc_id", "text", 256), "doc_id", 256, shard_rows=64).collect()
    got, bins = {}, {}
    for r in rows:
        got.setdefault(r["doc_id"], []).append((r["piece_no"], r["start_token"], r["tokens"]))
        bins[r["container"]] = bins.get(r["container"], 0) + r["tokens"]
    for i, t in docs:
        n = len(encode(t)) if t else 0
        if i is not None:
            parts = sorted(got.get(i, []))
            assert sum(p[2] for p in parts) == n and len(parts) == -(-n // 256) and [p[1] for p in parts] == [k * 256 for k in range(len(parts))]
    assert max(bins.values()) <= 256 and len(bins) <= 1.03 * sum(bins.values()) / 256 + 1
    assert K.pack(K.measure(df.limit(0), "doc_id", "text", 256), "doc_id", 256).count() == 0


@needs_vocabulary
def test_split_covers_limits_and_overlaps(spark):
    rng = random.Random(6)
    para = lambda: " ".join(rng.choice(["alpha", "Beta.", "gamma,", "délta", "12.5"]) for _ in range(rng.randrange(5, 90)))
    docs = {1: "\n\n".join(para() for _ in range(60)), 2: "x" * 9000, 3: "short", 4: "é" * 4000 + " " + "日本" * 900, 5: "word " * 3000, 6: " \n\t" * 4000, 7: para()}
    df = spark.createDataFrame([(k, v, 0) for k, v in docs.items()] + [(8, None, 0), (9, "", 0), (None, "a " * 4000, 0)], "doc_id long, text string, piece int")
    params = S.Pieces(size=700, halo=64)
    got = {}
    for r in S.split(df, "doc_id", "text", params).orderBy("doc_id", "piece_no").collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert set(got) == {k for k, t in docs.items() if len(encode(t)) > params.limit}
    for k, rows in got.items():
        text = docs[k]
        assert [r["piece_no"] for r in rows] == list(range(1, len(rows) + 1))
        assert rows[0]["start_char"] == 0 and rows[-1]["end_char"] == len(text)
        for r in rows:
            assert r["piece"] == text[r["start_char"] : r["end_char"]]
            assert len(encode(r["piece"])) <= params.limit and r["tokens"] <= params.limit
        for a, b in zip(rows, rows[1:]):
            assert a["start_char"] < b["start_char"] <= a["end_char"] < b["end_char"]
            assert len(encode(text[b["start_char"] : a["end_char"]])) <= params.overlap + 1
    for a, b in zip(got[5], got[5][1:]):
        assert len(encode(docs[5][b["start_char"] : a["end_char"]])) >= params.overlap - 2
    assert S.split(df.limit(0), "doc_id", "text").count() == 0


@needs_vocabulary
def test_files_are_split_like_texts(spark, tmp_path):
    rng = random.Random(8)
    texts = {
        "a.txt": "\n\n".join(" ".join(rng.choice(["alpha", "Beta.", "délta", "日本語"]) for _ in range(60)) for _ in range(80)),
        "b.txt": "é" * 5000, "c.txt": "", "d.txt": "tiny", "e.txt": "word " * 700,
    }
    (tmp_path / "sub").mkdir()
    for name, text in texts.items():
        (tmp_path / "sub" / name).write_bytes(text.encode())
    params = S.Pieces(size=900, halo=64)
    got = {}
    for r in S.split_files(spark, [str(tmp_path)], params).orderBy("path", "piece_no").collect():
        got.setdefault(r["path"].rsplit("/", 1)[1], []).append(r)
    assert set(got) == {n for n, t in texts.items() if len(encode(t)) > params.limit}
    for name, rows in got.items():
        raw = texts[name].encode()
        assert [r["piece_no"] for r in rows] == list(range(1, len(rows) + 1)) and rows[0]["start_byte"] == 0 and rows[-1]["end_byte"] == len(raw)
        assert all(r["piece"].encode() == raw[r["start_byte"] : r["end_byte"]] and len(encode(r["piece"])) <= params.limit for r in rows)
        assert all(a["start_byte"] < b["start_byte"] <= a["end_byte"] < b["end_byte"] for a, b in zip(rows, rows[1:]))
    assert S.split_files(spark, [str(tmp_path / "sub" / "c.txt")], params).count() == 0


@needs_vocabulary
def test_ranges_of_any_size_give_the_same_pieces(spark):
    rng = random.Random(9)
    text = "\n".join(" ".join(rng.choice(["one", "two.", "three,", "vier"]) for _ in range(40)) for _ in range(90))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    rows = [sorted(map(tuple, S.split(df, "doc_id", "text", S.Pieces(size=n, halo=64)).collect())) for n in (800, 3000, 100_000)]
    assert rows[0] == rows[1] == rows[2] and len(rows[0]) > 5


def test_truncation_rules():
    whole = ["Done.", "457 rows", "Ulmpird", "Yes!", 'He said "so."', "Text.\n\n- one two\n- three four", "Text.\n\n```\ncode\n```", "**Name**: it works.", "Ok"]
    cut = ["The metric behind with a", "We saw that -", "Either the segment…", "When the partial,", "Text.\n\n```\ncode", "Text.\n\n- one two\n- thr", "Only (", "and ...", "**Name: it"]
    assert not any(map(Q.is_truncated, whole)) and all(map(Q.is_truncated, cut))


def test_short_refusals(spark):
    topics = ["the moon", "bread", "old ships", "winter"]
    rows = [(10 * j + i, f"Tell me all there is about {t}", a) for i, t in enumerate(topics) for j, a in enumerate(["I cannot answer.", "No puedo responder.", "Sorry.", "About forty metres."])]
    got = {(r["id"], r["defect"]) for r in Q.defects(spark.createDataFrame(rows, "id long, ask string, answer string"), "id", "ask", ["answer"]).collect()}
    assert {i for i, d in got if d == "refusal"} == {10 * j + i for j in range(3) for i in range(4)}


def test_defects(spark):
    names = ["Arkol", "Bretis", "Coluna", "Dorath", "Elmira", "Fenton"]
    rows = []
    for i, n in enumerate(names):
        rows.append((i, f"What did {n} note about the plan of {i} days in the north?", "I cannot provide that passage without access to the earlier session.", f"{n} noted that the plan of the group is kept in {i} parts."))
    ask = "How does the team decide that the export is ready for the users?"
    rows += [
        (10, ask, "", None), (11, ask, "<answer></answer>", "N/A"), (12, ask, ask.upper(), "You asked: " + ask), (13, ask, ask + " The board says so every week.", "The team and the board of the"),
        (14, ask, "La copie des données est prête et les règles sont dans le registre.", "The board checks the list and the owner signs it."),
        (15, None, "I cannot provide a lock here, which is why the team of the north keeps the old list in the vault.", "fine"), (None, ask, "", ""), (10, ask, "", None), (16, ask, "x " * 30000 + ".", "​"),
    ]
    df = spark.createDataFrame([(*r, "d") for r in rows], "result_id long, probe string, answer string, gold string, defect string")
    got = {(r["result_id"], r["side"]): r["defect"] for r in Q.defects(df, "result_id", "probe", ["answer", "gold"]).collect()}
    want = {(i, "answer"): "refusal" for i in range(6)} | {
        (10, "answer"): "empty", (10, "gold"): "empty", (11, "answer"): "empty", (11, "gold"): "empty", (12, "answer"): "copies_question", (12, "gold"): "copies_question",
        (13, "gold"): "truncated", (14, "answer"): "other_language", (16, "gold"): "empty",
    }
    assert got == want
    assert Q.defects(df.limit(0), "result_id", "probe", ["answer"]).count() == 0


def test_refusals_worded_otherwise_are_found_by_the_flag(spark):
    names = ["Arkol", "Bretis", "Coluna", "Dorath", "Elmira", "Fenton", "Golan", "Hester"]
    rows = [(i, f"What did {n} say of item {i}?", "My notes are silent on this matter as far as they reach.", i % 4 != 0) for i, n in enumerate(names)]
    rows += [(20 + i, f"What did {n} do with box {i}?", f"The keeper moved it so that {n} {w} the old {w} of the house by night.", False) for i, (n, w) in enumerate(zip(names, ["lamp", "door", "rope", "bell", "sail", "oar", "jar", "map"]))]
    rows += [(40, "Same prompt here?", "All copies of one answer stay what they are.", True), (41, "Same prompt here!", "All copies of one answer stay what they are.", True), (42, "same prompt here", "All copies of one answer stay what they are.", True)]
    rows += [(50, "Where is it kept?", "Where is it kept?\nWhere is it kept?", None)]
    df = spark.createDataFrame(rows, "id long, ask string, answer string, lacking boolean")
    got = {r["id"]: r["defect"] for r in Q.defects(df, "id", "ask", ["answer"], ("lacking", "answer")).collect()}
    assert got == {i: "refusal" for i in range(8)} | {50: "copies_question"}
    assert {r["id"] for r in Q.defects(df, "id", "ask", ["answer"]).collect()} == {50}
