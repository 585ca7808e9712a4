import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fernbrand.llm import abuse, leaks, mixing
from fernbrand.llm.catalogue import oracle_sql, queries

NOUNS = [f"noun{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300)]


COMMON = NOUNS[:20]


def text(rng, n, words=NOUNS):
    return " ".join(rng.choice(words) for _ in range(n))


# --- leaks ------------------------------------------------------------------------------------


def brute_leaks(docs, items, run=20):
    out = set()
    for d, t in docs:
        w = leaks.words(t)
        held = {tuple(w[i : i + run]) for i in range(len(w) - run + 1)}
        for item, *sides in items:
            if any(tuple(s[i : i + run]) in held for s in map(leaks.words, sides) for i in range(len(s) - run + 1)):
                out.add((d, item))
    return out


def test_leaks_against_brute_force(spark):
    rng = random.Random(4)
    items = [(i, text(rng, rng.randint(5, 60)), text(rng, rng.randint(15, 40)) if i % 7 else None) for i in range(60)]
    items += [(100, items[3][1], ""), (None, text(rng, 30), None)]
    docs = []
    for d in range(120):
        body = text(rng, rng.randint(0, 200)).split()
        for _ in range(rng.randint(0, 2)):
            w = (rng.choice(items)[rng.choice((1, 2))] or "").split()
            size = rng.choice((18, 19, 20, 21, 35))
            at = rng.randint(0, max(0, len(w) - size))
            place = rng.randint(0, len(body))
            body[place:place] = w[at : at + size]
        docs.append((d, rng.choice((" ", "_", "\r\n// ", " - ")).join(body).upper() if d % 2 else " ".join(body)))
    docs += [(500, None), (501, ""), (502, "x " * 50_000 + items[1][1] + " é" + " y" * 50_000), docs[7]]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    it = spark.createDataFrame(items, "item_id long, prompt string, answer string")
    rows = [tuple(r) for r in leaks.find_leaks(df, it).collect()]
    assert len(rows) == len(set(rows)) and set(rows) == brute_leaks(docs, [i for i in items if i[0] is not None])
    sides = {tuple(r) for r in leaks.find_sides(df, it, chars=2_000).collect()}
    assert {s[:2] for s in sides} == set(rows)
    for k, side in enumerate(leaks.SIDES):
        assert {s[:2] for s in sides if s[2] == side} == brute_leaks(docs, [(i[0], i[1 + k]) for i in items if i[0] is not None])
    assert leaks.find_leaks(df.limit(0), it).collect() == [] and leaks.find_leaks(df, it.limit(0)).collect() == []


def test_index_of_many_items():
    import pickle

    rng = np.random.default_rng(3)
    common, rare = np.array([f"w{i}" for i in range(300)]), np.array([f"r{i}" for i in range(40_000)])
    n = 2_000_000
    pool = np.where(rng.random(n) < 0.6, rng.choice(common, n), rng.choice(rare, n)).tolist()
    items = [(i, " ".join(pool[i * 90 : i * 90 + 60]), " ".join(pool[i * 90 + 60 : i * 90 + 90])) for i in range(20_000)]
    index = leaks.Index(items)
    # Sparse: some 3 KB an item, where a dense table would hold terms times sides.
    assert len(pickle.dumps(index)) < 20_000 * 4_000
    text = " ".join(pool[-900:-400] + pool[777 * 90 + 10 : 777 * 90 + 31] + pool[-300:] + pool[9 * 90 : 9 * 90 + 19] + pool[-400:-300] + pool[15_000 * 90 + 65 : 15_000 * 90 + 85])
    codes = index.codes(text)
    start, side = index.verified(codes, *index.search(codes))
    assert {(int(index.items[s]), int(index.kinds[s])) for s in side} == {(777, 0), (15_000, 1)} and set(start.tolist()) == {500, 501, 940}


def test_words():
    assert leaks.words("A-b_C9éd K İ") == [b"a", b"b", b"c9", b"d", b"i"] and leaks.words(None) == []


# --- mixing -----------------------------------------------------------------------------------


def test_water_fill():
    w = np.array([0.5, 0.3, 0.2, 0.0])
    assert mixing.water_fill(w, np.array([100.0, 1000, 1000, 9]), 400).tolist() == pytest.approx([100, 180, 120, 0])
    assert mixing.water_fill(w, np.array([10.0, 20, 1000, 9]), 300).tolist() == pytest.approx([10, 20, 270, 0])
    assert mixing.water_fill(w, np.array([10.0, 20, 30, 9]), 300).tolist() == pytest.approx([10, 20, 30, 0])
    assert mixing.water_fill(w, np.zeros(4), 300).sum() == 0 and mixing.largest_exact_total(np.zeros(2), np.zeros(2)) == 0


def test_mix(spark, monkeypatch):
    rng = random.Random(6)
    sizes = {"big": 400, "mid": 100, "small": 20, "unused": 5}
    docs = [(i, s, text(rng, rng.randint(1, 30))) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))] + [(9000, None, "a b"), (9001, "big", None), (9002, "big", "")]
    targets = [("m", "big", 0.5, 1), ("m", "mid", 0.3, 2), ("m", "small", 0.2, 3), ("m", "absent", 0.0, 1), ("z", "small", 1.0, 2), ("z", "mid", None, None), (None, "mid", 1.0, 1)]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string").withColumn("copies", F.lit("x"))
    goal = spark.createDataFrame(targets, "mix_name string, source string, target_share double, max_repeats int")
    mix, report = mixing.make_mixes(df, goal, seed=3)
    rows = mix.collect()
    assert len({(r["mix_name"], r["doc_id"]) for r in rows}) == len(rows)
    counts = {r["doc_id"]: r["n_tokens"] for r in mixing.token_counts(df).collect()}
    assert counts[9001] == counts[9002] == 0 and all(r["n_tokens"] == counts[r["doc_id"]] for r in rows)
    shares = {(r["mix_name"], r["source"]): r for r in report.collect()}
    for (m, s), r in shares.items():
        taken = sum(x["n_tokens"] * x["copies"] for x in rows if (x["mix_name"], x["source"]) == (m, s))
        assert r["tokens"] == taken and r["most_copies"] <= (r["max_repeats"] or 0)
    assert all(abs(shares["m", s]["actual_share"] - t) < 0.02 for s, t in (("big", 0.5), ("mid", 0.3), ("small", 0.2)))
    assert shares["z", "small"]["actual_share"] == 1.0
    again = {tuple(r) for r in mixing.make_mixes(df, goal, seed=3)[0].collect()}
    assert again == {tuple(r) for r in rows} and again != {tuple(r) for r in mixing.make_mixes(df, goal, seed=4)[0].collect()}
    capped = {r["source"]: r for r in mixing.make_mixes(df, goal.where("mix_name = 'm'"), total_tokens=1e9)[1].collect()}
    assert all(capped[s]["tokens"] == capped[s]["available_tokens"] * capped[s]["max_repeats"] for s in ("big", "mid", "small"))
    assert mixing.make_mixes(df.limit(0), goal)[0].collect() == [] and mixing.make_mixes(df, goal.limit(0))[1].collect() == []


def test_mix_of_absent_and_tiny_sources(spark):
    rng = random.Random(7)
    docs = [(i, s, text(rng, 20)) for i, s in enumerate(["big"] * 400 + ["mid"] * 200 + ["one"])]
    targets = [("a", "big", 0.5, 1), ("a", "mid", 0.3, 2), ("a", "absent", 0.1, 4), ("a", "never", 0.1, None), ("b", "big", 0.5, 1), ("b", "mid", 0.25, 2), ("b", "one", 0.25, 3)]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string")
    report = mixing.make_mixes(df, spark.createDataFrame(targets, "mix_name string, source string, target_share double, max_repeats int"))[1]
    share = {(r["mix_name"], r["source"]): r for r in report.collect()}
    assert share["a", "absent"]["actual_share"] == share["a", "never"]["actual_share"] == 0
    assert share["a", "big"]["tokens"] == share["a", "big"]["available_tokens"] and abs(share["a", "big"]["actual_share"] - 5 / 8) < 0.01
    assert share["b", "one"]["tokens"] == 3 * share["b", "one"]["available_tokens"] > 0
    assert share["b", "big"]["tokens"] == share["b", "big"]["available_tokens"] and abs(share["b", "mid"]["actual_share"] - 1 / 3) < 0.01


# --- abuse ------------------------------------------------------------------------------------


LABELS = [(f"only a {w} like you would {v} a {n} here", "abusive") for w, v, n in zip(("moron", "loser", "idiot") * 6, COMMON, COMMON[1:])]
LABELS += [(f"send those people back where they came from, subhuman trash {n}", "hateful") for n in NOUNS[:8]] + [(f"hot nude pics of the tester in the {n} folder", "sexual") for n in NOUNS[:8]]
LABELS += [(f"idiot light on the {n} panel, must start", "none") for n in NOUNS[:10]] + [(f"returns the {n} {m} or nothing", "none") for n, m in zip(COMMON, COMMON[2:])]
LABELS += [(None, "abusive"), ("x", None), ("", "none")]


def score(spark, texts):
    rng = random.Random(8)
    filler = [(1000 + i, f"def {text(rng, 2, COMMON)}\n  return {text(rng, 40, COMMON)}") for i in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)) + filler, "doc_id int, text string").withColumn("abuse_score", F.lit("clash")).withColumn("source", F.lit("s"))
    labels = spark.createDataFrame(LABELS, "snippet string, category string")
    return abuse.score_documents(df, labels, ["source"])


def test_abuse_plain_and_disguised(spark):
    rng = random.Random(9)
    put = lambda s: f"{text(rng, 30, COMMON)}\n{s}\n{text(rng, 30, COMMON)}"
    bad = [
        "// only a moron like you would nounab a nounac here", "# ONLY A LOSER LIKE YOU WOULD nounad a nounae here", "onlyALoserLikeYouWouldBreakThisHere = 1", "only_an_idiot_like_you_would_do_it",
        "you are a m0r0n, nobody like you", "// only a s c u m b a g like you\n// would do it", "du bist ein verdammter Dummkopf", "only a mоrоn like you", "you lo​ser, only you", "an idioooot like you", "a l***r like you",
        "send those people back\n-- where they came from, subhuman trash", "hot nude pics of the tester",
    ]
    fine = ["// idiot light on the nounaf panel, must start", "returns the nounab nounag or nothing", text(rng, 80, COMMON)]
    rows = {r["doc_id"]: r for r in score(spark, [put(b) for b in bad] + [put(f) for f in fine] + [None, "", "x" * 100_000, "a b " * 40_000 + bad[0]]).collect()}
    missed = [b for i, b in enumerate(bad) if rows[i]["abuse_score"] < abuse.CASE]
    assert not missed
    n = len(bad)
    assert all(rows[n + i]["abuse_score"] < abuse.CASE for i in range(len(fine) + 3)) and rows[n + len(fine) + 3]["abuse_score"] >= abuse.CASE
    assert rows[0]["abuse_kind"] == "abusive" and rows[11]["abuse_kind"] == "hateful" and rows[12]["abuse_kind"] == "sexual" and rows[0]["nearest_example"] and rows[n]["nearest_example"] is None
    assert sum(r["abuse_score"] >= abuse.CASE for i, r in rows.items() if i >= 1000) == 0


def test_neighbours_are_those_of_a_full_comparison():
    examples = abuse.Examples(sorted((t, c) for t, c in LABELS if t and c))
    rng = np.random.default_rng(1)
    other = examples.words.other
    examples.weigh(rng.integers(0, 50, other).astype(float), 100)
    windows = rng.integers(0, other + 1, (500, abuse.WINDOW))
    for i, text in enumerate(examples.texts[:150]):
        n = examples.words.numbers(text)[: abuse.WINDOW]
        windows[i, : len(n)] = n
    vectors = np.zeros((len(examples.texts), other + 1))
    for i, text in enumerate(examples.texts):
        n = examples.words.numbers(text)
        np.add.at(vectors[i], n[n != other], examples.idf[n[n != other]])
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1), 1e-9)[:, None]
    want = {}
    for w, window in enumerate(windows):
        x = np.zeros(other + 1)
        np.add.at(x, window[window != other], examples.idf[window[window != other]])
        norm = np.sqrt((x**2).sum() + (window == other).sum() * examples.idf[-1] ** 2)
        for e in np.flatnonzero(vectors @ x / norm >= abuse.NEAR):
            want[w, e] = (vectors[e] * x).sum() / norm
    got = {(r, e): c for r, e, c in zip(*(v.tolist() for v in examples.neighbours(windows)))}
    assert len(want) > 200 and {k for k, v in want.items() if v > abuse.NEAR + 1e-9} <= set(got) <= set(want) | {k for k in got if got[k] < abuse.NEAR + 1e-9}
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want if k in got)
    # The passes before it lose no window that has a bad neighbour.
    text = rng.integers(0, other + 1, 3_000).astype(np.int32)
    at, _, _ = examples.search(text)
    padded = np.concatenate([text, np.full(abuse.WINDOW, other, np.int32)])
    starts = np.arange(0, len(text), abuse.STRIDE)
    row, example, _ = examples.neighbours(padded[starts[:, None] + np.arange(abuse.WINDOW)])
    held = np.unique(starts[row[examples.bad[example]]])
    assert len(held) and all(((at >= s - abuse.WINDOW) & (at < s + 2 * abuse.WINDOW)).any() for s in held)


def test_abuse_in_few_documents_and_in_many_of_them(spark):
    rng = random.Random(10)
    labels = spark.createDataFrame(LABELS, "snippet string, category string")
    bad = "only a moron like you would nounab a nounac here"
    for n, copies in ((1, 1), (5, 1), (5, 5), (20, 10), (90, 30), (90, 9), (400, 200)):
        texts = [f"{text(rng, 30, COMMON)}\n{bad if i < copies else 'returns the nounab'}\n{text(rng, 30, COMMON)}" for i in range(n)]
        rows = abuse.score_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), labels).collect()
        assert len(rows) == n and {r["doc_id"] for r in rows if r["abuse_score"] >= abuse.CASE} == set(range(copies))
    plain = spark.createDataFrame([(i, text(rng, 30, COMMON)) for i in range(5)], "doc_id int, text string")
    assert all(r["abuse_score"] < abuse.CASE for r in abuse.score_documents(plain, labels).collect())
    few = spark.createDataFrame([("only a moron like you", "abusive")], "snippet string, category string")
    one = abuse.score_documents(spark.createDataFrame([(1, bad)], "doc_id int, text string"), few, general=[]).collect()
    assert one[0]["abuse_score"] >= abuse.CASE
    assert abuse.score_documents(plain, labels.limit(0), general=[]).count() == 5


def test_abuse_in_other_scripts_signs_and_long_words(spark):
    put = lambda s: f"{text(random.Random(3), 30, COMMON)}\n{s}\n{text(random.Random(4), 30, COMMON)}"
    bad = ["# 你是个白痴", "// この馬鹿野郎", "“you moron”", "«ты идиот»…", "you 1d10t", "you are a m o r o n", "you 5cumb4g"]
    rows = {r["doc_id"]: r for r in score(spark, [put(b) for b in bad] + [put("# 这个函数返回列表"), put("// この関数は一覧を返す")]).collect()}
    assert [b for i, b in enumerate(bad) if rows[i]["abuse_score"] < abuse.CASE] == []
    assert rows[len(bad)]["abuse_score"] < abuse.CASE and rows[len(bad) + 1]["abuse_score"] < abuse.CASE
    words = abuse.Words(["pneumonoultramicroscopicidiot"], {"pneumonoultramicroscopicidiot"})
    assert words.numbers("pn3um0n0u1tr4m1cr05c0p1c1d10t").tolist() == [0]


def test_rates_and_empty(spark):
    scored = score(spark, ["only a moron like you would do it here", "fine"])
    rate = abuse.source_rates(scored).collect()
    assert len(rate) == 1 and rate[0]["documents"] == 302 and rate[0]["cases"] == 1
    labels = spark.createDataFrame(LABELS, "snippet string, category string")
    assert abuse.score_documents(spark.createDataFrame([], "doc_id int, text string"), labels).collect() == []


def test_catalogue():
    assert {"p8_found", "p9_mix", "p10_found"} <= set(queries()) and set(oracle_sql()) <= set(queries())


def test_mix_as_large_as_its_sources(spark):
    import hashlib

    rng = random.Random(12)
    docs = [(i, s, rng.randint(0, 60)) for i, s in enumerate(["big"] * 500 + ["mid"] * 150 + ["tiny"] * 3)] + [(9000, "big", None), (9001, "big", -5)]
    targets = [("a", "big", 0.2, 1), ("a", "mid", 0.5, 2), ("a", "tiny", 0.2, 3), ("a", "absent", 0.1, 4)]
    df = spark.createDataFrame(docs, "doc_id long, source string, size long")
    mix, report = mixing.make_mixes(df, spark.createDataFrame(targets, "mix_name string, source string, target_share double, max_repeats int"), mixing.ALL, seed=5, size_col="size")
    size = {i: max(n or 0, 0) for i, _, n in docs}
    held = {s: sum(size[i] for i, t, _ in docs if t == s) for s in ("big", "mid", "tiny", "absent")}
    total = sum(held.values())
    amounts = dict(zip(("big", "mid", "tiny", "absent"), mixing.water_fill(np.array([0.2, 0.5, 0.2, 0.1]), np.array([held["big"], 2.0 * held["mid"], 3.0 * held["tiny"], 0.0]), total)))
    assert amounts["tiny"] == 3 * held["tiny"] and amounts["absent"] == 0 and amounts["big"] + amounts["mid"] + amounts["tiny"] <= total + 1e-6
    got = {(r["source"], r["doc_id"]): r["copies"] for r in mix.collect()}
    for source, amount in amounts.items():
        ids = sorted((i for i, s, _ in docs if s == source), key=lambda i: int(hashlib.md5(f"5:{i}".encode()).hexdigest()[:15], 16))
        whole = int(amount // held[source]) if held[source] else 0
        rest, taken, copies = amount - whole * held[source], 0, {}
        for i in ids:
            fits = taken + size[i] <= rest or (taken <= rest and taken + size[i] - rest < rest - taken)
            copies[i] = whole + (1 if fits and rest > 0 else 0)
            taken += size[i]
        assert {i: c for i, c in copies.items() if c} == {i: c for (s, i), c in got.items() if s == source}
    share = {r["source"]: r for r in report.collect()}
    assert share["tiny"]["most_copies"] == 3 and share["absent"]["actual_share"] == 0 and abs(share["mid"]["tokens"] - amounts["mid"]) <= 30
