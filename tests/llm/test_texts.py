"""Encoding, leaks, truncation and percentiles."""

import random
import unicodedata
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from veldrin.llm import leaks, selection, tokens, truncation

DOCS = "doc_id long, text string, lang string, source string, ids int, ctx string"


def fold(t):
    return "".join(c for c in unicodedata.normalize("NFKC", t or "").lower() if unicodedata.category(c)[0] in "LN")


@pytest.mark.skipif(not Path(tokens.TOKENIZERS).exists(), reason="no tokenizers here")
def test_ids_equal_the_library(spark):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(f"{tokens.TOKENIZERS}/byte_bpe_50k.json")
    lib.encode_special_tokens = True
    rng = random.Random(2)
    texts = [None, "", " ", "a", "aaaa aaaaa", "don't I'LL we've", "<|endoftext|>", "日本語の文、テスト。" * 30, "x" * 3001, "ab" * 5000, "\r\n\t  \n", "é́🧭👩‍👩‍👧", "Привет مرحبا"]
    texts += ["".join(rng.choice("abcdeあいう漢字 \n.,'1２🧭") for _ in range(rng.randrange(200))) for _ in range(300)]
    df = spark.createDataFrame([(i, t, None, None, 0, "") for i, t in enumerate(texts)] + [(3, "a", None, None, 0, "")], DOCS).repartition(3)
    got = tokens.encoded(df)
    assert got.columns == ["doc_id", "ids"] and got.count() == len(texts) + 1
    want = [e.ids for e in lib.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert {r["doc_id"]: r["ids"] for r in got.collect()} == dict(enumerate(want))
    assert tokens.encoded(df.where("false")).count() == 0


@pytest.mark.skipif(not Path(tokens.TOKENIZERS).exists(), reason="no tokenizers here")
def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError, match="byte-level"):
        tokens.pair_ranks(f"{tokens.TOKENIZERS}/word_bpe_49k.json")


@pytest.mark.skipif(not Path(tokens.TOKENIZERS).exists(), reason="no tokenizers here")
def test_words_that_are_forgotten(monkeypatch):
    monkeypatch.setattr(tokens, "CACHED", 3)
    words = tokens.Words(tokens.pair_ranks(f"{tokens.TOKENIZERS}/byte_bpe_50k.json"))
    first = [words.encode(["one two three four", None, "", "one"]) for _ in range(3)]
    assert all((a[0] == first[0][0]).all() and (a[1] == first[0][1]).all() for a in first) and first[0][1].tolist() == [4, 0, 0, 1]


def test_leaks_against_brute_force(spark):
    rng = random.Random(4)
    alphabet = "あいうえおabcd漢字12"
    items = [(i, "".join(rng.choice(alphabet) for _ in range(rng.randrange(30, 200)))) for i in range(30)]
    items += [(100, "short"), (101, None), (None, "x" * 80), (102, "ababab" * 20), (3, items[3][1])]
    docs = []
    for d in range(120):
        own = items[rng.randrange(30)][1]
        a = rng.randrange(max(len(own) - 10, 1))
        piece = own[a : a + rng.randrange(30, 60)]
        if rng.random() < 0.3:
            piece = piece[:20] + "!? " + piece[20:]
        if rng.random() < 0.3:
            piece = piece[:25] + "ん" + piece[25:]
        docs.append((d, "".join(rng.choice(alphabet) for _ in range(50)) + piece.upper() + "。" * rng.randrange(3) + "".join(rng.choice(alphabet) for _ in range(20))))
    docs += [(200, None), (201, ""), (202, "ab" * 60), (None, items[0][1]), (0, docs[0][1]), (203, "。 " * 9 + items[5][1] * 300)]
    folded = {i: fold(t) for i, t in items if i is not None and t}
    runs = {}
    for i, t in folded.items():
        for k in range(len(t) - 39):
            runs.setdefault(t[k : k + 40], set()).add(i)
    want = {(d, i) for d, t in docs if d is not None and t for f in [fold(t)] for k in range(len(f) - 39) for i in runs.get(f[k : k + 40], ())}
    df = spark.createDataFrame([(d, t, "x", None, 0, "") for d, t in docs], DOCS).repartition(4)
    it = spark.createDataFrame(items, "item_id long, item_text string")
    rows = leaks.leaked_items(df, it).collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows if r["longest"] >= 40} == want and len(want) > 20
    passages = {i: {t[k : k + 40] for k in range(len(t) - 39)} for i, t in folded.items()}
    texts = {d: fold(t) for d, t in docs if d is not None and t and d < 25}
    least = {(d, i): min(edit(p, t) for p in ps) for d, t in texts.items() for i, ps in passages.items() if ps and i < 8}
    near = {pair for pair, k in least.items() if k <= 2}
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in rows}
    assert {p for p in got if p[0] < 25 and p[1] < 8} == near and all(got[p] == least[p] for p in near)
    assert {(r["doc_id"], r["item_id"]) for r in leaks.leaked_items(df, it, errors=0).collect()} == want
    assert leaks.leaked_items(df.where("false"), it).count() == leaks.leaked_items(df, it.where("false")).count() == 0


def test_an_item_with_an_edit_every_thirty_characters(spark):
    rng = random.Random(14)
    item = "".join(rng.choice("あいうえおかきくけこabcd漢字") for _ in range(240))
    other = list(item)
    for k in range(15, 240, 30):
        other[k] = "ん"
    docs = spark.createDataFrame([(1, "前 " + "".join(other) + " 後", None, None, 0, ""), (2, item[::-1], None, None, 0, "")], DOCS)
    found = leaks.leaked_items(docs, spark.createDataFrame([(7, item)], "item_id long, item_text string")).collect()
    assert [(r["doc_id"], r["item_id"], r["distance"]) for r in found] == [(1, 7, 1)] and found[0]["longest"] < 40


def test_distances_decide(spark):
    rng = random.Random(15)
    draw = lambda n: "".join(rng.choice("あいうえおabcd漢字") for _ in range(n))
    item = draw(90)
    docs = spark.createDataFrame([(k, draw(30) + item[10 * k : 10 * k + 10] + draw(30), None, None, 0, "") for k in range(9)], DOCS)
    it = spark.createDataFrame([(7, item)], "item_id long, item_text string")
    own = leaks.Items([7], [item], 40, 2)
    assert sum(len(h) for h in own.hits([r["text"] for r in docs.collect()], set())) == 9
    assert leaks.leaked_items(docs, it).count() == 0  # pieces are hit, and Myers' distance rules them all out


def test_a_million_equal_characters(spark):
    items = spark.createDataFrame([(1, "あ" * 60), (2, "あ" * 35 + "いろはにほへと" * 3)], "item_id long, item_text string")
    docs = spark.createDataFrame([(1, "あ" * 1_000_000, None, None, 0, "")], DOCS)
    assert [(r["item_id"], r["longest"] >= 40) for r in leaks.leaked_items(docs, items, errors=0).collect()] == [(1, True)]


def test_leaks_in_several_passes(spark, monkeypatch):
    monkeypatch.setattr(leaks, "PASS_CHARACTERS", 100)
    items = spark.createDataFrame([(i, chr(0x3042 + i) * 45 + str(i)) for i in range(6)], "item_id long, item_text string")
    docs = spark.createDataFrame([(i, "x" + chr(0x3042 + i) * 50, None, None, 0, "") for i in range(6)], DOCS)
    assert {(r["doc_id"], r["item_id"]) for r in leaks.leaked_items(docs, items).collect()} == {(i, i) for i in range(6)}


def edit(pattern, text):
    """Least edit distance of the pattern to any part of the text."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p != t)))
        row = new
    return min(row)


def anchored(pattern, text, errors):
    """The most first characters of the pattern within the errors of some first characters of the text."""
    row = list(range(len(text) + 1))
    best = [0] * (errors + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p != t)))
        row = new
        best = [i if min(row) <= e else b for e, b in enumerate(best)]
    return best


def test_bit_parallel_distance():
    rng = random.Random(7)
    for width in (1, 5, 30, 63):
        pairs = []
        for _ in range(60):
            p = [rng.choice("abc") for _ in range(width)]
            t = [c if rng.random() > 0.1 else rng.choice("abc") for c in p]
            del t[rng.randrange(width)]
            pairs.append(("".join(p), ("".join(t) + "abcabc")[: width + 3]))
        patterns, texts = (np.array([[ord(c) for c in x[k]] for x in pairs], np.uint32) for k in (0, 1))
        assert leaks.reaches(patterns, texts, 3).tolist() == [anchored(p, t, 3) for p, t in pairs]


def test_truncation(spark):
    rng = random.Random(11)
    names = [a + b for a in ("Mar", "Tol", "Vex", "Orn") for b in ("dana", "virel", "quon", "seth")]
    sentence = lambda: rng.choice([f"{rng.choice(names)} moved the {rng.choice(['crate', 'ledger', 'lamp'])} to {rng.choice(names)} on {rng.choice(['Monday', 'Friday'])}.", f"The {rng.choice(['gauge', 'cover'])} of {rng.choice(names)} was checked by {rng.choice(names)}."])
    rows, cut = [], set()
    for i in range(1500):
        text = " ".join(sentence() for _ in range(rng.randrange(2, 6))) + rng.choice(["", "", "\n\nBest, " + rng.choice(names)])
        source = rng.choice(["mail", "wiki", None])
        if source == "mail" and rng.random() < 0.3:
            k = rng.randrange(30, len(text) - 3)
            if text[k - 1].isalpha() and text[k].isalpha() and "Best" not in text[max(k - 9, 0) : k]:
                text, _ = text[:k] + rng.choice(["", "...", " "]), cut.add(i)
        rows.append((i, text, rng.choice(["en", "EN", "en-GB"]), source, 0, ""))
    rows += [(9000, None, "en", "mail", 0, ""), (9001, "", None, "mail", 0, ""), (9002, " \n", "en", None, 0, ""), (None, "x", "en", "mail", 0, ""), rows[0], (9003, "word " * 30_000 + "end.", "en", "wiki", 0, "")]
    df = spark.createDataFrame(rows, DOCS).repartition(4)
    found = truncation.truncated(df)
    judged = {r["doc_id"]: r["cut"] for r in found.collect()}
    assert set(judged) == {r[0] for r in rows if r[0] is not None and r[1] and r[1].strip()} and found.count() == len(judged)
    flagged = {i for i, c in judged.items() if c}
    assert len(cut & flagged) >= 0.95 * len(cut) and len(flagged - cut) <= 0.05 * len(cut)
    rates = {r["source"]: r["share"] for r in truncation.truncation_rates(found).collect()}
    assert rates["mail"] > 0.1 > rates["wiki"] and None in rates
    assert truncation.truncated(df.where("false")).count() == 0


def test_sizes_where_texts_pile_up(spark):
    sizes = [("s", 300, 700 + i) for i in range(60)] + [("s", 100 + 3 * i, 2 * i) for i in range(200)] + [(None, 5, 1024)] * 30
    odds = spark.createDataFrame(sizes, "source string, chars int, bytes int")
    assert {tuple(r) for r in truncation.limits(odds).collect()} == {("s", "chars", 300), (None, "chars", 5), (None, "bytes", 256)}


RUNS = "kind string, day string, v double, n int, grp string, low double"


def brute(rows, permille):
    out = {}
    for dim, at in (("kind", 0), ("day", 1)):
        for metric, col in (("v", 2), ("n", 3)):
            groups = {}
            for r in rows:
                if r[col] is not None and not (isinstance(r[col], float) and np.isnan(r[col])):
                    groups.setdefault(r[at], []).append(float(r[col]))
            for g, values in groups.items():
                values.sort()
                for p in permille:
                    out[dim, g, metric, p] = (len(values), values[max(-(-len(values) * p // 1000), 1) - 1])
    return out


@pytest.mark.parametrize("finish", [0, 3, 512])
def test_percentiles_against_brute_force(spark, monkeypatch, finish):
    monkeypatch.setattr(selection, "FINISH", finish)
    monkeypatch.setattr(selection, "SORTED_ROWS", 90)
    monkeypatch.setattr(selection, "RUN_VALUES", 16)
    rng = random.Random(6)
    value = lambda: rng.choice([None, float("nan"), 0.0, -0.0, float("inf"), float("-inf"), rng.gauss(0, 9), float(rng.randrange(5)), 1e300])
    rows = [(rng.choice(["a", "a", "a", "b", None]), f"d{rng.randrange(3)}", value(), rng.choice([None, rng.randrange(50)]), "g", 1.0) for _ in range(600)] + [("only", "d0", None, None, "g", 1.0)]
    dims = {"kind": F.col("kind"), "day": F.col("day")}
    permille = [0, 250, 500, 990, 1000]
    df = spark.createDataFrame(rows, RUNS)
    whole = selection.sorted_runs(df.repartition(5), dims, ["v", "n"])
    got = {(r["dimension"], r["grp"], r["metric"], r["permille"]): (r["n"], r["value"]) for r in selection.select_percentiles(whole, permille).collect()}
    assert got == brute(rows, permille)
    if finish == 3:  # days loaded apart and united
        parts = selection.sorted_runs(df.where("day = 'd0'"), dims, ["v", "n"]).unionByName(selection.sorted_runs(df.where("day <> 'd0'"), dims, ["v", "n"]))
        again = {(r["dimension"], r["grp"], r["metric"], r["permille"]): (r["n"], r["value"]) for r in selection.select_percentiles(parts, permille).collect()}
        assert again == got


def test_percentiles_beyond_the_broadcast(spark, monkeypatch):
    monkeypatch.setattr(selection, "BROADCAST_GROUPS", 0)
    monkeypatch.setattr(selection, "FINISH", 4)
    df = spark.range(300).select((F.col("id") % 7).cast("string").alias("k"), F.sqrt("id").alias("v"))
    got = {r["grp"]: r["value"] for r in selection.select_percentiles(selection.sorted_runs(df, {"k": F.col("k")}, ["v"]), [500]).collect()}
    assert got == {str(k): sorted(float(np.sqrt(i)) for i in range(300) if i % 7 == k)[-(-len(range(k, 300, 7)) // 2) - 1] for k in range(7)}
    assert selection.select_percentiles(selection.sorted_runs(df.where("false"), {"k": F.col("k")}, ["v"]), [500]).count() == 0


FOLDER = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not FOLDER.exists(), reason="no test tables here")
def test_registered_queries(spark):
    from veldrin.llm import queries

    con = duckdb.connect()
    con.execute(f"CREATE VIEW run_acceptance AS SELECT * FROM read_parquet('{FOLDER}/run_acceptance.parquet')")
    every = __spark_entry__.queries()
    assert set(queries.QUERIES) <= set(every)
    got = every["p5_percentiles"](spark, str(FOLDER))
    want = con.execute(queries.ORACLE_SQL["p5_percentiles"])
    names = [c[0] for c in want.description]
    assert sorted(tuple(str(r[c]) for c in names) for r in got.collect()) == sorted(tuple(map(str, r)) for r in want.fetchall())
    columns = {"p1_found": ["id_a", "id_b"], "p2_found": ["keep_id", "copy_id"], "p3_found": ["id_a", "id_b"], "p7_found": ["doc_id", "item_id"], "p8_found": ["doc_id"], "p6_ids": ["doc_id", "ids"]}
    for name in sorted(set(queries.QUERIES) - {"p5_percentiles"}):
        df = every[name](spark, str(FOLDER))
        assert df.columns == columns.get(name, df.columns)
        assert df.count() >= (name == "p6_ids")


def test_copies_of_a_whole_text_are_not_cut(spark):
    rng = random.Random(12)
    words = ["crate", "ledger", "lamp", "gauge", "cover", "window", "bridge", "garden"]
    sentence = lambda: f"The {rng.choice(words)} near the {rng.choice(words)} was {rng.choice(['moved', 'checked', 'closed'])} by Marvirel in {rng.randrange(2000, 2030)}."
    rows = [(i, " ".join(sentence() for _ in range(rng.randrange(2, 6))), "en", "mail", 0, "") for i in range(3000)]
    hot = "The garden near the lamp was closed by Tolquon. Quarterly bulletins go to every member of the league."
    rows += [(10_000 + i, hot + " " * (i % 3), "en", "mail", 0, "") for i in range(3000)]
    judged = truncation.truncated(spark.createDataFrame(rows, DOCS).repartition(4)).groupBy(F.col("doc_id") >= 10_000).agg(F.count("*").alias("n"), F.count_if("cut").alias("cut")).collect()
    assert {(r["n"], r["cut"]) for r in judged} == {(3000, 0)}
