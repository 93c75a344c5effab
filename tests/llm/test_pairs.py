"""Near duplicates, format duplicates and overlaps across splits against brute force."""

import json
import random
import tracemalloc
import unicodedata

import numpy as np
import pytest

from veldrin.llm import format_duplicates as fmt
from veldrin.llm import near_duplicates as near
from veldrin.llm import split_overlap as over

CASES = "id string, type string, state string, instructions string, criteria string, split string, source string, cls long, text string"
WORDS = [f"{a}{b}{c}" for a in ("ka", "mo", "tri", "サ", "ペ") for b in ("lu", "ne", "ード", "漢") for c in ("x", "字", "pp")]


def fold(t):
    return "".join(c for c in unicodedata.normalize("NFKC", t or "").lower() if unicodedata.category(c)[0] in "LN")


def pieces(t):
    return {t[i : i + 3] for i in range(len(t) - 2)} or ({t} if t else set())


def like(a, b):
    u = pieces(a) | pieces(b)
    return len(pieces(a) & pieces(b)) / len(u) if u else 1.0


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        k = rng.randrange(len(words))
        words[k : k + 1] = rng.choice([[], [rng.choice(WORDS)], [words[k], rng.choice(WORDS)]])
    return words


def corpus(seed=3, groups=25):
    rng = random.Random(seed)
    rows = []
    for g in range(groups):
        base = [rng.choice(WORDS) + str(rng.randrange(100)) for _ in range(30)]
        for _ in range(rng.randrange(1, 5)):
            text = " ".join(edited(rng, base, rng.randrange(0, 5)))
            criteria = rng.choice([None, json.dumps({"b": f"x{g}", "a": "y"}), json.dumps({"a": "Y ", "b": f"X{g}"})])
            rows.append((text, criteria))
    rows += [(None, None), ("", None), (" 。 ", None), ("ab", None), ("AB!", None), ("a", None), ("long " * 20_000, None), ("long " * 20_000 + "er", None), ("[[broken", None)]
    split = ["train", "dev", "test", "calibration", "train", None]
    out = [(f"id{i:04d}", rng.choice(["choice", "Choice ", "score"]), s, rng.choice([None, "", "Which?"]), c, rng.choice(split), "s", 7, "clash") for i, (s, c) in enumerate(rows)]
    out += [(None, *out[0][1:]), out[0], out[1]]  # a row without an id, and rows delivered twice
    return out


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, CASES).repartition(5)


def true_pairs(rows):
    kept = {r[0]: r for r in rows if r[0] and fold(r[2])}
    ids = sorted(kept)
    text = {i: fold(kept[i][2]) + fold(kept[i][3]) for i in ids}
    return kept, {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if like(text[a], text[b]) >= 0.6}


def test_near_pairs(df, rows):
    kept, want = true_pairs(rows)
    got = [tuple(r) for r in near.near_duplicate_pairs(df).collect()]
    assert len(got) == len(set(got)) and set(got) <= want and len(want) > 20
    assert len(set(got)) >= 0.97 * len(want)
    assert {(a, b) for a, b in want if fold(kept[a][2]) + fold(kept[a][3]) == fold(kept[b][2]) + fold(kept[b][3])} <= set(got)


def test_near_groups(df, rows):
    kept, _ = true_pairs(rows)
    found = near.near_duplicate_groups(df).collect()
    pairs = {tuple(r) for r in near.near_duplicate_pairs(df).collect()}
    assert sorted(r["id"] for r in found) == sorted(kept)
    group = {r["id"]: r["group_id"] for r in found}
    assert all(group[a] == group[b] for a, b in pairs)
    parent = {i: i for i in kept}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    assert group == {i: root(i) for i in kept}


def test_chains_become_one_group(spark):
    chain = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(60)] + [("x", "y"), ("y", "x"), ("z", "z")]
    got = {r["node"]: r["label"] for r in near.smallest_reachable(spark.createDataFrame(chain, "u string, v string")).collect()}
    assert got == {f"n{i:03d}": "n000" for i in range(61)} | {"x": "x", "y": "x"}


def test_signatures_estimate_weighted_likeness():
    rng = np.random.default_rng(5)
    w = rng.uniform(0.2, 5, near.BUCKETS)
    a = np.sort(rng.choice(1 << 50, 300, replace=False).astype(np.uint64))
    b = np.sort(np.concatenate([a[:200], rng.choice(1 << 50, 100, replace=False).astype(np.uint64)]))
    weight = lambda x: w[(x & np.uint64(near.BUCKETS - 1)).astype(int)].sum()
    exact = weight(np.intersect1d(a, b)) / weight(np.union1d(a, b))
    shift = np.uint64(50)
    many = [near.signatures(np.concatenate([near.mix(x + np.uint64(k)) >> np.uint64(14) & ~np.uint64(near.BUCKETS - 1) | x & np.uint64(near.BUCKETS - 1) | np.uint64(i) << shift for i, x in enumerate((a, b))]), 2, w) for k in range(40)]
    assert abs(np.mean([(s[0] == s[1]).mean() for s in many]) - exact) < 0.04
    one = near.signatures(np.array([5, 5 | 1 << 50], np.uint64), 2, w)
    assert (one == 5).all()  # a single piece fills every register


def test_hot_copies_stay_small(spark):
    hot = [(f"h{i:04d}", "same old text that everybody sends", None) for i in range(300)] + [("x", "another text altogether here", None)]
    found = near.near_duplicate_groups(spark.createDataFrame(hot, "id string, state string, instructions string").repartition(6)).collect()
    assert {(r["group_id"], r["copies"], r["links"]) for r in found} == {("h0000", 300, 0), ("x", 1, 0)}


def test_empty_tables(spark):
    empty = spark.createDataFrame([], CASES)
    assert near.near_duplicate_pairs(empty).count() == near.near_duplicate_groups(empty).count() == 0
    assert fmt.format_copies(empty).count() == fmt.copy_counts(empty).count() == 0
    assert over.overlapping(empty).count() == 0 and over.overlap_report(over.overlapping(empty), empty).count() == 0


def canonical(v):
    if isinstance(v, dict):
        return "{" + ",".join(sorted(f"{fold(k)}:{canonical(x)}" for k, x in v.items())) + "}"
    if isinstance(v, list):
        return "[" + ",".join(map(canonical, v)) + "]"
    return '"' + fold(v) + '"' if isinstance(v, str) else json.dumps(v)


def field(text, scalars):
    if text is None:
        return "missing" if scalars else ""
    if not scalars and text.lstrip()[:1] not in "{[":
        return fold(text)
    try:
        return canonical(json.loads(text))
    except ValueError:
        return fold(text)


def test_format_copies(spark, rows):
    objects = [{"A": ["x", 1, {"k": None}], "b": True}, {"B ": True, "a": ["X!", 1, {"K": None}]}, {"a": [1, "x", {"k": None}], "b": True}, {"a": ["x", 1.0, {"k": None}], "b": True}, {"a": ["x", "1", {"k": None}], "b": True}]
    more = [(f"j{i}", "noul", json.dumps(o), "?", None, "train", "s", 1, "t") for i, o in enumerate(objects)] + [("j8", " NOUL", json.dumps(objects[0], indent=3), None, None, "dev", "s", 1, "t"), ("j9", "noul", json.dumps(objects[0]), "", "{}", "dev", "s", 1, "t")]
    every = rows + more
    sets = {}
    for r in {r[0]: r for r in every if r[0]}.values():
        if fold(r[2]):
            sets.setdefault((fold(r[1]), field(r[2], False), fold(r[3]), field(r[4], True)), []).append(r[0])
    want = {(min(v), x) for v in sets.values() for x in v if x != min(v)}
    df = spark.createDataFrame(every, CASES).repartition(4)
    got = [tuple(r) for r in fmt.format_copies(df).collect()]
    assert sorted(got) == sorted(want) and {("j0", "j1"), ("j0", "j8")} <= want
    counts = {r["keep_id"]: r["copies"] for r in fmt.copy_counts(df).collect()}
    assert counts == {min(v): len(v) for v in sets.values()}


def test_colliding_fingerprints_are_told_apart():
    a, b = {"type": "x", "instructions": None, "state": "s", "criteria": None}, {"type": "x", "instructions": "", "state": "S.", "criteria": None}
    f = fmt.Fields()
    assert fmt.same_fields(a, b, f) and fmt.fingerprint(a, f) == fmt.fingerprint(b, f)
    assert not fmt.same_fields(a, b | {"criteria": "{}"}, f) and not fmt.same_fields(a | {"criteria": '{"a": 1}'}, b | {"criteria": '{"a": 2}'}, f)
    assert fmt.same_fields(a | {"criteria": '{"a": 1, "a": 2}'}, b | {"criteria": '{"a": 2, "a": 1}'}, f)


def criteria(text):
    if text is None or not text.strip():
        return None
    return fold(json.dumps(json.loads(text), sort_keys=True, ensure_ascii=False))


def test_overlaps_across_splits(df, rows):
    kept, near_pairs = true_pairs(rows)
    want = set()
    for a, b in near_pairs:
        x, y = kept[a], kept[b]
        ca, cb = criteria(x[4]), criteria(y[4])
        if (x[5] == "train") != (y[5] == "train") and fold(x[1]) == fold(y[1]) and ((ca is None and cb is None) or (ca is not None and cb is not None and like(ca, cb) >= 0.6)):
            want.add((a, b))
    found = over.overlapping(df).collect()
    got = {tuple(sorted((r["train_id"], r["eval_id"]))) for r in found}
    assert len(found) == len(got) and got <= want and got == want and len(want) > 3
    report = over.overlap_report(over.overlapping(df), df).collect()
    assert sum(r["pairs"] for r in report) == len(got) and all(r["same"] <= r["overlapping"] <= r["cases"] for r in report)


@pytest.mark.parametrize("letters", ["abcdé漢", "".join(chr(0x100 + 7 * i) for i in range(17_000))])
def test_backward_search_counts_every_place(letters):
    rng = random.Random(1)
    pool = [rng.choice(letters) for _ in range(6)]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(0, 60))) for _ in range(80)] + [letters[:30_000]]
    index = over.TextIndex(*over.to_codes(texts))
    for t in rng.sample([t for t in texts if len(t) > 4], 40):
        at = rng.randrange(len(t) - 4)
        for n in range(1, over.DEPTH + 1):
            symbols = index.symbols(np.array([ord(c) for c in t[at : at + n]]))
            low, high = index.whole(symbols[-1:])
            for s in symbols[-2::-1]:
                low, high = index.step(np.array([s]), low, high)
            begin = np.concatenate([[0], np.cumsum([len(x) + 1 for x in texts])])
            want = sorted(begin[i] + k for i, x in enumerate(texts) for k in range(len(x) - n + 1) if x[k : k + n] == t[at : at + n])
            assert sorted(index.order[low[0] : high[0]].tolist()) == want
    assert index.symbols(np.array([0x1F600])).tolist() == [0]


def test_matches_lose_no_pair_that_is_alike():
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdefghij漢字") for _ in range(rng.randrange(3, 120))) for _ in range(40)]
    change = lambda t: "".join(c if rng.random() > 0.05 else rng.choice("xyz") for c in t)
    left, right = [change(rng.choice(base)) for _ in range(150)] + ["ab", ""], [change(rng.choice(base)) for _ in range(150)] + ["ab", "abc"]
    x, y = over.Shard(right, 0.6).search(left)
    got = set(zip(x.tolist(), y.tolist()))
    assert got == {(i, j) for i, s in enumerate(left) for j, t in enumerate(right) if len(s) > 2 and len(t) > 2 and like(s, t) >= 0.6} and len(got) > 100


def test_pieces_come_by_first_place_whatever_the_alphabet():
    rng = random.Random(6)
    many = "".join(chr(0x10000 + i) for i in range(140_000))  # with 600 texts, no piece and text fit into one number
    for texts in (["ab", "", "ababab", "aaaa", "漢字漢字漢字"], [many] + ["".join(rng.choice("ab𠀀") for _ in range(9)) for _ in range(600)]):
        row, place, _, starts = over.distinct_pieces(texts)
        want = [(i, starts[i] + k) for i, t in enumerate(texts) for k in range(len(t) - 2) if t.find(t[k : k + 3]) == k]
        assert list(zip(row.tolist(), place.tolist())) == want


def test_a_first_look_rules_out_unrelated_texts():
    rng = random.Random(7)
    texts = ["".join(chr(rng.randrange(0x4E00, 0x5000)) for _ in range(rng.randrange(150, 200))) for _ in range(60)]
    texts += [t[:20] + "変" + t[21:] for t in texts]
    row, place, codes, _ = over.distinct_pieces(texts)
    look = over.coarse(over.parities(row, place, codes, len(texts)))
    passed = 0
    for i, t in enumerate(texts[:60]):
        for j, u in enumerate(texts):
            differ, apart = int(np.bitwise_count(look[i] ^ look[j]).sum()), len(pieces(t) ^ pieces(u))
            assert differ <= apart and (j % 60 != i or differ <= 6)
            passed += j % 60 != i and differ <= (len(t) + len(u)) / 4
    assert passed < 0.02 * 60 * 118


def test_a_shard_is_built_in_little_memory(monkeypatch):
    monkeypatch.setattr(over, "STREAM", 500)
    rng = np.random.default_rng(8)
    letters = rng.permutation(np.arange(0x4E00, 0x5600))
    texts = ["".join(map(chr, letters[(rng.random(200) ** 2 * len(letters)).astype(int)])) for _ in range(5000)]
    tracemalloc.start()
    try:
        over.Shard(texts, 0.6)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 80 * 200 * len(texts)  # 8 million characters in each of two tasks of an executor of 3 GB


def test_shards_give_the_same(df, monkeypatch):
    whole = sorted(map(str, over.overlapping(df).collect()))
    monkeypatch.setattr(over, "SHARD_CHARACTERS", 700)
    monkeypatch.setattr(over, "SHARD_QUERIES", 10)
    assert sorted(map(str, over.overlapping(df).collect())) == whole


def test_overlaps_with_edits_spread_evenly(spark):
    rng = random.Random(8)
    letters = [chr(0x4E00 + i) for i in range(400)] + list("abcdefghij0123")
    rows, want = [], set()
    for i in range(300):
        base = [rng.choice(letters) for _ in range(rng.randrange(110, 300))]
        near, step = list(base), rng.choice([12, 13, 14, 16])
        for k in range(rng.randrange(step), len(near), step):
            near[k] = rng.choice(letters)
        rows += [(f"t{i}", "choice", "".join(base), None, None, "train", "s", 1, ""), (f"e{i}", "choice", "".join(near), None, None, "dev", "s", 1, "")]
        if like("".join(base), "".join(near)) >= 0.6:
            want.add((f"t{i}", f"e{i}"))
    got = {(r["train_id"], r["eval_id"]) for r in over.overlapping(spark.createDataFrame(rows, CASES).repartition(3)).collect()}
    assert got == want and len(want) > 200


def test_overlaps_in_a_hot_family(spark):
    text = "この短い文は何度も現れますか、はいかいいえで"
    criteria = lambda i: json.dumps({"rule": f"number {i} of the many rules that this family has"})
    rows = [(f"e{i}", "choice", text, None, criteria(i), "dev", "s", 1, "") for i in range(1500)] + [(f"n{i}", "choice", f"{i % 10}{text}", None, criteria(i), "test", "s", 1, "") for i in range(1500)]
    rows += [("t0", "choice", text, None, criteria(7777), "train", "s", 1, ""), ("t1", "choice", text + "か", None, criteria(8888), "train", "s", 1, ""), ("t2", "choice", text, None, None, "train", "s", 1, "")]
    found = over.overlapping(spark.createDataFrame(rows, CASES).repartition(3)).collect()
    got = {(r["train_id"], r["eval_id"]) for r in found}
    assert len(found) == len(got) and got == {(t, r[0]) for t in ("t0", "t1") for r in rows[:3000]}


def test_near_pairs_in_a_hot_template(spark):
    rng = random.Random(9)
    letters = [chr(0x4E00 + i) for i in range(3000)]
    draw = lambda n: "".join(rng.choice(letters) for _ in range(n))
    template = draw(90)
    rows = [(f"h{i:03d}", template + draw(rng.randrange(20, 30)), None) for i in range(80)] + [(f"x{i:03d}", draw(115), None) for i in range(160)]
    want = {(a[0], b[0]) for k, a in enumerate(rows) for b in rows[k + 1 :] if like(a[1], b[1]) >= 0.6}
    got = {tuple(r) for r in near.near_duplicate_pairs(spark.createDataFrame(rows, "id string, state string, instructions string").repartition(3)).collect()}
    assert got <= want and len(want) > 1000 and len(got) >= 0.97 * len(want)


@pytest.mark.parametrize("depth", [500, 900, 1500, 5000, 20_000, 50_000])
def test_deeply_nested_json(depth):
    deep = lambda inner: "[" * depth + inner + "]" * depth
    record = {"type": "x", "instructions": None, "state": deep('"A"'), "criteria": deep('{"b": 1, "a": "Y"}')}
    other = record | {"state": deep(' "a!"'), "criteria": deep('{"a": "y", "b": 1}')}
    f = fmt.Fields()
    assert fmt.fingerprint(record, f) == fmt.fingerprint(other, f) and fmt.same_fields(record, other, f)
    assert not fmt.same_fields(record, record | {"criteria": deep('{"b": 2, "a": "Y"}')}, f)


def test_near_pairs_where_one_template_is_in_most_rows(spark):
    rng = random.Random(21)
    letters = [chr(0x4E00 + i) for i in range(3000)]
    draw = lambda n: "".join(rng.choice(letters) for _ in range(n))
    template = draw(100)
    rows = [(f"h{i:04d}", template + draw(rng.randrange(8, 21)), None) for i in range(1000)] + [(f"x{i:04d}", draw(115), None) for i in range(1000)]
    sizes = {i: len(pieces(t)) for i, t, _ in rows[:1000]}
    common = {t[-24:-20] for _, t, _ in rows[:1]}  # only the template is shared, so that sizes give the likeness
    assert common
    shared = len(pieces(template))
    want = {(a, b) for k, a in enumerate(sorted(sizes)) for b in sorted(sizes)[k + 1 :] if shared / (sizes[a] + sizes[b] - shared) >= 0.6}
    df = spark.createDataFrame(rows, "id string, state string, instructions string")
    got = {tuple(r) for r in near.near_duplicate_pairs(df.repartition(8)).toPandas().itertuples(index=False)}
    assert len(want) > 400_000 and len(got & want) >= 0.99 * len(want)


def test_partitions_do_not_change_the_pairs(df):
    one, eight, many = (sorted(map(tuple, near.near_duplicate_pairs(df.repartition(n)).collect())) for n in (1, 8, 64))
    assert one == eight == many


def test_a_popular_text_is_one_row(spark):
    rows = [(f"h{i:04d}", f"this popular text stands everywhere in the table {i % 2}", None) for i in range(400)]
    records = near.staged_records(near.folded_records(spark.createDataFrame(rows, "id string, state string, instructions string").repartition(16), "id", "state", ["instructions"]))
    assert records.where("head").count() > 2 == near.one_head(records, {"text": ("head", ("cls", "alt"))})["text"].count()
