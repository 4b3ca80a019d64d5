"""The operators against plain versions written out here, on odd tables, and with columns whose names clash."""

import hashlib
import math
import random
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pagewright.llm import decontam, lang_id, line_dedup, mixing, near_dup, quality_model, quality_rules, repeats, token_counts, toxicity
from pagewright.llm.common import labelled_sample

SCHEMA = "doc_id long, text string, lang string, source string"
ODD = [(1, None, None, None), (2, "", "en", "s"), (3, "  \n\t ", "en", "s"), (4, "one", "en", "s"), (4, "one", "en", "s"), (None, "no id here", None, "s"), (5, "wörter und mehr " * 3000, "de", None), (6, "x" * 40_000, "en", "t")]
#: Names that operators use inside, in other cases too.
CLASH = ["_k", "_key", "gone", "GONE_", "h", "h2", "k", "k2", "row", "site", "weight", "slope", "_s", "_b", "_h", "_source", "size", "hits", "items", "n_hit", "_", "digest", "rep", "unit", "share", "component_id", "kept", "score", "predicted", "n_lines", "positions", "pass"]


def with_clashes(df):
    return df.withColumns({c: F.lit("clash") for c in CLASH if c.lower() not in [x.lower() for x in df.columns]})


def words(n, rng, stock=400):
    return [f"w{rng.randrange(stock)}" for _ in range(n)]


# every operator on odd rows, an empty table, and clashing names


def operators(spark, bench, labels):
    learn = F.lit(True)
    return {
        "repeats": lambda d: repeats.remove_repeats(d)[0],
        "decontaminate": lambda d: decontam.decontaminate(d, bench),
        "decontaminate and keep": lambda d: decontam.decontaminate(d, bench, keep=d.columns),
        "token_counts": lambda d: token_counts.token_counts(d),
        "line_dedup": line_dedup.line_dedup,
        "quality_rules": quality_rules.quality_rules,
        "language_id": lambda d: lang_id.language_id(d, learn),
        "near_duplicates": near_dup.near_duplicates,
        "score_quality": lambda d: quality_model.score_quality(d, quality_model.train(d, labels, learn)),
        "curriculum": mixing.curriculum,
        "toxicity": lambda d: toxicity.score_toxicity(d, toxicity.train(d, labels, learn)),
    }


NAMES = ["curriculum", "decontaminate", "decontaminate and keep", "language_id", "line_dedup", "near_duplicates", "quality_rules", "repeats", "score_quality", "token_counts", "toxicity"]


@pytest.mark.parametrize("name", NAMES)
def test_clashing_names_change_nothing(spark, name):
    bench = spark.createDataFrame([(1, "no id here")], "item_id long, text string")
    labels = spark.createDataFrame([(2, 0, 0), (4, 1, 1)], "doc_id long, quality int, toxic int")
    run = operators(spark, bench, labels)[name]
    odd = spark.createDataFrame(ODD, SCHEMA)
    plain = run(odd)
    show = lambda d: sorted(str([r[c] for c in plain.columns]) for r in d.collect())
    want = show(plain)
    assert len(want) == len(ODD)
    assert show(run(with_clashes(odd))) == want
    assert run(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("name", [n for n in NAMES if n not in ("repeats",)])
def test_ids_of_another_type(spark, name):
    bench = spark.createDataFrame([("a", "no id here")], "item_id string, text string")
    labels = spark.createDataFrame([("2", 0, 0)], "doc_id string, quality int, toxic int")
    d = spark.createDataFrame([(r[0] and str(r[0]), *r[1:]) for r in ODD], "doc_id string, text string, lang string, source string")
    assert operators(spark, bench, labels)[name](d).count() == len(ODD)


def test_columns_of_any_name_are_kept(spark):
    d = with_clashes(spark.createDataFrame(ODD, SCHEMA))
    assert set(d.columns) - {"n_lines"} <= set(line_dedup.line_dedup(d).columns)
    assert {c for c in d.columns if c not in ("text", "size", "positions")} <= set(mixing.curriculum(d).columns)
    assert near_dup.drop_near_duplicates(d).columns == d.columns
    assert {r["gone"] for r in line_dedup.line_dedup(d).collect()} == {"clash"}


# 1: pieces of hot contexts


def test_equal_windows_have_equal_keys():
    rng = random.Random(3)
    passage = bytes(rng.choice(b"abcdefghij") for _ in range(500))
    texts = [bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 90))) + passage + bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 90))) for _ in range(6)]
    for step in repeats.STEPS:
        keys = {}
        for t in texts:
            own = repeats.anchors(t).tolist()
            for _, _, context in repeats.contexts(t, own):
                covered = []
                for key, at, piece in repeats.pieces(context, step):
                    for i in range(len(piece) - repeats.LENGTH + 1):
                        keys.setdefault(piece[i : i + repeats.LENGTH], set()).add(key)
                        covered.append(at + i)
                assert covered == list(range(len(context) - repeats.LENGTH + 1))
        assert all(len(k) == 1 for k in keys.values())


def test_long_texts_in_segments_are_the_same(spark, monkeypatch):
    rng = random.Random(8)
    passage = "".join(rng.choice("abcdefgh") for _ in range(700))
    rows = [(i, "".join(rng.choice("xyz ") for _ in range(rng.randint(100, 3000))) + passage + "".join(rng.choice("xyz ") for _ in range(900)), "en", "s") for i in range(5)] + [(9, "ab" * 1500, "en", "s")]
    d = spark.createDataFrame(rows, SCHEMA)
    want = sorted(map(tuple, repeats.remove_repeats(d)[0].collect()))
    monkeypatch.setattr(repeats, "SEGMENT", 333)
    assert sorted(map(tuple, repeats.remove_repeats(d)[0].collect())) == want


# 2


def test_items_without_id_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "x one two three y"), (2, "one two"), (3, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(None, "one two three"), (7, "two"), (8, None), (9, "..")], "item_id long, text string")
    for block_words in (1, 1000):
        got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.contaminated, r.items_sha256) for r in decontam.decontaminate(docs, bench, block_words=block_words).collect()}
        seven = hashlib.sha256(b"7").hexdigest()
        assert got == {1: (5, 3, 1, True, seven), 2: (2, 1, 1, True, seven), 3: (0, 0, 0, False, hashlib.sha256(b"").hexdigest())}
    assert not decontam.decontaminate(docs, bench.limit(0)).filter("contaminated").count()


# 3


def test_cache_is_read_and_appended(spark, tmp_path, monkeypatch):
    cache = str(tmp_path / "cache")
    first = spark.createDataFrame([(1, "a b"), (2, " a b\r\n"), (3, "c")], "doc_id long, text string")
    more = first.union(spark.createDataFrame([(4, "d e f"), (5, "c")], "doc_id long, text string"))
    token_counts.token_counts(first, cache).collect()
    assert spark.read.parquet(cache).count() == 2
    assert {r.doc_id: r.n_tokens for r in token_counts.token_counts(more, cache).collect()} == {1: 2, 2: 2, 3: 1, 4: 3, 5: 1}
    assert spark.read.parquet(cache).count() == 3
    spark.read.parquet(cache).withColumn("n_tokens", F.col("n_tokens") + 100).write.parquet(f"{cache}2")  # stored counts are used, not made again
    assert {r.n_tokens for r in token_counts.token_counts(more, f"{cache}2").collect()} == {102, 101, 103}


# 5


def test_thresholds_of_small_and_large_groups(spark):
    """A group of 40 has its own thresholds, one of 39 those of its language, a language of 39 those of all."""
    rng = random.Random(4)
    rows = []
    for lang, source, n in (("en", "a", 40), ("en", "b", 39), ("de", "c", 39), ("en", "d", 100)):
        for _ in range(n):
            base = " ".join(words(60, rng))
            rows.append((len(rows), base + " " + "#" * rng.randint(0, {"a": 40, "b": 2, "c": 90, "d": 8}[source]), lang, source))
    got = {r.doc_id: r for r in quality_rules.quality_rules(spark.createDataFrame(rows, SCHEMA)).collect()}
    ratio = {i: got[i].n_symbols / got[i].word_chars for i in got}

    def limit(ids):
        v = sorted(ratio[i] for i in ids)
        at = lambda p: v[max(0, math.ceil(p * len(v)) - 1)]
        return at(0.75) + max(0.05, 4 * (at(0.75) - at(0.25)))

    group = {(l, s): [i for i, r in enumerate(rows) if r[2:] == (l, s)] for l, s in {r[2:] for r in rows}}
    want = {("en", "a"): limit(group["en", "a"]), ("en", "b"): limit([i for (l, _), g in group.items() if l == "en" for i in g]), ("de", "c"): limit(range(len(rows))), ("en", "d"): limit(group["en", "d"])}
    for key, ids in group.items():
        for i in ids:
            assert got[i].max_symbols == pytest.approx(want[key])
            assert got[i].kept == (not got[i].base_failed and ratio[i] <= want[key] + 1e-12)


# 6


def test_rank_order_profiles_by_hand(spark):
    rng = random.Random(6)
    letters = {"xx": "abcde ", "yy": "efghi ", "zz": "öüäßé "}
    rows = [(i, "".join(rng.choice(letters[lang]) for _ in range(200)), lang, "s") for i, lang in enumerate(list(letters) * 12)]
    tests = [(100 + i, "".join(rng.choice(letters[lang] + "ae") for _ in range(rng.choice([3, 30, 120]))), None, "s") for i, lang in enumerate(list(letters) * 8)]

    def grams(text):
        t = "_" + re.sub(r"[\W\d_]+", "_", text.lower()).strip("_") + "_"
        return Counter(t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1) if t[i : i + n] != "_")

    def order(counts, k=300):
        number = lambda g: sum(ord(c) << (21 * i) for i, c in enumerate(reversed(g)))
        return sorted(counts, key=lambda g: (-counts[g], number(g)))[:k]

    profiles = {lang: order(sum((grams(r[1]) for r in rows if r[2] == lang), Counter())) for lang in letters}
    d = spark.createDataFrame(rows + tests, SCHEMA)
    got = {r.doc_id: (r.lang_pred, r.score) for r in lang_id.language_id(d, F.col("lang").isNotNull(), per_lang=1000).collect()}
    for i, text, *_ in tests:
        if not re.search(r"[^\W\d_]", text):
            assert got[i] == ("und", 0.0)
            continue
        own = order(grams(text))
        far = {lang: sum(abs(p.index(g) - k) if g in p else 300 for k, g in enumerate(own)) for lang, p in profiles.items()}
        best = min(sorted(far), key=far.get)
        assert got[i][0] == best and got[i][1] == pytest.approx(max(0, 1 - far[best] / (300 * len(own))))


# 8


def test_ftrl_by_hand():
    rng = random.Random(1)
    rows = [(" ".join(words(rng.randint(0, 30), rng, 40)) + (" !!" if i % 3 == 0 else ""), int(i % 3 == 0)) for i in range(60)]
    z, n = Counter(), Counter()

    def weight(i):
        return 0.0 if abs(z[i]) <= quality_model.L1 else (math.copysign(quality_model.L1, z[i]) - z[i]) / ((quality_model.BETA + math.sqrt(n[i])) / quality_model.ALPHA + quality_model.L2)

    for _ in range(quality_model.EPOCHS):
        for text, y in rows:
            place, value = quality_model.features(text)
            w = [weight(int(i)) for i in place]
            p = 1 / (1 + math.exp(-sum(a * float(b) for a, b in zip(w, value))))
            for i, x, wi in zip(place.tolist(), value.tolist(), w):
                g = (p - y) * x
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / quality_model.ALPHA * wi
                n[i] += g * g
    got = quality_model.fit(rows)
    assert np.flatnonzero(got).tolist() == sorted(i for i in z if weight(i))
    assert all(got[i] == pytest.approx(weight(i), abs=1e-5) for i in z)
    assert sum((quality_model.sigmoid(float(got[i] @ x)) >= 0.5) == y for (i, x), y in ((quality_model.features(t), y) for t, y in rows)) >= 55


def test_the_sample_is_the_same_on_every_run(spark):
    docs = spark.createDataFrame([(i % 50, f"text {i}") for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id long, quality int")
    runs = [[tuple(r) for r in labelled_sample(docs.repartition(k), labels.repartition(k), F.lit(True), "quality", 20).collect()] for k in (1, 7)]
    assert runs[0] == runs[1] and len(runs[0]) == 20 and all(t == min(f"text {i}" for i in range(200) if i % 50 == d) for d, t, _ in runs[0])


# 10


def kernel(a, b):
    """Common gapped subsequences of three letters, by listing all."""

    def features(word):
        out = Counter()
        for i, j, k in combinations(range(len(word)), 3):
            if k - i < toxicity.SPAN:
                out[word[i] + word[j] + word[k]] += toxicity.GAP ** (k - i - 2)
        return out

    x, y = features(a), features(b)
    length = lambda w: math.sqrt(sum(toxicity.GAP ** (2 * (k - i - 2)) for i, j, k in combinations(range(len(w)), 3) if k - i < toxicity.SPAN))
    return sum(v * y[t] for t, v in x.items()) / (length(a) * length(b))


def test_string_kernel_by_hand():
    rng = random.Random(2)
    stock = ["".join(rng.choice("abcdiot") for _ in range(rng.randint(3, 12))) for _ in range(30)] + ["idiot", "idxiot", "moron"]
    marks = ["idiot", "moron", "abcabc"]
    near = toxicity.Likeness(marks)
    texts = [set(rng.sample(stock, rng.randint(0, 8))) for _ in range(40)]
    got = near.vectors(texts)
    for t, row in zip(texts, got):
        want = [max([kernel(w, m) ** toxicity.POWER for w in t], default=0.0) for m in marks]
        assert row == pytest.approx(want, abs=2e-3, rel=2e-3)
    assert np.array_equal(toxicity.Likeness(marks, kept=8).vectors(texts), got)  # forgetting changes nothing


def test_other_scripts_are_told_apart():
    a, b, c = toxicity.feature_rows(["дурак", "дурбк", "привет"])
    assert a @ b > 2 * max(a @ c, 0.05)


# 7: sets of words themselves, and rows that share an id


def plain_sets(texts, size):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        n = min(size, len(w))
        out.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set())
    return out


def plain_components(ids, sets):
    root = {i: i for i in ids}
    for (i, a), (j, b) in combinations(zip(ids, sets), 2):
        if a and b and 100 * len(a & b) >= 80 * len(a | b) and root[i] != root[j]:
            lo, hi = sorted((root[i], root[j]))
            root = {k: lo if v == hi else v for k, v in root.items()}
    return root


def test_near_duplicates_by_word_sets(spark):
    rng = random.Random(12)
    base = [words(rng.randint(30, 70), rng) for _ in range(6)]
    texts = []
    for b in base:
        for k in range(9):
            t = list(b)
            for _ in range(k // 2):
                t[rng.randrange(len(t))] = rng.choice(["Other", "ÄB", "x y"])
            texts.append(rng.choice([" ", "\n", "\t"]).join(t).upper() if k % 4 == 1 else " ".join(t))
    texts += ["a b c", "A B c", "a b", "", None, "ß", "SS"]
    for size in (4, 5):
        sets = plain_sets(texts, size)
        root = plain_components(range(len(texts)), sets)
        got = near_dup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), size=size).collect()
        assert {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got} == {(i, len(s), root[i], root[i] == i) for i, s in enumerate(sets)}


def test_rows_that_share_an_id_are_judged_by_their_text(spark):
    d = spark.createDataFrame([(1, "a b c d e f"), (1, "q r s t u v w"), (0, "a b c d e f"), (None, None)], "doc_id long, text string")
    assert sorted(map(tuple, near_dup.drop_near_duplicates(d).collect()), key=str) == [(0, "a b c d e f"), (1, "q r s t u v w"), (None, None)]


# the pipeline, stage by stage


def test_pipeline_by_hand(spark, tmp_path):
    """Every stage of the pipeline on a small corpus, against plain Python; the classifier's scores are taken as they are."""
    rng = random.Random(20)
    boiler = [" ".join(words(8, rng)) for _ in range(3)]
    item = " ".join(words(14, rng))
    docs, labels = [], []
    for i in range(140):
        good = i % 7 != 0
        body = [" ".join(words(12, rng, 3000)) for _ in range(4)] if good else ["$$ !! " + " ".join(rng.choice("xyz") * 3 for _ in range(10))]
        if i % 5 == 1:
            body.insert(2, boiler[i % 3])
        if i % 20 == 4 and good:
            body[1] += " " + item
        if i % 10 == 9 and good and docs[-1][0] % 7:
            body = docs[-1][1].split("\n")[:-1] + [docs[-1][1].split("\n")[-1] + " end"]
        docs.append((i, "\n".join(body), "en", f"s{i // 3 % 6}", 0))
        labels.append((i, int(good), 0))
    docs += [(200, None, None, None, 0), (201, "", "en", "s1", 0)]
    docs = [(*d[:4], len(d[1] or "")) for d in docs]
    sf = str(tmp_path)
    spark.createDataFrame(docs, SCHEMA + ", n_chars long").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    now = spark.read.parquet(f"{sf}/documents.parquet")
    seen = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, sf).write.parquet(f"{sf}/stage{k}")
        now = spark.read.parquet(f"{sf}/stage{k}")
        seen.append({r.doc_id: r for r in now.collect()})
    scores = {r.doc_id: r.predicted for r in quality_model.score_quality(spark.read.parquet(f"{sf}/documents.parquet"), quality_model.train(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"), corpus_pipeline.split_remainder("doc_id", 5) != 0)).collect()}
    assert set(seen[0]) == {i for i, p in scores.items() if p} and 100 < len(seen[0]) < 140

    left = {i: (r.text, r.source) for i, r in seen[0].items()}
    spread = {}
    for i, (t, s) in left.items():
        for line in (t or "").split("\n") if t is not None else []:
            if len(line.split()) >= 4:
                spread.setdefault(line.strip(), []).append((i, s))
    bad = {l: min(i for i, _ in w) for l, w in spread.items() if len({s for _, s in w}) >= 5}
    assert bad
    want = {}
    for i, (t, _) in left.items():
        parts = None if t is None else t.split("\n")
        kept = parts and [x for x in parts if not (x.strip() in bad and bad[x.strip()] != i)]
        if parts is None or kept == parts or "\n".join(kept).strip():
            want[i] = t if parts is None else "\n".join(kept)
    assert {i: r.text for i, r in seen[1].items()} == want and any(want[i] != left[i][0] for i in want)
    assert all(r.n_chars == len(r.text or "") for r in seen[1].values())

    ids = sorted(want)
    root = plain_components(ids, plain_sets([want[i] for i in ids], near_dup.SHINGLE))
    assert {i: r.text for i, r in seen[2].items()} == {i: want[i] for i in ids if root[i] == i} and len(seen[2]) < len(seen[1])

    find = [" ".join(item.split()[i : i + 10]) for i in range(5)]
    clean = {i for i in seen[2] if not any(f" {p} " in f" {' '.join(re.findall('[a-z0-9]+', (want[i] or '').lower()))} " for p in find)}
    assert set(seen[3]) == clean and len(seen[3]) < len(seen[2])

    sizes = {i: len((want[i] or "").split()) for i in clean}
    of = Counter()
    for i in clean:
        of[left[i][1]] += sizes[i]
    order = sorted((s for s in of if s is not None)) + [None] * (None in of)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, open_, rest = {}, set(order), float(sum(of.values()))
    while open_:
        level = rest / sum(weight[s] for s in open_)
        cut = {s for s in open_ if level * weight[s] > 3 * of[s]}
        for s in cut or open_:
            target[s] = 3.0 * of[s] if cut else level * weight[s]
        rest -= sum(target[s] for s in cut)
        open_ = open_ - cut if cut else set()
    assert set(seen[4]) == clean
    for i, r in seen[4].items():
        s = left[i][1]
        assert r.size == sizes[i] and r.source_size == of[s] and r.target == pytest.approx(target[s]) and r.taken in {k * r.size for k in range(4)}
    for s in order:
        assert abs(sum(r.taken for i, r in seen[4].items() if left[i][1] == s) - target[s]) <= max(sizes.values())


@pytest.mark.parametrize("similarity", [50, 80])
def test_blocks_by_size_lose_no_link(spark, monkeypatch, similarity):
    """Large buckets of sets of many sizes, some at exactly the least ratio of sizes."""
    monkeypatch.setattr(near_dup, "SMALL", 1)
    monkeypatch.setattr(near_dup, "BLOCK", 3)
    rng = random.Random(5)
    base = words(64, rng, 100_000)
    texts = [" ".join(base[:n]) for n in (2, 4, 5, 8, 10, 16, 20, 25, 32, 40, 50, 64)] + [" ".join(base[n:]) for n in (8, 16, 32)] + [" ".join(words(30, rng, 100_000)) for _ in range(5)]
    sets = plain_sets(texts, 1)
    root = {i: i for i in range(len(texts))}
    for (i, a), (j, b) in combinations(enumerate(sets), 2):
        if 100 * len(a & b) >= similarity * len(a | b) and root[i] != root[j]:
            lo, hi = sorted((root[i], root[j]))
            root = {k: lo if v == hi else v for k, v in root.items()}
    got = near_dup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), size=1, similarity=similarity).collect()
    missed = [r.doc_id for r in got if r.component_id != root[r.doc_id]]
    assert not missed or similarity == 50 and len(missed) <= 2  # bands are made for 80


@pytest.mark.parametrize("empty", [False, True])
def test_pipeline_on_odd_rows(spark, tmp_path, empty):
    sf = str(tmp_path)
    rows = [] if empty else [(*r, len(r[1] or ""), "more") for r in ODD + [(1, "one two three four five six seven", "en", "s"), (8, "one two three four five six seven", None, "s")]]
    spark.createDataFrame(rows, SCHEMA + ", n_chars long, gone string").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    got = corpus_pipeline.run(spark, sf).collect()
    assert len(got) == (0 if empty else len(rows) - 1)
    if not empty:
        assert sorted((r.doc_id for r in got if r.doc_id is not None)) == sorted(r[0] for r in rows[:-1] if r[0] is not None)
        assert {r.doc_id: r.size for r in got}[5] == 9000


def test_long_texts_lose_lines_in_linear_time(spark):
    """Twenty thousand lines a text: cutting the text anew for each line would take minutes."""
    rows = [(i, "\n".join([f"line {i} number {k} of text" for k in range(20_000)] + ["the same line on every site"] * 3), "en", f"s{i}") for i in range(6)]
    got = {r.doc_id: (r.n_lines, r.n_removed, len(r.text)) for r in line_dedup.line_dedup(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: (20_003, 3 if i else 0, len(t) - (3 * 28 if i else 0)) for i, t, *_ in rows}
