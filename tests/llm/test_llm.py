"""The training-data operators against brute force, SQL or held-out rows, and on odd inputs."""

import glob
import hashlib
import os
import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pagewright.llm import decontam, lang_id, line_dedup, mixing, near_dup, quality_model, quality_rules, repeats, token_counts, toxicity
from pagewright.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
ODD = [(1, None, None, None), (2, "", "en", "s"), (3, "  \n\t ", "en", "s"), (4, "one", "en", "s"), (4, "one", "en", "s"), (None, "no id here", None, "s"), (5, "wörter und mehr " * 4000, "de", None), (6, "x" * 50_000, "en", "t")]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(rows):
    return sorted(tuple("" if v is None or v != v else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, duck, name):
    a, b = QUERIES[name](spark, SF).toPandas(), duck.execute(ORACLE_SQL[name]).df()
    cols = sorted(a.columns)
    assert cols == sorted(b.columns) and plain(a[cols].itertuples(index=False)) == plain(b[cols].itertuples(index=False))


def removed_by_force(texts):
    seen = Counter(t[i : i + 200] for t in texts for i in range(len(t) - 199))
    out = []
    for t in texts:
        m = np.zeros(len(t), bool)
        for i in range(len(t) - 199):
            if seen[t[i : i + 200]] > 1:
                m[i : i + 200] = True
        runs = int((np.diff(np.r_[0, m.astype(int)]) == 1).sum())
        out.append((int(m.sum()), runs, hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~m])).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [0, 4096])
def test_repeats(spark, hot, monkeypatch):
    monkeypatch.setattr(repeats, "HOT", hot)
    rng = random.Random(1)
    noise = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    passage, base = noise(260), noise(900)
    texts = [noise(rng.randint(0, 150)) + passage + noise(rng.randint(0, 400)) for _ in range(12)]
    texts += [base[: k * 60] + "#" + base[k * 60 :] for k in range(1, 9)] + ["ab" * 500, "z" * 200, noise(199), noise(199)]
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)] + [(100 + i, *r[1:]) for i, r in enumerate(ODD)] + [(200, base, "en", "s"), (201, base, "en", "s")]
    got = plain((r.doc_id, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove_repeats(spark.createDataFrame(rows, SCHEMA))[0].collect())
    assert got == plain((r[0], *x) for r, x in zip(rows, removed_by_force([(r[1] or "").encode() for r in rows])))


@pytest.mark.parametrize("small,block", [(24, 512), (1, 4)])
def test_near_duplicates(spark, small, block, monkeypatch):
    monkeypatch.setattr(near_dup, "SMALL", small)
    monkeypatch.setattr(near_dup, "BLOCK", block)
    rng = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    base = [rng.choice(words) for _ in range(80)]
    texts = []
    for k in range(40):
        t = list(base)
        for _ in range(k % 8):
            t[rng.randrange(len(t))] = rng.choice(words)
        texts.append(" ".join(t))
    texts += [" ".join(rng.choice(words) for _ in range(60)) for _ in range(20)]
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)] + [(100 + (r[0] or 0), *r[1:]) for r in ODD]
    sets = {i: set(near_dup.shingles(t, 4).tolist()) for i, t, *_ in rows}
    root = {i: i for i in sets}
    for i in sorted(sets):
        for j in sorted(sets):
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = {k: min(a, b) if v in (a, b) else v for k, v in root.items()}
    got = near_dup.near_duplicates(spark.createDataFrame(rows, SCHEMA), size=4).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.component_id, r.n_shingles, r.kept) for r in got} == {(i, root[i], len(s), root[i] == i) for i, s in sets.items()}


def test_wu_manber_equals_plain_search():
    rng = random.Random(4)
    items = [(str(i), " ".join(rng.choice("abc") for _ in range(rng.choice([1, 2, 5, 10, 14])))) for i in range(12)]
    tables = decontam.build(items)
    for _ in range(200):
        text = " ".join(rng.choice("abcd") for _ in range(rng.randint(0, 60)))
        words, hit, found = decontam.search(text, tables)
        want, names = [False] * len(words), set()
        for name, item in items:
            for p in decontam.item_windows(item):
                for i in range(len(words) - len(p) + 1):
                    if tuple(words[i : i + len(p)]) == p:
                        want[i : i + len(p)] = [True] * len(p)
                        names.add(name)
        assert (hit, found) == (want, names)


def test_decontaminate_in_blocks_is_the_same(spark):
    docs, bench = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "benchmark"))
    assert plain(decontam.decontaminate(docs, bench, block_words=2000).collect()) == plain(decontam.decontaminate(docs, bench).collect())


def test_token_counts_and_cache(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(token_counts.TOKENIZER))
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(r[0], r[1]) for r in ODD] + [(9, "a <|endoftext|>\n\n b  c")], "doc_id long, text string"))
    want = plain((r.doc_id, len((r.text or "").encode()), len(t.encode(r.text or "", add_special_tokens=False))) for r in docs.collect())
    cache = str(tmp_path / "cache")
    for _ in range(2):
        assert plain((r.doc_id, r.n_bytes, r.n_tokens) for r in token_counts.token_counts(docs, cache).collect()) == want
    stored = spark.read.parquet(cache)
    assert stored.count() == stored.select("digest").distinct().count()


def test_measures_equal_plain_counts():
    rng = random.Random(5)
    for _ in range(200):
        text = "".join(rng.choice(["a", "b", " ", "\n", "#", "\t"]) for _ in range(rng.randint(0, 120)))
        words = text.split()
        windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        hit = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
        lines = text.split("\n")
        again = sum(1 for i, x in enumerate(lines) if x.strip() and x in lines[:i])
        assert quality_rules.measure(text) == (len(words), sum(map(len, words)), text.count("#"), again, len(hit))


def test_quality_rules_keep_ordinary_documents(spark):
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(60)), "en", "s") for i in range(60)] + [(100, " ".join(f"v{k}###" for k in range(60)), "en", "s")]
    got = {r.doc_id: r.kept for r in quality_rules.quality_rules(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert not got.pop(100) and all(got.values())


def test_language_of_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    got = QUERIES["op6_language_id"](spark, SF).filter("held_out").join(docs, "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.95 * len(got)


@pytest.mark.parametrize("name,label,least", [("op8_quality_classifier", "quality", 0.9), ("op10_toxicity", "toxic", 0.85)])
def test_classifiers_on_held_out_rows(spark, name, label, least):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = QUERIES[name](spark, "/root/testdata/sf0.01").filter("held_out").join(labels, "doc_id").collect()
    assert sum(r.predicted == r[label] for r in got) >= least * len(got)


def test_string_kernel_tolerates_gaps_and_insertions():
    table = toxicity.feature_rows(["idiot"])[0]
    near, far = toxicity.kernel_sums(toxicity.codes([toxicity.letters(w) for w in ("i.d.i.o.t", "idxiot", "1d10t")]), table), toxicity.kernel_sums(toxicity.codes(["wonderful", "garden"]), table)
    assert near.min() > 0.5 > 0.2 > far.max()


def test_spelled_words_by_every_mark_and_gap():
    ways = [gap.join("idiot") for gap in (" ", ".", "-", "_", "*", " - ", " . ", "* ", "- ", "  ", "\t", " _ ")]
    for way in ways:
        assert all("idiot" in toxicity.tokens_of(text) for text in (way, f"such a man, {way} he is", f"so {way}")), way
    assert "dumb" in toxicity.tokens_of("d u m b man") and "idiot" not in toxicity.tokens_of("id - io - t")
    assert toxicity.tokens_of("_" * 3000 + "name " + "_ " * 3000)  # lines of marks end in linear time


def test_gapped_insults_score_as_plain_ones(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("aeioulnrst") for _ in range(6)) for _ in range(300)]
    clean = [" ".join(rng.choices(words, k=30)) for _ in range(300)]
    insult = lambda t: " ".join([t, rng.choice(["dumbhead", "jackfool"])])
    model = toxicity.fit([(insult(t), 1) for t in clean[:100]] + [(t, 0) for t in clean[100:]])
    texts = [clean[0], clean[0] + " dumbhead", clean[0] + " d - u - m - b - h - e - a - d", clean[0] + " d. u. m. b. h. e. a. d"]
    got = toxicity.score_toxicity(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).orderBy("doc_id").collect()
    assert [r.predicted for r in got] == [0, 1, 1, 1]


def test_training_order_has_every_pass(spark):
    """All words taken have a position, and by any time a source has given the share of its target that the schedule demands."""
    rng = random.Random(9)
    sizes = {"a": 120, "b": 120, "c": 20, "d": 60}
    docs = [(f"{s}{i}", s, " ".join("w" * rng.randint(1, 30))) for s, n in sizes.items() for i in range(n)] + [("none", "a", None)]
    d = spark.createDataFrame(docs, "doc_id string, source string, text string")
    mix = {r.doc_id: r for r in mixing.curriculum(d).collect()}
    order = mixing.training_order(d).collect()
    assert [r.position for r in order] == sorted(r.position for r in order)
    assert Counter(r.doc_id for r in order) == Counter({k: r.passes for k, r in mix.items() if r.passes}) and max(r.passes for r in mix.values()) > 1
    for k, r in mix.items():
        assert r.positions == sorted(x.position for x in order if x.doc_id == k) and r.position == (r.positions or [None])[0]
    for i, s in enumerate(sizes):
        slope, target = mixing.SLOPES[i % 3], next(r.target for r in mix.values() if r.source == s)
        given = 0
        for r in (r for r in order if r.source == s):
            due = target * (r.position + slope * (r.position**2 - r.position))
            assert abs(given + r.size / 2 - due) < 1e-6 * target
            given += r.size
        assert given == sum(r.taken for r in mix.values() if r.source == s)


def test_odd_inputs(spark):
    odd, none = spark.createDataFrame(ODD, SCHEMA), spark.createDataFrame([], SCHEMA)
    labels = spark.createDataFrame([(2, None, None)], "doc_id long, quality int, toxic int")
    for d, n in ((odd, len(ODD)), (none, 0)):
        assert line_dedup.line_dedup(d).count() == n
        assert quality_rules.quality_rules(d).count() == n
        assert {r.lang_pred for r in lang_id.language_id(d, F.lit(True)).filter("doc_id in (1, 2, 3)").collect()} <= {"und"}
        assert mixing.curriculum(d.withColumn("size", F.lit("clash"))).count() == n
        assert quality_model.score_quality(d, quality_model.train(d, labels, F.lit(True))).count() == n
        assert toxicity.score_toxicity(d, toxicity.train(d, labels, F.lit(True))).count() == n
        assert repeats.remove_repeats(d)[0].count() == near_dup.near_duplicates(d).count() == n


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first, columns = docs.count(), docs.columns
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        path = f"{os.environ.get('TMPDIR', '/tmp')}/pagewright-stage-{os.getpid()}-{len(kept)}"
        stage(spark, docs, SF).write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
        kept.append(docs.count())
        if len(kept) < 5:
            assert docs.columns == columns
    assert first > kept[0] >= kept[1] >= kept[2] >= kept[3] == kept[4] > 0.6 * first
    assert not near_dup.near_duplicates(spark.read.parquet(path.replace("-4", "-3"))).filter("NOT kept").count()
