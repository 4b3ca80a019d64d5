"""What shows only on tables with repeated URLs, more sites or larger groups than sf0.001 has."""

import random

from pyspark.sql import functions as F

from pagewright.operators import clusters, duplicates, graph, sites
from pagewright.plans import audit_queries, corpus, corpus_queries, queries, report_queries
from pagewright.storage import staged


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def _repeated_urls(spark, tmp_path):
    d = spark.createDataFrame([(i, f"https://a.example/{i % 3}") for i in range(1, 13)], "page_id long, url string")
    d.write.parquet(f"{tmp_path}/pages.parquet")
    return str(tmp_path)


def test_a_gap_of_a_late_site_is_found(spark):
    ids = [f"s{i}.example/blog" for i in range(15)]
    members = spark.createDataFrame([(c, f"https://{c}/{j}", 10 * i + j, 5, 0, "t", 2) for i, c in enumerate(ids) for j in range(2)], "cluster_id string, url string, ord long, word_count int, internal_links int, title string, depth int")
    k = spark.createDataFrame([(c.split("/")[0], i, "Blog basics", f"https://{c}-else", 80) for i, c in enumerate(ids)], "site string, ord int, query string, page string, impressions int")
    assert {r.site for r in corpus_queries.gap_issues(members, k).collect()} == {c.split("/")[0] for c in ids}


def test_coverage_gaps_within_a_site(spark):
    labels = spark.createDataFrame([("a", "a/x", "Blog"), ("b", "b/x", "Blog")], "site string, cluster_id string, label string")
    members = spark.createDataFrame([("b/x", "https://b/1")], "cluster_id string, url string")
    k = spark.createDataFrame([("a", 1, "blog one", "https://a/1", 30), ("b", 2, "blog two", "https://b/1", 30), ("b", 3, "BLOG three", "https://b/2", 30), ("b", 4, "blog four", "https://b/2", 29)], "site string, ord int, query string, page string, impressions int")
    assert rows(clusters.coverage_gaps(labels, members, k, within=("site",))) == [("a/x", "blog one", 1), ("b/x", "blog three", 1)]
    assert rows(clusters.coverage_gaps(labels, members, k.drop("site"))) == [("a/x", "blog one", 1), ("a/x", "blog three", 3), ("a/x", "blog two", 2), ("b/x", "blog one", 1), ("b/x", "blog three", 2)]


def test_sitemap_audit_of_urls_crawled_more_than_once(spark, tmp_path):
    got = queries.q_sitemap_audit(spark, _repeated_urls(spark, tmp_path)).collect()
    assert [tuple(r) for r in got] == [("a.example", 12, 3, 4, 4, 6)]


def test_sitemap_broken_of_urls_crawled_more_than_once(spark, tmp_path):
    got = report_queries.q_sitemap_broken(spark, _repeated_urls(spark, tmp_path))
    assert rows(got) == [("a.example", "https://a.example/0", 404), ("a.example", "https://a.example/1", 404), ("a.example", "https://a.example/2", 404)]


def _near(hashes):
    return {(i, j) for i in range(len(hashes)) for j in range(i + 1, len(hashes)) if hashes[i] != hashes[j] and bin(hashes[i] ^ hashes[j]).count("1") <= 10}


def test_near_pairs_of_a_group_of_several_parts(spark, monkeypatch):
    rng = random.Random(5)
    base = [rng.getrandbits(63) for _ in range(6)]
    hashes = list(dict.fromkeys(b ^ sum(1 << i for i in rng.sample(range(63), rng.randrange(9))) for b in base for _ in range(40)))
    monkeypatch.setattr(duplicates, "PART", 16)
    h = spark.createDataFrame([(i, x, s) for i, x in enumerate(hashes) for s in ("a", "b") if s == "a" or i < 10], "id long, hash long, site string")
    got = duplicates.near_pairs(h, "id", ["site"]).collect()
    assert len(got) == len({(r.site, r.a, r.b) for r in got})
    assert {(r.a, r.b) for r in got if r.site == "a"} == _near(hashes)
    assert {(r.a, r.b) for r in got if r.site == "b"} == _near(hashes[:10])


def test_every_near_pair_of_keys_that_share_hashes(spark, monkeypatch):
    rng = random.Random(7)
    base = [rng.getrandbits(63) for _ in range(4)]
    hashes = [b ^ sum(1 << i for i in rng.sample(range(63), 7 * (k // 5 % 2))) for b in base for k in range(30)]
    monkeypatch.setattr(duplicates, "PART", 16)
    got = duplicates.near_pairs(spark.createDataFrame(list(enumerate(hashes)), "id long, hash long"), "id", every=True).collect()
    want = {(i, j): d for i in range(len(hashes)) for j in range(i + 1, len(hashes)) if (d := bin(hashes[i] ^ hashes[j]).count("1")) <= 10}
    assert len(got) == len(want) and {(r.a, r.b): r.distance for r in got} == want


def test_every_near_pair_of_pages_but_those_left_out(spark):
    """Texts of the same words in another order have one hash; the first of them is canonical for /1 and in a cluster with /2."""
    words = [f"word{i}" for i in range(40)]
    texts = [words, words[::-1], words[5:] + words[:5], words, [f"other{i}" for i in range(40)]]
    p = [("s", f"/{i}", i, "t", ["h"], "m", " ".join(t)) for i, t in enumerate(texts)] + [("u", "/9", 9, "t", ["h"], "m", " ".join(words))]
    d = spark.createDataFrame(p, "site string, url string, ord int, title string, h1 array<string>, meta_description string, text_content string")
    members = spark.createDataFrame([("/0", "c"), ("/2", "c")], "url string, cluster_id string")
    pairs = spark.createDataFrame([("/1", "/0")], "a string, b string")
    got = [(r.a, r.b, r.distance) for r in duplicates.near_duplicate_pages(d, "site", members, pairs, every=True).collect()]
    assert sorted(got) == [("/0", "/3", 0), ("/1", "/2", 0), ("/1", "/3", 0), ("/2", "/3", 0)]


def test_messages_count_every_near_pair(spark):
    sf = "/root/testdata/sf0.001"
    p = staged(corpus.pages(spark, sf).drop("html"), "pages")
    good = [r for r in p.filter("status_code = 200").orderBy("ord").collect() if len(r.text_content.split()) >= 20]
    cluster = {r.url: r.cluster_id for r in corpus_queries.cluster_members(p).collect()}
    own = {frozenset((r.a, r.b)) for r in sites.canonical_pairs(p.filter("status_code = 200")).collect()}
    hashes = {r.ord: r.hash & (1 << 64) - 1 for r in duplicates.simhash(p, "ord", F.col("text_content")).collect()}
    near = [(x, y) for i, x in enumerate(good) for y in good[i + 1 :] if x.site == y.site and bin(hashes[x.ord] ^ hashes[y.ord]).count("1") <= 10]
    near = [(x, y) for x, y in near if frozenset((x.url, y.url)) not in own and (x.url not in cluster or cluster[x.url] != cluster.get(y.url))]
    every = corpus_queries.all_issues(spark, sf)
    (text,) = [r.text for r in audit_queries.q_audit_messages(spark, sf).collect()]
    assert f"Issues: {every.filter(F.col('type') != 'near_duplicate_content').count() + len(near)}\n" in text
    assert len(near) > every.filter("type = 'near_duplicate_content'").count()


def test_near_pairs_broadcast_no_classes(spark):
    """An explode hides from the optimizer how many rows there are, so the driver must never gather them."""
    h = spark.range(200).select("id", F.xxhash64("id").alias("hash"), F.lit("s").alias("site"))
    plan = duplicates.near_pairs(h, "id", ["site"])._jdf.queryExecution().executedPlan().toString()
    pairs = plan[: plan.index("Generate")]
    assert "SortMergeJoin" in pairs and "BroadcastHashJoin" not in pairs


def test_the_bag_of_issues_reads_only_what_its_sources_wrote(spark):
    """The plans of all sources as one are more than the driver holds: none may be left in the plan of what is counted from them."""
    plan = corpus_queries.all_issues(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 12 and "Join" not in plan and "Exchange" not in plan and "Aggregate" not in plan


def test_passed_checks_look_at_the_pages_that_were_written(spark):
    plan = corpus_queries.q_corpus_passed(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "html#" not in plan and plan.count("Scan parquet") == 13


def test_simple_scores_are_one_aggregation_of_written_issues(spark):
    plan = corpus_queries.q_corpus_simple_scores(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_search_terms_and_sitemaps_are_read_as_written(spark, monkeypatch):
    """``lower`` of a literal is worked out by the driver, whose first call makes over 3 GB of garbage; entries were made anew by each reader."""
    given = {}
    gaps, canonical, sitemap = corpus_queries.gap_issues, corpus_queries.canonical_issues, corpus_queries.sitemap_issues
    plan = lambda d: d._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(corpus_queries, "gap_issues", lambda m, k: given.update(terms=plan(k)) or gaps(m, k))
    monkeypatch.setattr(corpus_queries, "canonical_issues", lambda p, e: given.update(canonical=plan(e)) or canonical(p, e))
    monkeypatch.setattr(corpus_queries, "sitemap_issues", lambda p, e, s: given.update(sitemap=plan(e)) or sitemap(p, e, s))
    corpus_queries.all_issues(spark, "/root/testdata/sf0.001")
    assert set(given) == {"terms", "canonical", "sitemap"} and all(p.startswith("Relation [") and "\n" not in p.strip() for p in given.values())


def test_simhash_is_a_fold(spark):
    d = spark.createDataFrame([(1, "Some words, here"), (2, ""), (3, None), (4, "x")], "id long, text string")
    h = duplicates.simhash(d, "id", F.col("text"))
    bits = lambda t: sum((2 * sum(x >> i & 1 for x in t) >= len(t)) << i for i in range(64)) if t else 0
    hashes = {w: r.h & (1 << 64) - 1 for w in ("some", "words", "here", "x") for r in [spark.range(1).select(duplicates.hash64(F.lit(w)).alias("h")).first()]}
    want = {1: bits([hashes["some"], hashes["words"], hashes["here"]]), 2: 0, 3: 0, 4: hashes["x"]}
    assert {r.id: r.hash & (1 << 64) - 1 for r in h.collect()} == want
    assert h._jdf.queryExecution().optimizedPlan().toString().count("CASE WHEN") < 10


def test_levels_of_clicks_are_one_scan(spark):
    e = spark.createDataFrame([(f"https://a.example/{i}", f"https://a.example/{i + 1}") for i in range(5)], "src string, dst string")
    depth = graph.click_depth(e, "https://a.example/0")
    assert {r.url[-1]: r.depth for r in depth.collect()} == {str(i): i for i in range(6)}
    assert depth._jdf.queryExecution().executedPlan().toString().count("Scan parquet") == 1


def test_rounds_of_redirects_are_written_once_each(spark, monkeypatch):
    rounds, staged = [], sites.staged
    monkeypatch.setattr(sites, "staged", lambda d, tag: rounds.append(tag) or staged(d, tag))
    hops = spark.createDataFrame([("/a", 301, "/b"), ("/b", 302, "/c"), ("/c", 200, None), ("/l", 301, "/m"), ("/m", 301, "/l"), ("/e", 301, ""), ("/n", None, "/a"), ("/x", 301, "/gone")], "url string, status_code int, location string")
    chains = sites.redirect_chains(hops)
    got = {r.start_url: ("".join(r.path), r.final_url, r.final_status, r.hops, r.is_loop) for r in chains.collect()}
    assert got == {"/a": ("/a/b/c", "/c", 200, 2, False), "/b": ("/b/c", "/c", 200, 1, False), "/c": ("/c", "/c", 200, 0, False), "/l": ("/l/m", "/l", 301, 2, True), "/m": ("/m/l", "/m", 301, 2, True),
                   "/e": ("/e", "/e", 301, 0, False), "/n": ("/n", "/n", 0, 0, False), "/x": ("/x/gone", "/gone", 0, 1, False)}
    assert len(rounds) == 3
