"""Near-duplicates by circulant MinHash, banding and exact Jaccard verification.

Two permutations of the 32-bit circle make all signature coordinates: the first scatters the shingle hashes, the second, shifted
by one place for each coordinate, orders them; a coordinate is the least place that any shingle gets. Coordinates in bands of
ROWS make buckets. With 24 bands of 4, a pair at similarity 0.8 shares no bucket with probability 3e-6, and has an estimate
below 0.5, which is not verified, with probability 1e-11.

Documents with equal shingle sets are one node. In each bucket every node is compared with one hub, the node that shares most
buckets with others; verified links are joined into components. Where a bucket still holds
several components, all pairs across them are compared too; in large buckets one block of nodes meets another inside a task, which
compares signatures and full sets and gives links only, each pair only in the first band that it shares, so that pairs that are
not links never become rows. A comparison first looks at the signatures (an estimate under ``0.8 - SLACK`` is seven standard
errors off) and then counts the full shingle sets. Component labels spread by least label and pointer jumping over tables in the
shared folder.

Shingles are of five words unless the caller says otherwise, as ``op7_near_duplicates`` does with four.

Edge cases: null, empty and wordless texts have no shingles, component_id is their own id; texts shorter than a shingle are
one shingle; rows that share an id count as one node; a null id is reachable but names no component; an empty table gives an
empty result; other columns are kept by ``drop_near_duplicates``, whatever their names, and ignored by ``near_duplicates``; a row
goes only if a row of its component stays, so of rows that share an id each is judged by its own text; texts may be of any length.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, staged, table

SHINGLE = 5
SIMILARITY = 80
BANDS, ROWS = 24, 4
SLACK = 0.3
#: Buckets of more nodes are compared in blocks of BLOCK nodes, inside tasks.
SMALL, BLOCK = 24, 512
#: As many shingles as a block has at most, on average (8 bytes each).
WEIGHT = 2_000_000
P = [np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
SHIFTS = np.arange(BANDS * ROWS, dtype=np.uint32)[:, None]
LETTERS = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles."""
    words = (text or "").encode().translate(LETTERS).split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    size = min(size, len(h))
    out = np.full(len(h) - size + 1, size, np.uint64)
    for i in range(size):
        out = (out ^ h[i : i + len(out)]) * P[0]
        out ^= out >> np.uint64(29)
    return np.unique(out * P[1])


def mix(x: np.ndarray) -> np.ndarray:
    """A permutation of the 32-bit integers, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)
    return x


def signature(s: np.ndarray) -> np.ndarray:
    out = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for a in range(0, len(s), 1024):
        part = s[a : a + 1024]
        first = mix((part ^ (part >> np.uint64(32))).astype(np.uint32) * np.uint32(0x9E3779B1))
        np.minimum(out, mix(first[None, :] - SHIFTS).min(1), out=out)
    return out


def _row_key(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) with 128 bits that stand for the row."""
    return docs.withColumn("k", F.xxhash64("doc_id", "text")).withColumn("k2", F.xxhash64("text", "doc_id"))


def _signed(docs: DataFrame, size: int) -> DataFrame:
    def rows(c: dict[str, list]) -> dict[str, list]:
        sets = [shingles(t, size) for t in c["text"]]
        return {
            "doc_id": c["doc_id"], "k": c["k"], "k2": c["k2"], "n_shingles": [len(s) for s in sets],
            "set_key": [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets],
            "sig": [signature(s).tobytes() if len(s) else None for s in sets],
        }

    own = _row_key(docs.select("doc_id", "text"))
    schema = T.StructType([own.schema["doc_id"], own.schema["k"], own.schema["k2"], T.StructField("n_shingles", T.LongType()), T.StructField("set_key", T.BinaryType()), T.StructField("sig", T.BinaryType())])
    return arrow_map(own, rows, schema)


def _sets(docs: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    schema = T.StructType([T.StructField("node", docs.schema["doc_id"].dataType), T.StructField("set", T.BinaryType())])
    texts = docs.select(F.col("doc_id").alias("node"), "text").join(nodes, "node", "left_semi")
    return arrow_map(texts, lambda c: {"node": c["node"], "set": [shingles(t, size).tobytes() for t in c["text"]]}, schema)


def _near_signatures(pairs: DataFrame, reps: DataFrame, least: float) -> DataFrame:
    """a, b and the estimated similarity of the pairs whose signatures agree in a share of at least ``least``."""
    a = pairs.join(reps.select(F.col("node").alias("a"), F.col("sig").alias("sa")), "a")
    both = a.join(reps.select(F.col("node").alias("b"), F.col("sig").alias("sb")), "b").select("a", "b", "sa", "sb")

    def rows(c: dict[str, list]) -> dict[str, list]:
        n = len(c["a"])
        x, y = (np.frombuffer(b"".join(c[k]), np.uint32).reshape(n, -1) for k in ("sa", "sb"))
        return {"a": c["a"], "b": c["b"], "est": (x == y).mean(1).tolist()}

    schema = T.StructType([both.schema["a"], both.schema["b"], T.StructField("est", T.DoubleType())])
    return arrow_map(both, rows, schema).filter(F.col("est") >= least)


def _candidates(t) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of one block pair across components, by signatures, each only in the first band that it shares."""
    n = t.num_rows
    sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint32).reshape(n, BANDS * ROWS)
    node, label, blk, band, lo, hi, least = (t.column(c).to_numpy() for c in ("node", "label", "blk", "band", "lo", "hi", "least"))
    first, second = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for at in range(0, n, 32):
        part = slice(at, at + 32)
        equal = sig[part, None, :] == sig[None, :, :]
        ok = (equal.mean(2) >= least[0]) & (label[part, None] != label[None, :]) & (node[part, None] < node[None, :])
        if lo[0] != hi[0]:
            ok &= blk[part, None] != blk[None, :]
        i, j = np.nonzero(ok)
        mine = equal[i, j].reshape(len(i), BANDS, ROWS).all(2).argmax(1) == band[0]
        first.append(i[mine] + at)
        second.append(j[mine])
    return np.concatenate(first), np.concatenate(second)


def _hit(t):
    """The rows of one block pair that are in a pair of candidates."""
    return t.take(np.unique(np.concatenate(_candidates(t))))


def _links_inside(t):
    """A spanning forest of the similar pairs of one block pair, by their full sets."""
    import pyarrow as pa

    node, label, percent = t.column("node").to_numpy(), t.column("label").to_pylist(), t.column("percent")[0].as_py()
    sets = [np.frombuffer(s, np.uint64) for s in t.column("set").to_pylist()]
    up = {x: x for x in label}

    def root(x):
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    i, j = _candidates(t)
    first, second = [], []
    for x in np.unique(i).tolist():
        others = [y for y in j[i == x].tolist() if root(label[x]) != root(label[y]) and 100 * min(len(sets[x]), len(sets[y])) >= percent * max(len(sets[x]), len(sets[y]))]
        for y in others:
            if root(label[x]) == root(label[y]):
                continue
            at = np.minimum(np.searchsorted(sets[x], sets[y]), len(sets[x]) - 1)
            common = int(np.count_nonzero(sets[x][at] == sets[y]))
            if 100 * common >= percent * (len(sets[x]) + len(sets[y]) - common):
                up[root(label[x])] = root(label[y])
                first.append(x)
                second.append(y)
    return pa.table({"a": pa.array(node[first] if first else node[:0]), "b": pa.array(node[second] if second else node[:0])})


def _across_blocks(docs: DataFrame, own: DataFrame, reps: DataFrame, size: int, least: float, similarity: int) -> DataFrame:
    """a, b: links across components in the large buckets of ``own``, enough of them to join what is similar.

    Blocks of nodes meet inside tasks, first by signatures, then those of candidates by full sets; no pair that is not a link
    becomes a row. Similar sets are of similar size, so nodes fall into classes by the size of their sets, each class as wide as
    the similarity allows, and a block meets those of its own class and of the next ones only. The number of blocks follows a
    class's nodes and the size of their sets, which bounds a task's memory.
    """
    own = own.join(reps.select("node", "sig", "n_shingles"), "node").withColumn("cls", F.floor(F.log("n_shingles") / F.log(F.lit(100 / similarity)) + 1e-9).cast("bigint"))
    blocks = own.groupBy("bucket", "cls").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n_shingles") / WEIGHT)).cast("bigint").alias("blocks"))
    name = lambda c, i: F.shiftleft(c, 32) + i  # noqa: E731  # a block's number: class and place
    dealt = own.join(blocks, ["bucket", "cls"]).withColumn("blk", name(F.col("cls"), F.pmod(F.xxhash64("node"), F.col("blocks"))))
    dealt = dealt.withColumn("other", F.explode(F.array(*[F.col("cls") + d for d in (-1, 0, 1)]))).join(blocks.select("bucket", F.col("cls").alias("other"), F.col("blocks").alias("others")), ["bucket", "other"])
    dealt = dealt.withColumn("_o", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("others") - 1))).withColumn("_o", name(F.col("other"), F.col("_o")))
    dealt = dealt.select("bucket", F.least("blk", "_o").alias("lo"), F.greatest("blk", "_o").alias("hi"), "band", "node", "label", "sig", "blk", F.lit(least).alias("least"), F.lit(similarity).alias("percent"))
    hit = staged(dealt.groupBy("bucket", "lo", "hi").applyInArrow(_hit, dealt.schema), "near-blocks")
    sets = staged(_sets(docs, hit.select("node").distinct(), size), "near-sets")
    kind = reps.schema["node"].dataType
    return hit.join(sets, "node").groupBy("bucket", "lo", "hi").applyInArrow(_links_inside, T.StructType([T.StructField("a", kind), T.StructField("b", kind)])).distinct()


def _verified(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """a, b of the pairs whose full sets are similar."""
    a = pairs.select("a", "b").join(sets.select(F.col("node").alias("a"), F.col("set").alias("sa")), "a")
    both = a.join(sets.select(F.col("node").alias("b"), F.col("set").alias("sb")), "b").select("a", "b", "sa", "sb")

    def rows(c: dict[str, list]) -> dict[str, list]:
        out = []
        for x, y in zip(c["sa"], c["sb"], strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            common = len(np.intersect1d(x, y, assume_unique=True))
            out.append(100 * common >= similarity * (len(x) + len(y) - common))
        return {"a": c["a"], "b": c["b"], "linked": out}

    schema = T.StructType([both.schema["a"], both.schema["b"], T.StructField("linked", T.BooleanType())])
    return arrow_map(both, rows, schema).filter("linked").select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """node and label (the least node reachable) for the nodes of ``links(a, b)``."""
    both = staged(links.select("a", "b").union(links.select("b", "a")).distinct(), "near-links")
    label = staged(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label"), F.lit(True).alias("moved")), "near-labels")
    while not label.filter("moved").isEmpty():
        heard = both.join(label.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("m"))
        step = label.join(heard, "node", "left").select("node", F.col("label").alias("old"), F.least("label", "m").alias("at"))
        up = label.select(F.col("node").alias("at"), F.col("label").alias("up"))
        label = staged(step.join(up, "at").select("node", F.least("at", "up").alias("label"), (F.least("at", "up") < F.col("old")).alias("moved")), "near-labels")
    return label.select("node", "label")


def _judged(docs: DataFrame, size: int, similarity: int) -> DataFrame:
    """doc_id, n_shingles, component_id, kept and the row's key for each row of ``docs(doc_id, text)``."""
    signed = staged(_signed(docs, size), "near-signed")
    classes = signed.filter("set_key IS NOT NULL").groupBy("set_key").agg(F.min("doc_id").alias("node"), F.first("sig").alias("sig"), F.first("n_shingles").alias("n_shingles")).filter("node IS NOT NULL")
    reps = staged(classes, "near-classes")
    buckets = reps.select("node", F.posexplode(F.array(*[F.xxhash64(F.lit(i), F.expr(f"substring(sig, {i * ROWS * 4 + 1}, {ROWS * 4})")) for i in range(BANDS)])).alias("band", "bucket"))
    shared = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = staged(buckets.join(shared, "bucket"), "near-members")
    known = members.groupBy("node").agg(F.sum("n").alias("known"))
    hubs = members.join(known, "node").groupBy("bucket").agg(F.max(F.struct("known", F.col("node").alias("hub"))).alias("h")).select("bucket", F.col("h.hub").alias("hub"))
    star = members.join(hubs, "bucket").filter("node <> hub").select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
    least = similarity / 100 - SLACK
    tested = staged(_near_signatures(star, reps, least), "near-tested")
    wanted = tested.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = staged(_sets(docs, wanted, size), "near-sets")
    links = staged(_verified(tested, sets, similarity), "near-verified")
    label = components(links)

    # buckets that still hold several components: all pairs across them
    own = members.join(label, "node", "left").select("bucket", "band", "n", "node", F.coalesce("label", "node").alias("label"))
    mixed = own.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi").select("bucket")
    own = staged(own.join(mixed, "bucket", "left_semi"), "near-mixed")
    few = own.filter(F.col("n") <= SMALL)
    x, y = few.select("bucket", F.col("node").alias("a"), F.col("label").alias("la")), few.select("bucket", F.col("node").alias("b"), F.col("label").alias("lb"))
    cross = x.join(y, "bucket").filter("a < b AND la <> lb").select("a", "b").distinct().join(tested.select("a", "b"), ["a", "b"], "left_anti")
    cross = staged(_near_signatures(cross, reps, least).select("a", "b"), "near-cross")
    new = cross.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(sets.select("node"), "node", "left_anti")
    sets = sets.unionByName(staged(_sets(docs, new, size), "near-sets"))
    more = _verified(cross, sets, similarity).unionByName(_across_blocks(docs, own.filter(F.col("n") > SMALL), reps, size, least, similarity))
    more = staged(more, "near-verified")
    classes = reps.select("set_key", "node").join(label, "node", "left").select("set_key", F.coalesce("label", "node").alias("label"))
    if not more.isEmpty():  # components joined by them: a graph of labels
        to = lambda side: label.select(F.col("node").alias(side), F.col("label").alias("l" + side))
        between = more.join(to("a"), "a", "left").join(to("b"), "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")).filter("a <> b")
        last = components(between).select(F.col("node").alias("label"), F.col("label").alias("last"))
        classes = classes.join(last, "label", "left").select("set_key", F.coalesce("last", "label").alias("label"))
    out = signed.select("doc_id", "n_shingles", "set_key", "k", "k2").join(classes, "set_key", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("label", "doc_id").alias("component_id"), "k", "k2")
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def near_duplicates(docs: DataFrame, size: int = SHINGLE, similarity: int = SIMILARITY) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of ``docs(doc_id, text)``; similarity in percent."""
    return _judged(docs, size, similarity).select("doc_id", "n_shingles", "component_id", "kept")


def drop_near_duplicates(docs: DataFrame, size: int = SHINGLE, similarity: int = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` with one document left of each component."""
    gone = _judged(docs, size, similarity).filter(~F.col("kept")).select("k", "k2").distinct()
    # the caller's columns travel in one struct, so that no name of theirs meets one of ours
    own = _row_key(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "text"))
    return own.drop("doc_id", "text").join(gone, ["k", "k2"], "left_anti").select("row.*")


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), size=4)
