"""Suffix-array dedup: removes every byte covered by a LENGTH-byte string that also starts anywhere else in the corpus.

Texts are byte strings; matches never cross documents, and strings are judged on the input.

1. Every window of LENGTH bytes takes the least hash of its GRAM-byte grams as its anchor, so equal windows have equal anchors
   wherever they stand. Anchors that occur once in the corpus are dropped by one aggregation; so most text is never moved.
2. What is left is cut into contexts: runs of windows with one anchor. Equal contexts are pre-aggregated to one with a count;
   one with a count over 1 is repeated as a whole.
3. Contexts are dealt out by anchor. In each block of them a run-length index is built: the suffix array by prefix doubling,
   its Burrows-Wheeler transform compressed to runs, and match lengths with the neighbours in suffix order sampled at the
   heads and ends of runs only. Streaming over the text, the match length of any other position is its last sample less the
   distance (inside a run both neighbours move along), which gives the matching statistics of every position against all
   others; positions with LENGTH or more are repeated.
4. An anchor with more than HOT distinct contexts (a passage in a large part of all documents) would not fit into one block.
   Its contexts are cut finer, into pieces of at most STEPS windows whose anchor stands about equally far in, and dealt out by
   the bytes that all such windows share; equal windows still meet. Pieces are pre-aggregated like contexts and indexed as soon
   as their key has no more than HOT, else cut again. A piece of one window is shared as a whole, so the last step ends it.
5. Marks go back from pieces and contexts to places, and the marked texts are cut.

Exact copies are found by digest first: all but short ones go as a whole, and one of them stands for all in steps 2 to 4.
Contexts are cut out of the texts twice, once for the index and once for their places, which costs less than storing them.

Memory of a task: a block has at most BLOCK bytes and one more anchor, that is 0.45 MB, and takes some 70 MB while it is
indexed; texts are hashed in segments of SEGMENT bytes, however long they are.

Edge cases: null texts are empty; texts under LENGTH bytes are kept; repeated rows are copies of each other; an empty table gives
an empty result; other columns are ignored; a null id is an id like others; very long texts are read in segments.
"""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, discard, ship, staged, table

LENGTH, GRAM = 200, 40
SPAN = LENGTH - GRAM + 1
#: As many contexts as one key may bring into a block (512 x 359 bytes), and bytes after which a block is closed.
HOT, BLOCK = 512, 262_144
#: Windows of a piece, step by step; the last one must be 1.
STEPS = (32, 8, 1)
SEGMENT = 1 << 20

_rng = np.random.default_rng(5)
BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        for i, b in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            steps = np.full(max(n, 1 << 17), b, np.uint64)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def gram_hashes(b: np.ndarray) -> np.ndarray:
    up, down = powers(len(b) + 1)
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(BYTE[b] * up[:-1], out=sums[1:])
    h = (sums[GRAM:] - sums[:-GRAM]) * down[: len(b) - GRAM + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def window_anchors(h: np.ndarray) -> np.ndarray:
    """The least of every SPAN gram hashes in a row."""
    m, width = h, 1
    while 2 * width <= SPAN:
        m = np.minimum(m[:-width], m[width:])
        width *= 2
    return np.minimum(m[: len(m) - (SPAN - width)], m[SPAN - width :]) if SPAN > width else m


def segments(text: bytes):
    """Offset and bytes of overlapping parts of a text, so that each window is in one of them."""
    for at in range(0, len(text) - LENGTH + 1, SEGMENT):
        yield at, text[at : at + SEGMENT + LENGTH - 1]


def anchors(text: bytes) -> np.ndarray:
    """The text's anchors as signed numbers; one that can repeat inside the text stands twice or more."""
    out = [np.zeros(0, np.int64)]
    for _, part in segments(text):
        h = gram_hashes(np.frombuffer(part, np.uint8))
        own = np.unique(window_anchors(h))
        at = np.minimum(np.searchsorted(own, h), len(own) - 1)
        twice = np.bincount(at[own[at] == h], minlength=len(own)) > 1
        out += [own.view(np.int64), own[twice].view(np.int64)]
    return np.concatenate(out)


def contexts(text: bytes, wanted: list[int]) -> list[tuple[int, int, bytes]]:
    """(anchor, offset, bytes) of the runs of windows with a wanted anchor, in parts of at most SPAN windows."""
    out, wanted = [], np.array(wanted, np.int64)
    for base, part in segments(text):
        m = window_anchors(gram_hashes(np.frombuffer(part, np.uint8))).view(np.int64)
        starts = np.flatnonzero(np.concatenate([[True], m[1:] != m[:-1]]))
        ends = np.append(starts[1:], len(m))
        use = np.isin(m[starts], wanted)
        for a, e in zip(starts[use].tolist(), ends[use].tolist(), strict=True):
            out += [(int(m[a]), base + i, part[i : min(i + SPAN, e) + LENGTH - 1]) for i in range(a, e, SPAN)]
    return out


def pieces(context: bytes, step: int) -> list[tuple[int, int, bytes]]:
    """(key, offset, bytes) of the runs of windows of a context whose first anchor stands as far in, counted in steps.

    The key is made of the step's number and the bytes that all windows of that step share, so equal windows have equal keys.
    """
    h = gram_hashes(np.frombuffer(context, np.uint8))
    windows = np.arange(len(context) - LENGTH + 1)
    found = np.flatnonzero(h == h[: SPAN].min())  # a context has one anchor
    place = found[np.searchsorted(found, windows)]
    number = (place - windows) // step
    starts = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (number[1:] != number[:-1])]))
    out = []
    for a, e in zip(starts.tolist(), [*starts[1:].tolist(), len(windows)], strict=True):
        p, n = int(place[a]), int(number[a])
        shared = context[p - n * step : p - (n + 1) * step + 1 + LENGTH]
        out.append((xxhash.xxh3_64_intdigest(shared, seed=n) - (1 << 63), a, context[a : e + LENGTH - 1]))
    return out


def matching_statistics(texts: list[bytes]) -> list[np.ndarray]:
    """For each position of each text, how long a string starts there that also starts at any other position of the texts,
    right for all lengths up to LENGTH (the suffixes are sorted by their first LENGTH bytes or more).

    Matches end with their texts: each is followed by a separator of its own.
    """
    count = len(texts)
    t = np.full(sum(map(len, texts)) + count, 0, np.int64)
    at, bounds = 0, []
    for i, x in enumerate(texts):
        t[at : at + len(x)] = np.frombuffer(x, np.uint8).astype(np.int64) + count
        t[at + len(x)] = i
        bounds.append((at, at + len(x)))
        at += len(x) + 1
    n = len(t)

    def shifted(a: np.ndarray, by: int) -> np.ndarray:
        out = np.zeros_like(a)
        out[: n - by] = a[by:]
        return out

    bits = max(2, int(count + 256).bit_length())
    width = 3 if 3 * bits <= 63 else 2
    key = t
    for i in range(1, width):
        key = (key << bits) | shifted(t, i)
    ranks = []
    while True:
        order = np.argsort(key, kind="quicksort")
        new = np.concatenate([[False], key[order][1:] != key[order][:-1]]).cumsum()
        rank = np.empty(n, np.int64)
        rank[order] = new
        ranks.append((width, rank.astype(np.int32)))
        if new[-1] == n - 1 or width >= LENGTH:
            break
        key = (rank << 32) | (shifted(rank, width) + 1) * (np.arange(n) + width < n)
        width *= 2
    previous = t[order - 1]  # the transform
    heads = np.concatenate([[True], previous[1:] != previous[:-1]])

    def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        length = np.zeros(len(a), np.int64)
        for w, r in reversed(ranks):
            x, y = np.minimum(a + length, n - 1), np.minimum(b + length, n - 1)
            length += np.where(r[x] == r[y], w, 0)
        for _ in range(ranks[0][0] - 1):
            x, y = np.minimum(a + length, n - 1), np.minimum(b + length, n - 1)
            length += (t[x] == t[y]) & (a != b)
        return length

    def streamed(samples: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        last = np.zeros(n, np.int64)
        value = np.zeros(n, np.int64)
        value[samples] = lengths
        last[samples] = samples
        last = np.maximum.accumulate(last)
        return np.maximum(value[last] - (np.arange(n) - last), 0)

    j = np.flatnonzero(heads)
    before = np.zeros(len(j), np.int64)
    before[1:] = common(order[j[1:]], order[j[1:] - 1])
    k = np.append(j[1:] - 1, n - 1)  # ends of runs
    after = np.zeros(len(k), np.int64)
    after[:-1] = common(order[k[:-1]], order[k[:-1] + 1])
    both = np.maximum(streamed(order[j], before), streamed(order[k], after))
    return [both[a:b] for a, b in bounds]


def spans(repeated: np.ndarray) -> list[tuple[int, int]]:
    """Byte spans covered by the windows that are marked."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], repeated.astype(np.int8), [0]])))
    return [(int(a), int(b) + LENGTH - 1) for a, b in zip(edge[::2], edge[1::2], strict=True)]


CONTEXT = T.StructType([T.StructField(n, t) for n, t in (("h", T.LongType()), ("digest", T.BinaryType()), ("at", T.IntegerType()), ("cid", T.BinaryType()), ("ctx", T.BinaryType()), ("copies", T.LongType()))])
PIECE = T.StructType([T.StructField(n, t) for n, t in (("whole", T.BinaryType()), ("at", T.IntegerType()), ("h", T.LongType()), ("cid", T.BinaryType()), ("ctx", T.BinaryType()), ("copies", T.LongType()))])
MARK = T.StructType([T.StructField("cid", T.BinaryType()), T.StructField("lo", T.IntegerType()), T.StructField("hi", T.IntegerType())])


def _indexed(batches):
    """Marks of the contexts in batches sorted by anchor: whole anchors are gathered into blocks, each with its own index."""
    import pyarrow as pa

    def marks(block):
        cids, los, his = [], [], []
        for (cid, ctx, copies), ms in zip(block, matching_statistics([c for _, c, _ in block]), strict=True):
            if copies > 1:  # repeated as a whole; here only for others to match
                continue
            for lo, hi in spans(ms[: len(ctx) - LENGTH + 1] >= LENGTH):
                cids.append(cid)
                los.append(lo)
                his.append(hi)
        return pa.RecordBatch.from_arrays([pa.array(cids, pa.binary()), pa.array(los, pa.int32()), pa.array(his, pa.int32())], names=["cid", "lo", "hi"])

    block, size, last = [], 0, None
    for b in batches:
        for h, cid, ctx, copies in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            if h != last and size > BLOCK:
                yield marks(block)
                block, size = [], 0
            block.append((cid, ctx, copies))
            size += len(ctx)
            last = h
    if block:
        yield marks(block)


def _marks(kinds: DataFrame, steps: tuple[int, ...] = STEPS) -> DataFrame:
    """cid, lo and hi of the repeated spans of the contexts ``kinds(h, cid, ctx, copies)``, which are distinct by h and cid.
    One with copies is repeated as a whole, which is its only mark: else each of its places would meet each of its pieces' marks.

    Tables of pieces are small beside those of contexts, and stay."""
    per_key = kinds.groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    several = kinds.join(per_key.filter(f"n > 1 AND n <= {HOT}" if steps else "n > 1").select("h"), "h").select("h", "cid", "ctx", "copies")
    alone = kinds.join(per_key.filter("n = 1").select("h"), "h").filter("copies = 1").select("h", "cid", "ctx", "copies")  # may match itself
    parts = int(kinds.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number given is kept: blocks stay spread over tasks
    ship(kinds.sparkSession)
    marks = several.unionByName(alone).repartition(parts, "h").sortWithinPartitions("h").mapInArrow(_indexed, MARK)
    marks = marks.unionByName(kinds.filter("copies > 1").select("cid", F.lit(0).alias("lo"), F.length("ctx").alias("hi")))
    if not steps:
        return marks
    hot = kinds.join(per_key.filter(f"n > {HOT}").select("h"), "h").select("cid", "ctx", "copies")

    def cut(c: dict[str, list]) -> dict[str, list]:
        rows = [(cid, at, key, xxhash.xxh3_128_digest(x), x, n) for cid, ctx, n in zip(c["cid"], c["ctx"], c["copies"], strict=True) for key, at, x in pieces(ctx, steps[0])]
        return dict(zip(PIECE.names, ([*x] for x in zip(*rows, strict=True)), strict=True)) if rows else {n: [] for n in PIECE.names}

    finer = staged(arrow_map(hot, cut, PIECE), "repeat-pieces")
    if finer.isEmpty():
        return marks
    own = staged(finer.groupBy("h", "cid").agg(F.sum("copies").alias("copies"), F.first("ctx").alias("ctx")), "repeat-contexts")
    inside = finer.filter("copies = 1").select("whole", "at", "cid").join(_marks(own, steps[1:]), "cid")
    return marks.unionByName(inside.select(F.col("whole").alias("cid"), (F.col("at") + F.col("lo")).alias("lo"), (F.col("at") + F.col("hi")).alias("hi")))


def remove_repeats(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row of ``docs(doc_id, text)``; digest and kept bytes of each
    distinct text that lost some of its bytes)."""
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    text = text.withColumn("digest", F.unhex(F.sha2("text", 256)))
    keys = staged(text.select("doc_id", "digest", F.octet_length("text").cast("bigint").alias("n_bytes")), "repeat-keys")

    def found(c: dict[str, list]) -> dict[str, list]:
        own = [anchors(t) for t in c["text"]]
        return {"h": np.concatenate([np.zeros(0, np.int64), *own]), "k": np.repeat(np.array([int.from_bytes(d[:8], "big", signed=True) for d in c["digest"]], np.int64), [len(x) for x in own])}

    anchor = T.StructType([T.StructField("h", T.LongType()), T.StructField("k", T.LongType())])
    occ = staged(arrow_map(text.filter(F.octet_length("text") >= LENGTH).select("text", "digest"), found, anchor), "repeat-anchors")
    again = occ.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h")
    wanted = occ.join(again, "h", "left_semi").distinct().groupBy("k").agg(F.collect_list("h").alias("wanted"))

    classes = keys.filter(F.col("n_bytes") >= LENGTH).groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    first8 = F.conv(F.hex(F.substring("digest", 1, 8)), 16, -10).cast("bigint")
    sources = classes.withColumn("k", first8).join(wanted, "k").select(F.col("digest").alias("_d"), "rep", "copies", "wanted")
    source_texts = staged(text.join(sources, (F.col("digest") == F.col("_d")) & F.col("doc_id").eqNullSafe(F.col("rep"))).select("digest", "text", "copies", "wanted"), "repeat-texts")
    discard(occ)

    def cut(c: dict[str, list]) -> dict[str, list]:
        rows = [(h, d, at, xxhash.xxh3_128_digest(x), x, n) for d, t, n, w in zip(c["digest"], c["text"], c["copies"], c["wanted"], strict=True) for h, at, x in contexts(t, w)]
        return dict(zip(("h", "digest", "at", "cid", "ctx", "copies"), ([*x] for x in zip(*rows, strict=True)), strict=True)) if rows else {n: [] for n in CONTEXT.names}

    cuts = arrow_map(source_texts, cut, CONTEXT)
    places = cuts.select("digest", "at", "cid", F.length("ctx").alias("len"))
    kinds = staged(cuts.groupBy("h", "cid").agg(F.sum("copies").alias("copies"), F.first("ctx").alias("ctx")), "repeat-contexts")
    marks = staged(_marks(kinds), "repeat-marks")
    discard(kinds)

    marked = places.join(marks, "cid").select("digest", F.struct((F.col("at") + F.col("lo")).alias("lo"), (F.col("at") + F.col("hi")).alias("hi")).alias("span"))
    marked = marked.groupBy("digest").agg(F.collect_list("span").alias("spans")).withColumnRenamed("digest", "_d")
    texts = source_texts.filter("copies = 1").select("digest", "text").join(marked, F.col("digest") == F.col("_d"))

    def removed(c: dict[str, list]) -> dict[str, list]:
        n, spans_, kept = [], [], []
        for t, own in zip(c["text"], c["spans"], strict=True):
            out, end, gone, runs = [], 0, 0, 0
            for s in sorted((s["lo"], s["hi"]) for s in own):
                if s[0] > end or not runs:
                    out.append(t[end : s[0]])
                    runs += 1
                    gone += s[1] - s[0]
                    end = s[1]
                elif s[1] > end:
                    gone += s[1] - end
                    end = s[1]
            out.append(t[end:])
            n.append(gone)
            spans_.append(runs)
            kept.append(b"".join(out))
        return {"digest": c["digest"], "kept": kept, "n_removed": n, "n_spans": spans_, "kept_sha256": [hashlib.sha256(k).hexdigest() for k in kept]}

    schema = T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("kept", T.BinaryType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType())])
    cut_texts = staged(arrow_map(texts.select("digest", "text", "spans"), removed, schema), "repeat-kept")
    discard(source_texts, marks)

    copied = F.coalesce(F.col("copies") > 1, F.lit(False))
    out = keys.join(classes.select("digest", "copies"), "digest", "left").join(cut_texts.drop("kept"), "digest", "left")
    out = out.select(
        "doc_id",
        "n_bytes",
        F.when(copied, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("bigint").alias("n_removed"),
        F.when(copied, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("bigint").alias("n_spans"),
        F.when(copied, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("digest")))).alias("kept_sha256"),
    )
    return out, cut_texts.select("digest", "kept")


def op1_remove_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))[0]
