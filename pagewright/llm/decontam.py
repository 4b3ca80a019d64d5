"""Benchmark decontamination by Wu-Manber search over words.

Windows of 10 item words (shorter items: the whole item) are the patterns. Per pattern length, a shift table over blocks of two
words says how far the scan may jump: a block that ends no pattern is skipped past, so most words of a clean text are never
looked at. A block with shift 0 picks its bucket of patterns by the block's hash, and words are compared directly. Words found
inside any occurrence are hit; each occurrence names the items its window comes from.

The patterns are read and broadcast in blocks of about ``block_words`` pattern words (by a hash of the item), which bounds what
the driver and each worker hold. A benchmark of one block, the usual case, takes one pass over the documents. A larger one takes
a pass for each block; between passes the hits so far travel with the documents through the shared folder.

Edge cases: null texts and items have no words; items without words have no window; an item with a null id is searched for and
its occurrences are hit, but it names no item; repeated rows, items and windows are all kept; an empty benchmark leaves all
documents clean; an empty table gives an empty result; other columns are ignored, or kept if asked for, whatever their names;
texts may be of any length. Item ids are compared as strings.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, spare, staged, table

WINDOW = 10
BLOCK_WORDS = 2_000_000
#: Bytes of words stay (A-Z as a-z); other ASCII bytes part words.
TABLE = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(TABLE).split()


def item_windows(text: str | None, window: int = WINDOW) -> set[tuple[bytes, ...]]:
    w = words_of(text)
    if not w:
        return set()
    return {tuple(w[i : i + window]) for i in range(max(1, len(w) - window + 1))}


class ShiftTable:
    """Patterns of one length: how far each block of words lets the scan jump, and the patterns by their last block."""

    def __init__(self, patterns: dict[tuple[bytes, ...], list[str]]):
        self.length = len(next(iter(patterns)))
        self.block = min(2, self.length)
        self.patterns = patterns
        self.skip = self.length - self.block + 1
        self.shift: dict = {}
        for p in patterns:
            for end in range(self.block, self.length + 1):
                key = self.key(p, end)
                self.shift[key] = min(self.shift.get(key, self.skip), self.length - end)
        self.bucket = defaultdict(list)
        for p in patterns:
            self.bucket[hash(self.key(p, self.length))].append(p)

    def key(self, words, end: int):
        return (words[end - 2], words[end - 1]) if self.block == 2 else words[end - 1]

    def find(self, words: list[bytes]):
        """Start and pattern of every occurrence."""
        at, n, m, get, skip, two = self.length, len(words), self.length, self.shift.get, self.skip, self.block == 2
        while at <= n:
            key = (words[at - 2], words[at - 1]) if two else words[at - 1]
            jump = get(key, skip)
            if jump:
                at += jump
                continue
            for p in self.bucket[hash(key)]:
                if all(a == b for a, b in zip(p, words[at - m : at], strict=True)):
                    yield at - m, p
            at += 1


def build(items: list[tuple[str, str | None]], window: int = WINDOW) -> list[ShiftTable]:
    by: dict[int, dict] = defaultdict(lambda: defaultdict(list))
    for item, text in items:
        for p in item_windows(text, window):
            by[len(p)][p].append(item)
    return [ShiftTable(dict(p)) for _, p in sorted(by.items())]


def pattern_blocks(benchmark: DataFrame, block_words: int, window: int = WINDOW):
    """The items in blocks of about ``block_words`` pattern words (at six bytes a word), read one after another."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), "text")
    letters = items.agg(F.sum(F.octet_length("text"))).collect()[0][0] or 0
    count = max(1, -(-letters * window // (6 * block_words)))
    of = F.pmod(F.xxhash64("item", "text"), F.lit(count))
    for i in range(count):
        yield [(r[0], r[1]) for r in items.filter(of == i).collect()]  # one block


def search(text: str | None, tables: list[ShiftTable]) -> tuple[list[bytes], list[bool], set[str]]:
    """Words of a text, whether each is hit, and the items found."""
    words = words_of(text)
    hit, items = [False] * len(words), set()
    for t in tables:
        for start, p in t.find(words):
            hit[start : start + t.length] = [True] * t.length
            items.update(t.patterns[p])
    items.discard(None)
    return words, hit, items


SCHEMA = [("n_words", T.LongType()), ("n_hit", T.LongType()), ("n_items", T.LongType()), ("items_sha256", T.StringType()), ("contaminated", T.BooleanType())]


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, keep: list[str] | None = None) -> DataFrame:
    """doc_id (or the columns ``keep``) with n_words, n_hit, n_items, items_sha256 and contaminated, for each row of ``docs``."""
    keep = [k for k in keep or ["doc_id"] if k.lower() not in [n for n, _ in SCHEMA]]
    rest = [k for k in keep if k != "text"]
    # the caller's columns travel in one struct, so that no name of theirs meets one of ours
    d = docs.select(F.struct(F.lit(0).alias(spare("_", docs)), *[F.col(f"`{k}`") for k in rest]).alias("row"), "text", F.lit(None).cast("binary").alias("hits"), F.lit(None).cast("array<string>").alias("items"))
    found = T.StructType([*d.schema.fields, *[T.StructField(n, t) for n, t in SCHEMA]])
    first = True
    for block in pattern_blocks(benchmark, block_words, window):
        if not first:
            d = staged(d.select("row", "text", "hits", "items"), "decontam-pass")  # one block of patterns in a worker at a time
        d = arrow_map(d, _searcher(docs.sparkSession.sparkContext.broadcast(block), window), found)
        first = False
    return d.select(*[F.col("text") if k == "text" else F.col(f"row.`{k}`") for k in keep], *[n for n, _ in SCHEMA])


def _searcher(sent, window: int):
    """Rows of documents with the hits of one block of patterns added: ``hits`` holds 0 or 1 for each word, null if all are 0."""
    built: list[list[ShiftTable]] = []

    def rows(c: dict[str, list]) -> dict[str, list]:
        if not built:
            built.append(build(sent.value, window))
        n, hits, items = [], [], []
        for text, before, names in zip(c["text"], c["hits"], c["items"], strict=True):
            words, hit, found = search(text, built[0])
            now = bytes(hit) if any(hit) else None
            if before and now:
                now = bytes(a | b for a, b in zip(before, now, strict=True))
            n.append(len(words))
            hits.append(now or before)
            items.append(sorted(found.union(names or ())))
        return c | {
            "hits": hits, "items": items, "n_words": n, "n_hit": [sum(h or b"") for h in hits], "n_items": list(map(len, items)),
            "items_sha256": [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items], "contaminated": [h is not None for h in hits],
        }

    return rows


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: {documents}: the table searched. Ends with h: doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each row.
HITS_SQL = r"""
dw AS (SELECT row_number() OVER () AS rid, *, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS words FROM {documents}),
bw AS (SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
pats AS (SELECT DISTINCT item, least(10, len(w)) AS m, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS p
         FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM bw WHERE len(w) > 0)),
lens AS (SELECT DISTINCT m FROM pats),
wins AS (SELECT rid, i, m, array_to_string(words[i : i + m - 1], ' ') AS p FROM (SELECT rid, words, m, unnest(range(1, len(words) - m + 2)) AS i FROM dw, lens WHERE len(words) >= m)),
occ AS (SELECT rid, i, wins.m AS m, item FROM wins JOIN pats USING (p)),
hitw AS (SELECT rid, count(DISTINCT k) AS n_hit FROM (SELECT rid, unnest(range(i, i + m)) AS k FROM occ) GROUP BY rid),
hiti AS (SELECT rid, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM occ GROUP BY rid),
h AS (SELECT dw.*, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
      FROM dw LEFT JOIN hitw USING (rid) LEFT JOIN hiti USING (rid))"""

OP2_SQL = "WITH " + HITS_SQL.format(documents="documents").lstrip() + "\nSELECT doc_id, n_words, n_hit, n_items, items_sha256, contaminated FROM h"
