"""Contexts with copies have one mark, however many others they share strings with."""

import random

from pagewright.llm import repeats


def test_a_context_with_copies_has_one_mark(spark):
    rng = random.Random(4)
    shared, other = rng.randbytes(300), rng.randbytes(300)
    rows = [(1, b"copied", bytearray(shared + other), 3), (1, b"single", bytearray(rng.randbytes(50) + shared + rng.randbytes(50)), 1)]
    marks = repeats._marks(spark.createDataFrame(rows, "h long, cid binary, ctx binary, copies long")).collect()
    own = lambda cid: {(m.lo, m.hi) for m in marks if bytes(m.cid) == cid}
    assert [(m.lo, m.hi) for m in marks if bytes(m.cid) == b"copied"] == [(0, 600)]
    covered = {i for lo, hi in own(b"single") for i in range(lo, hi)}
    assert covered == set(range(50, 350))
