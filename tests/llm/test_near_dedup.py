import random

import numpy as np
import pytest

from tablewright.llm import near_dedup as N
from tablewright.llm.common import ascii_words


@pytest.mark.parametrize("shared_root", [False, True])
def test_only_pairs_that_can_be_links_are_proposed(spark, shared_root):
    """Texts of one passage with 2 or 7 words replaced: many share rare shingles, few are similar enough."""
    draw = random.Random(4)
    base = [f"w{i}" for i in range(160)]
    texts = []
    for i in range(60):
        words = list(base)
        for at in draw.sample(range(160), draw.choice([2, 7, 7, 7])):
            words[at] = f"o{draw.randrange(40)}"
        texts.append(" ".join(words))
    sets = [N.shingles(ascii_words(t)) for t in texts]
    names = [bytes([i]) for i in range(60)]
    roots = [names[i % 3] if shared_root and i < 30 else names[i] for i in range(60)]

    def alike(a, b):
        common = len(np.intersect1d(a, b))
        return 100 * common >= 75 * (len(a) + len(b) - common)

    across = [(i, j) for i in range(60) for j in range(i) if roots[i] != roots[j]]
    links = {frozenset((names[i], names[j])) for i, j in across if alike(sets[i], sets[j])}
    nodes = spark.createDataFrame([(a, len(s), r) for a, s, r in zip(names, sets, roots)], "node binary, n long, root binary")
    rows = N.sharing_rare(nodes, spark.createDataFrame(list(zip(names, texts)), "node binary, text string")).collect()
    found = {frozenset((bytes(r["a"]), bytes(r["b"]))) for r in rows}
    assert len(found) == len(rows) and links and links <= found
    assert len(found) <= 2 * len(links) + 20 < len(across) / 2


def test_sketches_differ_in_no_more_places_than_sets():
    draw = np.random.default_rng(1)
    for n in (1, 30, 900, 20_000):
        one = np.unique(draw.integers(0, 1 << 63, n, dtype=np.int64))
        other = np.unique(np.r_[one[n // 10 :], draw.integers(0, 1 << 63, n // 10, dtype=np.int64)])
        differ = sum((a ^ b).bit_count() if a ^ b >= 0 else ((a ^ b) & (1 << 64) - 1).bit_count() for a, b in zip(N.sketch(one), N.sketch(other)))
        assert len(N.sketch(one)) == N.SKETCH and differ <= len(np.setxor1d(one, other))
    assert N.sketch(np.zeros(0, np.int64)) == [0] * N.SKETCH
