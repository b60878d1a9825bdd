import random

import numpy as np
import pytest

from quarry.llm.ngram_join import Bounds, cell_links, ngram_components, overlap_counts
from quarry.llm.queries import op13_ngram_join, oracle_sql
from tests.conftest import SF
from tests.llm.test_operators import brute_components, frame
from tests.oracle import compare


def blocks(rng, n, tokens, size):
    sets = [np.unique(rng.choice(tokens, rng.integers(1, size))) for _ in range(n)]
    return sets, (np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])]))


def test_products_count_overlaps(monkeypatch):
    rng = np.random.default_rng(1)
    tokens = rng.integers(0, 2**64 - 1, 400, np.uint64).view(np.int64)
    monkeypatch.setattr("quarry.llm.ngram_join.EXPANSION", 50)
    for some in (tokens, tokens[:5], tokens[:1]):
        one, left = blocks(rng, 30, some, 200)
        two, right = blocks(rng, 17, tokens, 90)
        assert (overlap_counts(left, right) == [[len(set(a) & set(b)) for b in two] for a in one]).all()
    assert not overlap_counts(left, (tokens[300:310], np.array([0, 10]))).any()


def test_cells_link_what_reaches_the_bound():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**62, 100)
    sets = [np.unique(np.concatenate([base[: 100 - k], rng.integers(0, 2**62, k)])) for k in (0, 2, 5, 8, 30)]
    links = cell_links([np.arange(5), np.array([], int)], [sets, []], Bounds(85))
    assert len(links) == 3 and {x for p in links for x in p} == {0, 1, 2, 3}
    assert cell_links([np.array([7]), np.array([7, 8, 9])], [sets[:1], [sets[0], sets[1], sets[4]]], Bounds(85)) == [(7, 8)]


@pytest.mark.parametrize("percent", [60, 85, 100])
def test_bounds_lose_no_partner(percent):
    b = Bounds(percent)
    for n in range(1, 400):
        for m in range(-(-percent * n // 100), n + 1):
            k = min(b.extra(x) for x in (n, m))
            assert -(-(-(-percent * n // 100)) // 20) <= n and 1 <= b.sample(np.array([n]))[0] <= n
            assert -(-percent * n // 100) // 20 + 1 <= k or b.extra(m) >= -(-percent * n // 100) // 20 + 1


@pytest.mark.parametrize(("few", "members"), [(64, 1 << 20), (2, 300), (0, 2000)])
def test_components_equal_all_pairs(spark, few, members):
    rnd = random.Random(few)
    words = [f"w{k}" for k in range(60)]
    base = [[rnd.choice(words) for _ in range(rnd.randrange(40, 160))] for _ in range(8)]
    texts = [None, "", " \t", "one", "ONE", "one two three", "x" * 300_000, "a b c d e f g h i", "a b c d e f g h i j"]
    for _ in range(160):
        t = list(rnd.choice(base))
        for _ in range(rnd.randrange(5)):
            t[rnd.randrange(len(t))] = rnd.choice(words)
        texts.append(" ".join(t) if rnd.random() < 0.9 else " ".join(t[:30] + base[0][:30]).upper())
    want, sizes = brute_components(texts, 4, 85)
    rows = ngram_components(frame(spark, texts), few=few, members=members).collect()
    assert len(rows) == len(texts) and len(set(want.values())) < len(texts) - 30
    for r in rows:
        assert (r.component_id, r.n_shingles) == (want[r.doc_id], sizes[r.doc_id])


@pytest.mark.parametrize("common", [200, 184])
def test_a_template_that_many_share(spark, common):
    """Sets of which all pairs share much: linked at 200 of 212 words, not at 184 of 212."""
    shared = [f"c{k}" for k in range(common)]
    texts = [" ".join([*shared, *(f"o{d}-{k}" for k in range(212 - common))]) for d in range(400)]
    want, _ = brute_components(texts[:40], 4, 85)
    assert len(set(want.values())) == (1 if common == 200 else 40)
    found = {r.doc_id: r.component_id for r in ngram_components(frame(spark, texts), few=8, members=5000).collect()}
    assert len(set(found.values())) == (1 if common == 200 else 400)


def test_ids_that_repeat_nulls_and_nothing(spark):
    text = " ".join(f"t{k}" for k in range(40))
    rows = [(None, text), (1, text), (1, text), (2, text + " more"), (3, "else"), (3, text), (None, None)]
    found = [sorted(map(tuple, ngram_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(n)).collect()), key=repr) for n in (1, 4)]
    assert found[0] == found[1] and len(found[0]) == 7
    assert [r[2] for r in found[0] if r[0] in (1, 2)] == [1, 1, 1] and all(r[2] is None for r in found[0] if r[0] is None)
    assert ngram_components(spark.createDataFrame(rows, "doc_id long, text string").limit(0)).count() == 0


def test_the_query_equals_its_sql(spark):
    assert compare(spark, SF, op13_ngram_join, oracle_sql()["op13_ngram_join"]) is None
