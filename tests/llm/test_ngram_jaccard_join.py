import random

import brute
import numpy as np
import pytest

from shelfmark.llm import ngram_jaccard_join as join


def crowd(seed, bases=4, copies=25, size=80):
    """Texts in clouds of near copies, with shared passages, short and empty texts, exact copies."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    passage = " ".join(rng.choices(vocabulary, k=30))
    texts = [None, "", " \n\t", "one two", "One  two", "one two three", "a b c d e", "A b c d E"]
    for _ in range(bases):
        base = rng.choices(vocabulary, k=size + rng.randrange(size))
        for _ in range(copies):
            words = list(base)
            for _ in range(rng.randrange(0, 6)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            texts.append(" ".join(words))
    texts += [passage + " " + " ".join(rng.choices(vocabulary, k=rng.randrange(1, 90))) for _ in range(30)]
    texts += texts[8:12] * 3
    rng.shuffle(texts)
    return [(i * 3 + 1, t) for i, t in enumerate(texts)]


def run(spark, rows, **columns):
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, point string, region int").repartition(5)
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in join.jaccard_components(docs).collect())


@pytest.mark.parametrize("region", [join.REGION, 3000])
def test_components_agree_with_brute_force(spark, monkeypatch, region):
    # small limits send the clouds through the rounds of large regions
    monkeypatch.setattr(join, "REGION", region)
    monkeypatch.setattr(join, "PART", region // 3)
    rows = crowd(region % 7)
    assert run(spark, rows) == sorted(brute.jaccard(rows))


def test_region_links_connect_what_all_links_connect():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 60, 120)
    sets = []
    for _ in range(70):
        own = base.copy()
        own[rng.integers(0, 120, rng.integers(0, 22))] = rng.integers(0, 1 << 60)
        sets.append(np.unique(own.astype(np.uint64)))
    sets += [np.unique(rng.integers(0, 1 << 60, 50).astype(np.uint64)) for _ in range(5)]
    keys = [str(i).encode() for i in range(len(sets))]
    links = join.region_links(sets, keys, [0.0] * len(sets))
    assert len(links) < len(sets)

    def groups(pairs):
        root = {k: k for k in keys}

        def find(k):
            while root[k] != k:
                k = root[k]
            return k

        for a, b in pairs:
            root[find(a)] = find(b)
        out = {}
        for k in keys:
            out.setdefault(find(k), set()).add(k)
        return sorted(map(sorted, out.values()))

    every = []
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            both = len(np.intersect1d(a, b))
            if 100 * both >= 75 * (len(a) + len(b) - both):
                every.append((keys[i], keys[j]))
    assert groups(links) == groups(every)


def test_empty_table_and_one_of_each_group(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert join.jaccard_components(empty).count() == 0
    same = "a b c d e f g h i j"
    docs = spark.createDataFrame(
        [(3, same, "p"), (2, same, "q"), (2, same, "q"), (None, same, "r"), (9, "", "s"), (8, None, "t"), (7, "other words", "u")],
        "doc_id long, text string, _key string",
    )
    kept = join.keep_one_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r._key) for r in kept.collect()) == [(2, "q"), (7, "u"), (8, "t"), (9, "s")]


def test_components_of_chains_and_stars(spark):
    from shelfmark.llm.common import components

    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (300, 200)]
    found = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(found[i] == 0 for i in range(41)) and all(found[i] == 100 for i in range(100, 160)) and found[300] == 200

def test_template_texts_end_in_few_rounds(spark, monkeypatch):
    """Texts that share a template and stay below the threshold leave a region many pivots at a time."""
    rng = random.Random(8)
    vocabulary = [f"v{i}" for i in range(5000)]
    template = rng.choices(vocabulary, k=68)
    rows = [(i, " ".join(template + rng.choices(vocabulary, k=14))) for i in range(300)]
    rows += [(1000 + i, rows[7][1] + " more" * i) for i in range(4)]
    rounds = []
    real = join._measured

    def counted(*args):
        rounds.append(1)
        return real(*args)

    monkeypatch.setattr(join, "_measured", counted)
    for name, value in (("REGION", 2000), ("PART", 4000), ("PIVOTS", 64)):
        monkeypatch.setattr(join, name, value)
    assert run(spark, rows) == sorted(brute.jaccard(rows))
    assert 2 <= len(rounds) < 10


def test_shared_counts():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 90, rng.integers(1, 40)).astype(np.uint64)) for _ in range(30)]
    got = join.shared_counts(sets[:7], sets)
    assert got.tolist() == [[len(np.intersect1d(p, s)) for s in sets] for p in sets[:7]]
