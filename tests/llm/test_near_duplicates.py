"""The pipeline's near-duplicate stage: links of the trie, and the number of pairs that it compares."""

from __future__ import annotations

import random

import pytest

pytest.importorskip("harrow.llm.queries")

from pyspark.sql import functions as F  # noqa: E402

from harrow.llm import jaccard  # noqa: E402
from harrow.llm.simhash import fingerprint  # noqa: E402


def sets_of(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("tie", F.xxhash64("text"))
    return jaccard._prefixes(rows, 5)


def copies(n, seed=1):
    """One text of 90 words and n copies, each with one other word."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(90)]
    return [" ".join(base)] + [" ".join(base[:k] + [f"own{i}"] + base[k + 1:]) for i, k in enumerate(rng.choices(range(90), k=n))]


def test_trie_links_texts_within_the_budget(spark):
    """Pairs of the trie are the classes at 4 or fewer differing bits."""
    texts = copies(40) + [" ".join(f"x{i}_{k}" for k in range(50)) for i in range(10)]
    fps = [fingerprint(t, 5) for t in texts]
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4 and group[i] != group[j]:
                a, b = sorted((group[i], group[j]))
                group = [a if g == b else g for g in group]
    pairs = jaccard._trie_pairs(sets_of(spark, texts), 4).collect()
    of = {jaccard.name(jaccard.shingles(t)): g for t, g in zip(texts, group)}
    assert len(pairs) == len(of) - len(set(of.values())) > 0
    assert all(of[r["a"]] == of[r["b"]] for r in pairs)


def test_near_copies_are_compared_once_each(spark):
    """A group of near copies costs a pair per copy, not one per copy and smallest set."""
    sets = sets_of(spark, copies(300))
    pairs = jaccard._hub_pairs(jaccard._tokens(sets)).collect()
    assert len(pairs) <= sets.count() and len({r["b"] for r in pairs}) == len(pairs)


def test_unlike_texts_of_one_passage_are_not_compared(spark):
    """Sets that share a passage and little else are parted before pairs are made."""
    rng = random.Random(2)
    passage = [f"p{k}" for k in range(30)]
    texts = [" ".join(passage + [f"{i}q{rng.randrange(10**9)}" for _ in range(70)]) for i in range(200)]
    sets = sets_of(spark, texts)
    whole = sets.select("v", "n", F.posexplode("prefix").alias("pos", "t")).withColumn("pos", F.lit(0))
    common = jaccard.shingles(" ".join(passage))[:1].view("int64")[0]
    tokens = whole.select("v", "n", "pos", F.lit(int(common)).alias("t")).distinct().withColumn("m", F.col("v"))
    assert tokens.count() == 200
    assert jaccard._open_pairs(tokens, sets).count() == 0


def test_stage_takes_links_of_the_trie(spark, monkeypatch):
    """Copies within four bits and farther ones go, texts that share a part stay."""
    seen = []
    own = jaccard.near_groups
    monkeypatch.setattr(jaccard, "near_groups", lambda *a, **k: seen.append(k) or own(*a, **k))
    texts = copies(12)
    half = texts[0].split()[:45]
    rows = list(enumerate(texts + [" ".join(half + [f"z{k}" for k in range(45)])]))
    out = jaccard.drop_similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r["doc_id"] for r in out) == [0, 13]
    assert seen == [{"budget": 4}]
