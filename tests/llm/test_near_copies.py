"""Near copies against the exact similarity of all pairs."""

import random
from collections import Counter

from pyspark.sql import functions as F

from postlens.llm import near_copies
from tests.llm import brute

DATA = "/root/testdata/sf0.001"


def sets(text, width=5):
    words = brute.WORD.findall((text or "").lower())
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def planted(n, low, high, seed):
    """Pairs of texts with a few replaced words, of a similarity from ``low`` to ``high``."""
    rng, pairs = random.Random(seed), []
    while len(pairs) < n:
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(80, 300))]
        copy = list(words)
        for at in rng.sample(range(len(words)), rng.randint(1, len(words) // 30)):
            copy[at] = f"new{rng.randrange(5000)}"
        a, b = " ".join(words), " ".join(copy)
        if low <= jaccard(sets(a), sets(b)) < high:
            pairs.append((a, b))
    return pairs


def test_scattered_edits_are_found(spark, shared):
    for low, high in ((0.8, 0.85), (0.85, 0.9), (0.9, 0.95)):
        pairs = planted(100, low, high, 1)
        rows = [(2 * i + side, pair[side]) for i, pair in enumerate(pairs) for side in (0, 1)]
        kept = {r["doc_id"] for r in near_copies.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert {2 * i for i in range(100)} <= kept and len(kept) <= 101


def test_a_chain_around_no_hub_is_found(spark, shared):
    """Each text is near the next only, and all share buckets with others that are not near them."""
    words = [f"w{i}" for i in range(120)]
    chain = []
    for step in range(60):
        words = words[:step * 2] + [f"n{step}a", f"n{step}b"] + words[step * 2 + 2 :]
        chain.append(" ".join(words))
    near = [(i, j) for i in range(60) for j in range(i) if jaccard(sets(chain[i]), sets(chain[j])) >= 0.8]
    assert all((i, i - 1) in near for i in range(1, 60)) and (59, 0) not in near
    kept = near_copies.drop_near_copies(spark.createDataFrame(list(enumerate(chain)), "doc_id long, text string").repartition(5))
    assert [r["doc_id"] for r in kept.collect()] == [0]


def test_components_equal_all_pairs(spark, shared):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    crowd, rng = rows[0][1].split(), random.Random(2)
    for i in range(40):
        rows.append((5000 + i, " ".join([*crowd, f"tail{rng.randrange(10**6)}"])))
    rows += [(6000 + i, t) for i, pair in enumerate(planted(20, 0.7, 0.8, 3)) for t in pair]
    rows += [(7000, None), (7001, ""), (7002, " \n"), (7003, "two words"), (7004, "Two  WORDS"), (None, rows[1][1] + " end"), (7005, rows[2][1])]
    found, label = [sets(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if jaccard(found[i], found[j]) >= 0.8 and label[i] != label[j]:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    want = Counter(min(((rows[i][0] is None, rows[i][0] or 0) for i in range(len(rows)) if label[i] == x)) for x in set(label))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_llm_at", F.lit("x")).repartition(5)
    kept = near_copies.drop_near_copies(docs)
    assert kept.columns == ["doc_id", "text"]
    assert Counter((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == want
    assert near_copies.drop_near_copies(docs.limit(0)).count() == 0
