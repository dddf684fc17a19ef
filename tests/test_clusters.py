"""Clusters of near duplicates against a union of all pairs."""

import random

import pytest

from plumbline.operators import clusters, dedup


def _hashes(limit):
    rng = random.Random(limit)
    out = []
    for block in ("0000", "ffff", "8abc"):
        bases = [rng.getrandbits(48) for _ in range(8)]
        for _ in range(60):
            word = rng.choice(bases)
            for _ in range(rng.randint(0, 7)):
                word ^= 1 << rng.randrange(48)
            out.append(block + f"{word:012x}")
        chain = rng.getrandbits(48)  # each link near, the ends far apart
        for step in range(30):
            out.append(block + f"{chain:012x}")
            for bit in rng.sample(range(48), limit):
                chain ^= 1 << bit
    return out + ["0000" + "0" * 12] * 120 + [None, None]


def _brute(hashes, limit):
    names = sorted({h for h in hashes if h})
    root = {h: h for h in names}

    def find(h):
        while root[h] != h:
            h = root[h]
        return h

    near = {h: set() for h in names}
    for i, a in enumerate(names):
        for b in names[i + 1:]:
            if a[:4] == b[:4] and bin(int(a, 16) ^ int(b, 16)).count("1") <= limit:
                near[a].add(b)
                near[b].add(a)
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {h: find(h) for h in names}, near


@pytest.mark.parametrize("limit", [3, 6])
def test_clusters_equal_a_union_of_all_pairs(spark, limit):
    hashes = _hashes(limit)
    df = spark.createDataFrame(list(enumerate(hashes)), "id long, phash string").repartition(7)
    root, near = _brute(hashes, limit)
    rows = clusters.near_duplicate_clusters(df, "id", "phash", limit).collect()
    count = {h: hashes.count(h) for h in root}
    assert {r["hash"]: r["cluster"] for r in rows} == root
    assert all((r["n"], r["links"], r["partners"]) == (count[r["hash"]], len(near[r["hash"]]), sum(count[b] for b in near[r["hash"]])) for r in rows)
    items = {r["item"]: r for r in clusters.clustered_items(df, "id", "phash", limit).collect()}
    assert len(items) == sum(h is not None for h in hashes)
    members = {}
    for i, h in enumerate(hashes):
        if h:
            members.setdefault(root[h], []).append(i)
    assert all((items[i]["representative"], items[i]["cluster_items"]) == (min(m), len(m)) for m in members.values() for i in m)
    total = clusters.cluster_summary(clusters.near_duplicate_clusters(df, "id", "phash", limit)).first().asDict()
    pairs = sum(count[h] * (count[h] - 1) for h in root) + sum(count[h] * count[b] for h in root for b in near[h])
    assert total == {"hashed_items": len(items), "clusters": sum(len(m) > 1 for m in members.values()), "clustered_items": sum(len(m) for m in members.values() if len(m) > 1),
                     "largest_cluster": max(map(len, members.values())), "near_duplicate_pairs": pairs // 2,
                     "hash_pairs": sum(map(len, near.values())) // 2 + sum(n > 1 for n in count.values())}


def test_no_hashes(spark):
    df = spark.createDataFrame([(1, None)], "id long, phash string")
    assert clusters.clustered_items(df, "id", "phash").count() == 0
    assert clusters.cluster_summary(clusters.near_duplicate_clusters(df, "id", "phash")).first()["near_duplicate_pairs"] == 0


def test_hashes_are_compared_in_as_many_tasks_as_a_shuffle_has(spark):
    items = spark.createDataFrame([(i, f"{i * 2654435761 % 2 ** 64:016x}") for i in range(200)], "item long, phash string")
    for found in (dedup.near_duplicates(items, "item", "phash"), dedup.near_duplicate_pairs(items, "item", "phash")):
        assert "REPARTITION_BY_NUM" in found._jdf.queryExecution().executedPlan().toString()
