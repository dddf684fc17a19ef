import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators import clusters, dedup


def _brute(hashes, limit):
    pairs = {}
    for i in range(len(hashes)):
        for j in range(i + 1, len(hashes)):
            a, b = sorted((hashes[i], hashes[j]))
            gap = bin(int(a, 16) ^ int(b, 16)).count("1")
            if a[:4] == b[:4] and gap <= limit:
                pairs[(a, b, gap)] = pairs.get((a, b, gap), 0) + 1
    return pairs


@pytest.mark.parametrize("limit", [4, 6, 8])
def test_near_duplicates_equal_brute_force(spark, limit):
    rng = random.Random(limit)
    hashes = []
    for block in ("0000", "ffff", "8abc"):
        bases = [rng.getrandbits(48) for _ in range(8)]
        for _ in range(60):
            word = rng.choice(bases)
            for _ in range(rng.randint(0, 7)):
                word ^= 1 << rng.randrange(48)
            hashes.append(block + f"{word:012x}")
    hashes += ["0000" + "0" * 12] * 90  # a third of all items are copies of one
    df = spark.createDataFrame(list(enumerate(hashes)), "id long, phash string")
    got = {(r["hash_a"], r["hash_b"], r["hamming"]): r["item_pairs"] for r in dedup.near_duplicate_pairs(df, "id", "phash", limit).collect()}
    assert got == _brute(hashes, limit)


def test_nulls_are_equal_and_floats_normal(spark):
    df = spark.createDataFrame([(None, "x", float("nan")), (None, "x", None), ("x", None, None)], "a string, b string, c double")
    row = dedup.duplicate_rate(df).first()
    assert (row["rows"], row["duplicate_rows"]) == (3, 1)


def test_long_texts_and_maps_take_part_in_identity(spark):
    long = "y" * 500
    df = spark.createDataFrame([(long, {"k": 1}), (long, {"k": 1}), (long + "z", {"k": 1}), (long, {"k": 2})], "t string, m map<string,int>")
    assert dedup.duplicate_rate(df).first()["duplicate_rows"] == 1


def test_row_order_and_partitions_do_not_matter(spark):
    df = spark.range(1000).select((F.col("id") % 97).alias("a"), (F.col("id") % 2).cast("string").alias("split"))
    one = dedup.duplicates_and_leakage(df.coalesce(1), "split").first()
    many = dedup.duplicates_and_leakage(df.orderBy(F.desc("id")).repartition(13), "split").first()
    assert one == many and one["leakage_rate"] == 1.0


def test_leakage_ignores_missing_splits(spark):
    df = spark.createDataFrame([(1, "train"), (1, None), (2, "train"), (2, "test")], "a int, split string")
    row = dedup.split_leakage(df, "split").first()
    assert (row["num_contents"], row["leaked_contents"]) == (2, 1)


def test_stems(spark):
    rows = spark.createDataFrame([("a/b.c.png",), ("x.txt",), ("d/.hidden",)], "p string").select(dedup.path_stem(F.col("p")).alias("s")).collect()
    assert [r["s"] for r in rows] == ["b.c", "x", ".hidden"]


def test_near_duplicates_count_pairs_that_differ_in_their_leading_digits(spark):
    rng = random.Random(3)
    bases = [rng.getrandbits(64) for _ in range(12)]
    words = []
    for _ in range(300):
        word = rng.choice(bases)
        for bit in rng.sample(range(64), rng.randint(0, 5)):
            word ^= 1 << bit
        words.append(word)
    words += [bases[0]] * 40 + [0, 1 << 63, 0xFC00000000000000, 0xFE00000000000000]
    df = spark.createDataFrame([(i, f"{w:016x}") for i, w in enumerate(words)] + [(999, None)], "id long, phash string").repartition(5)
    near = [(min(a, b), max(a, b)) for i, a in enumerate(words) for b in words[i + 1:] if (a ^ b).bit_count() <= 6]
    row = dedup.near_duplicates(df, "id", "phash").first()
    assert (row["near_duplicate_pairs"], row["hash_pairs"], row["hashed_items"]) == (len(near), len(set(near)), len(words))
    assert any(a >> 48 != b >> 48 for a, b in near)


def test_large_cells_are_dealt_in_parts_and_lose_no_pair(spark, monkeypatch):
    rng = random.Random(5)
    words = list({sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for _ in range(400)})
    df = spark.createDataFrame([(i, f"{w:016x}") for i, w in enumerate(words)], "id long, phash string")
    expected = sum((a ^ b).bit_count() <= 6 for i, a in enumerate(words) for b in words[i + 1:])
    monkeypatch.setattr(clusters, "CELL", 30)
    monkeypatch.setattr(clusters, "AT_A_TIME", 50)
    assert dedup.near_duplicates(df, "id", "phash").first()["hash_pairs"] == expected
    assert dedup.near_duplicate_pairs(df, "id", "phash", 6, 0).count() == expected
