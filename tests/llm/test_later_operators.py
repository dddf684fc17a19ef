"""Quality ranking, vector codes and conversation repair against brute-force versions, with nulls, ties, repeats, long texts and empty tables."""

import hashlib
import random
import sys
import zlib
from collections import Counter
from itertools import product
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from plumbline.llm import conversations, quality, vector_codes  # noqa: E402
from plumbline.llm.common import held_out  # noqa: E402

SF = "/root/testdata/sf0.01"


# conversations

def least(rows, start=0, ends=(0, 3)):
    """(cost, edits) by a table over rows and states."""
    steps = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}

    def closed(now):
        moved = True
        while moved:
            moved = False
            for (s, i), t in steps.items():
                if i in "ua" and s in now:
                    way = (now[s][0] + 5, now[s][1] + "I")
                    if t not in now or way < now[t]:
                        now[t], moved = way, True
        return now

    now = closed({start: (0, "")})
    for initial, fault in rows:
        then = {}
        for s, (cost, audit) in now.items():
            ways = [(s, 2, "D")]
            if fault not in ("blank", "duplicate"):
                more = 5 if fault == "truncated" else 0
                ways += [(t, more, "K") for (a, i), t in steps.items() if a == s and i == initial]
                ways += [(t, 1 + more, "R") for (a, i), t in steps.items() if a == s and i in "ua"]
            for t, c, e in ways:
                label = (cost + c, audit + e)
                if t not in then or label < then[t]:
                    then[t] = label
        now = closed(then)
    found = [now[t] for t in ends if t in now]
    return min(found) if found else None


def test_bidirectional_search_finds_the_least_edits():
    draw = random.Random(3)
    for _ in range(1500):
        rows = [(draw.choice("suax") if draw.random() < 0.9 else "", draw.choice([None, None, None, "blank", "duplicate", "truncated"])) for _ in range(draw.randint(0, 9))]
        assert conversations.cheapest(rows) == least(rows)
        for s, t in product(range(4), range(4)):
            assert conversations.cheapest(rows, s, (t,)) == least(rows, s, (t,))


def test_all_edits_are_tried():
    """Against every string of edits of up to two rows and three inserts."""
    steps = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    for rows in product([("s", None), ("u", None), ("a", "truncated"), ("x", None), ("u", "duplicate")], repeat=2):
        best = None
        for n in range(6):
            for audit in product("DIKR", repeat=n):
                if len(audit) - audit.count("I") != 2:
                    continue
                states, cost, at = {0}, 0, 0
                for e in audit:
                    initial, fault = ("", None) if e == "I" else rows[at]
                    at += e != "I"
                    cost += {"D": 2, "I": 5, "K": 0, "R": 1}[e] + (5 if e in "KR" and fault == "truncated" else 0)
                    if e in "KR" and fault == "duplicate":
                        states = set()
                    if e != "D":
                        states = {t for (a, i), t in steps.items() if a in states and (i == initial if e == "K" else i in "ua")}
                if states & {0, 3} and (best is None or (cost, "".join(audit)) < best):
                    best = (cost, "".join(audit))
        assert conversations.cheapest(list(rows)) == best


ROWS = "conv_id long, turn long, role string, text string, cost long, part int, key string, _c long"


def talk():
    draw = random.Random(11)
    rows = []
    for conv in [*range(30), None]:
        for turn in range(draw.randint(1, 12)):
            role = draw.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = draw.choice(["Yes.", "No!", "Why?", "cut", None, "", " \t\n", "日本語。", "x" * 40_000 + ".", "ok. \x0b", "\xa0", f"t{turn}."])
            rows.append((conv, draw.choice([turn, turn, turn, turn + 1, None]), role, text, 1, 2, "k", 3))
    rows += [(40, i, ("user", "assistant")[i % 2], f"Word {i % 9}." if i % 5 else "open", 1, 2, "k", 3) for i in range(200)]
    return rows + rows[:3] + rows[-2:]


def mended(rows, damage):
    by = {}
    for conv, turn, role, text, *_ in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20 if damage else -1
        role, text = " " if role is None else role, " " if text is None else text
        role = "user" if kind == 4 else role
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        by.setdefault(conv, []).extend([(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1))
    out = []
    for conv, told in by.items():
        told.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, faults = set(), []
        for _, role, text in told:
            bare = text.rstrip(" \t\n\x0b\f\r")
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
            seen.add((role, text))
        cost, audit = least([(r[1][:1], f) for r, f in zip(told, faults, strict=True)])
        lines, state, at = [], 0, 0
        for e in audit:
            _, role, text = (None, "", "") if e == "I" else told[at]
            at += e != "I"
            if e != "D":
                mark = role[0] if e == "K" else "a" if state == 2 else "u"
                state = {"s": 1, "u": 2, "a": 3}[mark]
                lines.append(f"{role if e == 'K' else 'user' if mark == 'u' else 'assistant'}:{text}")
        turns = [t for t, _, _ in told if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        wrong = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(told, told[1:], strict=False))
        n = Counter(faults)
        out.append((conv, gaps, n["blank"], n["duplicate"], n["truncated"], wrong, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("block", "damage"), [(512, True), (4, True), (1, False)])
def test_conversation_repair(spark, block, damage):
    table = spark.createDataFrame(talk(), ROWS).repartition(4)
    got = conversations.repair(table, conversations.damage_kind if damage else None, block)
    columns = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert got.columns == columns
    assert sorted((tuple(r) for r in got.collect()), key=repr) == mended(talk(), damage)


def test_one_long_conversation_is_spread(spark):
    rows = [(1, i, ("user", "assistant")[i % 2], f"No {i}.") for i in range(3000)]
    got = conversations.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), None, 50).collect()
    assert [tuple(r) for r in got] == mended(rows, False)


def test_no_conversations(spark):
    empty = spark.createDataFrame([], ROWS)
    assert conversations.repair(empty, conversations.damage_kind).count() == 0
    gone = next((c, 0) for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    row = conversations.repair(spark.createDataFrame([(*gone, "user", "Hi.")], "conv_id long, turn long, role string, text string"), conversations.damage_kind).first()
    assert tuple(row)[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


# vector codes

def test_equal_average_search_is_exact():
    draw = np.random.default_rng(2)
    for n, k, spread in ((256, 16, 300), (256, 4, 3), (7, 16, 100), (1, 1, 5), (100, 2, 0)):
        entries = draw.integers(-spread, spread + 1, (n, k))
        rows = draw.integers(-spread - 5, spread + 6, (300, k))
        far = ((rows[:, None, :] - entries[None]) ** 2).sum(2)
        index, best = vector_codes.Codebook(entries).nearest(rows)
        assert (index == far.argmin(1)).all() and (best == far.min(1)).all()


VECTORS = "vec_id long, embedding array<float>, label int, error long, code string, _label int"


def vectors(n=900):
    draw = np.random.default_rng(8)
    rows = [(int(i * 3 % 997), [float(x) for x in draw.normal(0, 0.3, 8).astype(np.float32)], int(i % 5) if i % 7 else None, 1, "c", 2) for i in range(n)]
    odd = [(5, None, 1), (6, [0.1] * 7 + [None], 1), (7, [float("nan")] * 8, 1), (8, [float("inf")] + [0.0] * 7, 2), (None, [0.5] * 8, None), (2000, [], 3), (2001, [0.25] * 3, 3),
           (2002, [1e9, -1e9] + [0.0] * 6, 4)]
    return rows + [rows[0], rows[0]] + [(*r, 1, "c", 2) for r in odd]


def coded(rows, entries=256):
    kept = [(v, [min(max(int(np.floor(1024 * x)), -(1 << 26)), 1 << 26) for x in e] + [0] * (8 - len(e)), lab, e) for v, e, lab, *_ in rows
            if e is not None and all(x is not None and np.isfinite(x) for x in e)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[3]))
    data = np.array([r[1] for r in kept]).reshape(len(kept), 4, -1)
    books = data[:entries].transpose(1, 0, 2).copy()

    def nearest():
        far = [((data[:, p, None, :] - books[p][None]) ** 2).sum(2) for p in range(4)]
        return [f.argmin(1) for f in far], [f.min(1) for f in far]

    for _ in range(4):
        index, _ = nearest()
        for p in range(4):
            for e in range(books.shape[1]):
                own = data[index[p] == e, p]
                if len(own):
                    books[p][e] = own.sum(0) // len(own)
    index, far = nearest()
    errors = np.sum(far, 0)
    total = Counter()
    for r, e in zip(kept, errors.tolist(), strict=True):
        total[r[2]] += e
    sha = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return sorted(((r[0], "".join(f"{int(index[p][i]):02x}" for p in range(4)), int(errors[i]), total[r[2]], sha) for i, r in enumerate(kept)), key=repr)


@pytest.mark.parametrize("n", [900, 40])
def test_vector_codes(spark, n):
    table = spark.createDataFrame(vectors(n), VECTORS).repartition(5)
    got = vector_codes.coded_with_sums(table)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == coded(vectors(n))


def test_codes_stand_for_their_vectors(spark):
    table = spark.createDataFrame(vectors(40), VECTORS).filter("vec_id < 900 and size(embedding) = 8")
    found, codes = vector_codes.compress(table)
    rows = {r["vec_id"]: r["embedding"] for r in table.filter("forall(embedding, x -> x is not null and not isnan(x) and abs(x) < 1e8)").collect()}
    for r in found.collect():
        want = vector_codes.scaled(np.array(rows[r["vec_id"]]))
        assert ((want - vector_codes.restored(codes, r["code"])) ** 2).sum() == r["error"]


def test_no_vectors(spark):
    assert vector_codes.coded_with_sums(spark.createDataFrame([], VECTORS)).count() == 0
    assert vector_codes.coded_with_sums(spark.createDataFrame([(1, None, 1, 1, "c", 2)], VECTORS)).count() == 0


# quality

DOCS = "doc_id long, text string, lang string, score double, features string, _train int"


def written_texts():
    draw = random.Random(4)
    syllables = ["the", "of", "er", "and", "in", "to", "ra", "él", "ün"]

    def word():
        return "".join(draw.choice(syllables) for _ in range(draw.randint(1, 3)))

    rows, labels = [], []
    for i in range(600):
        words = [word() for _ in range(draw.randint(5, 150))]
        good = i % 4 != 0
        text = ". ".join(" ".join(words[k:k + 9]).capitalize() for k in range(0, len(words), 9)) + "."
        if not good:
            text = draw.choice([text.upper().replace(" ", "!! "), " | ".join(words), " ".join(w + "$$$" for w in words), " ".join([words[0]] * 80)])
        rows.append((i, text, "en", 1.0, "f", 1))
        labels.append((i, int(good), "x"))
    rows += [(700, None, None, 0.0, "f", 1), (701, "", None, 0.0, "f", 1), (702, " \n ", None, 0.0, "f", 1), (703, "word " * 100_000, "en", 0.0, "f", 1),
             (None, "A text without an id. It is plain.", None, 0.0, "f", 1), rows[1], rows[1]]
    return rows, [*labels, labels[1], (None, 1, "x"), (2, None, "x"), (3, 7, "x"), (9999, 1, "x")]


def test_quality_ranking(spark):
    rows, marks = written_texts()
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    labels = spark.createDataFrame(marks, "doc_id long, quality int, features string")
    out = held_out(F.col("doc_id"), 5, 0)
    got = quality.scored(docs.withColumn("held", out), labels, ~out, keep=["doc_id", "held"]).collect()
    assert len(got) == len(rows)
    right = {i: q for i, q, _ in marks[:600]}
    held = [r for r in got if r["held"] and r["doc_id"] in right]
    assert len(held) > 80 and np.mean([r["predicted"] == right[r["doc_id"]] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    empty = {r["score"] for r in got if r["doc_id"] in (700, 701, 702)}
    assert len(empty) == 1
    again = quality.scored(docs.withColumn("held", out), labels, ~out, keep=["doc_id", "held"]).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_scores_follow_preferences(spark):
    """One feature tells the classes apart: the weights rank by it, and the threshold lies between the classes."""
    rows = [(i, [float(i % 2)] + [0.5] * (len(quality.FEATURES) - 1), i % 2) for i in range(200)]
    found = quality.fit(spark.createDataFrame(rows, "doc_id long, features array<double>, quality int"))
    assert found.weights[0] > 0 and not found.weights[1:].any()
    assert 0 < found.threshold < found.weights[0]


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame(written_texts()[0][:9], DOCS)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in quality.scored(docs, none, F.lit(True)).collect()} == {0.5}
    one = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int")
    assert {r["predicted"] for r in quality.scored(docs, one, F.lit(True)).collect()} == {1}
    assert quality.scored(docs.limit(0), one, F.lit(True)).count() == 0


def test_few_bad_rows_are_still_met(spark):
    rows = [(i, [float(i == 0)] + [0.1 * (i % 3)] * (len(quality.FEATURES) - 1), int(i > 0)) for i in range(300)]
    found = quality.fit(spark.createDataFrame(rows, "doc_id long, features array<double>, quality int"), sample=10)
    assert found.weights[0] < 0


def test_weighted_quantile_and_best(spark):
    assert quality.weighted_quantile(np.array([3.0, 1.0, 2.0, 4.0]), np.ones(4), 0.5) == 2.5
    assert quality.weighted_quantile(np.array([1.0, 2.0]), np.array([1.0, 9.0]), 0.5) == 2.0
    kept = quality.best(spark.range(100).select(F.col("id").alias("doc_id"), (F.col("id") / 100).alias("score")), 0.25)
    assert abs(kept.count() - 25) <= 1


@pytest.mark.skipif(not Path(SF).exists(), reason="test tables are not here")
def test_quality_on_the_given_labels(spark):
    from plumbline.llm.queries import QUERIES

    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")
    rows = QUERIES["op11_quality_ranking"](spark, SF).join(labels, "doc_id").filter("held_out").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.97


def test_quality_learns_from_every_labelled_row(spark):
    """Each class has more rows than were read before; what tells them apart is on a few rows alone, and the threshold counts all."""
    width = len(quality.FEATURES)
    rows = spark.range(45_000).select(
        F.col("id").alias("doc_id"), F.concat(F.array((F.col("id") * 7919 % 45_000 / 45_000.0 + F.when(F.col("id") % 2 == 1, 0.3).otherwise(0.0))),
                                              F.array_repeat(F.lit(0.5), width - 1)).alias("features"), (F.col("id") % 2).cast("int").alias("quality"))
    found = quality.fit(rows)
    worths = np.sort(np.array([r["w"] for r in rows.select(found.worth().alias("w")).collect()]))
    assert found.weights[0] > 0
    assert abs(found.threshold - (worths[22_499] + worths[22_500]) / 2) < 1e-9
