"""The corpus operators against brute-force versions on small tables with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import math
import random
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from plumbline.llm import (  # noqa: E402
    bpe, components, exact_dedup, language, lattice_lm, mixing, resemblance, sentence_dedup, simhash, substring_dedup, suffix_array, syncmers, token_files)
from plumbline.llm.queries import vocabulary  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, key string, _id int, n int"
EXTRA = ("clash", "clash", 7, 7)
SPACE = " \t\n\x0b\f\r"


def words(text):
    out, now = [], ""
    for c in text:
        if c in SPACE:
            if now:
                out.append(now)
            now = ""
        else:
            now += c
    return [*out, now] if now else out


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def corpus():
    draw = random.Random(5)
    part = ["the", "of", "er", "and", "Über", "été", "ñu", "in.", "to!", "x", "日本"]
    prose = [" ".join(draw.choice(part) + draw.choice(part) for _ in range(draw.randint(1, 120))) for _ in range(25)]
    shared = "A shared passage that stands in many texts. " * 3 + "It has " + " ".join(f"word{i}" for i in range(60)) + ". The end of it."
    texts = [*prose, prose[0], prose[0].upper(), prose[1] + " " + shared, shared + "\n" + prose[2], prose[3] + " one more", None, "", "   ", "!!!", "É",
             "a" * 3000, "ab " * 900, "日本語" * 50, "Of Of Of " * 300, " ".join(prose)]
    rows = [(i * 3, t, ("en", "fr", None)[i % 3], ("s1", "é", None, "s0")[i % 4], None, *EXTRA) for i, t in enumerate(texts)]
    return rows + [rows[4], rows[4], (None, prose[5], "en", "s1", 3, *EXTRA), (None, None, None, None, None, *EXTRA)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(frame, *columns):
    return sorted((tuple(r) for r in frame.select(*columns).collect()), key=repr)


def test_suffix_arrays():
    draw = random.Random(1)
    for _ in range(300):
        s = [draw.randint(1, draw.choice([1, 2, 5, 30])) for _ in range(draw.randint(0, 60))] + [0]
        order = suffix_array.suffix_array(np.array(s))
        assert order.tolist() == sorted(range(len(s)), key=lambda i, s=s: s[i:])
        prefix, before = suffix_array.permuted_prefixes(np.array(s, np.uint16), order)
        for j, i in zip(order[:-1].tolist(), order[1:].tolist(), strict=True):
            same = next((k for k in range(len(s)) if max(i, j) + k >= len(s) or s[i + k] != s[j + k]), 0)
            assert (prefix[i], before[i]) == (same, j)


def removed(texts, length=200):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i:i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(d, gone, strict=True) if not g)
        out.append((len(d), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("many", [2048, 2])
def test_substring_dedup(docs, empty, many):
    table = corpus()
    want = sorted(((r[0], *x) for r, x in zip(table, removed([r[1] for r in table]), strict=True)), key=repr)
    got = substring_dedup.substring_dedup(docs, many)
    assert rows(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want
    assert sum(r[2] for r in want) > 1000
    assert substring_dedup.substring_dedup(empty).count() == 0


def test_lattice_is_the_sum_of_all_segmentations():
    pieces = lattice_lm.Pieces.load(vocabulary("piece_bpe_32k.model"))
    logs = dict(zip(pieces.keys.tolist(), pieces.logs[:, 0].tolist(), strict=True))

    def brute(text):
        if not text:
            return 1.0
        total = math.exp(sum(pieces.bytes[b, 0] for b in text[0].encode())) * brute(text[1:])
        for k in range(1, min(len(text), lattice_lm.LONGEST) + 1):
            key = lattice_lm._hash(text[:k])
            total += math.exp(logs[key]) * brute(text[k:]) if key in logs else 0
        return total

    some = ["the", "there", "étude", "x", "日本", "nation", "the"]
    assert np.allclose(lattice_lm.marginal(some, pieces)[:, 0], [math.log(brute("▁" + w)) for w in some])
    counts = lattice_lm.expected(["there", "nation"], np.array([[1.0], [2.0]]), pieces)
    # bytes and pieces account for every letter once
    letters = sum(len("▁there") * 1 + len("▁nation") * 2 for _ in (0,))
    assert counts[:-256].sum() <= letters


def test_lattice_score(docs, empty):
    table = corpus()
    got = lattice_lm.score(docs, vocabulary("piece_bpe_32k.model")).collect()
    held = [zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 7 == 2 for r in table]
    tokens = [[*words(lower(r[1])), None] for r in table]
    seen = Counter(t for ts, h in zip(tokens, held, strict=True) if not h for t in ts)
    total, kinds = sum(seen.values()), len(seen)
    want = sorted(((r[0], h, len(ts), sum(seen[t] > 0 for t in ts), total, round(sum(math.log10((seen[t] + 1) / (total + kinds + 1)) for t in ts), 6))
                   for r, h, ts in zip(table, held, tokens, strict=True)), key=repr)
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=repr) == want
    assert all(r.score <= 0 and math.isfinite(r.score) for r in got)
    assert lattice_lm.score(empty, vocabulary("piece_bpe_32k.model")).count() == 0


def spelled_brute(letters, pieces):
    """Log of the summed probability of all segmentations into pieces of any length, one prefix after another."""
    logs = dict(zip(pieces.keys.tolist(), pieces.logs[:, 0].tolist(), strict=True))
    alpha = [0.0]
    for to in range(1, len(letters) + 1):
        ways = [alpha[-1] + sum(pieces.bytes[b, 0] for b in letters[to - 1].encode())]
        for start in range(max(0, to - 40), to):
            key = lattice_lm._hash(letters[start:to])
            if key in logs:
                ways.append(alpha[start] + logs[key])
        alpha.append(np.logaddexp.reduce(ways))
    return alpha[-1]


def test_lattice_uses_the_longest_pieces():
    import sentencepiece

    path = vocabulary("piece_bpe_32k.model")
    model, pieces = sentencepiece.SentencePieceProcessor(model_file=path), lattice_lm.Pieces.load(path)
    plain = [p for i in range(model.get_piece_size()) for p in [model.id_to_piece(i)]
             if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i)) and "▁" not in p[1:]]
    assert pieces.longest == max(map(len, plain)) > 12 and len(pieces.keys) == len(set(plain))
    assert {lattice_lm._hash(p) for p in plain} == set(pieces.keys.tolist())
    some = ["international", "understanding", "internationalrepresentation", "x"]
    assert np.allclose(lattice_lm.marginal(some, pieces)[:, 0], [spelled_brute("▁" + w, pieces) for w in some])
    counts = lattice_lm.expected(["international"], np.array([[1.0]]), pieces)
    assert counts[np.searchsorted(pieces.keys, np.uint64(lattice_lm._hash("▁international"))), 0] > 0


def test_lattice_scores_long_words_in_log_space():
    pieces = lattice_lm.Pieces.load(vocabulary("piece_bpe_32k.model"))
    draw = random.Random(9)
    some = ["".join(draw.choice("abcXYZ019+/日本") for _ in range(n)) for n in (3, 5000)]
    totals = lattice_lm.Totals(np.array([90, 110]), np.array([40, 50]), 0.6, np.array([5, 6]))
    got = lattice_lm.word_logs(some, np.array([[4], [0]]), pieces, totals)
    for word, count, result in zip(some, (4, 0), got, strict=True):
        spelled = np.logaddexp(spelled_brute("▁" + word, pieces) + math.log(1 - lattice_lm.FLAT), lattice_lm.flat_logs([word])[0] + math.log(lattice_lm.FLAT))
        every = np.log(count / 110) if count else -np.inf
        backs = [np.logaddexp(spelled + math.log(lattice_lm.SPELLED), every + math.log(1 - lattice_lm.SPELLED)), spelled]
        for k, (tokens, kinds) in enumerate(((90, 40), (110, 50))):
            kept = math.log((count - 0.6) / tokens) if count else -np.inf
            assert result[k] == pytest.approx(np.logaddexp(kept, math.log(0.6 * kinds / tokens) + backs[k]) / math.log(10))
    assert got[1].max() < -5000


def simhash_brute(text):
    ws = words(lower(text))
    if not ws:
        return 0
    shingles = [" ".join(ws[i:i + 3]) for i in range(len(ws) - 2)] or [" ".join(ws)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def grouped(prints, radius=3):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_near_dedup(docs, empty):
    table = corpus()
    prints = [simhash_brute(r[1]) for r in table]
    root, least = grouped(prints), {}
    for g, r in zip(root, table, strict=True):
        if r[0] is not None:
            least[g] = min(least.get(g, r[0]), r[0])
    want = sorted(((r[0], f"{p:016x}", least.get(g)) for r, p, g in zip(table, prints, root, strict=True)), key=repr)
    assert rows(simhash.near_components(docs), "doc_id", "fingerprint", "component_id") == want
    assert simhash.near_components(empty).count() == 0
    stays = simhash.without_near_copies(docs.filter("doc_id is not null"))
    assert stays.count() == stays.select("doc_id").distinct().count() > 5 and stays.columns == docs.columns


@pytest.mark.parametrize("cell", [2048, 8])
def test_links_find_every_pair(spark, cell):
    draw = random.Random(2)
    prints = set()
    for _ in range(6):
        centre = draw.getrandbits(64)
        for _ in range(60):
            p = centre
            for _ in range(draw.randint(0, 5)):
                p ^= 1 << draw.randrange(64)
            prints.add(p)
    prints |= {0, (1 << 64) - 1, 1, 1 << 63}
    order = sorted(prints, key=lambda p: p - (1 << 64) if p >> 63 else p)
    signed = [p - (1 << 64) if p >> 63 else p for p in order]
    want = {signed[i]: signed[g] for i, g in enumerate(grouped(order))}
    edges = simhash.links(spark.createDataFrame([(s,) for s in signed], "print long"), cell)
    got = {r["node"]: r["root"] for r in components.components(edges).collect()}
    assert {k: v for k, v in want.items() if k in got} == got
    assert all(list(want.values()).count(want[k]) == 1 for k in want if k not in got)


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(0, 200)] + [(1000, 1000 + i) for i in range(300)] + [(7, 7), (5000, 4000)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(201), 0), **dict.fromkeys(range(1000, 1300), 1000), 4000: 4000, 5000: 4000}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_quotient_filters_merge_without_loss():
    draw = np.random.default_rng(3)
    for width in (64 - 3, 20, 6):
        parts = [draw.integers(0, 1 << width, n).astype(np.uint64) for n in (0, 1, 50, 400)]
        filters = [exact_dedup.QuotientFilter.build(*np.unique(p, return_counts=True), width) for p in parts]
        whole = exact_dedup.QuotientFilter.build(np.zeros(0, np.uint64), np.zeros(0, np.int64), width)
        for one in filters:
            whole = whole.merge(exact_dedup.QuotientFilter.from_bytes(one.to_bytes()))
        prints, counts = whole.fingerprints()
        want, times = np.unique(np.concatenate(parts), return_counts=True)
        assert prints.tolist() == want.tolist() and counts.tolist() == times.tolist()


def test_exact_dedup(docs, empty):
    groups = defaultdict(list)
    for r in corpus():
        groups[lower(r[1])].append(r[0])
    want, seen = [], Counter()
    for r in corpus():
        ids = groups[lower(r[1])]
        keep = max((i for i in ids if i is not None), default=None)
        seen[r[0], lower(r[1])] += 1
        want.append((r[0], keep, len(ids), r[0] == keep and seen[r[0], lower(r[1])] == 1, hashlib.sha256(lower(r[1]).encode()).hexdigest()))
    assert rows(exact_dedup.exact_dedup(docs), "doc_id", "keep_id", "group_size", "kept", "text_sha256") == sorted(want, key=repr)
    assert exact_dedup.exact_dedup(empty).count() == 0
    stays = exact_dedup.without_copies(docs)
    assert stays.columns == docs.columns and stays.count() == sum(w[3] for w in want)


def test_syncmers(docs, empty):
    table = sorted(corpus(), key=lambda r: (-1 if r[0] is None else r[0], r[1] or ""))
    texts = [r[1] or "" for r in table]
    want = []
    for i, t in enumerate(texts):
        after = texts[(i + 1) % len(texts)]
        q = len(t) // 4
        want.append((table[i][0], len(t), hashlib.sha256((t[:len(t) - q] + after[:q]).encode()).hexdigest()))
    got = syncmers.edited_fingerprints(docs)
    assert rows(got, "doc_id", "n_chars", "edited_sha256") == sorted(want, key=repr)
    found = {(r.doc_id, r.n_chars): r for r in got.collect()}
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in found.values())
    assert found[0, len(texts[2])].fingerprint == found[75, len(texts[2])].fingerprint
    assert all(r.near_edited == 1.0 for r in found.values() if r.fingerprint == r.edited_fingerprint)
    long = [r for r in found.values() if r.n_chars > 300 and r.doc_id is not None and r.doc_id < 75]
    assert sum(r.near_edited for r in long) / len(long) > 0.4
    assert syncmers.edited_fingerprints(empty).count() == 0


def test_syncmers_by_brute_force(spark):
    text = "one two three four five six seven eight nine ten two three four"
    h = [r[0] for r in spark.createDataFrame([(i, w) for i, w in enumerate(text.split())], "i int, w string").orderBy("i").select(F.xxhash64("w")).collect()]
    edges = [i for i in range(len(h) - 2) if min(h[i], h[i + 2]) <= h[i + 1]]
    hashed = spark.createDataFrame([(h[i], h[i + 1], h[i + 2]) for i in edges], "a long, b long, c long").select(F.xxhash64("a", "b", "c"))
    got = spark.createDataFrame([(text,)], "text string").select(syncmers.anchors(F.col("text"))).first()[0]
    assert sorted(got) == sorted(r[0] for r in hashed.collect())


def test_syncmers_of_unspaced_text_do_not_depend_on_its_offset(spark):
    draw = random.Random(12)
    for letters in ("日月火水木金土年時分今何人女男子山川田中", "abcdefghijklmnopqrstuvwxyz0123456789+/"):
        passage, other = ("".join(draw.choice(letters) for _ in range(n)) for n in (300, 400))
        table = [(0, passage), *[(k, other[:k] + passage + other[20:]) for k in range(1, 16)]]
        got = dict(spark.createDataFrame(table, "i int, text string").select("i", syncmers.anchors(F.col("text"))).collect())
        assert len(set(got[0])) > 100 and all(set(got[0]) <= set(got[k]) for k in range(1, 16))


def test_syncmers_keep_all_anchors_and_their_positions(spark):
    draw = random.Random(13)
    own = [[f"w{draw.randrange(10**6)}" for _ in range(20_000)] for _ in range(2)]
    passage = [f"p{i}" for i in range(150)]
    texts = [" ".join(own[0][:5000] + passage + own[0][5000:]), " ".join(own[1][:900] + passage + own[1][900:]), None]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    at = defaultdict(dict)
    for r in syncmers.anchor_positions(frame).collect():
        at[r.doc_id][r.anchor] = r.position
    common = set(at[0]) & set(at[1])
    assert len(common) > 60 and {at[0][a] - at[1][a] for a in common} == {4100} and 2 not in at
    first = [r for r in syncmers.edited_fingerprints(frame.filter("doc_id < 2")).collect() if r.doc_id == 0][0]
    assert first.near_next == pytest.approx(len(common) / len(set(at[0]) | set(at[1]))) and len(first.fingerprint) == 64


ODD = ["", " ", "a  b ", "<|endoftext|>x <|endoftext|>  y", "a\u0085b c\x1cd  e", "don't 'S 'll 1234 ５", "é ́x", "    a", "🙂👍🏽 x\t y", "ΑΣ. İ ß ǅ", "<|startoftext|> A"]


def odd_texts():
    draw = random.Random(4)
    return ODD + ["".join(draw.choice(" \n\t a.b'sé1\x0b\x1c\x85　<|endoftext|>日́A≠") for _ in range(draw.randint(0, 25))) for _ in range(500)]


def test_bpe_equals_the_library(docs, empty, spark):
    from tokenizers import Tokenizer

    path = vocabulary("byte_bpe_50k.json")
    library, own, texts = Tokenizer.from_file(path), bpe.Bpe(path), odd_texts()
    ids, joined = own.encode(texts)
    for text, got, comma in zip(texts, ids, joined, strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert got.tolist() == want and comma.decode() == ",".join(map(str, want))
        assert own.decode(got).decode() == library.decode(want, skip_special_tokens=False)
    want = []
    for r in corpus():
        code = library.encode(r[1] or "", add_special_tokens=False).ids
        back = library.decode(code, skip_special_tokens=False)
        want.append((r[0], len(code), hashlib.sha256(",".join(map(str, code)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    assert rows(bpe.round_trip(docs, path), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)
    again = bpe.decode(bpe.encode(docs, path), path)
    assert rows(again, "doc_id", "text") == sorted(((r[0], r[1] or "") for r in corpus()), key=repr)
    assert bpe.round_trip(empty, path).count() == 0


def test_language(spark, empty):
    draw = random.Random(6)
    parts = {"aa": ["the", "ing", "er", "and"], "bb": ["été", "eau", "oi", "que"], "cc": ["zu", "sch", "ung", "ö"]}
    table = [(i, " ".join(draw.choice(p) + draw.choice(p) for _ in range(draw.randint(5, 40))), k)
             for i, (k, p) in enumerate(x for _ in range(40) for x in parts.items())]
    table += [(1000, None, "aa"), (1001, "", "bb"), (1002, "123 !!", "cc"), (1003, "THE THEING", None), (3, table[3][1], table[3][2])]
    frame = spark.createDataFrame(table, "doc_id long, text string, lang string").withColumn("score", F.lit("x"))
    got = {r.doc_id: r for r in language.identify(frame, F.col("doc_id") % 3 != 5, ["doc_id", "score"]).collect()}
    assert all(got[i].lang_pred == k for i, _, k in table if i < 1000)
    assert [got[i].lang_pred for i in range(1000, 1004)] == ["und", "und", "und", "aa"]
    assert all(0 <= r.score <= 1 for r in got.values())
    assert language.identify(empty, F.lit(True)).count() == 0
    untaught = language.identify(frame, F.lit(False)).collect()
    assert {r.lang_pred for r in untaught} == {"und"} and len(untaught) == len(table)


def test_language_distance_is_out_of_place():
    profiles = language.Profiles({"x": np.array([5, 7, 9]), "y": np.array([9, 5, 1])})
    keys = {"k": np.array([5, 5, 5, 9, 9, 4])}
    old, language.grams = language.grams, lambda text: keys[text]
    try:
        # own order 5, 9, 4: against x 0 + 1 + 3 (absent), against y 1 + 1 + 3, of 3 each
        assert profiles.distances("k").tolist() == pytest.approx([4 / 9, 5 / 9])
    finally:
        language.grams = old


def test_token_files(docs, empty, spark):
    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")
    library, own, texts = Tokenizer.from_file(path), token_files.WordEncoder(path), odd_texts()
    ids, counts = own.encode(texts, 2)
    ends = np.cumsum(counts)
    for text, a, b in zip(texts, ends - counts, ends, strict=True):
        assert ids[a:b].tolist() == [*library.encode(text, add_special_tokens=False).ids, 2], text
    want, at = [], 0
    for r in sorted(corpus(), key=lambda r: (-1 if r[0] is None else r[0], r[1] or "")):
        code = [*library.encode(r[1] or "", add_special_tokens=False).ids, 2]
        want.append((r[0], at, len(code), zlib.crc32(np.array(code, "<u4").tobytes())))
        at += len(code)
    assert rows(token_files.round_trip(docs, path), "doc_id", "start", "n_tokens", "ids_crc32") == sorted(want, key=repr)
    assert token_files.round_trip(empty, path).count() == 0


def test_token_files_read_by_id(docs, spark, tmp_path):
    folder = f"file://{tmp_path}/ids"
    token_files.write_token_ids(docs, folder, vocabulary("word_bpe_49k.json"))
    some = token_files.read_token_ids(spark, folder, [3, 99])
    assert sorted(r.doc_id for r in some.collect()) == [3, 99]
    assert "In(doc_id, [3,99])" in some._jdf.queryExecution().toString() or "PushedFilters" in some._jdf.queryExecution().toString()


def targets_brute(sizes, weights=(5, 2, 1), total=1.5, most=2.0):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, free, target = total * sum(sizes.values()), set(order), {}
    while free:
        share = left / sum(weight[s] for s in free)
        full = {s for s in free if share * weight[s] >= most * sizes[s]}
        if not full:
            return target | {s: share * weight[s] for s in free}
        for s in full:
            target[s] = most * sizes[s]
            left -= target[s]
        free -= full
    return target


def test_mix(docs, empty, spark):
    sizes = defaultdict(int)
    for r in corpus():
        sizes[r[3]] += len(words(r[1] or ""))
    want = targets_brute(sizes)
    labels = spark.createDataFrame([(3, 1, 0), (3, 0, 0), (6, 0, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    first = mixing.mix(docs, labels, carry=["doc_id", "source", "size"]).collect()
    again = mixing.mix(docs.repartition(5), labels, carry=["doc_id", "source"]).collect()
    key = lambda r: repr((r.doc_id, r.source, r.size, r.taken))
    assert sorted(map(key, first)) == sorted(map(key, again))
    taken = defaultdict(int)
    for r in first:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and 0 <= r.taken <= 2 * r["size"]
        epochs = int(r.target // r.source_size)
        assert epochs * r["size"] <= r.taken <= (epochs + 1) * r["size"]
        taken[r.source] += r.taken
    assert all(taken[s] == round(want[s]) for s in sizes)
    assert mixing.mix(empty).count() == 0


def test_mix_repeats_rows(docs):
    mixed = mixing.mix(docs, carry=docs.columns)
    expected = {r.taken for r in mixed.groupBy().agg(F.sum("taken").alias("taken")).collect()}
    copies = mixing.repeated(mixed)
    assert copies.agg(F.sum(mixing.word_count(F.coalesce("text", F.lit(""))))).first()[0] == expected.pop()


def test_sentence_spans(spark, docs, empty):
    def brute(table, span, least):
        seen, spans = defaultdict(list), {}
        for k, (i, t) in enumerate(table):
            parts = sentence_dedup.sentences(t or "")
            assert "".join(parts) == (t or "")
            found = []
            for a in range(len(parts)):
                b = a + span
                while b < len(parts) and sum(len(p.split()) for p in parts[a:b]) < least:
                    b += 1
                if a == 0 and b > len(parts):
                    b = len(parts)
                if b > len(parts) or sum(len(p.split()) for p in parts[a:b]) < (least if a else 1) and b - a < len(parts):
                    break
                if a == 0 and not "".join(parts).strip():
                    break
                found.append((a, b, "\0".join(p.strip().lower() for p in parts[a:b])))
            spans[k] = found
            for a, _, s in found:
                seen[s].append((i, k, a))
        out = []
        for k, (i, t) in enumerate(table):
            gone = {x for a, b, s in spans[k] if min(seen[s]) != (i, k, a) for x in range(a, b)}
            parts = sentence_dedup.sentences(t or "")
            out.append((i, len(parts), len(gone), "".join(p for x, p in enumerate(parts) if x not in gone)))
        return sorted(out, key=repr)

    draw = random.Random(8)
    base = [" ".join(draw.choice("abcdefgh") * draw.randint(1, 3) for _ in range(draw.randint(3, 12))) + draw.choice([".", "!", "?\n", "。"]) + " " for _ in range(40)]
    table = [(i, "".join(draw.choices(base, k=draw.randint(1, 12)))) for i in range(60)] + [(100, None), (101, ""), (102, "  \n "), (103, "no end")]
    frame = spark.createDataFrame(table, "doc_id long, text string").repartition(4)
    got = sentence_dedup.sentence_span_dedup(frame, 2, 12, 0)
    assert rows(got, "doc_id", "n_sentences", "n_removed", "kept_text") == brute(table, 2, 12)
    assert sentence_dedup.sentence_span_dedup(empty).count() == 0
    assert sentence_dedup.sentence_span_dedup(docs).count() == docs.count()


def test_sentence_spans_as_the_query_takes_them(spark, docs):
    """Runs of three sentences and long runs of two, every result column, on texts with repeats, nulls and ids that repeat."""
    draw = random.Random(18)
    base = [" ".join(draw.choice("abcdefgh") * draw.randint(1, 3) for _ in range(draw.choice([2, 5, 40, 70]))) + draw.choice([". ", "! ", "?\n", "。"]) for _ in range(40)]
    table = [(draw.choice([i, i, 7, None]), "".join(draw.choices(base, k=draw.randint(0, 9)))) for i in range(90)] + [(100, None), (101, "  \n "), (102, "no end"), (103, "x " * 30_000)]
    table += corpus_texts()

    def runs(parts):
        plain = [p.strip().lower() for p in parts]
        if 0 < len(plain) < 3:
            return [(0, len(plain))] if "".join(plain) else []
        two = [(i, i + 2) for i in range(len(plain) - 1) if len(plain[i]) + len(plain[i + 1]) >= 200]
        return [(i, i + 3) for i in range(len(plain) - 2)] + two

    seen = defaultdict(set)
    names = {k: ((i is not None, i or 0), hashlib.sha256((t or "").encode()).digest()[:16]) for k, (i, t) in enumerate(table)}
    cut = {k: sentence_dedup.sentences(t or "") for k, (_, t) in enumerate(table)}
    said = {k: [(a, b, "\0".join(p.strip().lower() for p in cut[k][a:b])) for a, b in runs(cut[k])] for k in cut}
    for k, found in said.items():
        for a, _, s in found:
            seen[s].add((*names[k], a))
    want = []
    for k, (i, _) in enumerate(table):
        gone = {x for a, b, s in said[k] if min(seen[s]) != (*names[k], a) for x in range(a, b)}
        kept = "".join(p for x, p in enumerate(cut[k]) if x not in gone)
        want.append((i, len(cut[k]), len(gone), sum(len(cut[k][x]) for x in gone), hashlib.sha256(kept.encode()).hexdigest()))
    frame = spark.createDataFrame(table, "doc_id long, text string").repartition(4)
    got = rows(sentence_dedup.sentence_span_dedup(frame), "doc_id", "n_sentences", "n_removed", "chars_removed", "kept_sha256")
    assert got == sorted(want, key=repr) and sum(r[2] for r in got) > 50


def corpus_texts():
    return [(r[0], r[1]) for r in corpus()]


def test_rows_of_one_id_do_not_share_a_name_by_chance(spark):
    """Two texts of one id that agree in Spark's 32-bit hash: what repeats of the one does not touch the other."""
    pool = spark.range(400_000).select(F.concat(F.lit("Row "), "id", F.lit(". It stands alone. So it stays.")).alias("t"))
    twins = pool.groupBy(F.hash("t").alias("h")).agg(F.sort_array(F.collect_list("t")).alias("ts")).filter("size(ts) > 1").first()["ts"]
    frame = spark.createDataFrame([(0, twins[0]), (7, twins[0]), (7, twins[1])], "doc_id long, text string")
    kept = rows(sentence_dedup.sentence_span_dedup(frame, 4, 0, 0), "doc_id", "kept_text")
    assert kept == sorted([(0, twins[0]), (7, ""), (7, twins[1])], key=repr)


def test_sentence_spans_of_few_words(spark):
    passage = "昨日は雨が降りました。今日は晴れています。明日は風が強いでしょう！傘は要りますか？いいえ。"
    footer = "All rights reserved. Do not copy. Ask us."
    table = [(1, "一番目の文章。" + passage + "終わりです。"), (2, "別の話が始まる。" + passage + "続きがある。"),
             (3, "The first text tells of one thing. " + footer), (4, "Another text says much more of it. " + footer)]
    got = sentence_dedup.sentence_span_dedup(spark.createDataFrame(table, "doc_id long, text string"))
    assert {r.doc_id: (r.n_removed, r.kept_text) for r in got.collect()} == {
        1: (0, table[0][1]), 2: (5, "別の話が始まる。続きがある。"), 3: (0, table[2][1]), 4: (3, "Another text says much more of it. ")}


def planted_ids():
    """Rows without ids, and an id with two texts, one of them a near copy of another's; each with the number of its group."""
    draw = random.Random(10)
    own = [" ".join(f"w{draw.randrange(10**6)}" for _ in range(80)) for _ in range(8)]
    table = [(None, own[0], 0), (None, own[1], 1), (None, own[2], 2), (None, own[2], 2), (3, own[3], 3), (5, own[3].upper(), 3), (5, own[4], 4),
             (None, own[5].upper(), 5), (9, own[5], 5), (11, own[6], 6), (11, own[6], 6), (12, None, 7), (None, "", 7), (13, " ", 7)]
    stay = [(None, own[0]), (None, own[1]), (None, own[2]), (3, own[3]), (5, own[4]), (9, own[5]), (11, own[6]), (12, None)]
    return [(i, t, g) for i, t, g in table], sorted(stay, key=repr)


def test_near_copies_of_rows_that_share_or_lack_an_id(spark):
    table, stay = planted_ids()
    frame = spark.createDataFrame(table, "doc_id long, text string, n int")
    for parts in (1, 3):
        assert rows(simhash.without_near_copies(frame.repartition(parts)), "doc_id", "text") == stay
        assert rows(resemblance.without_near_copies(frame.repartition(parts)), "doc_id", "text") == stay


@pytest.mark.parametrize("cell", [2048, 3])
def test_near_copies_by_resemblance(spark, cell):
    draw = random.Random(11)
    passage = [f"p{i}" for i in range(12)]
    texts = []
    for _ in range(40):
        now = [f"w{draw.randrange(500)}" for _ in range(draw.choice([3, 5, 9, 14, 60, 150]))] + draw.choice([[], passage])
        for _ in range(draw.randint(1, 5)):
            texts.append(" ".join(now))
            now = list(now)
            for _ in range(draw.randint(0, 2)):
                now[draw.randrange(len(now))] = f"w{draw.randrange(500)}"

    def shingles(text):
        ws = words(lower(text))
        return {tuple(ws[i:i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()

    sets = [shingles(t) for t in texts]
    edges = [(j, i) for i in range(len(texts)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    root = list(range(len(texts)))
    for _ in texts:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = sorted(r.doc_id for r in resemblance.without_near_copies(frame, cell).collect())
    assert got == sorted(set(root)) and 40 < len(got) < len(texts) - 20
    # radius 3 over shingles of three words leaves near copies in
    assert simhash.without_near_copies(frame).count() > len(got)
    assert resemblance.without_near_copies(frame.limit(0)).count() == 0


def test_near_copies_meet_in_simhash_cells():
    """Cells are runs of the SimHash, equal for equal sets; near sets meet in one, unrelated ones seldom, and are near by their bits."""
    draw = np.random.default_rng(4)
    met = strange = 0
    for _ in range(200):
        own = np.unique(draw.integers(0, 1 << 63, 180, dtype=np.uint64))
        near = np.unique(np.concatenate((own[20:], draw.integers(0, 1 << 63, 20, dtype=np.uint64))))
        words, other = resemblance.simhash(own), resemblance.simhash(near)
        assert words.dtype == np.uint64 and (resemblance.simhash(own[::-1].copy()) == words).all()
        cells = [set(resemblance.cells_of(w).tolist()) for w in (words, other, resemblance.simhash(near ^ np.uint64(1 << 40)))]
        assert len(cells[0]) == 64
        met += bool(cells[0] & cells[1])
        strange += len(cells[0] & cells[2])
        rows = np.stack([*np.stack((words, other))[:, :resemblance.COMPARED].T.view(np.int64), np.array([len(own), len(near)])])
        assert resemblance._near(rows, np.array([0]), np.array([1])).all()
    assert met >= 195 and strange <= 3


def test_near_copies_that_no_simhash_cell_holds_are_found(spark, monkeypatch):
    """Cells of SimHash runs are left empty here: the smallest members alone have to lose no pair."""
    monkeypatch.setattr(resemblance, "leaders", lambda rows: iter(()))
    draw = random.Random(7)
    texts, near = [], []
    for k in range(60):
        ws = [f"v{draw.randrange(10 ** 6)}" for _ in range(draw.choice([13, 14, 24, 60, 120]))]
        one = list(ws)
        one[0 if k % 3 else -1] = "other"  # one shingle of 9 or more: resemblance is 0.8 or higher
        texts += [" ".join(ws), " ".join(one)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = sorted(r.doc_id for r in resemblance.without_near_copies(frame).collect())
    assert got == list(range(0, len(texts), 2))


def test_two_sets_at_four_fifths_share_one_of_their_smallest_members():
    draw = np.random.default_rng(9)
    for n in [*range(1, 40), 200]:
        for _ in range(20):
            whole = np.unique(draw.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
            out = int(draw.integers(0, n // 5 + 1))
            one = np.setdiff1d(whole, draw.choice(whole, out, replace=False))
            assert 5 * len(one) >= 4 * n and set(resemblance.fifth(whole)) & set(resemblance.fifth(one))
    assert len(resemblance.fifth(np.zeros(0, np.uint64))) == 0


def test_profiles_without_a_sample_come_from_all_rows(spark, monkeypatch):
    draw = random.Random(2)
    rows = [(i, "".join(draw.choice("abcdefgh ij") for _ in range(draw.randrange(3, 90))), draw.choice(["x", "y", None])) for i in range(300)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    monkeypatch.setattr(language, "AT_A_TIME", 500)
    monkeypatch.setattr(language, "HELD", 200)
    got = language.fit(frame, 50, None)
    want = {}
    for lang in ("x", "y"):
        keys, counts = np.unique(np.concatenate([language.grams(t) for _, t, l in rows if l == lang]), return_counts=True)
        want[lang] = language.ranked(keys, counts, 50)
    plain = language.Profiles(want)
    assert got.names == plain.names and all((a == c).all() and (b == d).all() for (a, b), (c, d) in zip(got.sorted, plain.sorted, strict=True))
    few = language.fit(frame, 50, 5)
    assert any(len(a) != len(c) or (a != c).any() for (a, _), (c, _) in zip(few.sorted, plain.sorted, strict=True))


def test_near_sets_of_any_size_are_within_the_radius():
    draw = np.random.default_rng(5)
    for n in (4, 5, 9, 10, 40, 300):
        for _ in range(40):
            own = np.unique(draw.integers(0, 1 << 63, n, dtype=np.uint64))
            near = own[:-max(1, n // 5)] if n >= 5 else np.append(own, np.uint64(1))
            words = np.stack([resemblance.simhash(own), resemblance.simhash(near)]).T.view(np.int64)
            rows = np.concatenate((words, np.array([[len(own), len(near)]])))
            assert resemblance._within(rows, np.array([0]), np.array([1])).tolist() == [0]
            far = np.stack([words[:, 0], ~words[:, 0]], axis=1)
            assert not len(resemblance._within(np.concatenate((far, rows[-1:])), np.array([0]), np.array([1])))
