"""SimHash links, spelling variants and hard negatives against plain versions of their contracts."""

import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from loomgraph.llm import negatives, queries, simhash, variants

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def classes_of(n, linked):
    """Rows 0..n-1 by what they reach."""
    at = list(range(n))
    for i, j in itertools.combinations(range(n), 2):
        if linked(i, j) and at[i] != at[j]:
            a, b = at[i], at[j]
            at = [b if x == a else x for x in at]
    return at


# --- simhash -------------------------------------------------------------------


def plain_fingerprint(text):
    w = SPACE.findall(low(text))
    k = min(3, len(w))
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]).encode(), 42) for i in range(len(w) - k + 1)] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    fps = [plain_fingerprint(t) for _, t in rows]
    at = classes_of(len(rows), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 2)
    least = {}
    for (i, _), c in zip(rows, at, strict=True):
        if i is not None:
            least[c] = min(i, least.get(c, i))
    return Counter((i, f"{f:016x}", least.get(c)) for (i, _), f, c in zip(rows, fps, at, strict=True))


def test_masks_cover():
    masks = simhash.masks()
    assert len(masks) == 7
    for i, j in itertools.combinations_with_replacement(range(64), 2):
        assert any(not m >> i & 1 and not m >> j & 1 for m in masks)


@pytest.mark.parametrize("small", [256, 1])
def test_simhash(docs, no_docs, small):
    got = Counter(tuple(r) for r in simhash.components(docs, small=small).collect())
    assert got == plain_components([(r.doc_id, r.text) for r in docs.collect()])
    assert simhash.components(no_docs).count() == 0


def test_fingerprint_of_long_text(spark, monkeypatch):
    """Blocks give the same as one."""
    monkeypatch.setattr(simhash, "BLOCK", 7)
    text = " ".join(f"W{i % 41}" for i in range(300))
    starts, ends = zip(*[m.span() for m in SPACE.finditer(text)], strict=True)
    import numpy as np

    assert simhash.fingerprint(text.lower().encode(), np.array(starts), np.array(ends)) == plain_fingerprint(text)
    assert simhash.fingerprint(b"", np.array([], int), np.array([], int)) == 0


@pytest.mark.parametrize("small", [256, 4])
def test_simhash_links(spark, small):
    """Chains, balls and lone fingerprints, in small buckets and in large ones."""
    r = random.Random(5)
    fps = [r.getrandbits(64) for _ in range(60)]
    for f in fps[:12]:
        near = f
        for _ in range(6):
            near ^= 1 << r.randrange(64)
            fps += [near, near ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)), near ^ (0b111 << r.randrange(60))]
    fps = list(dict.fromkeys(fps))
    classes = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long")
    got = [(a % (1 << 64), b % (1 << 64)) for a, b in simhash.links(classes, small).collect()]
    at = {f: i for i, f in enumerate(fps)}
    pairs = {(at[a], at[b]) for a, b in got}
    mine = classes_of(len(fps), lambda i, j: (i, j) in pairs or (j, i) in pairs)
    want = classes_of(len(fps), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 2)
    same = lambda x: {tuple(i for i, c in enumerate(x) if c == k) for k in set(x)}
    assert same(mine) == same(want)


# --- spelling variants -----------------------------------------------------------


def plain_variants(rows):
    counts = Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = low(w)
            h = zlib.crc32(f"{i}:{w}".encode())
            if i is not None and h % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}

    def is_near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    near = {w: [v for v in words if v != w and is_near(v, w)] for w in words}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 5 * words[w] else None
    out = Counter()
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out[(w, form[w], root, words[w], len(near[w]), words.get(form[w]))] += 1
    return out


def noisy_texts():
    r = random.Random(9)
    base = ["letters", "Étoiles", "grünlich", "aaaaaaa", "programme", "x" * 70, "ÿÿÿÿÿÿ"]
    pool = []
    for i, w in enumerate(base):
        pool += [w] * 400
        for _ in range(6):
            k = r.randrange(len(w))
            for v in (w[:k] + w[k + 1 :], w[:k] + r.choice("abcéÉÿ") + w[k:], w[:k] + r.choice("abcéÉÿ") + w[k + 1 :]):
                pool += [v] * r.choice([5, 6, 20, 79, 80])
                pool += [v + "s"] * r.choice([1, 5])
    r.shuffle(pool)
    return [(i % 37 if i % 37 else None, "-".join(pool[i : i + 50])) for i in range(0, len(pool), 50)]


def test_variants(spark, no_docs):
    rows = [*noisy_texts(), (1, None), (2, ""), (3, " 12 ")]
    rows += rows[:2]
    table = spark.createDataFrame([(i, t, 7, "clash") for i, t in rows], "doc_id long, text string, n int, word string").repartition(3)
    want = plain_variants(rows)
    assert sum(1 for w in want if w[1]) > 10
    assert Counter(tuple(r) for r in variants.grouped(table).collect()) == want
    assert variants.grouped(no_docs).count() == 0


def test_variants_of_long_texts(spark, monkeypatch):
    """Long texts are scanned match by match, long words have keys in parts."""
    rows = noisy_texts()[:30]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    whole = "-".join(t for _, t in rows)
    for raw in (whole, ""):
        monkeypatch.setattr(variants, "LONG", 10)
        a = Counter(dict(variants.text_words(raw.encode(), 5)))
        monkeypatch.setattr(variants, "LONG", 1 << 20)
        assert a == Counter(dict(variants.text_words(raw.encode(), 5)))
    word = "ab" * 40_000
    long = spark.createDataFrame([(i, " ".join([word] * 5 + [word[1:]])) for i in range(6)], "doc_id long, text string")
    got = {len(r.word): r for r in variants.grouped(long, noise=1 << 40).collect()}
    assert got[80_000].n == 30 and got[79_999].form == word and got[79_999].n_near == 1
    assert variants.grouped(table, often=10**9).count() == 0


def test_keys_tell_words_apart():
    seen = defaultdict(set)
    words = ["".join(x) for x in itertools.product("abé", repeat=6)]
    for w in words:
        for k1, k2, kind in variants.word_keys(w, 5):
            seen[k1, k2].add((kind, w))
    for members in seen.values():
        wild = [w for kind, w in members if kind == variants.WILD]
        assert len(wild) in (0, len(members))
        if len(wild) > 1:
            (place,) = {i for i in range(6) for a, b in itertools.combinations(wild, 2) if a[i] != b[i]}
            assert len({w[:place] + w[place + 1 :] for w in wild}) == 1


# --- hard negatives --------------------------------------------------------------


def plain_negatives(rows, every=10):
    """rows: vec_id, label, vector."""
    own = [(i, lab, [math.floor(256 * x) for x in v]) for i, lab, v in rows if lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    own.sort(key=lambda r: (r[0] is None, r[0] or 0))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = Counter()
    for k, (a, label, v) in enumerate(own):
        if a is None or a % every:
            continue
        scored = [(-dot(v, u), j) for j, (_, _, u) in enumerate(own)]
        same = sorted(x for x in scored if own[x[1]][1] == label and x[1] != k)[:5]
        other = sorted(x for x in scored if own[x[1]][1] != label)
        for s, j in same:
            found = [x for x in other if 80 * -s <= 100 * -x[0] <= 100 * -s][:5]
            out.update((a, own[j][0], n + 1, own[i][0], -s, -t) for n, (t, i) in enumerate(found))
    return out


def vectors():
    r = random.Random(3)
    rows = []
    for i in range(160):
        c = [r.gauss(0, 1) for _ in range(9)] if i % 3 else [1.0] * 9
        rows.append((i, 1 if i % 3 == 0 else i % 5, [x * 0.3 + 0.2 * (k % 2) for k, x in enumerate(c)]))
    rows += [rows[0], rows[10], rows[11], (None, 1, [0.3] * 9), (None, 2, [0.3] * 9), (170, None, [1.0] * 9), (180, 1, None), (190, 1, [1.0, None] + [0.0] * 7), (200, 1, [float("nan")] * 9), (210, 2, [float("inf")] * 9)]
    return rows + [(220, 2, [0.5, 0.5]), (221, 77, [0.1] * 9), (230, 78, [0.1] * 9), (240, 2, [])]


@pytest.mark.parametrize("blocks", [(512, 8192, 32), (3, 7, 4)])
def test_negatives(spark, blocks):
    rows = vectors()
    table = spark.createDataFrame([(*r, 1, "clash") for r in rows], "vec_id long, label int, embedding array<double>, row int, anchor string").repartition(3)
    got = Counter(tuple(r) for r in negatives.mine(table, F.col("vec_id") % 10 == 0, blocks=blocks).collect())
    want = plain_negatives(rows)
    assert len(want) > 100 and got == want


def test_negatives_of_large_components(spark):
    """Beyond what float64 adds exactly."""
    rows = [(i, i % 2, [2.0**22 + i, 1.0 + i % 3, -(2.0**20)]) for i in range(40)]
    table = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    assert Counter(tuple(r) for r in negatives.mine(table, F.col("vec_id") % 10 == 0, blocks=(2, 8, 2)).collect()) == plain_negatives(rows)


def test_negatives_of_nothing(spark):
    none = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    assert negatives.mine(none, F.col("vec_id") % 100 == 0).count() == 0
    lone = spark.createDataFrame([(0, 1, [1.0]), (1, 2, [1.0])], "vec_id long, label int, embedding array<float>")
    assert negatives.mine(lone, F.col("vec_id") % 100 == 0).count() == 0
    with pytest.raises(ValueError):
        negatives.mine(none, F.lit(True), positives=9)


def test_new_operators_are_registered():
    assert {"op11_simhash", "op12_variants", "op13_negatives"} <= set(queries.QUERIES)
