"""Each operator against a plain version of its contract."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from loomgraph.llm import chat, decontaminate, jaccard, licenses, mixing, pseudonyms, quality, repeats, tokens, toxicity
from loomgraph.llm.kernel import text_slices
from loomgraph.llm.queries import tokenizer_path

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def rows(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def counted(df):
    return Counter(tuple(r) for r in df.collect())


# --- quality -------------------------------------------------------------------


def plain_quality(text):
    t = text or ""
    w = SPACE.findall(t)
    lines = [x for x in t.split("\n") if SPACE.search(x)]
    at = defaultdict(list)
    for i in range(len(w) - 4):
        at[tuple(w[i : i + 5])].append(i)
    hit = {p for v in at.values() if len(v) > 1 for i in v for p in range(i, i + 5)}
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit)


def test_quality(docs, no_docs):
    got = counted(quality.ledger(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
    assert got == Counter((i, *plain_quality(t)) for i, t in rows(docs))
    assert quality.ledger(no_docs).count() == 0


def test_quality_policies(docs):
    ledger = quality.ledger(docs).cache()
    bits = [r.fail_bits for r in ledger.collect()]
    whole = quality.mask(quality.DEFAULT)
    for r in quality.ablation(ledger, quality.DEFAULT).collect():
        bit = quality.mask(quality.Policy("x", (r.rule,)))
        assert r.n_failed == sum(bool(b & bit) for b in bits)
        assert r.n_failed_alone == sum(b & whole == bit for b in bits)


# --- decontamination -------------------------------------------------------------


def plain_hits(text, items, window=13):
    w = ALNUM.findall(low(text))
    hit, found = set(), set()
    for item, t in items:
        v = ALNUM.findall(low(t))
        k = min(len(v), window)
        for j in range(len(v) - k + 1 if k else 0):
            for i in range(len(w) - k + 1):
                if w[i : i + k] == v[j : j + k]:
                    hit.update(range(i, i + k))
                    found.add(str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


ITEMS = [(1, "w2000 W2001 " + " ".join(f"w{i}" for i in range(2002, 2020))), (10, "one two three"), (2, None), (3, ""), (4, " ".join(f"w{i}" for i in range(30, 50))), (5, "é ü 字 words"), (1, "one two")]


@pytest.mark.parametrize("max_words", [200_000, 8])
def test_decontamination(spark, docs, no_docs, max_words):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    own = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    got = counted(decontaminate.judged(decontaminate.hits(own, items, max_words=max_words)).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"))
    assert got == Counter((i, *plain_hits(t, ITEMS)) for i, t in rows(own))
    assert decontaminate.hits(no_docs, items).count() == 0
    clean = counted(decontaminate.clean(docs, items, max_words=max_words).select("doc_id"))
    assert clean == Counter((i,) for i, t in rows(docs) if not plain_hits(t, ITEMS)[4])


def test_decontamination_of_repeated_rows(spark, docs):
    """Also with several groups of items, rows of the same or no doc_id are judged each by itself."""
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    more = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(None, "one two three"), (None, "one two nine"), (None, "no hit here"), (9, "one two")], "doc_id long, text string"))
    got = counted(decontaminate.judged(decontaminate.hits(more, items, max_words=8)).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"))
    assert got == Counter((i, *plain_hits(t, ITEMS)) for i, t in rows(more))


def test_decontamination_without_items(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    got = decontaminate.judged(decontaminate.hits(docs, none)).collect()
    assert Counter((r.doc_id, r.n_words) for r in got) == Counter((i, len(ALNUM.findall(low(t)))) for i, t in rows(docs))
    assert not any(r.contaminated for r in got)


@pytest.mark.parametrize("max_words", [8, 200_000])
def test_without_spans(spark, docs, max_words):
    """Against spans of the plain version, cut out word by word."""
    items = spark.createDataFrame(ITEMS, "item_id int, text string")

    def plain(text, least):
        if text is None:
            return None
        w = list(ALNUM.finditer(low(text)))
        hit = set()
        for _, t in ITEMS:
            v = ALNUM.findall(low(t))
            k = min(len(v), 13)
            for j in range(len(v) - k + 1 if k else 0):
                for i in range(len(w) - k + 1):
                    if [x[0] for x in w[i : i + k]] == v[j : j + k]:
                        hit.add((i, i + k))
        out, at = "", 0
        for lo, hi in decontaminate.united(list(hit)):
            if hi - lo >= least:
                out, at = out + text[at : w[lo].start()], w[hi - 1].end()
        return out + text[at:]

    for least in (1, 4):
        got = decontaminate.without_spans(docs, items, least, max_words=max_words)
        assert got.columns == docs.columns
        assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter((i, plain(t, least)) for i, t in rows(docs))


def test_removed_spans():
    assert decontaminate.removed_spans("a b, c d e", [(1, 3)]) == "a  d e"


# --- mixing ----------------------------------------------------------------------


def test_targets_stop_at_three_times():
    got = mixing.targets({"a": 10, "b": 100, None: 1000})
    assert sum(got.values()) == 1110 and got["a"] == 30 and got["b"] == 300 and got[None] == 780
    assert mixing.targets({"a": 0}) == {"a": 0}
    assert mixing.targets({}) == {}


def test_flow_prefers_what_is_unused():
    both, a, b = frozenset("ab"), frozenset("a"), frozenset("b")
    got = mixing.flow({both: 100, a: 50, b: 10}, {"a": 80, "b": 80})
    assert sum(got.values()) == 160
    assert got[a, "a"] == 50 and got[b, "b"] == 10 and got[both, "a"] == 30 and got[both, "b"] == 70


def test_flow_repeats_at_rising_cost():
    got = mixing.flow({frozenset("a"): 10, frozenset("ab"): 10}, {"a": 40, "b": 0})
    assert got == {(frozenset("a"), "a"): 20, (frozenset("ab"), "a"): 20}


def test_flow_costs_least_by_brute_force():
    """All ways to route words of two patterns to two sources: none fills more, or as much at a lower cost."""
    import itertools

    a, b = frozenset("a"), frozenset("ab")

    def cost(words, uses):
        whole, rest = divmod(uses, words) if words else (0, 0)
        return sum(i * words for i in range(whole)) + whole * rest

    for words_a, words_b, quota_a, quota_b in itertools.product((1, 2), (1, 3), (0, 2, 5), (1, 4)):
        got = mixing.flow({a: words_a, b: words_b}, {"a": quota_a, "b": quota_b}, 3)
        ways = []
        for x, y, z in itertools.product(range(3 * words_a + 1), range(3 * words_b + 1), range(3 * words_b + 1)):
            if x + y <= quota_a and z <= quota_b and y + z <= 3 * words_b:
                ways.append((-(x + y + z), cost(words_a, x) + cost(words_b, y + z)))
        x, y, z = got.get((a, "a"), 0), got.get((b, "a"), 0), got.get((b, "b"), 0)
        assert x + y <= quota_a and z <= quota_b
        assert (-(x + y + z), cost(words_a, x) + cost(words_b, y + z)) == min(ways)


def test_mix(docs, no_docs):
    got = mixing.mix(docs).collect()
    sizes = {}
    for r in docs.collect():
        sizes[r.source] = sizes.get(r.source, 0) + len(SPACE.findall(r.text or ""))
    goal = mixing.targets(sizes)
    taken = defaultdict(int)
    for r in got:
        assert 0 <= r.taken <= 3 * r.size and r.source_size == sizes[r.source] and r.target == float(goal[r.source])
        taken[r.source] += r.taken
    assert len(got) == docs.count()
    assert all(abs(taken[s] - goal[s]) <= 1 for s in goal)
    again = mixing.mix(docs.repartition(5)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    assert mixing.mix(no_docs).count() == 0


def test_taken_documents(docs):
    plan = {r.doc_id: r.taken for r in mixing.mix(docs.where("doc_id is not null").dropDuplicates(["doc_id"])).collect()}
    out = mixing.taken_documents(docs.where("doc_id is not null").dropDuplicates(["doc_id"]))
    assert out.columns == docs.columns
    got = defaultdict(int)
    for r in out.collect():
        got[r.doc_id] += len(SPACE.findall(r.text))
    assert got == {k: v for k, v in plan.items() if v}


def test_overlapping_sources(spark):
    d = spark.createDataFrame([(i, "w " * 10, ["a"] if i < 10 else ["a", "b"]) for i in range(20)], "doc_id long, text string, source array<string>")
    got = mixing.mix(d).collect()
    assert sum(r.taken for r in got) == 300 and all(r.taken <= 30 for r in got)


# --- toxicity --------------------------------------------------------------------


def test_toxicity(spark):
    rng = np.random.default_rng(1)
    vocabulary = [f"word{i}" for i in range(300)]
    data, labels = [], []
    for i in range(600):
        w = list(rng.choice(vocabulary, 40))
        toxic = i % 4 == 0
        if toxic:
            w[5] = w[20] = ["scumbag", "vermin"][i % 8 == 0]
        data.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    data += [(1000, "you are such a svumbag today"), (1001, None), (1002, ""), (1003, "vermins everywhere")]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    table = spark.createDataFrame([*labels, labels[0], (None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, table)
    assert {"scumbag", "vermin"} <= set(model.terms)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert len(got) == len(data) and all(0 <= r.score <= 1 for r in got.values())
    held = [i for i, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].predicted == (i % 4 == 0) for i in held)
    assert got[1000].misspelled_used == 1 and got[1003].strong_used == 1
    assert got[1001].score == got[1002].score < 0.5 < got[1003].score
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.predicted for r in toxicity.score(docs, toxicity.fit(docs, empty)).collect()} == {0}


def distance(a, b):
    d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_automaton_is_edit_distance():
    terms = ["clown", "stupid", "worthless", "disgusting"]
    trie = toxicity.Trie(terms)
    rng = np.random.default_rng(3)
    for _ in range(800):
        t = list(terms[rng.integers(4)])
        for _ in range(rng.integers(0, 4)):
            p, c = int(rng.integers(len(t))), chr(97 + int(rng.integers(26)))
            op = rng.integers(3)
            t[p : p + (op != 0)] = [c] if op < 2 else []
        w = "".join(t)
        want = any(min(distance(x, w), distance(x, w[:-1])) <= toxicity.edits_allowed(x) for x in terms)
        assert (trie.fuzzy(w) is not None) == want, w


def test_pieces_lose_no_misspelling():
    terms = ["clown", "stupid", "disgusting"]
    scanner = toxicity.Scanner({"zzzz": 1}, terms)
    words = ["cloown", "clwn", "lcown", "colwn", "stupidd", "sutpid", "stpid", "disgutsing", "dsgustng", "xisgustinx", "clown", "plain"]
    s = next(iter(toxicity.text_slices(pa.array([" ".join(words)]))))
    trie = toxicity.Trie(terms)
    assert scanner.counts(s)[0, 4] == sum(trie.fuzzy(w) is not None for w in words)


def test_no_misspelling_is_lost():
    """Swaps over any place with further edits and a tail letter, and beginnings whose first letter isn't ASCII."""
    terms = ["clown", "scumbag", "dickhead", "disgusting"]
    trie = toxicity.Trie(terms)
    rng = np.random.default_rng(9)
    words = {"scmubags", "dcikheid", "dickhaed"}
    while len(words) < 3000:
        t = list(terms[rng.integers(4)])
        for _ in range(rng.integers(1, 4)):
            p, c = int(rng.integers(len(t) - 1)), "éÄxyzab"[rng.integers(7)]
            match rng.integers(4):
                case 0:
                    t[p], t[p + 1] = t[p + 1], t[p]
                case 1:
                    t[p] = c
                case 2:
                    t.insert(p, c)
                case 3:
                    del t[p]
        words.add("".join(t) + "s" * int(rng.integers(2)))
    words = sorted(words)
    want = [trie.fuzzy(w.lower()) is not None for w in words]
    assert 300 < sum(want) < len(words)
    s = next(iter(toxicity.text_slices(pa.array(words))))
    assert (toxicity.Scanner({"zzzz": 1}, terms).counts(s)[:, 4:].sum(axis=1) > 0).tolist() == want
    assert trie.fuzzy("scmubags") and trie.fuzzy("dcikheid")
    s = next(iter(toxicity.text_slices(pa.array(["Ärschloch", "ärschloch", "arschloch"]))))
    assert toxicity.Scanner({"ärsch": 1}, []).counts(s)[:, 0].tolist() == [1, 1, 0]


def test_quotation_is_told_apart():
    scanner = toxicity.Scanner({"scum": 1}, [])
    s = next(iter(toxicity.text_slices(pa.array(['he said scum', 'you "scum" there', "you scum"]))))
    assert scanner.counts(s)[:, :2].tolist() == [[0, 1], [0, 1], [1, 0]]


def test_quotation_of_any_length():
    scanner = toxicity.Scanner({"scum": 1}, [])
    far = "blah " * 400
    texts = [f'"{far}" you scum and "bye"', f'"{far} scum {far}"', 'a " mark\nyou scum "', "„ihr scum“ und »scum« scum", None, ""]
    s = next(iter(toxicity.text_slices(pa.array(texts))))
    assert scanner.counts(s)[:, :2].tolist() == [[1, 0], [0, 1], [1, 0], [1, 2], [0, 0], [0, 0]]


# --- Jaccard join ------------------------------------------------------------------


def plain_sets(data):
    out = []
    for _, t in data:
        w = SPACE.findall(low(t))
        out.append({tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return out


def plain_components(data):
    sets = plain_sets(data)
    root = list(range(len(data)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(data):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return Counter((d, len(sets[i]), least.get(find(i), d)) for i, (d, _) in enumerate(data))


def test_components(docs, no_docs):
    assert counted(jaccard.components(docs)) == plain_components(rows(docs))
    assert jaccard.components(no_docs).count() == 0


def family(seed, n, length=60, edits=4):
    rng = np.random.default_rng(seed)
    base = [f"b{seed}x{i}" for i in range(length)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.integers(0, edits + 1)):
            w[int(rng.integers(length))] = f"e{rng.integers(10**9)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("members, shingles, repeats", [(4096, 1 << 22, 2), (6, 1 << 22, 2), (4096, 400, 100)])
def test_families(spark, monkeypatch, members, shingles, repeats):
    """Chains of near copies; with small cells, they are divided again and again, or joined in blocks."""
    monkeypatch.setattr(jaccard, "MEMBERS", members)
    monkeypatch.setattr(jaccard, "SHINGLES", shingles)
    monkeypatch.setattr(jaccard, "REPEATS", repeats)
    monkeypatch.setattr(jaccard, "PIVOTS", 3)
    monkeypatch.setattr(jaccard, "ROUNDS", 2)
    texts = [t for s in range(4) for t in family(s, 25)] + family(9, 30, 80, 8)
    data = list(enumerate(texts))
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    assert counted(jaccard.components(df)) == plain_components(data)


@pytest.mark.parametrize("repeats", [2, 100])
def test_short_hub_with_many_variants(spark, monkeypatch, repeats):
    """Variants link to the hub only, in cells larger than is joined at once."""
    monkeypatch.setattr(jaccard, "MEMBERS", 6)
    monkeypatch.setattr(jaccard, "REPEATS", repeats)
    monkeypatch.setattr(jaccard, "ROUNDS", 1)
    hubs = ["a b c d e f g", "k l m n o p q r s"]
    texts = [h if i == 30 else " ".join(h.split()[: 7 + 2 * j] + [f"v{j}x{i}"] * (1 + j)) for j, h in enumerate(hubs) for i in range(60)]
    data = list(enumerate(texts))
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    want = plain_components(data)
    assert {c for _, _, c in want} != {i for i, _ in data}
    assert counted(jaccard.components(df)) == want


def test_kept_one(docs):
    own = docs.where("doc_id is not null")
    kept = {r.doc_id for r in jaccard.kept_one(own).collect()}
    assert kept == {c for _, _, c in plain_components(rows(own))}
    assert jaccard.kept_one(own).columns == docs.columns


def test_kept_one_row(spark, docs):
    """One row of each component, also where ids repeat or are null; a repeated id may belong to several."""
    more = [(3, "another text with the id three here"), (None, "lone text that has no id at all"), (None, "lone text that has no id at all"), (None, None), (6, "")]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    data = rows(df)
    sets = plain_sets(data)
    group = list(range(len(data)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                group = [group[i] if g == group[j] else g for g in group]
    of = defaultdict(list)
    for g, row in zip(group, data, strict=True):
        of[g].append(row[0])
    want = Counter(min(v, key=lambda i: (i is None, i or 0)) for v in of.values())
    assert Counter(i for i, _ in rows(jaccard.kept_one(df))) == want


def test_signatures_bound_the_difference():
    rng = np.random.default_rng(5)
    for n in (3, 70, 900):
        a, b = (np.unique(rng.integers(0, 4 * n, n)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) for _ in range(2))
        assert jaccard.least_apart(jaccard.signature(a), jaccard.signature(b)) <= len(set(a.tolist()) ^ set(b.tolist()))


# --- tokens ------------------------------------------------------------------------


def test_tokens(docs, no_docs):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer_path())
    got = sorted(((r.doc_id is not None, r.doc_id), r.start, r.n_tokens, r.ids_crc32) for r in tokens.read(tokens.write(docs, tokenizer_path(), block_tokens=200)[0]).collect())
    want, at = [], 0
    for i, t in sorted(rows(docs), key=lambda r: (r[0] is not None, r[0], r[1] or "")):
        ids = plain.encode(t or "", add_special_tokens=False).ids + [2]
        want.append(((i is not None, i), at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == sorted(want)
    assert tokens.read(tokens.write(no_docs, tokenizer_path())[0]).count() == 0


def test_parts_are_tokenised_as_wholes():
    from tokenizers import Tokenizer

    plain, own = Tokenizer.from_file(tokenizer_path()), tokens.Encoder(tokenizer_path())
    rng = np.random.default_rng(2)
    pieces = [" ", "  ", "\n", ".", ",", "a", "foo", "Dé", "7", "!", "_", "\t", "\x0b", "'s", "\xa0", "½", ". ", ".\n", ", ", "\x00", "<|endoftext|>", "　", "字", "\x1f", "\r\n"]
    texts = ["".join(rng.choice(pieces, rng.integers(0, 12))) for _ in range(4000)]
    (s,) = text_slices(pa.array(texts))
    ids, n = own.encode(s)
    at = np.concatenate([[0], np.cumsum(n)])
    assert all(plain.encode(t, add_special_tokens=False).ids == ids[at[i] : at[i + 1]].tolist() for i, t in enumerate(texts))


def test_parts_are_forgotten_and_confirmed(monkeypatch):
    own = tokens.Encoder(tokenizer_path())
    texts = [" ".join(f"w{i}{j}" for j in range(50)) for i in range(20)] + ["x" * 100_000]
    (s,) = text_slices(pa.array(texts), 1 << 30)
    want = own.encode(s)
    monkeypatch.setattr(own, "MAX_BYTES", 1000)
    own.bound()
    assert not len(own.keys.view)
    # All parts under one hash: each is confirmed or tokenised by itself.
    monkeypatch.setattr(type(s), "word_hashes", lambda self, a, b, lower: np.zeros(len(a), np.uint64))
    got = own.encode(s)
    assert all(np.array_equal(x, y) for x, y in zip(got, want, strict=True))


@pytest.mark.parametrize("least", [2, 3, 8])
def test_repair_ends_when_no_pair_is_left(least):
    """By brute force: in what is left, no pair inside a document occurs ``least`` times without overlap."""
    rng = np.random.default_rng(least)
    for alphabet in (1, 2, 5, 300):
        lengths = rng.integers(0, 80, 60)
        ids = rng.integers(0, alphabet, int(lengths.sum())).astype(np.uint32)
        symbols, starts, rules, sizes = tokens.compress(ids, lengths, least)
        assert tokens.decode(symbols, rules).tolist() == ids.tolist()
        assert [len(tokens.decode(np.array([tokens.FIRST_RULE + i], np.uint32), rules)) for i in range(len(rules))] == sizes.tolist()
        edge = [*starts[lengths > 0].tolist(), len(symbols)]
        count = Counter()
        for lo, hi in zip(edge[:-1], edge[1:], strict=True):
            taken = {}
            for i in range(lo, hi - 1):
                p = (symbols[i], symbols[i + 1])
                if taken.get(p) != i - 1 or p[0] != p[1]:
                    count[p] += 1
                    taken[p] = i
        assert max(count.values(), default=0) < least


def test_repair_round_trip():
    rng = np.random.default_rng(4)
    lengths = rng.integers(0, 60, 200)
    ids = rng.integers(0, 6, int(lengths.sum())).astype(np.uint32)
    batch = tokens.pack(0, 0, list(range(200)), ids, lengths, 16).to_pylist()[0]
    assert len(batch["rules"]) and (tokens.decode(*tokens.unpack(batch["rules"], batch["wide"], batch["symbols"])) == ids).all()
    at = np.concatenate([[0], np.cumsum(lengths)])
    for i in np.flatnonzero(lengths)[:40]:
        one = tokens.one_document(batch["rules"], batch["wide"], batch["symbols"], batch["starts"], int(i))
        assert one[: lengths[i]].tolist() == ids[at[i] : at[i + 1]].tolist()


# --- repeats -----------------------------------------------------------------------


def plain_repeats(data, length=50):
    first = {}
    data = [(repeats.NO_ID if i is None else i, (t or "").encode()) for i, t in data]
    for i, b in sorted(data):
        for p in range(len(b) - length + 1):
            first.setdefault(b[p : p + length], i)
    out = Counter()
    for i, b in data:
        gone = [False] * len(b)
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < i:
                gone[p : p + length] = [True] * length
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and (j == 0 or not gone[j - 1]) for j, g in enumerate(gone))
        out[None if i == repeats.NO_ID else i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()] += 1
    return out


def test_repeats(docs, no_docs):
    got = repeats.remove_repeats(docs)
    assert counted(got.drop("spans")) == plain_repeats(rows(docs))
    for r in got.where("doc_id = 2").collect():
        assert hashlib.sha256(repeats.cut(rows(docs.where("doc_id = 2"))[0][1].encode(), r.spans)).hexdigest() == r.kept_sha256
    assert repeats.remove_repeats(no_docs).count() == 0


def test_repeats_over_blocks(spark):
    rng = np.random.default_rng(6)
    passage = "".join(rng.choice(list("abcdefgh "), 120))
    data = [(int(i), "".join(rng.choice(list("ijklmno "), rng.integers(0, 90))) + passage[: rng.integers(40, 120)] + "".join(rng.choice(list("pqrst "), rng.integers(0, 30)))) for i in rng.permutation(80)]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(9)
    assert counted(repeats.remove_repeats(df).drop("spans")) == plain_repeats(data)


def test_levels_merge_geometrically():
    family, known = repeats.Levels(), {}
    rng = np.random.default_rng(7)
    for batch in range(40):
        keys = rng.integers(0, 500, 30).astype(np.uint64)
        assert family.scan(keys).tolist() == [known.get(int(k), repeats.NO_ID) for k in keys]
        family.add(keys, np.full(30, batch))
        for k in keys:
            known.setdefault(int(k), batch)
        sizes = [len(k) for k, _ in family.levels]
        assert all(a >= 2 * b for a, b in zip(sizes, sizes[1:], strict=False))


# --- licences, pseudonyms, chat ------------------------------------------------------


def test_licenses(spark, no_docs):
    mit = licenses.TEMPLATES["mit-permission"]
    changed = mit.replace("person", "body").replace("charge", "cost")
    data = [(1, "x " * 30 + mit + " y" * 30), (2, "Released under the MIT license!"), (3, None), (4, ""), (5, mit[:60]), (6, "a b c\n" + changed), (6, "a b c\n" + changed)]
    got = sorted((r.doc_id, r.licenses) for r in licenses.scan(spark.createDataFrame(data, "doc_id long, text string")).collect())

    def plain(t):
        sh = lambda x: {tuple(w[i : i + 5]) for w in [ALNUM.findall(low(x))] for i in range(len(w) - 4)}
        return ",".join(sorted(n for n, x in licenses.TEMPLATES.items() if 100 * len(sh(x) & sh(t)) >= 75 * len(sh(x))))

    assert got == sorted((i, plain(t)) for i, t in data)
    assert got[0][1] == "mit-permission" and got[1][1] == "mit"
    assert licenses.scan(no_docs).count() == 0


def test_feistel_is_a_permutation():
    for size in (1, 2, 10, 997, 4096):
        p = pseudonyms.Permutation(b"key", "x", size)
        got = [p.apply(i) for i in range(size)]
        assert sorted(got) == list(range(size)) and [p.undo(x) for x in got] == list(range(size))


def test_pseudonyms_by_brute_force(spark):
    """Every value is found by looking at all stretches of a text, and permuted one by one."""
    own = pseudonyms.Pseudonyms(b"k")
    texts = ["card 4111 1111 1111 1111.", "no 4111111111111112 luhn", "mail a.b@x.org and A.B@x.org", "2024-02-30 is none, 2024-02-29 is", "ip 10.0.0.1, 10.0.0.256", "", "plain words only", "GB82WEST12345698765432 x", "x" * 2_000_000 + " 10.0.0.1"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(99, None)], "doc_id int, text string")
    got = {r.doc_id: r.text for r in pseudonyms.pseudonymise(df, b"k").collect()}
    want = {0: "4111 1111 1111 1111", 3: "2024-02-29", 4: "10.0.0.1", 7: "GB82WEST12345698765432", 8: "10.0.0.1"}
    kinds = {0: "card", 3: "date", 4: "ip", 7: "iban", 8: "ip"}
    for i, t in enumerate(texts):
        if i in want:
            assert got[i] == t.replace(want[i], own._replaced(kinds[i], want[i], False)) != t
        elif i == 2:
            assert got[i] == t.replace("a.b@", own._replaced("email", "a.b@x.org", False).split("@")[0] + "@").replace("A.B@", own._replaced("email", "A.B@x.org", False).split("@")[0] + "@")
        else:
            assert got[i] == t
    assert got[99] is None


def test_pseudonyms(spark, docs, no_docs):
    text = "card 4539578763621486, again 4539578763621486; not 4539578763621487. IBAN GB82WEST12345698765432 on 2024-02-29, not 2023-02-29; ip 10.0.0.255 not 10.0.0.256; mail a.b1@x.org; +1 (017) 555-7713"
    df = spark.createDataFrame([(1, text), (2, "see 4539578763621486"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in pseudonyms.pseudonymise(df, b"k").collect()}
    one = got[1].text
    cards = re.findall(r"\b\d{16}\b", one)
    assert cards[0] == cards[1] != "4539578763621486" and cards[2] == "4539578763621487"
    assert pseudonyms.luhn(cards[0][:-1]) == int(cards[0][-1]) and cards[0] in got[2].text
    assert "2023-02-29" in one and "2024-02-29" not in one and "10.0.0.256" in one and "@x.org" in one
    assert (got[1].n_card, got[1].n_iban, got[1].n_date, got[1].n_ip, got[1].n_email, got[1].n_phone) == (2, 1, 1, 1, 1, 1)
    assert got[3].text is None
    back = {r.doc_id: r.text for r in pseudonyms.pseudonymise(spark.createDataFrame([(i, r.text) for i, r in got.items()], "doc_id long, text string"), b"k", back=True).collect()}
    assert back[1] == text
    assert pseudonyms.pseudonymise(no_docs, b"k").count() == 0 and pseudonyms.pseudonymise(docs, b"k").count() == docs.count()


def test_chat(spark):
    call = lambda *c: chat.canonical({"tool_calls": [{"id": i, "name": n, "arguments": a} for i, n, a in c]})
    result = lambda i, c: chat.canonical({"tool_call_id": i, "content": c})
    data = [
        (1, 0, "user", "héllo", "x"),
        (1, 1, "assistant", call(("b", "add", {"x": "$a", "y": 1}), ("a", "find", {"q": "z"})), "x"),
        (1, 2, "tool", result("a", "found"), "x"),
        (1, 3, "tool", result("nobody", "?"), "x"),
        (1, 4, "assistant", call(("a", "find", {"q": "again"}), ("c", "find", {}), ("p", "find", {"q": "$r"}), ("r", "find", {"q": "$p"})), "x"),
        (2, 0, "assistant", 'text <tool_call>{"name":"find","id":"a","arguments":{"q":"1"}}</tool_call>', "x"),
        (None, 0, None, None, None),
    ]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string, json string")
    schemas = {"find": {"type": "object", "properties": {"q": {"type": "string"}}, "required": ["q"]}}
    msgs = chat.messages(df, schemas)
    linked = {(r.conv_id, r.turn, r.call_id): r for r in chat.ordered_calls(chat.links(msgs)).collect()}
    assert linked[1, 1, "a"].depth == 0 and linked[1, 1, "b"].depth == 1
    assert linked[1, 1, "a"].position == 1 and linked[1, 1, "b"].position == 2
    assert linked[1, 1, "a"].result == "found" and linked[1, 1, "a"].valid
    assert linked[1, 4, "a"].duplicate and not linked[1, 4, "c"].schema_ok
    assert linked[1, 4, "p"].depth is None and not linked[1, 4, "r"].valid
    out = {(r.conv_id, r.turn): r for r in chat.formatted(df, schemas).collect()}
    assert len(out) == len(data)
    assert (out[1, 1].n_calls, out[1, 1].n_valid, out[1, 1].n_answered) == (2, 2, 1)
    assert out[1, 2].linked and not out[1, 3].linked
    assert out[None, 0].json == '{"content":"","role":"user"}' and out[1, 0].json == '{"content":"héllo","role":"user"}'
    assert chat.formatted(df.limit(0)).count() == 0


def test_chat_survives_odd_texts(spark):
    """Surrogates, deep nesting, constants that aren't JSON, list types, conversations named by texts, nulls."""
    call = lambda a: '{"tool_calls":[{"id":"a","name":"f","arguments":' + a + "}]}"
    data = [
        ("x", 1, "assistant", call('{"q":"\\ud800"}')),
        ("x", 2, "tool", '{"tool_call_id":"a","content":"\\udfff"}'),
        ("y", 1, "assistant", call("[" * 200_000)),
        ("y", 2, "assistant", call("[" * 5000 + "]" * 5000)),
        ("z", 1, "assistant", call('{"q":NaN}')),
        ("w", 1, "assistant", call('{"q":null}')),
        (None, None, None, None),
    ]
    df = spark.createDataFrame(data, "conv_id string, turn int, role string, text string")
    got = {(r.conv_id, r.turn): r for r in chat.formatted(df, {"f": {"properties": {"q": {"type": ["string", "null"]}}}}).collect()}
    assert {k: (r.n_calls, r.n_valid, r.n_answered) for k, r in got.items()} == {("x", 1): (1, 1, 1), ("x", 2): (0, 0, 0), ("y", 1): (0, 0, 0), ("y", 2): (0, 0, 0), ("z", 1): (0, 0, 0), ("w", 1): (1, 1, 0), (None, None): (0, 0, 0)}
    assert "\\ud800" in got["x", 1].json and got[None, None].json == '{"content":"","role":"user"}'
    assert chat.formatted(df.limit(0)).count() == 0


def plain_links(data, schemas):
    """Calls of messages one by one: (conversation, turn, valid, depth)."""
    made, answers = [], {}
    for i, (conv, turn, role, text) in enumerate(data):
        _, calls, ref = chat.parse(role, text)
        if ref is not None:
            answers[conv, ref] = min(answers.get((conv, ref), turn), turn)
        made += [(conv, turn, place, i, c) for place, c in enumerate(calls)]
    first = {}
    for conv, turn, place, _, c in made:
        first[conv, c["id"]] = min(first.get((conv, c["id"]), (turn, place)), (turn, place))
    refs = {(conv, c["id"]): {r for r in chat._references(c["arguments"]) if (conv, r) in first} for conv, turn, place, _, c in made if first[conv, c["id"]] == (turn, place)}

    def depth(key, above=()):
        if key in above:
            return None
        inner = [depth((key[0], r), (*above, key)) for r in refs[key]]
        return None if None in inner else 1 + max(inner, default=-1)

    out = Counter()
    for conv, turn, place, _, c in made:
        alone, d = first[conv, c["id"]] == (turn, place), depth((conv, c["id"]))
        ok = not chat.errors(c["arguments"], schemas.get(c["name"], {})) and alone and d is not None and answers.get((conv, c["id"]), turn + 1) > turn
        out[conv, turn, place, c["id"], ok, d] += 1
    return out


def test_chat_links_by_brute_force(spark):
    rng = np.random.default_rng(11)
    schemas = {"f": {"type": "object", "properties": {"n": {"type": "integer"}}, "required": ["n"]}}
    data = []
    for conv in range(12):
        for turn in range(8):
            if rng.random() < 0.35:
                data.append((conv, turn, "tool", '{"tool_call_id":"c%d","content":"r"}' % rng.integers(6)))
                continue
            calls = [{"id": f"c{rng.integers(6)}", "name": "f" if rng.random() < 0.7 else "g", "arguments": {"n": int(rng.integers(9)) if rng.random() < 0.8 else "x", "of": [f"$c{rng.integers(6)}"] if rng.random() < 0.5 else []}} for _ in range(rng.integers(0, 3))]
            data.append((conv, turn, "assistant", chat.canonical({"tool_calls": calls})))
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").repartition(3)
    got = Counter((r.conv_id, r.turn, r.place, r.call_id, r.valid, r.depth) for r in chat.links(chat.messages(df, schemas)).collect())
    assert got == plain_links(data, schemas)


def test_chat_depth_has_no_limit(spark):
    """A chain of 40 calls, two of which also need an earlier one, and a circle with a call that depends on it."""
    args = {f"c{i}": {"x": f"$c{i - 1}", "y": f"$c{i // 2}" if i % 9 == 0 else 1} for i in range(1, 40)} | {"c0": {}, "p": {"x": "$q"}, "q": {"x": "$p"}, "z": ["$p", "$c3"]}
    data = [(1, t, "assistant", chat.canonical({"tool_calls": [{"id": i, "name": "f", "arguments": a}]})) for t, (i, a) in enumerate(args.items())]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    got = {r.call_id: (r.depth, r.valid) for r in chat.links(chat.messages(df)).collect()}
    assert got == {f"c{i}": (i, True) for i in range(40)} | {i: (None, False) for i in "pqz"}


def test_chat_query(spark, tmp_path):
    """The registered query: calls in order of depth and identifier, arguments against schemas, repeated rows."""
    from loomgraph.llm.queries import op1_chat

    good = {"id": "a", "name": "search_code", "arguments": {"repo_url": "r", "query": "q", "top_k": 3}}
    later = {"id": "A", "name": "analyze_impact", "arguments": {"repo_url": "r", "symbol_name": "$a", "direction": "affected"}}
    wrong = {"id": "b", "name": "view_source", "arguments": {"repo_url": "r", "start_line": "1"}}
    null = {"id": "c", "name": "view_source", "arguments": {"repo_url": "r", "file_path": "f", "start_line": None}}
    circle = {"id": "0", "name": "other", "arguments": {"x": "$0"}}
    text = chat.canonical({"content": "é", "tool_calls": [circle, later, null, wrong, good]})
    data = [(1, 0, "assistant", text), (1, 0, "assistant", text), (2, 0, "user", "hi"), (2, 1, "tool", chat.canonical({"tool_call_id": "a", "content": "x"}))]
    spark.createDataFrame(data, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    sha = lambda m: hashlib.sha256(chat.canonical(m).encode()).hexdigest()
    called = (1, 0, "assistant", sha({"content": "é", "role": "assistant", "tool_calls": [good, wrong, null, later, circle]}), 5, 3, 0)
    others = [(2, 0, "user", sha({"content": "hi", "role": "user"}), 0, 0, 0), (2, 1, "tool", sha({"content": "x", "role": "tool", "tool_call_id": "a"}), 0, 0, 0)]
    assert counted(op1_chat(spark, str(tmp_path))) == Counter([called, called, *others])


# --- pipeline ----------------------------------------------------------------------


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = np.random.default_rng(8)
    data = []
    for i in range(160):
        w = list(rng.choice([f"v{k}" for k in range(400)], 60))
        if i % 4 == 0:
            w[7] = w[30] = "scumbag"
        data.append((i, " ".join(w), "en", f"s{i % 3}", 1))
    item = " ".join(f"q{k}" for k in range(20))
    data += [(200, data[1][1], "en", "s0", 1), (201, item + " " + data[2][1], "en", "s0", 1), (202, None, None, None, None)]
    cols = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(data, cols).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(160)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == [c.split()[0] for c in cols.split(", ")]
        seen.append({r.doc_id for r in docs.collect()})
    clean = {i for i, *_ in data if i >= 160 or i % 4}
    assert seen[0] == clean and seen[1] == clean - {200} and seen[2] == clean - {200, 201}
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    mixed = corpus_pipeline.STAGES[3][1](spark, docs, str(tmp_path))
    assert len(got) == mixed.count() and {r.doc_id for r in got} <= seen[2]
    starts = sorted((r.start, r.n_tokens) for r in got)
    assert starts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:], strict=False))
    assert isinstance(mixing.targets({"a": 1})["a"], Fraction)
