"""Toxicity by fuzzy lexicon hits and their context.

The lexicon is learned: stems (word beginnings, or whole words) that occur far
more often in documents labelled toxic than their share explains; strong ones
hardly occur elsewhere, the others are weak.  Terms are whole words that make
up most of what a strong stem was seen in.  Both are held as tries.  A word is
a hit if a stem is its beginning, or if the Levenshtein automaton of the word,
run down the trie of terms, accepts one of five letters or more within one edit
(two from eight letters; a swap of neighbours is one edit): a misspelled hit.
Each hit is weighed by its context window: inside quotation marks, or with a
reporting word among the three words before it, it is quoted, otherwise used.  A logistic model over the capped
counts of the six kinds of hits gives the score; the lexicon decides which
words count, the labels what each kind is worth.

Labels are fitted on at most ``max_rows`` labelled documents (a seeded choice,
half of them at most toxic), never on held-out ones.  Scoring reads every word
of every text.

Nulls and empty texts have no hits and get the score of a document without
any.  Documents that repeat are scored alike.  A label that repeats counts
once, the largest; null labels are left out.  Without labels of both kinds
every score is 0.  Extra columns are ignored.
"""

from __future__ import annotations

import bisect
import re
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernel import U64, Slice, byte_codes, freed, mix, powers, rows, text_slices
from .storage import discard, keep_batches_small, materialize

MAX_ROWS = 20_000
SEED = 5
#: A stem must occur in this share of the toxic documents, and this many standard deviations over chance plus the log of the sample.
MIN_SHARE, MIN_Z = 0.01, 4.0
PREFIXES = range(4, 9)
#: Opening and closing quotation marks, and words that report another's speech.
QUOTES = ('"', "“", "”", "„", "«", "»")
#: Marks outside ASCII that may stand at the ends of what counts as a word.
EDGES = "“”„«»‘’‚…–—¿¡"
_MARKS = re.compile("|".join([*QUOTES, "\n"]).encode())
REPORTING = frozenset(b"said says wrote called quoted quote word term sagte schrieb dit dijo".split())
CONTEXT_BYTES = 60
#: Strong, weak and misspelled hits, each used and quoted.
KINDS = 6
#: More hits of a kind than these add nothing: one strong or misspelled one says it, weak ones add up.
CAPS = (1, 1, 4, 4, 1, 1)
NAMES = tuple(f"{k}_{c}" for k in ("strong", "weak", "misspelled") for c in ("used", "quoted"))


def edits_allowed(stem: str) -> int:
    return 0 if len(stem) < 5 else 1 if len(stem) < 8 else 2


class Trie:
    def __init__(self, stems: list[str]):
        """A stem that ends in a space stands for a whole word."""
        self.root: dict = {}
        for s in stems:
            node = self.root
            for c in s:
                node = node.setdefault(c, {})
            node[""] = s

    def exact(self, word: str) -> list[str]:
        """The stems that begin the word."""
        node, found = self.root, []
        for c in word + " ":
            node = node.get(c)
            if node is None:
                break
            if "" in node:
                found.append(node[""])
        return found

    def fuzzy(self, word: str, tail: int = 1) -> str | None:
        """A term within its edits of the word, or of the word less up to ``tail`` last letters.

        The automaton's state is the row of edit distances; branches whose row
        has no value within two are not entered.
        """
        n = len(word)
        found: list[tuple[int, str]] = []

        def walk(node: dict, row: list[int], above: list[int] | None, last: str, depth: int) -> None:
            for c, child in node.items():
                if c == "":
                    if (k := edits_allowed(child)) and (d := min(row[max(0, n - tail) :])) <= k:
                        found.append((d, child))
                    continue
                new = [depth + 1]
                for j in range(1, n + 1):
                    d = min(new[-1] + 1, row[j] + 1, row[j - 1] + (word[j - 1] != c))
                    if above and j > 1 and c == word[j - 2] and last == word[j - 1]:
                        d = min(d, above[j - 2] + 1)
                    new.append(d)
                if min(new) <= 2:
                    walk(child, new, row, c, depth + 1)

        walk(self.root, list(range(n + 1)), None, "", 0)
        return min(found)[1] if found else None


@dataclass
class Model:
    #: Stem to 1 (strong) or 2 (weak).
    stems: dict[str, int]
    terms: list[str]
    #: Bias, then a weight for each kind of hit.
    weights: list[float] = field(default_factory=lambda: [-50.0] + [0.0] * KINDS)

    def score(self, counts: np.ndarray) -> np.ndarray:
        z = self.weights[0] + np.minimum(counts, CAPS) @ np.array(self.weights[1:])
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def _letters(data: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of words in lower case, the set of letters as bits (a letter is its code point mod 64), and how many letters they have."""
    raw = data.tobytes()
    joined = b" ".join([raw[x:y] for x, y in zip(a.tolist(), b.tolist(), strict=True)])
    points = np.frombuffer(joined.decode("utf-8", "replace").lower().encode("utf-32-le"), "<u4")
    gaps = np.flatnonzero(points == 32)
    first, end = np.concatenate([[0], gaps + 1]), np.append(gaps, len(points))
    bits = U64(1) << (points.astype(U64) & U64(63))
    bits[gaps] = 0
    return np.bitwise_or.reduceat(bits, first), end - first


class Scanner:
    """Finds hits in slices; remembers what each distinct word is."""

    MAX_KNOWN = 1_500_000

    def __init__(self, stems: dict[str, int], terms: list[str]):
        self.stems, self.trie, self.terms = stems, Trie(list(stems)), Trie(terms)
        by_length: dict[int, list[bytes]] = defaultdict(list)
        for s in stems:
            raw = s.rstrip().encode()
            by_length[len(raw)].append(raw)
        self.prefixes = {n: np.sort(self._hash(v, n)) for n, v in by_length.items()}
        #: Of each term with edits: its letters as bits, their number, its edits.
        self.loose = [(sum({1 << (ord(x) & 63) for x in t}), len(t), k) for t in terms if (k := edits_allowed(t))]
        self.known, self.kind = np.zeros(0, U64), np.zeros(0, np.int8)

    @staticmethod
    def _hash(words: list[bytes], n: int) -> np.ndarray:
        block = np.frombuffer(b"".join(words), np.uint8).reshape(-1, n)
        return mix((byte_codes(True)[block] * powers(n)[0][:n]).sum(axis=1, dtype=U64))

    def _classify(self, s: Slice, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
        """0: no hit, 1: strong, 2: weak, 3: misspelled."""
        kind = np.zeros(len(a), np.int8)
        inverse = powers(len(s.data))[1]
        maybe = np.zeros(len(a), bool)
        for n, hashes in self.prefixes.items():
            i = np.flatnonzero(b - a >= n)
            h = mix((c[a[i] + n] - c[a[i]]) * inverse[a[i]])
            at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            maybe[i[hashes[at] == h]] = True
        # Lower case of other letters than ASCII is for the trie.
        high = np.concatenate([[0], np.cumsum(s.data >= 128)])
        maybe |= high[b] > high[a]
        near = np.zeros(len(a), bool)
        if len(a) and self.loose:
            bits, n = _letters(s.data, a, b)
            for term, size, k in self.loose:
                # An edit takes away one letter of the term at most, and brings one other; a tail letter brings one.
                i = np.flatnonzero((n >= size - k) & (n <= size + k + 1))
                lost, new = np.bitwise_count(U64(term) & ~bits[i]), np.bitwise_count(bits[i] & ~U64(term))
                near[i[(lost <= k) & (new <= k + 1)]] = True
        for i in np.flatnonzero(maybe | near).tolist():
            word = s.data[a[i] : b[i]].tobytes().decode("utf-8", "replace").lower().strip(EDGES)
            stems = self.trie.exact(word) if maybe[i] else []
            kind[i] = min(self.stems[x] for x in stems) if stems else 3 if near[i] and self.terms.fuzzy(word) else 0
        return kind

    def counts(self, s: Slice) -> np.ndarray:
        """Of each document of the slice, hits of each kind."""
        out = np.zeros((s.n_docs, KINDS), np.int64)
        a, b, wo = s.words("alnum")
        long = b - a >= 3
        docs = np.repeat(np.arange(s.n_docs), np.diff(wo))[long]
        a, b = a[long], b[long]
        if not len(a):
            return out
        c = s.prefix_sums(True)
        h = mix((c[b] - c[a]) * powers(len(s.data))[1][a])
        u, first, back = np.unique(h, return_index=True, return_inverse=True)
        kind = np.zeros(len(u), np.int8)
        at = np.minimum(np.searchsorted(self.known, u), max(len(self.known) - 1, 0))
        old = self.known[at] == u if len(self.known) else np.zeros(len(u), bool)
        kind[old] = self.kind[at[old]]
        new = np.flatnonzero(~old)
        kind[new] = self._classify(s, a[first[new]], b[first[new]], c)
        if len(self.known) > self.MAX_KNOWN:
            self.known, self.kind = np.zeros(0, U64), np.zeros(0, np.int8)
        at = np.searchsorted(self.known, u[new])
        self.known, self.kind = np.insert(self.known, at, u[new]), np.insert(self.kind, at, kind[new])
        each = kind[back]
        d, inside = -1, None
        for i in np.flatnonzero(each).tolist():
            if docs[i] != d:
                d = int(docs[i])
                lo, text = int(s.offs[d]), s.data[s.offs[d] : s.offs[d + 1]].tobytes()
                inside = quotations(text)
            quoted = self._quoted(text, int(a[i]) - lo, int(b[i]) - lo, inside)
            out[d, 2 * (int(each[i]) - 1) + quoted] += 1
        return out

    @staticmethod
    def _quoted(text: bytes, a: int, b: int, inside: list[tuple[int, int]]) -> bool:
        """Whether the middle of the word a..b is in a quotation (its ends may be marks), or a reporting word stands before it."""
        at = (a + b) // 2
        k = bisect.bisect(inside, (at + 1,)) - 1
        if k >= 0 and at < inside[k][1]:
            return True
        return bool(REPORTING & set(text[max(0, a - CONTEXT_BYTES) : a].lower().split()[-3:]))


def quotations(text: bytes) -> list[tuple[int, int]]:
    """Where the quotations of a text begin and end, however long, apart and ascending.

    Within a line, a mark opens a quotation if none is open, and the next mark
    closes it; so it doesn't matter which way round a language has its marks.
    A mark that nothing closes in its line quotes nothing.
    """
    out, opened = [], None
    for m in _MARKS.finditer(text):
        if m[0] == b"\n":
            opened = None
        elif opened is None:
            opened = m.end()
        else:
            out.append((opened, m.start()))
            opened = None
    return out


def _stem_counts(batches):
    """(stem, documents labelled toxic, other documents) of each slice."""
    for batch in batches:
        toxic, column = rows(batch, ["toxic", "text"])
        labels = toxic.to_numpy(zero_copy_only=False)
        for s in text_slices(column):
            a, b, wo = s.words("alnum")
            raw = s.data.tobytes()
            found: dict[str, list[int]] = defaultdict(lambda: [0, 0])
            for d in range(s.n_docs):
                lo, hi = wo[d], wo[d + 1]
                words = {raw[x:y] for x, y in zip(a[lo:hi].tolist(), b[lo:hi].tolist(), strict=True) if y - x >= 3}
                stems = set()
                for w in {w.decode("utf-8", "replace").lower() for w in words}:
                    stems.add(w + " ")
                    stems.update(w[:n] for n in PREFIXES if len(w) >= n)
                k = 0 if labels[s.lo + d] else 1
                for x in stems:
                    found[x][k] += 1
            yield pa.RecordBatch.from_pydict({"stem": list(found), "t": [v[0] for v in found.values()], "c": [v[1] for v in found.values()]}, schema=pa.schema([("stem", pa.string()), ("t", pa.int64()), ("c", pa.int64())]))


def _lexicon(counted: list[tuple[str, int, int]], n_toxic: int, n_clean: int) -> tuple[dict[str, int], list[str]]:
    """Stems whose share of toxic documents is far over chance, without those whose beginning is one as strong; and terms."""
    base = n_toxic / (n_toxic + n_clean)
    stems: dict[str, int] = {}
    terms: list[str] = []
    seen = {stem: t for stem, t, _ in counted}
    for stem, t, c in sorted(counted, key=lambda x: (len(x[0]), x[0])):
        z = (t - (t + c) * base) / np.sqrt((t + c) * base * (1 - base))
        if z < MIN_Z + np.log10(n_toxic + n_clean) or t < max(4, MIN_SHARE * n_toxic):
            continue
        kind = 1 if t * n_clean >= 100 * c * n_toxic or c == 0 else 2
        begins = [stem[:n] for n in range(1, len(stem)) if stem[:n] in stems]
        if stem[-1] == " " and kind == 1 and edits_allowed(stem.rstrip()) and 2 * t > seen.get(stem[: PREFIXES[0]], 2 * t):
            terms.append(stem.rstrip())
        if not any(stems[x] <= kind for x in begins):
            stems[stem] = kind
    return stems, terms


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> list[float]:
    x = np.hstack([np.ones((len(x), 1)), np.minimum(x, CAPS)])
    w, r = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    r[0, 0] = 1e-3
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + r, x.T @ (y - p) - r @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist()


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Held-out rows, crc32(doc_id as text) mod 5 = 0, are never read. At most ``max_rows`` labelled documents are."""
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & ~held_out(F.col(doc_id))).groupBy(F.col(doc_id).alias("__id")).agg(F.max(label).cast("int").alias("toxic"))
    order = F.xxhash64(F.lit(SEED), F.col("__id"))
    some = known.where("toxic = 1").orderBy(order, "__id").limit(max_rows // 2).unionByName(known.where("toxic = 0").orderBy(order, "__id").limit(max_rows // 2))
    sample = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("text")).join(F.broadcast(some), "__id")
    # Of copies, most agree on the smallest hash of three words; one is kept, or a group of copies would make its words stems.
    triples = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - 1), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    least = F.array_min(F.transform(F.array(F.split(F.col("text"), " ")), triples)[0])
    sample = sample.groupBy("toxic", least.alias("least")).agg(F.min_by("text", "__id").alias("text")).select("toxic", "text")
    sample, path = materialize(sample, "toxicity-sample")
    by = dict(sample.groupBy("toxic").count().collect())
    n_toxic, n_clean = by.get(1, 0), by.get(0, 0)
    if not n_toxic or not n_clean:
        return Model({}, [])
    stems = sample.mapInArrow(freed(_stem_counts), "stem string, t long, c long").groupBy("stem").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    # Stems in this share of the sample's toxic documents: a hundred times what such a document holds, at most.
    often = (F.col("t") >= max(4, MIN_SHARE * n_toxic)) & (F.col("t") * n_clean >= 5 * F.col("c") * n_toxic)
    counted = [tuple(r) for r in stems.where(often).collect()]
    model = Model(*_lexicon(counted, n_toxic, n_clean))

    def features(batches, stems=model.stems, terms=model.terms):
        scanner = Scanner(stems, terms)
        for batch in batches:
            toxic, column = rows(batch, ["toxic", "text"])
            for s in text_slices(column):
                got = scanner.counts(s)
                yield pa.RecordBatch.from_arrays([toxic.slice(s.lo, s.n_docs).cast(pa.int64()), *[pa.array(got[:, k]) for k in range(KINDS)]], names=["y", *(f"k{k}" for k in range(KINDS))])

    kinds = [f"k{k}" for k in range(KINDS)]
    seen = sample.mapInArrow(freed(features), "y long, " + ", ".join(f"{k} long" for k in kinds))
    seen = seen.select("y", *[F.least(k, F.lit(c)).alias(k) for k, c in zip(kinds, CAPS, strict=True)]).groupBy("y", *kinds).count().collect()
    discard(docs.sparkSession, path)
    x = np.repeat(np.array([[r[k] for k in kinds] for r in seen], float), [r["count"] for r in seen], axis=0)
    y = np.repeat(np.array([r["y"] for r in seen], float), [r["count"] for r in seen])
    model.weights = _logistic(x, y)
    return model


def held_out(doc_id: Column) -> Column:
    """A row without an id has no remainder: it isn't held out, and ``fit`` doesn't read it either."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", keep: bool = False) -> DataFrame:
    """doc_id, score, predicted and the hits of each kind; with ``keep``, the document's columns instead of doc_id."""
    cast = docs.sparkSession.sparkContext.broadcast(model)
    keep_batches_small(docs.sparkSession)
    place = docs.columns.index(text) if keep else None
    body = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")) if keep else docs.select(F.col(doc_id).alias("row"), F.col(text).alias("text"))
    kind = body.schema["row"].dataType.simpleString()

    def scan(batches):
        model = cast.value
        scanner = Scanner(model.stems, model.terms)
        for batch in batches:
            row = batch.column(0)
            column = batch.column(1) if place is None else row.field(place)
            for s in text_slices(column):
                got = scanner.counts(s)
                p = model.score(got)
                yield pa.RecordBatch.from_arrays([row.slice(s.lo, s.n_docs), pa.array(p), *[pa.array(got[:, k]) for k in range(KINDS)]], names=["row", "score", *(f"k{k}" for k in range(KINDS))])

    out = body.mapInArrow(freed(scan), f"row {kind}, score double, " + ", ".join(f"k{k} long" for k in range(KINDS)))
    out = out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
    hits = [F.col(f"k{k}").alias(name) for k, name in enumerate(NAMES)]
    return out.select("row", "predicted") if keep else out.select(F.col("row").alias("doc_id"), "score", "predicted", *hits)
