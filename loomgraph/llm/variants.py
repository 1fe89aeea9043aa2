"""Spelling variants by pairless wildcard groups.

Two words are near if one replaced, inserted or deleted letter makes one of the
other.  No pair is ever made:

* Words that are equal but for the letter at one place are the group of
  (place, prefix, suffix).  Of a group only its size and its two best words
  matter: each member has size - 1 near words there, the best of them being the
  first, or the second for the first itself.
* A word without one letter is a key too, and so is each whole word.  A group
  of a key is the word of that key, if there is one, and the words that become
  it: these have the word near them, and the word has all of these.

A word is in one group for each place and in one for each distinct deletion, so
groups together tell each near word of each word once.  All groups are one
shuffle: a window over (key, best first) reads the first two rows and the size,
and spills if it must.  Words that share no near word meet nowhere.

Words are known by their number in code-point order, which also breaks ties;
keys are polynomials of code points modulo the prime 2^61 - 1, for two bases,
and take time in proportion to a word's length, so no prefix is ever copied.

A word's form is its best near word if that is ``TIMES`` as frequent; forms
rise in frequency, so chains are shorter than log_5 of the largest count, and
roots are found by doubling.

A null or empty text has no words.  A null doc_id leaves its words as they are
(there is nothing to compute the noise from).  Repeated rows count again.
Extra columns are ignored; an empty table gives no rows.  Very long texts are
scanned match by match; words of any length are whole.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .kernel import freed, text_slices
from .storage import discard, materialize

LETTERS = re.compile("[A-Za-zÀ-ÿ]+")
LEAST_LENGTH, LEAST_COUNT, TIMES, NOISE = 6, 5, 5, 199
PRIME = (1 << 61) - 1
BASES = (0x1F3D5B79A8C6E4D, 0x0B8E2C47D915F63)
#: Distinct words held before they are handed on, and keys made at a time.
HELD, KEYS = 1 << 17, 1 << 16
#: Texts of more bytes are scanned match by match.
LONG = 1 << 20
WILD, OWN, CUT = 0, 1, 2


def text_words(raw: bytes, seed: int | None, noise: int = NOISE, least: int = LEAST_LENGTH) -> Iterator[tuple[str, int]]:
    """Words of a text and how often it has them; ``seed`` is the CRC-32 of what stands before a word in the noise's key."""
    text = raw.lower().decode("utf-8", "replace")  # bytes.lower() knows A-Z only
    found = Counter(LETTERS.findall(text) if len(raw) <= LONG else (m[0] for m in LETTERS.finditer(text)))
    for word, n in found.items():
        if len(word) < least:
            continue
        if seed is not None:
            h = zlib.crc32(word.encode(), seed)
            if h % noise == 0:
                at = h % len(word)
                word = word[:at] + word[at + 1 :]
                if len(word) < least:
                    continue
        yield word, n


def counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", noise: int = NOISE, least: int = LEAST_LENGTH) -> DataFrame:
    """Rows word, n over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        table = lambda: pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
        for batch in batches:
            keys = batch.column(0)
            for s in text_slices(batch.column(1)):
                for i in range(s.n_docs):
                    key = keys[s.lo + i].as_py()
                    seed = None if key is None else zlib.crc32(f"{key}:".encode())
                    for word, n in text_words(s.data[s.offs[i] : s.offs[i + 1]].tobytes(), seed, noise, least):
                        held[word] += n
                    if len(held) > HELD:
                        yield table()
                        held.clear()
        yield table()

    found = docs.select(F.col(f"`{doc_id}`").cast("string").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(freed(run), "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n"))


def word_keys(word: str, least: int) -> Iterator[tuple[int, int, int]]:
    """The keys (for two bases) and kinds of a word's groups."""
    codes = [ord(c) + 2 for c in word]
    n = len(codes)
    # The code 1 is the wildcard; no letter has it.
    made = []
    for base in BASES:
        power, whole = [1] * n, 0
        for i in range(1, n):
            power[i] = power[i - 1] * base % PRIME
        before = [0] * (n + 1)
        for i, c in enumerate(codes):
            whole = (whole * base + c) % PRIME
            before[i + 1] = whole
        made.append((power, before, whole))
    (p, f, w), (q, g, v) = made
    yield w, v, OWN
    for i, c in enumerate(codes):
        up, uq = p[n - 1 - i], q[n - 1 - i]
        yield (w + (1 - c) * up) % PRIME, (v + (1 - c) * uq) % PRIME, WILD
        if n > least and (not i or c != codes[i - 1]):
            yield (w + (f[i] - f[i + 1]) * up) % PRIME, (v + (g[i] - g[i + 1]) * uq) % PRIME, CUT


def keys(words: DataFrame, least: int = LEAST_LENGTH) -> DataFrame:
    """Rows k1, k2, kind, id, n for each group of each word (id, word, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ns = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            rows: list = []
            at: list = []
            for i, word in enumerate(batch.column(1)):
                for row in word_keys(word.as_py(), least):
                    rows.append(row)
                    at.append(i)
                    if len(rows) >= KEYS:
                        yield _table(rows, ids[at], ns[at])
                        rows, at = [], []
            if rows:
                yield _table(rows, ids[at], ns[at])

    return words.select("id", "word", "n").mapInArrow(freed(run), "k1 long, k2 long, kind int, id long, n long")


def _table(rows: list[tuple[int, int, int]], ids: np.ndarray, ns: np.ndarray) -> pa.RecordBatch:
    x = np.array(rows, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1]), pa.array(x[:, 2].astype(np.int32)), pa.array(ids), pa.array(ns)], names=["k1", "k2", "kind", "id", "n"])


def near(words: DataFrame, least: int = LEAST_LENGTH) -> DataFrame:
    """Rows id, n_near and best (less: minus its count, id) of each word that has near words."""
    own = Window.partitionBy("k1", "k2")
    best = own.orderBy("kind", F.desc("n"), "id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    this = F.struct("kind", "id", "n")
    turn = F.row_number().over(own.orderBy("kind", F.desc("n"), "id"))
    met = keys(words, least).select("kind", "id", F.count("*").over(own).alias("size"), F.first(this).over(best).alias("first"), F.nth_value(this, 2).over(best).alias("second"), turn.alias("turn")).where("size > 1")
    # A group of deletions whose word doesn't exist says nothing.
    met = met.where(f"kind < {CUT} or first.kind = {OWN}")
    number = F.when(F.col("kind") == CUT, 1).otherwise(F.col("size") - 1)
    other = F.when(F.col("turn") == 1, F.col("second")).otherwise(F.col("first"))
    return met.select("id", number.alias("number"), F.struct((-other.n).alias("less"), other.id.alias("id")).alias("best")).groupBy("id").agg(F.sum("number").cast("long").alias("n_near"), F.min("best").alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """Rows id, form_id, root_id: from each word with a form, the last that forms lead to."""
    now, path = materialize(forms.withColumn("root_id", F.col("form_id")), "variants-roots")
    while True:
        on = now.select(F.col("id").alias("root_id"), F.col("root_id").alias("further"))
        step, at_step = materialize(now.join(on, "root_id", "left").select("id", "form_id", F.coalesce("further", "root_id").alias("root_id"), F.col("further").isNotNull().alias("moved")), "variants-roots")
        discard(forms.sparkSession, path)
        now, path = step.drop("moved"), at_step
        if step.where("moved").isEmpty():
            return now


def grouped(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", noise: int = NOISE, least: int = LEAST_LENGTH, often: int = LEAST_COUNT, times: int = TIMES) -> DataFrame:
    """Rows word, form, root, n, n_near, form_n for each word of ``least`` letters and ``often`` occurrences."""
    known = counts(docs, doc_id, text, noise, least).where(F.col("n") >= often)
    # Range-sorted, so numbers rise with the words.
    words, at_words = materialize(known.orderBy("word").withColumn("id", F.monotonically_increasing_id()), "variants-words")
    best = F.when(-F.col("best.less") >= times * F.col("n"), F.col("best"))
    judged = words.join(near(words, least), "id", "left").select("id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), best.id.alias("form_id"), (-best.less).alias("form_n"))
    judged, _ = materialize(judged, "variants-judged")
    roots = _roots(judged.where("form_id is not null").select("id", "form_id"))
    name = lambda key, alias: judged.select(F.col("id").alias(key), F.col("word").alias(alias))
    named = roots.join(name("form_id", "form"), "form_id").join(name("root_id", "root"), "root_id").select("id", "form", "root")
    discard(docs.sparkSession, at_words)
    return judged.join(named, "id", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
