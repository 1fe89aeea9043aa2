"""Near duplicates by SimHash, found with covering locality-sensitive hashing.

A document's fingerprint has a bit for each bit of XXH64 (seed 42) of its
lower-cased three-word shingles, set if over half of them have it.

Each of the 64 places is given a vector of three bits that isn't zero; the mask
of a vector v keeps the places whose vector has an odd product with v.  For any
two places some v is orthogonal to both, so any two fingerprints that differ in
at most two places agree under at least one of the seven masks: every pair
within the radius collides in some table, and one that collides in none has no
partner.

* Equal fingerprints are one class from the start, so copies meet nowhere.
* A bucket of up to ``SMALL`` classes is compared in one task and leaves a tree.
* In a larger bucket each member names itself and what it becomes by one
  changed place that the mask leaves out.  Members that name the same are
  within two places of each other, and any two within two places name one in
  common; so groups of at most 65 take the place of pairs, however large the
  bucket is.

A null or empty text, or one without words, has the fingerprint zero and is
linked like any other; with one or two words, the words are the only shingle.
A null doc_id links, but is never the smallest; a component without any id has
a null one.  Repeated rows are members of one class, each with a row of its
own.  Extra columns are ignored; an empty table gives no rows.  Long texts are
hashed in blocks of ``BLOCK`` words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .jaccard import connected
from .kernel import U64, freed, text_slices
from .storage import discard, materialize

WORDS, SEED, RADIUS, BITS = 3, 42, 2, 64
#: Words that are hashed at a time.
BLOCK = 1 << 15
#: Members of a bucket that one task compares; results don't change with it.
SMALL = 256
#: Tasks over which the rows of one fingerprint or bucket are dealt.
SALTS = 8


def masks() -> list[int]:
    """One mask for each non-zero vector of RADIUS + 1 bits."""
    size = 1 << (RADIUS + 1)
    own = [1 + b % (size - 1) for b in range(BITS)]
    return [sum(1 << b for b in range(BITS) if (own[b] & v).bit_count() % 2) for v in range(1, size)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> int:
    """Of a text's lower-cased bytes and the places of its words."""
    from xxhash import xxh64_intdigest

    n = len(starts)
    if not n:
        return 0
    k = min(WORDS, n)
    counts = np.zeros(BITS, np.int64)
    for i in range(0, n - k + 1, BLOCK):
        j = min(i + BLOCK, n - k + 1) + k - 1
        joined = b" ".join(raw[starts[i] : ends[j - 1]].split())
        size = ends[i:j] - starts[i:j]
        after = np.cumsum(size + 1)
        hashes = [xxh64_intdigest(joined[a:b], SEED) for a, b in zip((after - size - 1)[: len(size) - k + 1].tolist(), (after - 1)[k - 1 :].tolist(), strict=True)]
        h = np.array(hashes, U64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n - k + 1, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows doc_id, fp (the fingerprint as a signed long), one a row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in text_slices(batch.column(1)):
                starts, ends, first = s.words("space")
                raw = s.data.tobytes().lower()
                fps = [fingerprint(raw, starts[a:b], ends[a:b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s.lo, s.n_docs), pa.array(np.array(fps, U64).view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(freed(run), "doc_id long, fp long")


def _tree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, b) that connect what links in each list of fingerprints."""
    for batch in batches:
        lists = batch.column(0)
        flat, at = lists.flatten().to_numpy().view(U64), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
        size = np.diff(at)
        two = at[:-1][size == 2]
        x, y = flat[two], flat[two + 1]
        near = np.bitwise_count(x ^ y) <= RADIUS
        a, b = [x[near]], [y[near]]
        for i, n in zip(at[:-1][size > 2].tolist(), size[size > 2].tolist(), strict=True):
            own = flat[i : i + n]
            linked = np.bitwise_count(own[:, None] ^ own[None, :]) <= RADIUS
            low = np.arange(n)
            while True:
                less = np.where(linked, low[None, :], n).min(axis=1)
                if (less == low).all():
                    break
                low = less
            moved = low != np.arange(n)
            a.append(own[moved])
            b.append(own[low[moved]])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v).view(np.int64)) for v in (a, b)], names=["a", "b"])


def _salted(rows: DataFrame, few: DataFrame, keys: list[str], by: Column, how: str = "inner") -> DataFrame:
    """``rows`` joined with the one row of their keys in ``few``; the rows of a key are dealt over tasks."""
    few = few.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("__salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).join(few, [*keys, "__salt"], how).drop("__salt")


def links(classes: DataFrame, small: int = SMALL) -> DataFrame:
    """Rows a, b that connect all distinct fingerprints (fp) that differ in at most two places."""
    tables = [(i, _signed(m), [_signed(1 << b) for b in range(BITS) if not m >> b & 1]) for i, m in enumerate(masks())]
    kept = F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for i, m, _ in tables])
    keyed = classes.select("fp", F.explode(kept).alias("x")).select("fp", "x.*")
    sizes, at_sizes = materialize(keyed.groupBy("t", "k").agg(F.count("*").alias("m")).where("m > 1"), "simhash-sizes")
    met, at_met = materialize(_salted(keyed, sizes, ["t", "k"], F.col("fp")), "simhash-met")
    lists = met.where(F.col("m") <= small).groupBy("t", "k").agg(F.collect_list("fp").alias("fps"))
    near = lists.select("fps").mapInArrow(freed(_tree), "a long, b long")
    free = F.element_at(F.array(*[F.array(F.lit(0), *map(F.lit, bits)).cast("array<long>") for _, _, bits in tables]), F.col("t") + 1)
    named = met.where(F.col("m") > small).select("fp", F.explode(F.transform(free, lambda bit: F.col("fp").bitwiseXOR(bit))).alias("z")).distinct()
    far = named.select(F.col("fp").alias("a"), F.min("fp").over(Window.partitionBy("z")).alias("b")).where("a != b")
    out, _ = materialize(near.unionByName(far).distinct(), "simhash-links")
    discard(classes.sparkSession, at_sizes, at_met)
    return out


def components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", small: int = SMALL) -> DataFrame:
    """Rows doc_id, fingerprint (16 hex digits), component_id for each document."""
    rows, _ = materialize(fingerprints(docs, doc_id, text), "simhash-rows")
    classes, at_classes = materialize(rows.groupBy("fp").agg(F.count("*").alias("n"), F.min("doc_id").alias("least")), "simhash-classes")
    roots = connected(links(classes, small))
    nodes = roots.select(F.col("a").alias("fp"), "root").unionByName(roots.select(F.col("root").alias("fp"), "root")).distinct()
    linked = classes.join(nodes, "fp")
    low = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    of_linked = _salted(linked.select("fp", "root"), low, ["root"], F.col("fp")).select("fp", "component_id")
    of_copies = classes.where("n > 1").join(nodes, "fp", "left_anti").select("fp", F.col("least").alias("component_id"))
    known, _ = materialize(of_linked.unionByName(of_copies), "simhash-components")
    discard(docs.sparkSession, at_classes)
    out = _salted(rows, known, ["fp"], F.col("doc_id"), "left")
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return out.select("doc_id", hexed.alias("fingerprint"), F.coalesce("component_id", "doc_id").alias("component_id"))
