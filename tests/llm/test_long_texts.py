"""Long texts take linear time; rows without ids, odd names and built words give right rows."""

import hashlib
import json
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest

from loomgraph.llm import chat, decontaminate, jaccard, mixing, pseudonyms, toxicity
from loomgraph.llm.kernel import BLOCK, text_slices

SIZE = 2_000_000


def timed(work, seconds=5.0):
    start = time.monotonic()
    out = work()
    assert time.monotonic() - start < seconds
    return out


def morse(n, a="a", b="b"):
    """The first n letters of the Thue-Morse word over a and b."""
    return "".join(b if bin(i).count("1") % 2 else a for i in range(n))


def hashes(*texts):
    s = next(text_slices(pa.array(texts)))
    a, b, _ = s.words("space")
    return s.word_hashes(a, b, True).tolist()


# --- words and links -----------------------------------------------------------


@pytest.mark.parametrize("n", [1024, 4096, 65536])
def test_built_words_differ(n):
    one, two = morse(n), morse(n, "b", "a")
    assert len(set(hashes(one, two))) == 2


def test_long_words_are_known_again():
    """A word's hash doesn't depend on its place, on the case of A-Z, or on its neighbours."""
    for n in (1, BLOCK - 1, BLOCK, BLOCK + 1, 3 * BLOCK, 3 * BLOCK + 5):
        w = "".join(random.Random(n).choices("abcxyz", k=n))
        assert len(set(hashes(w, "before " + w.upper(), w + " after")) & set(hashes(w))) == 1
        other = w[:-1] + ("a" if w[-1] != "a" else "b")
        assert hashes(w) != hashes(other)
    block = "q" * BLOCK
    assert len(set(hashes(*(block * k for k in range(1, 6))))) == 5
    one, two = "a" * BLOCK, "b" * BLOCK
    assert hashes(one + two) != hashes(two + one)


def test_built_words_are_not_linked(spark):
    df = spark.createDataFrame([(1, morse(2048)), (2, morse(2048, "b", "a")), (3, morse(2048).upper())], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard.components(df).collect()} == {1: 1, 2: 2, 3: 1}


def test_links_without_ids(spark):
    """Rows without an id, each with its own text, and one row very often: no join by id multiplies them."""
    own = [(None, " ".join(f"u{i}x{j}" for j in range(8))) for i in range(4000)]
    near = [(7, " ".join(f"n{j}" for j in range(40))), (None, " ".join(f"n{j}" for j in range(39)) + " last")]
    df = spark.createDataFrame(own + near + [(None, "one row very often repeated here")] * 3000, "doc_id long, text string").repartition(4)
    got = timed(lambda: jaccard.components(df).collect(), 120)
    assert len(got) == 7002
    assert sorted((r.doc_id is None, r.n_shingles) for r in got if r.component_id == 7) == [(False, 36), (True, 36)]
    assert sum(r.component_id is None for r in got) == 7000
    kept = jaccard.kept_one(df).collect()
    assert len(kept) == 4002 and sum("repeated" in r.text for r in kept) == 1


def test_links_below_half_are_refused(spark, no_docs):
    with pytest.raises(ValueError, match="percent"):
        jaccard.components(no_docs, percent=49)


# --- chat ----------------------------------------------------------------------


def test_tags_are_found_in_one_pass():
    tag = "<tool_call>"
    assert timed(lambda: chat.parse("assistant", tag * (SIZE // len(tag)))) == (tag * (SIZE // len(tag)), [], None)
    many = '<tool_call>{"id":"a","name":"f"}</tool_call>' * 20_000
    assert len(timed(lambda: chat.parse("assistant", "x" + many + "y" + tag))[1]) == 20_000
    plain = re.compile(r"<tool_call>(.*?)</tool_call>", re.DOTALL)
    rng = random.Random(5)
    for _ in range(2000):
        text = "".join(rng.choices([tag, "</tool_call>", "a", "\n", "<"], k=rng.randint(0, 9)))
        assert chat._tagged(text) == (plain.findall(text), plain.sub("", text))


def test_open_strings_are_read_once():
    text = "{" + "[" * 300 + '"' + '\\"' * (SIZE // 2)
    assert timed(lambda: chat.parse("assistant", text)) == (text, [], None)


def test_numbers_that_json_cannot_hold():
    for number in ("1e400", "-1e400", "NaN", "Infinity"):
        text = '{"tool_calls":[{"id":"a","name":"f","arguments":{"x":' + number + "}}]}"
        assert chat.parse("assistant", text) == (text, [], None)
    _, calls, _ = chat.parse("assistant", '{"tool_calls":[{"id":"a","name":"f","arguments":{"x":1e300,"y":1.0,"z":1}}]}')
    assert json.loads(chat.canonical(calls[0])) == calls[0] and chat.canonical(calls[0]["arguments"]) == '{"x":1e+300,"y":1.0,"z":1}'


def test_unknown_types_hold_nothing():
    assert chat.errors(1, {"type": "decimal"}) == ["$: not decimal"] and chat.errors(1, {"type": ["decimal", "integer"]}) == []


# --- pseudonyms ----------------------------------------------------------------

ADDRESS = r"(?P<email>\b[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})|"
PLAIN = re.compile(ADDRESS + pseudonyms._FOUND.pattern, re.VERBOSE | re.ASCII)


def test_values_are_found_as_by_one_pattern():
    rng = random.Random(11)
    parts = ["a", "Z9", "_", ".", "@", "x.org", " ", "-", "+", "%", "é", "+1 (017) 555-7713", "10.0.0.1", "2024-02-29", "4111 1111 1111 1111", "GB82WEST12345698765432", "0f" * 16, "555-123-4567", "m@h.co", "\n"]
    for _ in range(20_000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 12)))
        assert list(pseudonyms.found(text)) == [(m.lastgroup, *m.span()) for m in PLAIN.finditer(text)], text


@pytest.mark.parametrize("piece, tail", [("a.", " 1"), ("a.", "@"), ("a@", ""), ("a.a@b-", ".1"), ("1.", "@x"), ("a@b.co ", ""), ("@", "a@b.co"), ("+1 ", "x@y.de")])
def test_values_are_found_in_linear_time(piece, tail):
    text = piece * (SIZE // len(piece)) + tail
    n = len(timed(lambda: list(pseudonyms.found(text)), 8))
    assert n == (SIZE // len(piece) if piece == "a@b.co " else 1 if piece in ("@", "+1 ") else n)


def test_address_after_a_long_stretch(spark):
    text = "a." * 500_000 + " 1 then a.b@x.org and A.B@x.org"
    got = timed(lambda: pseudonyms.Pseudonyms(b"k").text(text))
    assert got[1] == {"email": 2} and got[0].startswith("a." * 500_000) and pseudonyms.Pseudonyms(b"k").text(got[0], back=True)[0] == text


# --- ids and names -------------------------------------------------------------


def test_items_without_an_id(spark):
    w = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(1, w), (None, w), (2, "nothing here")], "doc_id long, text string")
    items = spark.createDataFrame([(None, w), ("b", w), ("a", w), (None, "w3"), ("None", "elsewhere")], "item_id string, text string")
    for max_words in (5, 200_000):
        got = {r.doc_id: r for r in decontaminate.judged(decontaminate.hits(docs, items, max_words=max_words)).collect()}
        assert got[1].n_items == got[None].n_items == 3 and got[1].items_sha256 == hashlib.sha256(b"a,b").hexdigest()
        assert got[2].n_items == 0 and got[2].items_sha256 == hashlib.sha256(b"").hexdigest()


def test_rows_without_an_id_are_not_held_out(spark):
    df = spark.createDataFrame([(None,), (5,)], "doc_id long")
    got = [r.h for r in df.select(toxicity.held_out(df.doc_id).alias("h")).collect()]
    assert all(isinstance(h, bool) for h in got) and got[0] is False


def test_mix_of_rows_with_odd_names(spark):
    df = spark.createDataFrame([(i, "a b c", "s1", i) for i in range(9)], "doc_id long, text string, source string, `x.y` long")
    got = mixing.taken_documents(df)
    assert got.columns == df.columns and sum(len((r.text or "").split()) for r in got.collect()) == 27


def test_hashes_of_one_block_are_as_before():
    """Words of one block are hashed by the polynomial alone, at any place of a slice."""
    s = next(text_slices(pa.array(["ab", "x ab"])))
    a, b, _ = s.words("space")
    h = s.word_hashes(a, b, False)
    assert h[0] == h[2] != h[1] and h.dtype == np.uint64
