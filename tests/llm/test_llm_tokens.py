"""Token shards and their index against the tokenizer itself."""

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ratewise.llm import tokens

PATH = public_tokenizers.path("word_bpe_49k.json")
TOKENIZER = Tokenizer.from_file(PATH)


def ids_of(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids + [1]


def expected(rows):
    """Every document in file order: (doc_id, copy, start, n_tokens, crc32)."""
    out, start, seen = [], 0, {}
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids, copy = ids_of(text), seen.get(doc, 0)
        seen[doc] = copy + 1
        out.append((doc, copy, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def got(df):
    return sorted(((r["doc_id"], r["copy"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in df.collect()), key=lambda r: r[2])


ROWS = [(i * 7 % 101, f"Document {i}'s TEXT, it's é\u0301 \u00a0 {'x' * (i % 9)}<|endoftext|> ok") for i in range(101)]
ODD = [(None, None), (None, "null id"), (5, ""), (5, "again"), (5, "again"), (9000, "word " * 30_000), (9001, "z" * 20_000), (-4, " \t\n")]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=40), st.text(alphabet="aZé\u0301'sst <|>.,!?;:1\u00a0\u2028\x1c\t\nß\u03a3", max_size=60)), min_size=1, max_size=4))
def test_word_by_word_equals_whole_texts(texts):
    texts = [t.encode("utf-8", "replace").decode() for t in texts]
    data, counts = tokens.Encoder(PATH, "<u2").encode(pa.array(texts, pa.large_string()), 1)
    ids = np.frombuffer(data, "<u2")
    want = [ids_of(t) for t in texts]
    assert ids.tolist() == [x for w in want for x in w] and counts.tolist() == [len(w) for w in want]


def test_round_trip_through_the_index(spark, tmp_path):
    docs = spark.createDataFrame([(*r, 1, "s") for r in ROWS + ODD], "doc_id long, text string, copy int, shard string")
    assert got(tokens.round_trip(docs, PATH, 1, f"file://{tmp_path}/t")) == expected(ROWS + ODD)
    about = tokens.manifest(f"file://{tmp_path}/t")
    files = [(tmp_path / "t" / s["file"]).read_bytes() for s in about["shards"]]
    raw = np.frombuffer(b"".join(files), about["dtype"])
    assert about["dtype"] == "<u2" and raw.tolist() == [i for _, text in sorted(ROWS + ODD, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")) for i in ids_of(text)]


def test_one_id_in_many_shards(spark, tmp_path):
    """An id that most rows share spreads over shards, and its copies are still counted in order."""
    rows = [(1, "same text")] * 150 + [(0, "first"), (2, "last")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert got(tokens.round_trip(docs, PATH, 1, f"file://{tmp_path}/t")) == expected(rows)
    assert len(tokens.manifest(f"file://{tmp_path}/t")["shards"]) > 1


def test_absent_keys_are_refused(spark, tmp_path):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    folder = f"file://{tmp_path}/t"
    ledger = tokens.write(docs, folder, PATH, 1)
    tokens.build_index(ledger, folder)
    asked = spark.createDataFrame([(i, c) for i in range(-300, 300) for c in (0, 1)] + [(None, 0), (3, 0)], "doc_id long, copy long")
    found = tokens.lookup(asked, folder)
    assert sorted((r["doc_id"], r["copy"]) for r in found.collect()) == sorted((d, 0) for d, _ in ROWS)
    with_ids = tokens.fetch(found, folder, with_ids=True).filter("doc_id = 14").first()
    assert np.frombuffer(with_ids["ids"], "<u4").tolist() == ids_of(dict(ROWS)[14])


def test_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert tokens.round_trip(docs, PATH, 1, f"file://{tmp_path}/t").count() == 0
    assert tokens.manifest(f"file://{tmp_path}/t")["n_tokens"] == 0


@pytest.mark.parametrize("n", [1, 2, 50, 5000])
def test_perfect_hash_is_minimal(n):
    hashes = np.random.default_rng(n).integers(0, 2**63, n).astype(np.uint64)
    levels, slot = tokens.perfect_hash(hashes)
    assert sorted(slot.tolist()) == list(range(n))
    assert (tokens.find_slots(hashes, levels) == slot).all()


def test_equal_hashes_are_kept_by_key(monkeypatch):
    monkeypatch.setattr(tokens, "key_hash", lambda ids, copies: np.full(len(ids), 7, np.uint64))
    levels, slot = tokens.perfect_hash(np.full(2, 7, np.uint64))
    assert (slot == -1).all()
    rest = [{"doc_id": d, "copy": 0, "shard": 1, "offset": d, "n_tokens": 2} for d in (3, 4)]
    row = {"sizes": [len(x) for x in levels], "bits": [np.packbits(x).tobytes() for x in levels], "rest": rest}
    row |= {k: b"" for k in ("fingerprints", "shards", "offsets", "lengths")}
    found, _, offset, _ = tokens.probe(row, pa.array([3, 4, 5], pa.int64()), pa.array([0, 0, 0], pa.int64()))
    assert found.tolist() == [True, True, False] and offset[:2].tolist() == [3, 4]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_any_tokenizer_equals_whole_texts(name):
    """The way by words is taken only where the tokenizer's set-up proves it."""
    path = public_tokenizers.path(name)
    whole = Tokenizer.from_file(path)
    rows = ["Two  words, one\tline.\nNext Line", "", "it's <|endoftext|> here", "\u00c9t\u00e9 12 345", " lead"]
    coder = tokens.Encoder(path, "<u4")
    assert coder.by_word == name.startswith("word")
    ids, counts = coder.encode(pa.array(rows, pa.large_string()), 1)
    want = [whole.encode(t, add_special_tokens=False).ids + [1] for t in rows]
    assert counts.tolist() == [len(w) for w in want]
    assert np.frombuffer(ids, "<u4").tolist() == [i for w in want for i in w]


def test_printed_and_latin_words_need_no_tokenizer_run(monkeypatch):
    """Merges alone give the ids of words of printed ASCII signs and Latin-1 letters, whatever they are made of."""
    rng = np.random.default_rng(5)
    signs = [chr(c) for c in [*range(0x21, 0x7F), *range(0xC0, 0x100)] if c not in (0xD7, 0xF7)]
    words = ["".join(rng.choice(signs, n)) for n in rng.integers(1, 9, 4000)] + ["ÀÉ's", "don't.", "ÿ!?", "Straße,", "É", "x'Ll'D9"]
    words = [w for w in words if "<|" not in w]
    coder = tokens.Encoder(PATH, "<u2")
    whole = coder.tokenizer.encode_batch_fast(words, add_special_tokens=False)
    want = [i for e in whole for i in [*e.ids, 1]]

    class Merges:
        model = coder.tokenizer.model

    coder.tokenizer = Merges()
    data, counts = coder.encode(pa.array(words, pa.large_string()), 1)
    assert np.frombuffer(data, "<u2").tolist() == want and counts.tolist() == [len(e.ids) + 1 for e in whole]


def test_memory_is_given_back_between_slices_and_at_the_end_of_tasks(monkeypatch):
    from ratewise.llm import arrowtext, nearjoin

    given = []
    monkeypatch.setattr(arrowtext, "give_back", lambda: given.append("slices"))
    monkeypatch.setattr(nearjoin, "give_back", lambda: given.append("places"))
    batch = pa.record_batch({"doc_id": [1, 2, 3], "text": ["a" * 40, None, "b" * 40], "place": [1, 1, 2]})
    assert [b.num_rows for b in arrowtext.slices(iter([batch]), size=40)] == [2, 1] and given == ["slices"]
    assert sum(t.num_rows for t in nearjoin.places(iter([batch]))) == 3 and given == ["slices", "places"]
