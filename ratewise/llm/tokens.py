"""Token ids as raw shards, with a minimal perfect hash index for keyed access.

``write`` encodes texts and appends the ids to ``shard-*.bin`` files in ascending document order:
nothing but little-endian ids, 16 bits wide if the vocabulary allows, else 32. ``build_index`` maps
a key to where its ids start. Keys are dealt to buckets by hash, about ``BUCKET`` to a bucket; each
bucket gets a minimal perfect hash function of its own (levels of bit arrays; a key takes the first
level where no other key of its bucket has the same bit), and as many slots as keys, each with a
fingerprint, shard, offset and length. An access computes a bucket, a slot and one file range. Keys
that were never written are refused by the fingerprint, but for one in 2^32.

A key is (doc_id, copy): copies of an id count from 0 in file order, so repeated rows stay
accessible one by one; a null id is a key like any other and sorts first. Rows with the same id are
ordered by text. A null text counts as empty and gives only the end id. An empty table gives no
shards and an empty index. Extra columns are ignored. Should two keys ever share all 64 hash bits,
they are kept beside the slots of their bucket, by key.

Files are written under a name of the attempt and then renamed, so a repeated or doubled task
leaves the same files. The folder must be one that all executors reach (a shared mount or a store
that pyarrow.fs opens by its address).
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import broadcast_if_small, cut_lineage
from .arrowtext import Words, give_back, mix, slices, texts

BUCKET = 4096
GAMMA = 2.0
LEVELS = 48
CACHED_WORDS = 1 << 19
ENCODED_AT_ONCE = 1 << 14
#: Text encoded at once: the tables of a slice take some twenty times its bytes, in every worker.
ENCODED_BYTES = 1 << 20
PLAIN = re.compile("[a-z]+").fullmatch
#: Printed ASCII signs and the letters of Latin-1: no normal form changes them, each is lowered on its own.
LATIN = "!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
PRINTED = re.compile(f"[{LATIN}]+").fullmatch
#: The split of ``BY_WORD`` for these in lower case, and the signs that byte-level merges know their bytes by.
SPLIT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00ff]+|[0-9]|[^a-z0-9\u00df-\u00ff]+").findall
SIGNS = {chr(c): "\u00c3" + chr(b if b > 0xA0 and b != 0xAD else 323 if b == 0xAD else b + 162) for c in range(0xC0, 0x100) for b in [c - 0x40]}
BYTES = str.maketrans(SIGNS)
READ_BYTES = 8 << 20
LEDGER = "doc_id long, copy long, shard int, offset long, n_tokens long"


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder's address, and the folder's path in it."""
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


# --- encoding ------------------------------------------------------------------------------------


@cache
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: The only set-up for which words are encoded one by one. It drops white space, lowers
#: letters, and keeps letters, single digits and other signs apart.
BY_WORD = {
    "normalizer": {
        "type": "Sequence",
        "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}],
    },
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {
                "type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
                "behavior": "Removed", "invert": True,
            },
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


def words_are_apart(tokenizer: str) -> bool:
    """Whether a text's ids are its words' ids: proven for the set-up above with a plain merge model, else assumed not."""
    with open(tokenizer, encoding="utf-8") as file:
        parts = json.load(file)
    model, added = parts["model"], [t["content"] for t in parts["added_tokens"]]
    return (
        all(parts[k] == v for k, v in BY_WORD.items()) and model["type"] == "BPE" and not model["dropout"]
        and not parts["truncation"] and not parts["padding"] and all(t.startswith("<|") and " " not in t for t in added)
    )


def stems_and_tails(words: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Each word without its closing punctuation, and that; stems of ASCII and Latin-1 letters in lower case.

    The tokenizer lowers all letters and never merges letters with punctuation, so both parts can
    be encoded on their own and are shared by many words. Marks such as ``<|`` stay as written, and
    so does a word whose stem does not end in such a letter.
    """
    stem = pc.ascii_rtrim(words, ".,;:!?")
    size, whole = (pc.binary_length(x).to_numpy().astype(np.int64) for x in (stem, words))
    data, last = np.concatenate([np.zeros(2, np.uint8), _bytes(stem)]), np.cumsum(size) + 1
    letter = (data[last] | 0x20) - np.uint8(ord("a")) < 26
    latin = (data[last - 1] == 0xC3) & (data[last] >= 0x80) & (data[last] != 0x97) & (data[last] != 0xB7)
    apart = (size > 0) & (letter | latin) & ~pc.match_substring(stem, "<|").to_numpy(zero_copy_only=False)
    lower = pc.if_else(pc.match_substring_regex(stem, f"^[{LATIN}]+$"), pc.utf8_lower(stem), stem)
    cut = np.where(apart, whole - size, 0)
    tail = _bytes(words)[runs_of(np.cumsum(whole) - cut, cut)]
    offsets = np.concatenate([[0], np.cumsum(cut)]).astype(np.int64)
    tails = pa.LargeStringArray.from_buffers(len(words), pa.py_buffer(offsets), pa.py_buffer(tail))
    return pc.if_else(pa.array(apart), lower, words), tails


def _bytes(strings: pa.Array) -> np.ndarray:
    """The bytes of all strings, one after the other; the array has no nulls."""
    low, high = np.frombuffer(strings.buffers()[1], np.int64)[strings.offset + np.array([0, len(strings)])]
    return np.frombuffer(strings.buffers()[2], np.uint8)[low:high] if high > low else np.zeros(0, np.uint8)


def runs_of(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... ``size`` places of each, one after the other."""
    return np.arange(size.sum()) + np.repeat(begin - (np.cumsum(size) - size), size)


@cache
def encoder(path: str, dtype: str) -> Encoder:
    """One per process, so that tasks share the words it remembers."""
    return Encoder(path, dtype)


class Encoder:
    """Encodes slices of texts, word by word where the tokenizer's set-up allows, else as whole texts.

    A tokenizer that drops white space before it merges anything, in a normal form that does not reach
    across an ASCII space, gives a text its words' ids in order. Each different word of a slice is
    encoded once; words seen lately are remembered, up to ``CACHED_WORDS``.
    """

    def __init__(self, path: str, dtype: str):
        self.tokenizer, self.dtype = _tokenizer(path), np.dtype(dtype)
        self.by_word = words_are_apart(path)
        self._forget()

    def _forget(self) -> None:
        """A piece has a number; its ids are ``ids[begin[n] : begin[n + 1]]``. The empty one is 0."""
        self.known, self.ids, self.begin = {"": 0}, np.zeros(0, self.dtype), np.zeros(2, np.int64)

    def numbers(self, pieces: list[str]) -> np.ndarray:
        """The number of each piece; pieces not remembered are encoded and remembered."""
        known, merge = self.known, self.tokenizer.model.tokenize
        out = list(map(known.get, pieces))
        ids, sizes, later, merged = [], [], [], {}

        def keep(at: int, piece: str, own: list[int]) -> None:
            out[at] = known[piece] = len(self.begin) - 1 + len(sizes)
            ids.extend(own)
            sizes.append(len(own))

        for at in [i for i, n in enumerate(out) if n is None]:
            piece = pieces[at]
            if PLAIN(piece):  # lower-case ASCII letters are one piece for the tokenizer: its merges apply to them as they stand
                keep(at, piece, [t.id for t in merge(piece)])
            elif PRINTED(piece) and "<|" not in piece:
                own = []
                for part in SPLIT(piece.lower()):
                    if part not in merged:
                        merged[part] = [t.id for t in merge(part.translate(BYTES))]
                    own += merged[part]
                keep(at, piece, own)
            else:
                later.append(at)
        for low in range(0, len(later), ENCODED_AT_ONCE):
            some = later[low : low + ENCODED_AT_ONCE]
            encoded = self.tokenizer.encode_batch_fast([pieces[at] for at in some], add_special_tokens=False)
            for at, e in zip(some, encoded):
                keep(at, pieces[at], e.ids)
        if sizes:
            self.ids = np.concatenate([self.ids, np.array(ids, self.dtype)])
            self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum(sizes)])
        return np.array(out, np.int64)

    def words(self, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, one word after the other, and the number of ids of each."""
        stem, tail = (x.dictionary_encode() for x in stems_and_tails(vocabulary))
        both = np.empty((len(vocabulary), 2), np.int64)
        for side, part in enumerate((stem, tail)):
            both[:, side] = self.numbers(part.dictionary.to_numpy(zero_copy_only=False).tolist())[part.indices.to_numpy()]
        size = self.begin[both + 1] - self.begin[both]
        ids = self.ids[runs_of(self.begin[both].ravel(), size.ravel())]
        if len(self.known) > CACHED_WORDS:
            self._forget()
        return ids, size.sum(axis=1)

    def encode(self, column: pa.Array, end_id: int) -> tuple[bytes, np.ndarray]:
        """All ids as bytes, each text's followed by the end id, and the number of ids per text."""
        if not self.by_word:
            whole = self.tokenizer.encode_batch_fast(column.to_pylist(), add_special_tokens=False)
            parts = [np.array([*e.ids, end_id], self.dtype) for e in whole]
            return b"".join(p.tobytes() for p in parts), np.array([len(p) for p in parts], np.int64)
        words, n = Words(column), len(column)
        ids, size = self.words(words.vocabulary)
        ids, size = np.append(ids, np.array(end_id, self.dtype)), np.append(size, 1)
        begin = np.cumsum(size) - size
        # the words of each text, then the end
        code = np.insert(words.codes, words.starts[1:], len(size) - 1)
        total = np.cumsum(size[code])[code == len(size) - 1]
        return ids[runs_of(begin[code], size[code])].tobytes(), np.diff(np.concatenate([[0], total])) if n else total


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int, spread_seed: int = 11) -> DataFrame:
    """Write the shards and ``manifest.json``; the ledger ``doc_id, copy, shard, offset, n_tokens``.

    One range shuffle of (doc_id, text); a partition becomes a shard. A random second range key
    lets an id that very many rows share spread over shards. It follows the order of the rows, so
    ``docs`` should be a written table: a lost task of a plan that shuffles may see another order.
    """
    spark = docs.sparkSession
    vocabulary = _tokenizer(tokenizer).get_vocab_size()
    dtype = "<u2" if max(vocabulary, end_id + 1) <= 1 << 16 else "<u4"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    by = F.col("doc_id").asc_nulls_first()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.rand(spread_seed).alias("_spread"))
    ranged = rows.repartitionByRange(parts, by, "_spread").sortWithinPartitions(by, "text").drop("_spread")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        fs, root = open_fs(folder)
        coder, out, offset, last = encoder(tokenizer, dtype), None, 0, (None, -1)
        own = f"{root}/.{shard}-{uuid.uuid4().hex}"
        for batch in slices(batches, size=ENCODED_BYTES):
            give_back()  # beside the words it remembers, a worker keeps no more than one slice takes
            if out is None:
                fs.create_dir(root, recursive=True)
                out = fs.open_output_stream(own)
            ids, counts = coder.encode(texts(batch), end_id)
            out.write(ids)
            keys, copies = batch.column("doc_id").to_pylist(), []
            for key in keys:
                last = (key, last[1] + 1 if key == last[0] and last[1] >= 0 else 0)
                copies.append(last[1])
            begins = offset + np.cumsum(counts) - counts
            offset += int(counts.sum())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(copies, pa.int64()), pa.array(np.full(len(keys), shard, np.int32)), pa.array(begins), pa.array(counts)],
                names=["doc_id", "copy", "shard", "offset", "n_tokens"],
            )
        if out is not None:
            out.close()
            fs.move(own, f"{root}/shard-{shard:06d}.bin")

    ledger = cut_lineage(ranged.mapInArrow(run, LEDGER))
    return _finish(ledger, folder, dtype, end_id)


def _finish(ledger: DataFrame, folder: str, dtype: str, end_id: int) -> DataFrame:
    """Write the manifest (a line per shard) and go on counting copies that reach into later shards."""
    edge = lambda f: f(F.struct(F.col("doc_id").isNotNull(), F.col("doc_id"), F.col("copy")))
    shards = ledger.groupBy("shard").agg(
        F.sum("n_tokens").alias("n_tokens"), edge(F.min).alias("first"), edge(F.max).alias("last")
    ).orderBy("shard").collect()
    listed, begun, base, carried, before = [], [], 0, 0, None
    for s in shards:
        goes_on = before is not None and tuple(s["first"])[:2] == before
        carry = carried if goes_on else 0
        if carry:
            begun.append((s["shard"], s["first"]["doc_id"], carry))
        listed.append({"shard": s["shard"], "file": f"shard-{s['shard']:06d}.bin", "start": base, "n_tokens": s["n_tokens"]})
        base += s["n_tokens"]
        before = tuple(s["last"])[:2]
        carried = s["last"]["copy"] + 1 + (carry if before == tuple(s["first"])[:2] else 0)
    fs, root = open_fs(folder)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/manifest.json") as out:
        out.write(json.dumps({"dtype": dtype, "end_id": end_id, "n_tokens": base, "shards": listed}).encode())
    if not begun:
        return ledger
    more = ledger.sparkSession.createDataFrame(begun, "_shard int, _id long, _more long")
    same = (F.col("shard") == F.col("_shard")) & F.col("doc_id").eqNullSafe(F.col("_id"))
    return cut_lineage(ledger.join(F.broadcast(more), same, "left").select(
        "doc_id", (F.col("copy") + F.coalesce("_more", F.lit(0))).alias("copy"), "shard", "offset", "n_tokens"
    ))


def manifest(folder: str) -> dict:
    fs, root = open_fs(folder)
    with fs.open_input_file(f"{root}/manifest.json") as file:
        return json.loads(file.read())


# --- the index -----------------------------------------------------------------------------------


def key_hash(ids: pa.Array, copies: pa.Array) -> np.ndarray:
    blank = ids.is_null().to_numpy(zero_copy_only=False)
    value = ids.fill_null(0).to_numpy().astype(np.int64).view(np.uint64)
    return mix(mix(value, 1) + mix(copies.to_numpy().view(np.uint64), 2) + mix(blank.astype(np.uint64), 3), 4)


def fingerprint(hashes: np.ndarray) -> np.ndarray:
    return (mix(hashes, 5) >> np.uint64(32)).astype("<u4")


def perfect_hash(hashes: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Bit arrays of the levels, and each key's slot; -1 if no level separates the key."""
    slot, left, levels, base = np.full(len(hashes), -1, np.int64), np.arange(len(hashes)), [], 0
    while len(left) and len(levels) < LEVELS:
        size = max(8, int(GAMMA * len(left)))
        place = (mix(hashes[left], 10 + len(levels)) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(place, minlength=size)[place] == 1
        bits = np.zeros(size, bool)
        bits[place[alone]] = True
        slot[left[alone]] = base + np.cumsum(bits)[place[alone]] - 1
        base += int(alone.sum())
        levels.append(bits)
        left = left[~alone]
    return levels, slot


def find_slots(hashes: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """The slot of each key, or -1 if no level has its bit."""
    slot, base = np.full(len(hashes), -1, np.int64), 0
    for k, bits in enumerate(levels):
        left = np.flatnonzero(slot < 0)
        place = (mix(hashes[left], 10 + k) % np.uint64(len(bits))).astype(np.int64)
        hit = bits[place]
        slot[left[hit]] = base + np.cumsum(bits)[place[hit]] - 1
        base += int(bits.sum())
    return slot


INDEX = (
    "bucket long, n_keys long, sizes array<int>, bits array<binary>, fingerprints binary, shards binary, offsets binary, "
    "lengths binary, rest array<struct<doc_id: long, copy: long, shard: int, offset: long, n_tokens: long>>"
)


def _with_bucket(keys: DataFrame, buckets: int, rest: str = "") -> DataFrame:
    """Add ``bucket``; the hash is numpy's, so that reader and writer agree in any language version."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keys.schema) + ", bucket long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of = (key_hash(b.column("doc_id"), b.column("copy")) % np.uint64(buckets)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(of)], names=[*b.schema.names, "bucket"])

    return keys.mapInArrow(run, fields)


def build_index(ledger: DataFrame, folder: str) -> DataFrame:
    """Write ``index/`` beside the shards, one row per bucket, and return it as read back."""
    buckets = max(1, -(-ledger.count() // BUCKET))

    def build(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        hashes = key_hash(group["doc_id"].combine_chunks(), group["copy"].combine_chunks())
        levels, slot = perfect_hash(hashes)
        order = np.argsort(slot[slot >= 0])
        pick = lambda name, kind: np.asarray(group[name])[slot >= 0][order].astype(kind).tobytes()
        rest = group.filter(pa.array(slot < 0)).select(["doc_id", "copy", "shard", "offset", "n_tokens"]).to_pylist()
        row = {
            "bucket": group["bucket"][0].as_py(), "n_keys": group.num_rows, "sizes": [len(x) for x in levels],
            "bits": [np.packbits(x).tobytes() for x in levels], "fingerprints": fingerprint(hashes)[slot >= 0][order].tobytes(),
            "shards": pick("shard", "<i4"), "offsets": pick("offset", "<i8"), "lengths": pick("n_tokens", "<i8"), "rest": rest,
        }
        return pa.Table.from_pylist([row], schema=SCHEMA)

    out = f"{folder}/index"
    _with_bucket(ledger, buckets).groupBy("bucket").applyInArrow(build, INDEX).write.mode("overwrite").option("compression", "zstd").parquet(out)
    return ledger.sparkSession.read.schema(INDEX).parquet(out)


SCHEMA = pa.schema([
    ("bucket", pa.int64()), ("n_keys", pa.int64()), ("sizes", pa.list_(pa.int32())), ("bits", pa.list_(pa.binary())),
    ("fingerprints", pa.binary()), ("shards", pa.binary()), ("offsets", pa.binary()), ("lengths", pa.binary()),
    ("rest", pa.list_(pa.struct([(n, pa.int32() if n == "shard" else pa.int64()) for n in ("doc_id", "copy", "shard", "offset", "n_tokens")]))),
])


def probe(row: dict, ids: pa.Array, copies: pa.Array) -> tuple[np.ndarray, ...]:
    """(found, shard, offset, n_tokens) of keys in one bucket's index row."""
    hashes = key_hash(ids, copies)
    levels = [np.unpackbits(np.frombuffer(b, np.uint8), count=n).astype(bool) for n, b in zip(row["sizes"], row["bits"])]
    slot = find_slots(hashes, levels)
    marks = np.frombuffer(row["fingerprints"], "<u4")
    found = slot >= 0
    found[found] = marks[slot[found]] == fingerprint(hashes[found])
    at = np.where(found, slot, 0)
    column = lambda name, kind: np.frombuffer(row[name], kind)[at].copy() if len(marks) else np.zeros(len(hashes), kind)
    shard, offset, length = column("shards", "<i4"), column("offsets", "<i8"), column("lengths", "<i8")
    if row["rest"]:
        kept = {(r["doc_id"], r["copy"]): r for r in row["rest"]}
        for i, key in enumerate(zip(ids.to_pylist(), copies.to_pylist())):
            if r := kept.get(key):
                found[i], shard[i], offset[i], length[i] = True, r["shard"], r["offset"], r["n_tokens"]
    return found, shard, offset, length


def lookup(keys: DataFrame, folder: str) -> DataFrame:
    """``doc_id, copy, shard, offset, n_tokens`` of the distinct ``keys`` (doc_id, copy) that exist."""
    index = keys.sparkSession.read.schema(INDEX).parquet(f"{folder}/index")
    buckets = index.count()

    def look(group: pa.Table, rows: pa.Table) -> pa.Table:
        if not group.num_rows or not rows.num_rows:
            return RESULT.empty_table()
        ids, copies = group["doc_id"].combine_chunks(), group["copy"].combine_chunks()
        found, shard, offset, length = probe(rows.to_pylist()[0], ids, copies)
        table = pa.table([ids, copies, pa.array(shard, pa.int32()), pa.array(offset, pa.int64()), pa.array(length, pa.int64())], schema=RESULT)
        return table.filter(pa.array(found))

    asked = _with_bucket(keys.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("copy").cast("long").alias("copy")).distinct(), _buckets(index, buckets))
    return asked.groupBy("bucket").cogroup(index.groupBy("bucket")).applyInArrow(look, LEDGER)


def _buckets(index: DataFrame, rows: int) -> int:
    """Buckets at build time; a bucket without keys has no row."""
    total = index.agg(F.sum("n_keys")).first()[0] if rows else 0
    return max(1, -(-(total or 0) // BUCKET))


RESULT = pa.schema([("doc_id", pa.int64()), ("copy", pa.int64()), ("shard", pa.int32()), ("offset", pa.int64()), ("n_tokens", pa.int64())])


def fetch(found: DataFrame, folder: str, with_ids: bool = False) -> DataFrame:
    """Read the file ranges of ``lookup``: ``doc_id, copy, start, n_tokens, ids_crc32[, ids]``.

    ``start`` counts the ids of all documents before. A task takes whole shards, in file order, and
    reads neighbouring ranges together, up to ``READ_BYTES`` at once.
    """
    about = manifest(folder)
    dtype, wide = np.dtype(about["dtype"]), about["dtype"]
    starts = found.sparkSession.createDataFrame([(s["shard"], s["start"]) for s in about["shards"]], "shard int, _start long")
    parts = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = found.join(broadcast_if_small(starts, len(about["shards"]), 16), "shard").repartition(parts, "shard").sortWithinPartitions("shard", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder.cache_clear()  # writing is over: the words that workers remember need not live on with them
        give_back()
        fs, root = open_fs(folder)
        opened, file = -1, None
        for b in batches:
            shard, offset, count, base = (b.column(c).to_numpy() for c in ("shard", "offset", "n_tokens", "_start"))
            crc, ids, i = np.zeros(len(shard), np.int64), [], 0
            while i < len(shard):
                if shard[i] != opened:
                    if file is not None:
                        file.close()
                    opened, file = shard[i], fs.open_input_file(f"{root}/shard-{shard[i]:06d}.bin")
                j = i + 1
                while j < len(shard) and shard[j] == opened and (offset[j] + count[j] - offset[i]) * dtype.itemsize <= READ_BYTES:
                    j += 1
                span = int(offset[j - 1] + count[j - 1] - offset[i])
                part = np.frombuffer(file.read_at(span * dtype.itemsize, int(offset[i]) * dtype.itemsize), wide).astype("<u4")
                for k in range(i, j):
                    own = part[offset[k] - offset[i] : offset[k] - offset[i] + count[k]].tobytes()
                    crc[k] = zlib.crc32(own)
                    if with_ids:
                        ids.append(own)
                i = j
            out = [b.column("doc_id"), b.column("copy"), pa.array(base + offset), b.column("n_tokens"), pa.array(crc)]
            names = ["doc_id", "copy", "start", "n_tokens", "ids_crc32"]
            yield pa.RecordBatch.from_arrays(out + [pa.array(ids, pa.binary())] * with_ids, names=names + ["ids"] * with_ids)

    return rows.mapInArrow(run, "doc_id long, copy long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder beside the checkpoints, which all executors share."""
    from ..session import ensure_checkpoint_dir

    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def round_trip(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None) -> DataFrame:
    """Write shards and index, then read every document back through the index."""
    folder = folder or scratch(docs.sparkSession, "tokens")
    ledger = write(docs, folder, tokenizer, end_id)
    build_index(ledger, folder)
    return fetch(lookup(ledger.select("doc_id", "copy"), folder), folder)
