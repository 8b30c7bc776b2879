"""Language-model scores that sum over all segmentations of a text into subword pieces.

The pieces are those of an existing vocabulary; their scores there (ranks) are the starting weights
and the prior. Expected piece counts over all training words re-estimate the weights (expectation
maximisation over the corpus's word counts). A text is its words, each behind a word mark, then an
end. Pieces never reach over a word mark, so the probability of a text, summed over all its
segmentations, is the product over its words of the sums over theirs: a log-space forward recursion
per different word. Characters without a piece fall back to byte pieces, so every text has a score.

Word counts are corpus statistics: counted over all documents and shuffled by word, never bounded.
The most frequent words (at most ``HEAD``, a proven size) go to the tasks with their counts and
scores; all others are joined by word.

Cases: a null text counts as empty (one token, the end); a null id is the text ''; repeated rows
are scored one by one; without training documents only the prior speaks, and the base score counts
no known token; an empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrowtext import Words, slices, texts
from .tokens import scratch

MARK = "▁"
ROUNDS = 2
PRIOR_TOKENS = 1000.0
HEAD = 200_000
HEAD_BYTES = 64
HELD_WORDS = 400_000
BATCH = 4096
#: Words longer than this are taken one by one.
LONG = 48
BASE = np.uint64(0x9E3779B97F4A7C15)


# --- the vocabulary ------------------------------------------------------------------------------


@dataclass
class Vocabulary:
    pieces: list[str]
    prior: np.ndarray
    hashes: np.ndarray
    ids: np.ndarray
    longest: int
    bytes_at: int

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Piece ids of substring hashes, -1 where there is none."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.ids[at], -1)


def hash_of(codes: np.ndarray) -> np.uint64:
    h = np.uint64(0)
    for c in codes.astype(np.uint64):
        h = (h * BASE + c + np.uint64(1)) & np.uint64(2**64 - 1)
    return h


@cache
def vocabulary(path: str) -> Vocabulary:
    """Usable pieces of a sentencepiece model: no control pieces, none with an inner word mark.

    A piece's prior weight falls with its rank, as frequencies do.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, ranks = [], []
    for i in range(model.get_piece_size()):
        piece, score = model.id_to_piece(i), model.get_score(i)
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)) and MARK not in piece[1:] and score > -1e8:
            pieces.append(piece)
            ranks.append(-score)
    weight = np.concatenate([1.0 / (np.array(ranks) + 10.0), np.full(256, 1e-4)])
    with np.errstate(over="ignore"):
        hashes = np.array([hash_of(np.array([ord(c) for c in p])) for p in pieces], np.uint64)
    order = np.argsort(hashes)
    return Vocabulary(pieces, weight / weight.sum(), hashes[order], order.astype(np.int64), max(map(len, pieces)), len(pieces))


# --- the lattice ---------------------------------------------------------------------------------


def lattice(words: list[str], weights: np.ndarray, path: str, counts: np.ndarray | None = None, times: np.ndarray | None = None) -> np.ndarray:
    """Natural-log probability of each word (behind its mark), over all segmentations.

    With ``counts`` the expected uses of every piece, ``times`` the words' counts, are added to it.
    """
    vocab, out = vocabulary(path), np.zeros(len(words))
    length = np.array([len(w) + 1 for w in words], np.int64)
    order = np.argsort(length, kind="stable")
    edges = np.flatnonzero(np.diff(length[order], prepend=-1))
    for s, e in zip(edges, [*edges[1:], len(order)]):
        n = int(length[order[s]])
        step = BATCH if n <= LONG else 1
        for low in range(s, e, step):
            at = order[low : min(e, low + step)]
            out[at] = _same_length([MARK + words[i] for i in at], n, weights, vocab, counts, None if times is None else times[at])
    return out


def _same_length(words: list[str], n: int, weights, vocab: Vocabulary, counts, times) -> np.ndarray:
    m, widest = len(words), min(n, vocab.longest)
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(m, n).astype(np.uint64)
    with np.errstate(over="ignore"):
        head = np.zeros((m, n + 1), np.uint64)
        for j in range(n):
            head[:, j + 1] = head[:, j] * BASE + codes[:, j] + np.uint64(1)
        power, ids = np.uint64(1), []
        for size in range(1, widest + 1):
            power = power * BASE
            ids.append(vocab.find(head[:, size:] - head[:, : n + 1 - size] * power))
    scores = [np.where(i >= 0, weights[i], -np.inf) for i in ids]
    bare = ids[0] < 0  # characters without a piece: their bytes
    if bare.any():
        chars, which = np.unique(codes[bare], return_inverse=True)
        spelt = [chr(int(c)).encode("utf-8", "surrogatepass") for c in chars]
        scores[0][bare] = np.array([sum(weights[vocab.bytes_at + b] for b in s) for s in spelt])[which]
    ahead = _recursion(scores, n, m)
    total = ahead[:, n]
    if counts is not None:
        behind = _recursion([s[:, ::-1] for s in scores], n, m)[:, ::-1]
        for size, (i, s) in enumerate(zip(ids, scores), 1):
            use = np.exp(ahead[:, : n + 1 - size] + s + behind[:, size:] - total[:, None]) * times[:, None]
            hit = i >= 0
            counts += np.bincount(i[hit], use[hit], len(counts))
            if size == 1 and bare.any():
                for s_, u in zip(spelt, np.bincount(which, use[bare], len(spelt))):
                    for b in s_:
                        counts[vocab.bytes_at + b] += u
    return total


def _recursion(scores: list[np.ndarray], n: int, m: int) -> np.ndarray:
    """Log sums over the paths to each position; ``scores[k][:, i]`` leads from i to i + k + 1."""
    if m == 1 and n > LONG:
        rows, sums = [s[0].tolist() for s in scores], [0.0] + [-math.inf] * n
        for j in range(1, n + 1):
            ways = [sums[j - k - 1] + rows[k][j - k - 1] for k in range(min(j, len(rows)))]
            top = max(ways)
            sums[j] = top + math.log(sum(math.exp(w - top) for w in ways)) if top > -math.inf else top
        return np.array([sums])
    sums = np.full((m, n + 1), -np.inf)
    sums[:, 0] = 0
    for j in range(1, n + 1):
        ways = np.stack([sums[:, j - k - 1] + scores[k][:, j - k - 1] for k in range(min(j, len(scores)))])
        top = ways.max(0)
        safe = np.where(np.isfinite(top), top, 0)
        with np.errstate(divide="ignore"):
            sums[:, j] = safe + np.log(np.exp(ways - safe).sum(0))
    return sums


# --- corpus statistics ---------------------------------------------------------------------------


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 1


def lowered(batch: pa.RecordBatch) -> Words:
    return Words(texts(batch), lower=True)


def count_words(docs: DataFrame) -> DataFrame:
    """``word, c, n``: its tokens in training documents, and in all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[int]] = {}

        def flush():
            columns = [pa.array(held.keys(), pa.string()), *(pa.array([v[k] for v in held.values()], pa.int64()) for k in (0, 1))]
            return pa.RecordBatch.from_arrays(columns, names=["word", "c", "n"])

        for b in slices(batches):
            words = lowered(b)
            train = b.column("train").to_numpy(zero_copy_only=False).astype(bool)
            size = len(words.vocabulary)
            n, c = np.bincount(words.codes, minlength=size), np.bincount(words.codes[train[words.row]], minlength=size)
            for word, x, y in zip(words.vocabulary.to_pylist(), c.tolist(), n.tolist()):
                if have := held.get(word):
                    have[0] += x
                    have[1] += y
                else:
                    held[word] = [x, y]
            if len(held) > HELD_WORDS:
                yield flush()
                held.clear()
        if held:
            yield flush()

    counted = docs.select("text", (~held_out(F.col("doc_id"))).alias("train")).mapInArrow(run, "word string, c long, n long")
    return counted.groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))


def written(df: DataFrame, name: str) -> DataFrame:
    """Written once, compressed, beside the checkpoints."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def expected(batches: Iterator[pa.RecordBatch], weights: np.ndarray, path: str) -> Iterator[pa.RecordBatch]:
    """Expected uses of each piece in a task's words."""
    counts = np.zeros(len(weights))
    for b in batches:
        lattice(b.column("word").to_pylist(), weights, path, counts, b.column("c").to_numpy().astype(float))
    at = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["piece", "uses"])


@dataclass
class Model:
    path: str
    weights: np.ndarray  # natural logs: pieces, then the 256 bytes
    end: float


def train(words: DataFrame, documents: int, path: str, rounds: int = ROUNDS, prior_tokens: float = PRIOR_TOKENS) -> Model:
    """Re-estimate the piece weights on the training words; what comes back is one number per piece."""
    prior = vocabulary(path).prior
    uses = np.zeros(len(prior))
    for k in range(rounds):
        mass = uses + prior_tokens * prior
        rows = words.filter("c > 0").mapInArrow(partial(expected, weights=np.log(mass / mass.sum()), path=path), "piece long, uses double")
        uses = np.zeros(len(prior))
        for piece, value in rows.groupBy("piece").agg(F.sum("uses")).collect():
            uses[piece] = value
    mass = uses + prior_tokens * prior
    whole = mass.sum() + documents + 1
    return Model(path, np.log(mass / whole), math.log((documents + 1) / whole))


# --- scores --------------------------------------------------------------------------------------


def score_words(words: DataFrame, model: Model) -> DataFrame:
    """Add ``lp``, the log10 probability of each word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lp = lattice(b.column("word").to_pylist(), model.weights, model.path) / math.log(10)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lp)], names=[*b.schema.names, "lp"])

    return words.mapInArrow(run, "word string, c long, n long, lp double")


def frequent(words: DataFrame, most: int) -> int:
    """The smallest power of two such that at most ``most`` words occur at least so often."""
    steps = words.groupBy(F.floor(F.log2("n")).alias("e")).agg(F.count(F.lit(1)).alias("words")).orderBy(F.col("e").desc()).collect()
    total, least = 0, 1 << 62
    for e, count in steps:
        total += count
        if total > most:
            break
        least = 1 << e
    return least


def score(docs: DataFrame, path: str, rounds: int = ROUNDS, head: int = HEAD) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` per document."""
    spark = docs.sparkSession
    counted = written(count_words(docs), "words")
    n_train = docs.select("doc_id").filter(~held_out(F.col("doc_id"))).count()
    tokens, distinct = counted.agg(F.sum("c"), F.count(F.when(F.col("c") > 0, 1))).first()
    n, v = (tokens or 0) + n_train, distinct + (n_train > 0)
    model = train(counted, n_train, path, rounds)
    scored = written(score_words(counted, model), "scored")
    base = lambda c: np.log10((c + 0.5) / (n + 0.5 * (v + 1)))
    often = (F.col("n") >= frequent(scored, head)) & (F.octet_length("word") <= HEAD_BYTES)
    top = scored.filter(often).toArrow()
    shared = spark.sparkContext.broadcast((top["word"].to_pylist(), top["c"].to_numpy(), top["lp"].to_numpy()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, c, lp = shared.value
        place = {w: i for i, w in enumerate(names)}
        value = np.stack([c > 0, base(c), lp]) if len(c) else np.zeros((3, 1))
        for b in slices(batches):
            words = lowered(b)
            at = np.fromiter((place.get(w, -1) for w in words.vocabulary.to_pylist()), np.int64, len(words.vocabulary))
            code = at[words.codes]
            here = code >= 0
            sums = [np.bincount(words.row[here], value[k][code[here]], b.num_rows).astype(float) for k in range(3)]
            row, word = words.row[~here], words.codes[~here]
            pair, times = np.unique(row * max(1, len(at)) + word, return_counts=True)
            ends = np.searchsorted(pair, np.arange(b.num_rows + 1) * max(1, len(at))).astype(np.int32)
            rest = words.vocabulary.cast(pa.string()).take(pa.array(pair % max(1, len(at))))
            yield pa.RecordBatch.from_arrays([
                b.column("doc_id"), pa.array(words.counts + 1), pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2]),
                pa.ListArray.from_arrays(pa.array(ends), rest), pa.ListArray.from_arrays(pa.array(ends), pa.array(times.astype(np.int32))),
            ], names=["doc_id", "n_tokens", "known", "base", "lp", "rest", "times"])

    kind = "doc_id long, n_tokens long, known long, base double, lp double, rest array<string>, times array<int>"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, kind)
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "by-document")
    rare = rows.select("row", F.explode(F.arrays_zip("rest", "times")).alias("w")).select("row", F.col("w.rest").alias("word"), F.col("w.times").alias("times"))
    value = F.log10((F.col("c") + 0.5) / (n + 0.5 * (v + 1)))
    more = rare.join(scored.filter(~often), "word").groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("k2"), F.sum(value * F.col("times")).alias("b2"), F.sum(F.col("lp") * F.col("times")).alias("l2")
    )
    zero = lambda name: F.coalesce(name, F.lit(0))
    return rows.join(more, "row", "left").select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens",
        (F.col("known") + zero("k2") + F.lit(int(n_train > 0))).cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + zero("b2") + F.lit(float(base(n_train)))).alias("base_score"),
        (F.col("lp") + zero("l2") + F.lit(model.end / math.log(10))).alias("score"),
    )
