"""Language-model scores from a log-frequency Bloom filter of n-gram counts (Talbot and Osborne, 2007).

A filter holds each n-gram, those seen once too, with every level up to that of its quantised count; probing the levels in turn until one is
missing gives the count back. The bits of a level of an n-gram lie in one 64-bit word, so a probe of all of them is one look. It is built in segments on the executors. Up to MOST_BITS it is broadcast; a larger one stays in its segments, and what texts ask
for is dealt to them. Both give the same counts: no level is ever left out.
"""

from __future__ import annotations

import copy
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, slices

END, SEED = b"\n", 1
START = np.uint64(0x9E3779B97F4A7C15)
#: Words whose exact counts are broadcast, and bytes of one, at most: the bound of that table.
HEAD, HEAD_BYTES = 1 << 17, 64
#: Tokens for which one bucket of n-grams is made; bits of a key within its bucket.
BUCKET, KEY_BITS = 4_000_000, 40
#: Bits of the filter for each level that is stored, bits of a word that each sets, and the most bits of a filter that is broadcast.
BITS, PROBES, MOST_BITS = 8, 4, 5 << 27
BASE = 1.5
#: Tokens of the texts that ask the segments of a spread filter together, about.
ASKED = 1_000_000
BINS, RATIOS = 32, 64
#: Bytes of a word that is hashed together with others, at most.
LONG = 64
#: Bytes of the texts that are taken apart at a time, about.
TEXTS = 1 << 20
N_GRAMS = 3_000_000


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _pair(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    return _mix(_mix(before) + after)


def _key(h: np.ndarray, bits: int) -> np.ndarray:
    """Bucket (the top bits) and 40 further bits of each hash as one number."""
    return h >> np.uint64(64 - KEY_BITS - bits)


def _distinct(keys: np.ndarray) -> np.ndarray:
    """The different keys, sorted: several times faster than np.unique, which tells them apart by a table when it isn't asked for counts."""
    keys = np.sort(keys)
    return keys[np.append(True, keys[1:] != keys[:-1])] if len(keys) else keys


#: Least counts of the levels, from level 1 (seen once) on, and the count that stands for each.
EDGES = np.unique(np.ceil(BASE ** np.arange(100)).astype(np.int64))
VALUES = np.concatenate([[0.0], np.sqrt(EDGES[:-1] * np.maximum(EDGES[:-1], EDGES[1:] - 1.0))])


def level(counts: np.ndarray) -> np.ndarray:
    """The quantised count: 0 for none, then one more for each factor BASE."""
    return np.searchsorted(EDGES, counts, "right")


def _hashes(words: pa.Array) -> np.ndarray:
    """64-bit hashes of words: eight bytes of all at a time, words of more than LONG bytes one by one."""
    words = pa.concat_arrays([words.cast(pa.large_binary())])
    ends = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    starts, sizes = ends[:-1], np.diff(ends)
    data = np.zeros(int(ends[-1]) + 8 if len(words) else 8, np.uint8)
    data[:-8] = np.frombuffer(words.buffers()[2] or b"", np.uint8)[: len(data) - 8]
    eights = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    own = np.flatnonzero(sizes <= LONG)
    h = sizes.astype(np.uint64) * START + np.uint64(SEED)
    for at in range(0, LONG, 8):
        own = own[sizes[own] > at]
        if not len(own):
            break
        unused = np.maximum(64 - 8 * (sizes[own] - at), 0).astype(np.uint64)
        h[own] = _mix(h[own] ^ _mix((eights[starts[own] + at] << unused) + np.uint64(at)))
    for i in np.flatnonzero(sizes > LONG).tolist():
        h[i] = xxhash.xxh64_intdigest(words[i].as_buffer(), SEED)
    return h


class Tokens:
    """The tokens of some texts: `rows` of `words`, the different ones with END as the last, of all texts one after the other, each closed by END; `sizes` has how
    many each text has, `hashes` a hash of each word. Arrow splits and tells words apart, so Python sees each word once, however often it stands in the texts."""

    def __init__(self, texts: pa.Array, hashed: bool = True):
        listed = pa.compute.ascii_split_whitespace(pa.compute.ascii_lower(texts))
        every, ends = listed.flatten(), listed.offsets.to_numpy() - listed.offsets[0].as_py()
        # white space at the ends of a text gives empty words there
        fine = pa.compute.greater(pa.compute.binary_length(every), 0)
        ends = np.concatenate([[0], np.cumsum(fine.to_numpy(zero_copy_only=False))])[ends]
        coded = every.filter(fine).dictionary_encode()
        self.words, self.sizes = pa.concat_arrays([coded.dictionary, pa.array([END.decode()], coded.dictionary.type)]), np.diff(ends) + 1
        self.rows = np.full(len(coded) + len(texts), len(self.words) - 1)
        inner = np.ones(len(self.rows), bool)
        inner[np.cumsum(self.sizes) - 1] = False
        self.rows[inner] = coded.indices.to_numpy()
        if hashed:
            self.hashes = _hashes(self.words)

    def numerators(self, grams: Filter) -> np.ndarray:
        """One more than the count of each word, as the filter has it."""
        return grams.value(_mix(self.hashes)) + 1


def _before(h: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Of each token the hash of the one before it, START at a text's first."""
    out = np.concatenate([[START], h[:-1]]).astype(np.uint64)
    out[np.concatenate([[0], np.cumsum(sizes)[:-1]])] = START
    return out


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """The batches in pieces, and their texts: few enough rows that memory follows TEXTS bytes or one text."""
    for batch in batches:
        ends = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(batch.column(batch.num_columns - 1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            rows = max(1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TEXTS, "right")) - at)
            part = batch.slice(at, rows)
            yield part, pa.compute.fill_null(part.column(part.num_columns - 1), "")
            at += rows


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = none = pa.table({"word": pa.array([], pa.string()), "n": pa.array([], pa.int64())})
    held = []
    for _, texts in _parts(batches):
        tokens = Tokens(texts, hashed=False)
        held.append(pa.table({"word": tokens.words.cast(pa.string()), "n": pa.array(np.bincount(tokens.rows, minlength=len(tokens.words)))}))
        if sum(map(len, held)) > 500_000:
            counts = pa.concat_tables([counts, *held]).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])
            held = []
            if len(counts) > 500_000:
                yield from counts.to_batches()
                counts = none
    yield from pa.concat_tables([counts, *held]).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"]).to_batches()


BLOBS = pa.schema([("bucket", pa.int32()), ("low", pa.binary()), ("high", pa.binary()), ("n", pa.binary())])


def _blobs(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """Sorted keys with their counts, a row for each bucket."""
    bucket = (keys >> np.uint64(KEY_BITS)).astype(np.int32)
    starts = np.flatnonzero(np.diff(bucket, prepend=-1)) if len(bucket) else np.zeros(0, int)
    parts = [slice(a, b) for a, b in zip(starts, np.append(starts[1:], len(keys)), strict=True)]
    low, high = (keys & np.uint64(0xFFFFFFFF)).astype("<u4"), ((keys >> np.uint64(32)) & np.uint64(0xFF)).astype(np.uint8)
    n = np.minimum(counts, 2**32 - 1).astype("<u4")
    return pa.RecordBatch.from_arrays([pa.array(bucket[starts]), *(pa.array([x[p].tobytes() for p in parts], pa.binary()) for x in (low, high, n))], schema=BLOBS)


def _unblob(low: bytes, high: bytes) -> np.ndarray:
    return np.frombuffer(low, "<u4").astype(np.uint64) | (np.frombuffer(high, np.uint8).astype(np.uint64) << np.uint64(32))


def _pairs(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for _, texts in _parts(batches):
            tokens = Tokens(texts)
            h = tokens.hashes[tokens.rows]
            held.append(_key(_pair(_before(h, tokens.sizes), h), bits))
            size += len(h)
            if size > N_GRAMS:
                yield _blobs(*np.unique(np.concatenate(held), return_counts=True))
                held, size = [], 0
        if held:
            yield _blobs(*np.unique(np.concatenate(held), return_counts=True))

    return run


def _singles(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1 << 18):
            keys = _key(_mix(_hashes(batch.column(0))), bits)
            order = np.argsort(keys, kind="stable")
            yield _blobs(keys[order], batch.column(1).to_numpy()[order])

    return run


def _reduced(table: pa.Table) -> pa.Table:
    keys = np.concatenate([_unblob(a, b) for a, b in zip(table["low"].to_pylist(), table["high"].to_pylist(), strict=True)])
    counts = np.concatenate([np.frombuffer(x, "<u4") for x in table["n"].to_pylist()]).astype(np.int64)
    keys, inverse = np.unique(keys, return_inverse=True)
    levels = level(np.bincount(inverse, counts).astype(np.int64))
    keys, levels = keys[levels > 0], levels[levels > 0].astype(np.uint8)
    low, high = (keys & np.uint64(0xFFFFFFFF)).astype("<u4"), (keys >> np.uint64(32)).astype(np.uint8)
    kinds = [("bucket", pa.int32()), ("low", pa.binary()), ("high", pa.binary()), ("level", pa.binary()), ("histogram", pa.list_(pa.int64()))]
    return pa.table([pa.array([table["bucket"][0].as_py()], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (low, high, levels)), pa.array([np.bincount(levels, minlength=100).tolist()], pa.list_(pa.int64()))], schema=pa.schema(kinds))


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a partition, which are those of one bucket, to that bucket's keys and levels."""
    table = pa.Table.from_batches(list(batches), schema=BLOBS)
    for bucket in sorted(set(table["bucket"].to_pylist())):
        yield from _reduced(table.filter(pa.compute.equal(table["bucket"], bucket))).to_batches()


def _words_of(keys: np.ndarray, lev: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit word, of a segment's `size` bits, that these keys have at a level, and their bits in it."""
    h = _mix(keys * np.uint64(64) + np.uint64(lev))
    word = ((h >> np.uint64(32)) * np.uint64(size // 64)) >> np.uint64(32)
    bits = np.zeros(len(h), np.uint64)
    for probe in range(PROBES):
        bits |= np.uint64(1) << ((h >> np.uint64(6 * probe)) & np.uint64(63))
    return word.view(np.int64), bits


def _segments(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            row = {k: v[0] for k, v in batch.to_pydict().items()}
            keys, levels = _unblob(row["low"], row["high"]), np.frombuffer(row["level"], np.uint8)
            marks = np.zeros(size // 64, np.uint64)
            for lev in range(1, int(levels.max(initial=0)) + 1):
                np.bitwise_or.at(marks, *_words_of(keys[levels >= lev], lev, size))
            yield pa.RecordBatch.from_arrays([pa.array([row["bucket"]], pa.int32()), pa.array([marks.astype("<u8").tobytes()], pa.binary())], ["bucket", "bits"])

    return run


class Filter:
    """The log-frequency Bloom filter: the 64-bit words of its segments one after the other, and its top level."""

    def __init__(self, bits: int, size: int, top: int, marks: np.ndarray):
        self.bits, self.size, self.top, self.marks = bits, size, top, marks

    def levels(self, bucket: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """The level of each key (without its bucket's bits) in that segment; 0 if it isn't in the filter."""
        first = bucket.astype(np.int64) * (self.size // 64)
        levels, alive = np.zeros(len(keys), np.int64), np.arange(len(keys))
        for lev in range(1, self.top + 1):
            word, bits = _words_of(keys, lev, self.size)
            hit = np.flatnonzero(self.marks[first + word] & bits == bits)
            if not len(hit):
                break
            if len(hit) < len(alive):
                alive, keys, first = alive[hit], keys[hit], first[hit]
            levels[alive] = lev
        return levels

    def value(self, h: np.ndarray) -> np.ndarray:
        """The count that each hash's level stands for; 0 if it isn't in the filter."""
        keys = _key(h, self.bits)
        return VALUES[self.levels((keys >> np.uint64(KEY_BITS)).view(np.int64), keys & np.uint64((1 << KEY_BITS) - 1))]


class Answers:
    """What the segments of a spread filter say of the keys that a batch of texts asks for; read like the filter."""

    def __init__(self, bits: int, keys: np.ndarray, levels: np.ndarray):
        self.bits, self.keys, self.levels = bits, keys, levels

    def value(self, h: np.ndarray) -> np.ndarray:
        return VALUES[self.levels[np.searchsorted(self.keys, _key(h, self.bits))]]


class Model:
    """What the workers get: the filter, the head's exact counts, the totals and the mixture weights.

    segments (bucket, bits) is the table of a filter that is too large to broadcast; it stays on the executors.
    """

    def __init__(self, grams: Filter, head: dict[bytes, int], tokens: int, words: int, texts: int, weights: np.ndarray, segments: DataFrame | None = None):
        self.grams, self.head, self.tokens, self.words, self.texts, self.weights, self.segments = grams, head, tokens, words, texts, weights, segments

    def __getstate__(self) -> dict:
        return self.__dict__ | {"segments": None}

    def reading(self, grams: Filter | Answers | None) -> Model:
        """This model with other counts of n-grams, if given."""
        model = copy.copy(self)
        model.grams = grams or self.grams
        return model

    def parts(self, h: np.ndarray, one: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each token, from its hash and one more than its word's count: the count of the pair with the token before, the count of that."""
        before = _before(h, sizes)
        first = before == START
        past = np.where(first, float(self.texts), np.concatenate([[1.0], one[:-1]]) - 1)
        return np.minimum(self.grams.value(_pair(before, h)), past), past

    def log10(self, h: np.ndarray, one: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The log10 probability of each text: every token's is a mixture of its pair's and its word's, weighted by how often the token
        before was seen."""
        pair, past = self.parts(h, one, sizes)
        weight = self.weights[np.log2(past + 1).astype(int)]
        p = weight * pair / np.maximum(past, 1) + (1 - weight) * one / (self.tokens + self.words + 1)
        return np.add.reduceat(np.log10(p), np.concatenate([[0], np.cumsum(sizes)[:-1]]))


def _asking(tokens: Tokens, bits: int) -> np.ndarray:
    """The different keys of all words and pairs of the texts, sorted."""
    h = tokens.hashes[tokens.rows]
    return _distinct(np.concatenate([_key(_pair(_before(h, tokens.sizes), h), bits), _key(_mix(tokens.hashes), bits)]))


def _asked(bits: int):
    """(row, doc_id, text) to batches, named by their first row: the texts (bucket -1), and a row for each bucket with the keys they ask for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, keys, size = [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            name = held[0].column(0)[0].as_py()
            for part in held:
                n = part.num_rows
                yield pa.RecordBatch.from_arrays([pa.array([name] * n, pa.int64()), pa.array([-1] * n, pa.int32()), *part.columns, pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())], schema=ASKS)
            every = _distinct(np.concatenate(keys))
            own = _blobs(every, np.zeros(len(every), np.int64))
            n = own.num_rows
            yield pa.RecordBatch.from_arrays([pa.array([name] * n, pa.int64()), own.column(0), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.string()), own.column(1), own.column(2)], schema=ASKS)

        for batch, texts in _parts(batches):
            tokens = Tokens(texts)
            held.append(batch)
            keys.append(_asking(tokens, bits))
            size += len(tokens.rows)
            if size > ASKED:
                yield from flush()
                held, keys, size = [], [], 0
        if held:
            yield from flush()

    return run


ASKS = pa.schema([("batch", pa.int64()), ("bucket", pa.int32()), ("row", pa.int64()), ("doc_id", pa.int64()), ("text", pa.string()), ("low", pa.binary()), ("high", pa.binary())])
ANSWERS = pa.schema([("batch", pa.int64()), ("bucket", pa.int32()), ("level", pa.binary())])


def _answered(bits: int, size: int, top: int):
    """The keys that all batches ask of a bucket, and its segment, to the levels of each batch's keys."""

    def run(asked: pa.Table, segment: pa.Table) -> pa.Table:
        if not asked.num_rows:
            return ANSWERS.empty_table()
        marks = np.frombuffer(segment["bits"][0].as_py(), "<u8") if segment.num_rows else np.zeros(size // 64, np.uint64)
        grams, out = Filter(bits, size, top, marks), []
        for low, high in zip(asked["low"], asked["high"], strict=True):
            keys = _unblob(low.as_py(), high.as_py())
            out.append(grams.levels(np.zeros(len(keys), np.int64), keys).astype(np.uint8).tobytes())
        return pa.table([asked["batch"], asked["bucket"], pa.array(out, pa.binary())], schema=ANSWERS)

    return run


def _each(source: DataFrame, model: Model, shared, run, schema: str) -> DataFrame:
    """What run(shared, grams) makes of the batches of source (row, doc_id, text), each with its tokens.

    A spread filter is asked for the different keys of each batch in one shuffle, whatever its size; the answers come back to
    the batch's texts in a second one.
    """
    if model.segments is None:
        told = run(shared)
        return source.mapInArrow(lambda batches: told((batch, Tokens(texts)) for batch, texts in _parts(batches)), schema)
    bits, size, top = model.grams.bits, model.grams.size, model.grams.top
    kind = "batch long, bucket int, row long, doc_id long, text string, low binary, high binary"
    asked = materialize(source.select("row", "doc_id", "text").mapInArrow(_asked(bits), kind))
    keys = asked.where("bucket >= 0").select("batch", "bucket", "low", "high")
    answers = keys.groupBy("bucket").cogroup(model.segments.groupBy("bucket")).applyInArrow(_answered(bits, size, top), "batch long, bucket int, level binary")

    def join(table: pa.Table) -> pa.Table:
        bucket = table["bucket"].to_numpy()
        own = np.flatnonzero(bucket >= 0)
        own = own[np.argsort(bucket[own], kind="stable")]
        levels = np.frombuffer(b"".join(table["level"].take(pa.array(own)).to_pylist()), np.uint8)
        texts = table.select(["row", "doc_id", "text"]).take(pa.array(np.flatnonzero(bucket < 0))).combine_chunks()
        parts = [(batch, Tokens(part)) for batch, part in _parts(iter(texts.to_batches()))]
        keys = _distinct(np.concatenate([_asking(tokens, bits) for _, tokens in parts]))
        return pa.Table.from_batches(list(run(shared, Answers(bits, keys, levels))(parts)))

    texts = asked.where("bucket < 0").select("batch", "bucket", "row", "doc_id", "text", F.lit(None).cast("binary").alias("level"))
    return texts.unionByName(answers, allowMissingColumns=True).groupBy("batch").applyInArrow(join, schema)


def _ratios(shared, grams: Answers | None = None):
    """Left-one-out ratios of both probabilities, counted by how often the token before was seen."""

    def run(parts: Iterable[tuple[pa.RecordBatch, Tokens]]) -> Iterator[pa.RecordBatch]:
        model = shared.value.reading(grams)
        table = np.zeros((BINS, RATIOS), np.int64)
        for _, tokens in parts:
            one = tokens.numerators(model.grams)[tokens.rows]
            pair, past = model.parts(tokens.hashes[tokens.rows], one, tokens.sizes)
            ratio = (np.maximum(pair - 1, 0) / np.maximum(past - 1, 1)) / (np.maximum(one - 1, 1) / (model.tokens + model.words + 1))
            at = np.where(ratio > 0, np.clip(np.log2(np.maximum(ratio, 1e-9)) + 31, 1, RATIOS - 1), 0).astype(int)
            np.add.at(table, (np.log2(past + 1).astype(int), at), 1)
        i, j = np.nonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(table[i, j])], ["bin", "ratio", "n"])

    return run


def mixture(table: np.ndarray) -> np.ndarray:
    """Weights of the pair probability, one for each bin, by expectation maximisation over counted ratios."""
    ratio = np.where(np.arange(RATIOS) > 0, 2.0 ** (np.arange(RATIOS) - 30.5), 0)
    w = np.full(BINS, 0.1)
    for _ in range(50):
        part = w[:, None] * ratio / (w[:, None] * ratio + 1 - w[:, None])
        w = np.clip((table * part).sum(1) / np.maximum(table.sum(1), 1), 1e-6, 0.95)
    return np.where(table.sum(1) > 0, w, 1e-6)


def train(docs: DataFrame, most_bits: int = MOST_BITS) -> tuple[Model, DataFrame]:
    """Model and vocabulary (word, n, c, head) of docs (doc_id, text): all words and pairs of neighbours count, and all set the mixture's weights.

    Counts are folded in each task, words by word and pairs by 40-bit keys in as many buckets as the tokens ask for, so no bucket grows with
    the input. The driver sees totals, histograms, the head's words and the filter's bits, each of bounded size. A filter
    of more than `most_bits` is left in its segments, see _each().
    """
    text = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    words = text.select("text").mapInArrow(_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    words = materialize(words.withColumn("c", F.floor(F.log2("n") * 8).cast("int")))
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.coalesce(F.sum(F.when(F.col("word") == END.decode(), F.col("n"))), F.lit(0))).first()
    n_tokens, n_words, n_texts = total
    room, lowest = HEAD, 1 << 20
    for row in words.groupBy("c").count().orderBy(F.desc("c")).collect():
        room -= row["count"]
        if room < 0:
            break
        lowest = row["c"]
    in_head = (F.col("c") >= lowest) & (F.octet_length("word") <= HEAD_BYTES)
    words = words.withColumn("head", in_head)
    top_words = words.where("head").select("word", "n").toArrow()
    head = dict(zip((w.encode("utf-8", "surrogatepass") for w in top_words["word"].to_pylist()), top_words["n"].to_pylist(), strict=True))
    del top_words
    bits = max(3, math.ceil(math.log2(max(1, n_tokens / BUCKET))))
    schema = "bucket int, low binary, high binary, n binary"
    blobs = text.select("text").mapInArrow(_pairs(bits), schema).unionByName(words.select("word", "n").mapInArrow(_singles(bits), schema))
    kept = materialize(blobs.repartitionById(1 << bits, F.col("bucket")).mapInArrow(_buckets, "bucket int, low binary, high binary, level binary, histogram array<long>"))
    histogram = np.zeros(100, np.int64)
    for r in kept.select(F.posexplode("histogram").alias("level", "n")).groupBy("level").agg(F.sum("n").alias("n")).collect():
        histogram[r["level"]] = r["n"]
    stored = int((histogram * np.arange(100)).sum())
    size = -(-max(stored * BITS, 1 << 12) // (1 << bits) // 64) * 64 + 64
    made = materialize(kept.select("bucket", "low", "high", "level").mapInArrow(_segments(size), "bucket int, bits binary"))
    top, spread = int(np.flatnonzero(histogram).max(initial=0)), stored * BITS > most_bits
    marks = np.zeros((0 if spread else 1 << bits, size // 64), np.uint64)
    if not spread:
        for r in made.toLocalIterator():  # a part at a time, so that the driver holds the bits about once
            marks[r["bucket"]] = np.frombuffer(r["bits"], "<u8")
    model = Model(Filter(bits, size, top, marks.ravel()), head, n_tokens, n_words, n_texts, np.full(BINS, 0.1), made if spread else None)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = text.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    table = np.zeros((BINS, RATIOS))
    for r in _each(source, model, shared, _ratios, "bin int, ratio int, n long").groupBy("bin", "ratio").agg(F.sum("n").alias("n")).collect():
        table[r["bin"], r["ratio"]] = r["n"]
    shared.unpersist()
    model.weights = mixture(table)
    return model, words


SCORED = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()), ("word", pa.string()), ("times", pa.int64())])


def _scored(shared, grams: Answers | None = None):
    """A row for each text, and one for each word of it that isn't in the head (word not null)."""

    def run(parts: Iterable[tuple[pa.RecordBatch, Tokens]]) -> Iterator[pa.RecordBatch]:
        model = shared.value.reading(grams)
        all_n, head, n = model.tokens + model.words + 1, pa.array(list(model.head), pa.binary()), np.array([*model.head.values(), -1], np.int64)
        for batch, tokens in parts:
            rows, sizes, texts = tokens.rows, tokens.sizes, len(tokens.sizes)
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            counts = n[pa.compute.fill_null(pa.compute.index_in(tokens.words.cast(pa.binary()), head), -1).to_numpy(zero_copy_only=False)][rows]
            known = counts >= 0
            base = np.add.reduceat(np.where(known, np.log10((np.maximum(counts, 0) + 1) / all_n), 0.0), starts)
            score = model.log10(tokens.hashes[rows], tokens.numerators(model.grams)[rows], sizes)
            none = pa.nulls(texts, pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes), pa.array(np.add.reduceat(known.astype(np.int64), starts)), pa.array(base), pa.array(score), none, pa.nulls(texts, pa.int64())], schema=SCORED)
            rest = np.flatnonzero(~known)
            pairs, times = np.unique((np.repeat(np.arange(texts), sizes)[rest] << 32) | rows[rest], return_counts=True)
            words = tokens.words.take(pa.array(pairs & 0xFFFFFFFF)).cast(pa.string())
            own = batch.column(0).take(pa.array(pairs >> 32))
            yield pa.RecordBatch.from_arrays([own, *(pa.nulls(len(own), k) for k in (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())), words, pa.array(times)], schema=SCORED)

    return run


def score(docs: DataFrame, model: Model, words: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score for each row of docs.

    score is the log10 probability of the whole text by the model; base_score that of single words with add-one smoothing from exact
    counts: those of the head are at hand, the other words of each text are joined with the vocabulary. A null text counts
    as empty, which is the end token alone. Repeated rows stay repeated and score alike, a null doc_id stays null, an empty table gives
    no rows, other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    both = materialize(_each(source, model, shared, _scored, "row long, doc_id long, n_tokens long, n_known long, base double, score double, word string, times long"))
    rare = both.where("word is not null").select("row", "word", "times")
    logs: Column = F.log10((F.coalesce("n", F.lit(0)) + 1) / F.lit(float(model.tokens + model.words + 1)))
    found = rare.join(words.where(~F.col("head")).select("word", "n"), "word", "left")
    sums = found.groupBy("row").agg(F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("rare_known"), F.sum(F.col("times") * logs).alias("rare_base"))
    texts = both.where("word is null").drop("word", "times")
    return texts.join(sums, "row", "left").select("doc_id", "n_tokens", (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), (F.col("base") + F.coalesce("rare_base", F.lit(0.0))).alias("base_score"), "score")
