"""SimHash near-duplicates by covering locality-sensitive hashing (Pagh, 2016)."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, slices
from .components import connected_components

RADIUS, SHINGLE, SEED = 4, 4, 42
#: Members of a bucket that are compared with each other inside one task.
WIDE = 256
#: Shingles whose bits are counted at once.
BLOCK = 1 << 15


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """64-bit SimHash of one text; no words: zero. A bit is set if over half of the shingle hashes have it."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    ones = np.zeros(64, np.int64)
    hash64, space = xxhash.xxh64_intdigest, b" "
    for at in range(0, n, BLOCK):
        end = min(n, at + BLOCK)
        columns = [words[at + k : end + k] for k in range(width)] if n > 1 or len(words) >= width else [[space.join(words)]]
        h = np.fromiter((hash64(space.join(x), SEED) for x in zip(*columns, strict=True)), np.uint64, end - at)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits((2 * ones > n).astype(np.uint8), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        found = np.fromiter((fingerprint(t) for t in batch.column(0).to_pylist()), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(found.view(np.int64))], [*batch.schema.names[1:], "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) for each row of docs; a null text counts as empty."""
    return docs.select(F.col(text_col).cast("string").alias("text"), F.col(id_col).cast("long").alias("doc_id")).mapInArrow(_fingerprints, "doc_id long, fp long")


def covering_masks(radius: int = RADIUS) -> list[int]:
    """2^(radius+1)-1 masks of 64 bits: any two fingerprints within the radius agree on all bits of some mask.

    Bit i gets a nonzero vector of radius+1 bits; mask v has the bits whose vector has an odd number of ones in common
    with v. The vectors of at most `radius` differing bits span less than the whole space, so some v is orthogonal to all of
    them and its mask holds none of the differing bits. Vectors are dealt round-robin, so each mask has about 32 bits.
    """
    last = (1 << (radius + 1)) - 1
    return [sum(((((i % last) + 1) & v).bit_count() & 1) << i for i in range(64)) for v in range(1, last + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _stars(radius: int):
    """Members of a bucket, a sorted array of fingerprints, to links that join just the members that chains of near pairs join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            us, vs = [], []
            for members in batch.column(0).to_pylist():
                x = np.array(members, np.int64)
                near = np.bitwise_count(x[:, None] ^ x[None, :]) <= radius
                rest = np.ones(len(x), bool)
                while rest.any():
                    seen = np.zeros(len(x), bool)
                    seen[first := int(rest.argmax())] = True
                    while (grown := near[seen].any(0)).sum() > seen.sum():
                        seen = grown
                    rest &= ~seen
                    seen[first] = False
                    us += [members[first]] * int(seen.sum())
                    vs += x[seen].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    return run


def _midpoints(radius: int):
    """Each fingerprint with all values within half the radius of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flips = np.array([_signed(sum(1 << i for i in c)) for k in range((radius + 1) // 2 + 1) for c in combinations(range(64), k)], np.int64)
        for batch in slices(batches, 64):
            x = batch.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(x, len(flips))), pa.array((x[:, None] ^ flips[None, :]).ravel())], ["fp", "z"])

    return run


def near_links(fps: DataFrame, radius: int = RADIUS, wide: int = WIDE) -> DataFrame:
    """Links u, v between the distinct longs in fps.fp, enough to connect all that differ in at most `radius` bits.

    Buckets of a table are counted with a combining aggregate; two members are a pair at once, up to `wide` members are
    compared in one task, which holds at most `wide` longs. Larger buckets are solved exactly without comparing their members:
    each member is emitted with every value within radius/2 bits (2,081 for radius 4), and those that share
    such a value are linked to the least of them, a group bounded by the geometry and not by the data. An odd radius
    checks such links by distance, which may leave two members to other buckets or values.
    """
    if radius % 2:
        raise ValueError("an even radius, so that midpoints decide links exactly")
    masks = covering_masks(radius)
    fp = F.col("fp")
    keyed = fps.select("fp", F.explode(F.array(*[F.xxhash64(F.lit(v), fp.bitwiseAND(F.lit(_signed(m)))) for v, m in enumerate(masks)])).alias("key"))
    buckets = materialize(keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("u"), F.max("fp").alias("v")).where("n > 1"))
    pairs = buckets.where("n = 2").select("u", "v").where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= radius)
    members = keyed.join(buckets.where("n > 2").select("key", "n"), "key")
    small = members.where(F.col("n") <= wide).repartition("key").groupBy("key").agg(F.sort_array(F.collect_set("fp")).alias("x"))
    links = pairs.union(small.select("x").mapInArrow(_stars(radius), "u long, v long"))
    if buckets.where(F.col("n") > wide).limit(1).count():
        hot = members.where(F.col("n") > wide).select("fp").distinct()
        around = materialize(hot.mapInArrow(_midpoints(radius), "fp long, z long"))
        least = around.groupBy("z").agg(F.min("fp").alias("u"), F.count("*").alias("n")).where("n > 1")
        links = links.union(around.join(least, "z").where(F.col("u") != fp).select("u", fp.alias("v")).distinct())
    return links


def components(marked: DataFrame, radius: int, wide: int) -> DataFrame:
    """fp, component_id for each different fingerprint of marked (doc_id, fp): the smallest doc_id that it reaches over links."""
    each = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = connected_components(near_links(each, radius, wide), 60).withColumnRenamed("node", "fp")
    rooted = materialize(each.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.join(named, "root").select("fp", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, wide: int = WIDE) -> DataFrame:
    """doc_id, fp, fingerprint (16 hex digits), component_id for each row of docs.

    component_id is the smallest doc_id reachable over links of at most `radius` differing bits, itself included.
    Copies share a fingerprint and are counted once before any bucket is made. Null and wordless texts have
    fingerprint zero and are linked like any other. A null doc_id is kept and never named as a component unless all of
    its component are null. Repeated rows stay repeated; an empty table gives no rows; other columns are ignored.
    """
    marked = materialize(fingerprints(docs, id_col, text_col))
    return marked.join(components(marked, radius, wide), "fp", "left").select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Near copies of texts: words of a shingle, the similarity of their sets from which two texts are linked, bands of a sketch and values of a band, and
#: the similarity by sketches from which the exact one is looked at.
TEXT_SHINGLE, SIMILAR, BANDS, ROWS, LOOK = 5, 0.8, 25, 5, 0.65
SKETCH = BANDS * ROWS
#: Texts, and shingles of theirs, that one task compares; texts of a larger cluster that all its tasks compare with theirs.
MEMBERS, SHINGLES, LEADERS = 2048, 1 << 24, 16
#: Bits of a table of marked rows: 64 to a row, so at most half a million rows of two longs are sent to all tasks, whatever the input.
SLOTS = 1 << 25
_MINS = np.random.default_rng(SEED).integers(1 << 32, 1 << 63, SKETCH, np.int64).astype(np.uint64) | np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingles(words: list[bytes], width: int = TEXT_SHINGLE) -> np.ndarray:
    """The hashes of a text's shingles of `width` words in order; fewer words are one shingle, none give none."""
    if not words:
        return np.zeros(0, np.uint64)
    hash64 = xxhash.xxh64_intdigest
    own = np.fromiter((hash64(w, SEED) for w in words), np.uint64, len(words))
    n, width = max(1, len(words) - width + 1), min(width, len(words))
    h = np.full(n, width, np.uint64)
    for k in range(width):
        h = _mixed(h * np.uint64(0x9E3779B97F4A7C15) + own[k : k + n])
    return h


def shingle_set(words: list[bytes], width: int = TEXT_SHINGLE) -> np.ndarray:
    """The different hashes of a text's shingles, sorted."""
    return np.unique(shingles(words, width))


def sketch(own: np.ndarray) -> bytes:
    """SKETCH min-hash values of a set, a byte each: as a share of them, equal ones tell the similarity of two sets."""
    least = np.full(SKETCH, (1 << 64) - 1, np.uint64)
    for at in range(0, len(own), BLOCK // 8):
        least = np.minimum(least, (_mixed(own[at : at + BLOCK // 8])[:, None] * _MINS[None, :]).min(0))
    return (_mixed(least) >> np.uint64(56)).astype(np.uint8).tobytes()


def _majority(h: np.ndarray) -> int:
    """SimHash of hashes, as a signed long; of none: zero."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), BLOCK):
        ones += np.unpackbits(h[at : at + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits((2 * ones > len(h)).astype(np.uint8), bitorder="little").view("<i8")[0])


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


MARKED = "doc_id long, text_hash long, node long, size long, fp long, sketch binary"


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 256):
        nodes, sizes, fps, sketches = [], [], [], []
        for text in batch.column(0).to_pylist():
            h = shingles(_words(text))
            own = np.unique(h)
            nodes.append(_signed(xxhash.xxh64_intdigest(own.tobytes(), SEED)))
            sizes.append(len(own))
            fps.append(_majority(h))
            sketches.append(sketch(own))
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(fps, pa.int64()), pa.array(sketches, pa.binary())], ["doc_id", "text_hash", "node", "size", "fp", "sketch"])


def _shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 64):
        own = [shingle_set(_words(t)).view(np.int64) for t in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(own, pa.list_(pa.int64()))], ["doc_id", "text_hash", "shingles"])


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of a bucket (node, sketch) to a spanning forest of those pairs whose sketches are alike in LOOK or more."""
    for batch in slices(batches, 64):
        us, vs = [], []
        for members in batch.column(0).to_pylist():
            nodes = [m["node"] for m in members]
            marks = np.frombuffer(b"".join(m["sketch"] for m in members), np.uint8).reshape(len(nodes), SKETCH)
            left = np.arange(len(nodes))
            while len(left):
                front, left = left[:1], left[1:]
                while len(front) and len(left):
                    near = (marks[left] == marks[front[0]]).sum(1) >= LOOK * SKETCH
                    us += [nodes[front[0]]] * int(near.sum())
                    vs += [nodes[x] for x in left[near]]
                    front, left = np.concatenate([front[1:], left[near]]), left[~near]
        yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])


def _compared(table: pa.Table) -> pa.Table:
    """Texts (node, part, sketch, shingles) to the links that join what all pairs of similarity SIMILAR would join, parts being joined already.

    Pairs are those of different parts whose sketches are alike in LOOK or more and whose sizes allow the similarity, the likeliest first; each is
    either of one part by then, or compared by its sets. None is given up because another one failed.
    """
    node, first = np.unique(table.column("node").to_numpy(), return_index=True)
    table = table.take(pa.array(first))
    part = np.unique(table.column("part").to_numpy(), return_inverse=True)[1]
    marks = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(len(node), SKETCH)
    sets = [x.values.to_numpy() for x in table.column("shingles")]
    size = np.array([len(x) for x in sets])
    left, right, like = [], [], []
    for i in range(len(node) - 1):
        may = (part[i + 1 :] != part[i]) & (np.minimum(size[i + 1 :], size[i]) >= SIMILAR * np.maximum(size[i + 1 :], size[i]))
        some = np.flatnonzero(may) + i + 1
        told = (marks[some] == marks[i]).sum(1)
        some, told = some[keep := told >= LOOK * SKETCH], told[keep]
        left.append(np.full(len(some), i, np.int32))
        right.append(some.astype(np.int32))
        like.append(told.astype(np.uint8))
    order = np.argsort(255 - np.concatenate(like), kind="stable") if like else []
    a, b = (np.concatenate(x)[order] if x else np.zeros(0, np.int32) for x in (left, right))
    us, vs, take = [], [], 256
    while len(a):
        for i, j in zip(a[:take].tolist(), b[:take].tolist(), strict=True):
            if part[i] != part[j]:
                common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if common / max(1, size[i] + size[j] - common) >= SIMILAR:
                    part[part == part[j]] = part[i]
                    us.append(node[i])
                    vs.append(node[j])
        a, b = a[take:], b[take:]
        a, b = a[apart := part[a] != part[b]], b[apart]
        take = min(4096, 2 * take)
    return pa.table({"u": pa.array(us, pa.int64()), "v": pa.array(vs, pa.int64())})


def candidates(nodes: DataFrame, members: int = MEMBERS) -> DataFrame:
    """Edges u, v between nodes (node, fp, sketch) that connect all pairs that may be near copies.

    Those within the covering radius of their SimHash fingerprints, as near_links() finds them; and, as a similarity of 0.8 lies beyond that radius, those
    that share a band of their sketches and are alike in LOOK of them (0.99995 of all pairs at 0.8). Buckets of bands are counted by a combining aggregate; only members
    of shared ones get their sketches, `members` of them in a task at most. Those of a larger bucket are all joined to its least one.
    """
    firsts = materialize(nodes.groupBy("fp").agg(F.min("node").alias("first")))
    links = near_links(firsts.select("fp"))
    end = lambda c: firsts.select(F.col("fp").alias(c), F.col("first").alias(f"{c}_first"))
    near = links.join(end("u"), "u").join(end("v"), "v").select(F.col("u_first").alias("u"), F.col("v_first").alias("v"))
    same = nodes.join(firsts, "fp").where(F.col("node") != F.col("first")).select(F.col("first").alias("u"), F.col("node").alias("v"))
    keys = F.array(*[F.xxhash64(F.lit(b), F.substring("sketch", b * ROWS + 1, ROWS)) for b in range(BANDS)])
    keyed = nodes.select("node", F.explode(keys).alias("key"))
    counts = materialize(keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("least")).where("n > 1"))
    shared = materialize(keyed.join(counts, "key"))
    small = shared.where(F.col("n") <= members).join(nodes.select("node", "sketch"), "node")
    grouped = small.groupBy("key").agg(F.collect_list(F.struct("node", "sketch")).alias("x"))
    trees = grouped.select("x").mapInArrow(_trees, "u long, v long")
    stars = shared.where((F.col("n") > members) & (F.col("node") != F.col("least"))).select(F.col("least").alias("u"), F.col("node").alias("v"))
    return near.unionByName(same).unionByName(trees).unionByName(stars)


def _slot(key: Column) -> tuple[Column, Column]:
    at = F.pmod(key, F.lit(SLOTS))
    return F.shiftright(at, 6).alias("slot"), (at % 64).cast("int").alias("bit")


def marked_rows(df: DataFrame, keys: DataFrame, key: Column) -> DataFrame:
    """df with column hit: true for all rows whose key (the same columns in df and keys) is one of keys, and for few others.

    What is sent to all tasks is a table of bits with a bound of its own, at every size of keys: if they fill it, more rows are hit in vain.
    """
    slot, bit = _slot(key)
    bits = keys.select(slot, bit).groupBy("slot").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
    return df.withColumns({"slot": slot, "bit": bit}).join(F.broadcast(bits), "slot", "left").withColumn("hit", F.coalesce(F.expr("shiftright(bits, bit) & 1") == 1, F.lit(False))).drop("slot", "bit", "bits")


def similar_links(clustered: DataFrame, texts: DataFrame, members: int = MEMBERS, most: int = SHINGLES) -> DataFrame:
    """Links u, v that join what all pairs of exact similarity SIMILAR or more join within each cluster; two sets without shingles are one node.

    clustered: node, root (its cluster), size (its shingles), sketch, doc_id, text_hash (of one text of it); texts: text, doc_id, text_hash. Only
    texts of clusters are shingled, which a table of bits of bounded size tells where the texts lie, so no text is shuffled. A cluster of up to `members` texts
    with `most` shingles is one task's work. A larger one is dealt over tasks, each of which has LEADERS texts of the cluster too, so
    near copies of the same text meet; then texts that are not in the part of most of the cluster are compared with all the others, in blocks.
    """
    key = F.xxhash64("doc_id", "text_hash")
    hit = marked_rows(texts, clustered, key).where("hit").select("text", "doc_id", "text_hash")
    sets = hit.mapInArrow(_shingled, "doc_id long, text_hash long, shingles array<long>").dropDuplicates(["doc_id", "text_hash"])
    parts = F.ceil(F.greatest(F.col("n") / members, F.col("total") / most)).cast("int")
    per = clustered.groupBy("root").agg(F.count("*").alias("n"), F.sum("size").alias("total")).withColumn("tasks", parts)
    own = materialize(clustered.join(per.select("root", "n", "tasks"), "root").join(sets, ["doc_id", "text_hash"]).select("root", "n", "tasks", "node", F.col("node").alias("part"), "sketch", "shingles"))
    compare = lambda df, *by: df.groupBy(*by).applyInArrow(_compared, "u long, v long")
    links = materialize(compare(own.where("tasks = 1"), "root"))
    large = own.where("tasks > 1")
    if large.isEmpty():
        return links
    dealt = F.pmod(F.xxhash64("node"), F.col("tasks")).cast("int").alias("task")
    each = F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("task")
    leads = F.pmod(F.xxhash64("node", F.lit(1)), F.greatest(F.lit(1), F.col("n") / LEADERS).cast("long")) == 0
    columns = ("root", "node", "part", "sketch", "shingles")
    first = materialize(compare(large.select(*columns, dealt).unionByName(large.where(leads).select(*columns, each)), "root", "task"))
    told = large.drop("part").join(connected_components(first).withColumnRenamed("root", "part"), "node", "left").withColumn("part", F.coalesce("part", "node"))
    sizes = materialize(told.groupBy("root", "part").agg(F.count("*").alias("k")))
    main = sizes.groupBy("root").agg(F.max_by("part", F.struct("k", "part")).alias("main"), (F.sum("k") - F.max("k")).alias("apart")).where("apart > 0")
    split = told.join(main, "root").withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("apart") * F.col("tasks") / F.col("n"))).cast("int"))
    block = F.pmod(F.xxhash64("node", F.lit(2)), F.col("blocks")).cast("int").alias("block")
    blocks = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
    both = split.select(*columns, dealt, blocks).unionByName(split.where("part <> main").select(*columns, block, each))
    return links.unionByName(first).unionByName(materialize(compare(both, "root", "task", "block")))


def near_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", members: int = MEMBERS) -> DataFrame:
    """doc_id, text_hash, times, component of each different id and text of docs: near copies, joined by links of similar texts, share a component,
    named by the least (doc_id, text_hash) in it.

    Texts with the same set of five-word shingles are one node. candidates() connects nodes that may be near copies to clusters; within a cluster
    every pair that its sketches don't rule out is decided by its sets of shingles, exactly, unless both are joined already. Null ids are left out,
    null texts are empty, texts without words are alike, an empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    own = docs.where(F.col(id_col).isNotNull()).select(text.alias("text"), F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"))
    marked = materialize(own.mapInArrow(_marked, MARKED))
    rep = F.min(F.struct("doc_id", "text_hash", "size", "fp", "sketch")).alias("rep")
    nodes = materialize(marked.groupBy("node").agg(rep).select("node", "rep.*"))
    clustered = materialize(connected_components(candidates(nodes, members)).join(nodes, "node"))
    roots = connected_components(similar_links(clustered, own, members))
    rooted = materialize(nodes.select("node", "doc_id", "text_hash").join(roots, "node", "left").select("node", "doc_id", "text_hash", F.coalesce("root", "node").alias("root")))
    named = rooted.groupBy("root").agg(F.min(F.struct("doc_id", "text_hash")).alias("component"))
    label = rooted.join(named, "root").select("node", "component")
    return marked.groupBy("doc_id", "text_hash", "node").agg(F.count("*").alias("times")).join(label, "node").select("doc_id", "text_hash", "times", "component")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs with one row for each component of near_texts(): the one with the smallest id.

    A row is told apart by its id and its text, so an id that comes with two texts is two documents, in two components perhaps. Of
    different texts of a component's smallest id the one with the least hash stays; of rows that repeat id and text the one with the least hash of
    all columns. The columns are those of docs, whatever their names. Rows without an id stay, as they can't be told apart; an empty table
    gives no rows. Only ids and hashes are compared. Rows that a table of bits of bounded size tells to stay go nowhere, at every size of the input; those that
    it marks, the ones that go and few others, meet the ids in a join.
    """
    key = [F.col(id_col).cast("long").alias("id"), F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("text_hash")]
    own = docs.select(F.struct(*docs.columns).alias("row"), *key)
    stays = (F.col("doc_id") == F.col("component.doc_id")) & (F.col("text_hash") == F.col("component.text_hash"))
    told = near_texts(docs, id_col, text_col).select(F.col("doc_id").alias("id"), "text_hash", "times", stays.alias("stays"))
    told = materialize(told.where("not stays or times > 1"))
    rows = marked_rows(own, told, F.xxhash64("id", "text_hash"))
    maybe = rows.where("hit").drop("hit").join(told, ["id", "text_hash"], "left")
    alone = rows.where("not hit").unionByName(maybe.where("stays is null").withColumn("hit", F.lit(True)).drop("times", "stays"))
    if told.where("stays").isEmpty():
        return alone.select("row.*")
    one = maybe.where("stays").groupBy("id", "text_hash").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return alone.select("row.*").unionByName(one.select("row.*"))
