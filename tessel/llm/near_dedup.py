"""MinHash near-dedup with weighted DartMinHash signatures.

A document is the multiset of its windows of five words (a shorter text is one window). Darts are thrown by hashing:
every unit of an element's weight carries a Poisson process of darts along a rank axis, each dart has a coordinate, and
the signature keeps the earliest dart of each coordinate that lies in the document's region (weight by rank). As the
rank bound shrinks with the total weight, about k ln k darts are looked at however long the text. Two documents agree
in a coordinate with the probability of their weighted Jaccard similarity.

Signatures of ``BANDS * ROWS`` coordinates are cut into bands and joined on equal bands; a pair at similarity 0.8 has
no band in common in 3 of 100,000 cases. Candidates are verified with their exact similarity, in two rounds, so that a
bucket of m documents doesn't give m^2 rows: first all against one leader a bucket, another one in each band, whose text
goes once to each ``MEMBERS`` of them; then, where a bucket still spans several components, between those components.
Before that second round documents are left out that can't have a link there, as too many of their windows occur in no
other document concerned; the others are dealt into slabs of some ``LOAD`` windows of a bucket, each two slabs are a
group for a task, and a pair of documents is looked at in its first common band, if their components differ. All pairs
within a bucket are then verified, ruled out by an exact bound, or in one class already: no link is lost. What a group
holds is bounded, the number of groups grows with the square of a bucket's slabs. Classes are the connected components
of links, found by alternating large-star and small-star steps.

Work is done on distinct texts (by MD5), copies are only given their text's class. The class id is the least doc_id.

Cases: null and empty texts, and those without words, have no windows and are classes of their own; rows without doc_id
belong to their text's class, whose id is null if no row of it has one; rows that share a doc_id are told apart by their
texts; repeated rows get equal results, and ``deduplicate`` keeps one of them; an empty table gives an empty result;
columns besides doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.llm.words import batches, mix64, shingle_hashes, slices, word_hashes, words_of
from tessel.session import release, scratch, settle, table

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 26, 5
MEMBERS, LOAD = 64, 1 << 18
_STEP, _UNIT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)


def weighted_set(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct window hashes, in order, and their counts."""
    return np.unique(shingle_hashes(word_hashes(words_of(text)), SHINGLE), return_counts=True)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard of sets in order: sum of least over sum of greatest weights."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    hit = b[0][at] == a[0]
    both = np.minimum(a[1][hit], b[1][at[hit]]).sum()
    return float(both / (a[1].sum() + b[1].sum() - both))


def _uniform(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def _darts(cells: np.ndarray, share: np.ndarray, bound: float) -> tuple[np.ndarray, np.ndarray]:
    """Darts (hash, rank) of rank under ``bound`` in unit cells; of a cell's width only ``share`` belongs to the set."""
    found, ranks = [], []
    rank, n = np.zeros(len(cells)), 0
    wide = int(bound + 6 * bound**0.5 + 8)
    if len(cells) * wide <= 4096:  # few cells: their darts all at once
        h = mix64(cells[:, None] + _STEP * np.arange(1, wide + 1, dtype=np.uint64))
        r = np.cumsum(-np.log(_uniform(h)), 1)
        at = r < bound
        found, ranks = [h[at]], [r[at]]
        shares = [np.broadcast_to(share[:, None], r.shape)[at]]
        more = r[:, -1] < bound
        cells, share, rank, n = cells[more], share[more], r[more, -1], wide
    else:
        shares = []
    while len(cells):
        n += 1
        h = mix64(cells + np.array([n], np.uint64) * _STEP)
        rank = rank - np.log(_uniform(h))
        on = rank < bound
        cells, share, rank, h = cells[on], share[on], rank[on], h[on]
        found.append(h)
        ranks.append(rank)
        shares.append(share)
    h, r, s = np.concatenate(found), np.concatenate(ranks), np.concatenate(shares)
    if (s < 1).any():
        inside = _uniform(mix64(h ^ _UNIT)) < s
        h, r = h[inside], r[inside]
    return h, r


def dart_minhash(keys: np.ndarray, weights: np.ndarray, k: int) -> np.ndarray:
    """The hash of the earliest dart of each of ``k`` coordinates, for elements of any positive weights."""
    weights = np.asarray(weights, float)
    units = np.ceil(weights).astype(np.int64)
    if (units == 1).all():
        cells, unit = mix64(keys + _UNIT), np.zeros(len(keys))
        each = weights
    else:
        unit = np.arange(units.sum()) - np.repeat(np.cumsum(units) - units, units)
        cells = mix64(np.repeat(keys, units) + _UNIT * (unit.astype(np.uint64) + np.uint64(1)))
        each = np.repeat(weights, units)
    share = np.minimum(each - unit, 1.0)
    bound = (k * np.log(k) + 2 * k) / weights.sum()
    while True:
        h, r = _darts(cells, share, bound)
        coordinate = (mix64(h + _STEP) % np.uint64(k)).astype(np.int64)
        order = np.lexsort((r, coordinate))
        coordinate, h = coordinate[order], h[order]
        first = np.flatnonzero(np.diff(coordinate, prepend=-1))
        if len(first) == k:
            return h[first]
        bound *= 2


def band_keys(signature: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    parts = signature.reshape(bands, rows)
    key = mix64(np.arange(1, bands + 1, dtype=np.uint64))
    for i in range(rows):
        key = mix64(key + parts[:, i])
    return key.view(np.int64)


def _sign(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in batches(rows):
        out = []
        for t in texts:
            keys, weights = weighted_set(t)
            out.append(band_keys(dart_minhash(keys, weights, BANDS * ROWS)) if len(keys) else None)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("node"), pa.array(out, pa.list_(pa.int64()))], ["doc_id", "node", "bands"])


def _verify(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) from rows in order: a leader's text (b null), then those of its members."""
    leader = None
    for batch in slices(rows):
        close = []
        for b, t in zip(batch.column("b").to_pylist(), batch.column("text").to_pylist(), strict=True):
            if b is None:
                leader = weighted_set(t)
            close.append(b is not None and similarity(leader, weighted_set(t)) >= SIMILARITY)
        yield batch.select(["a", "b"]).filter(pa.array(close, pa.bool_()))


def _links(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of ``pairs(a, b, n)`` that are similar enough, by their exact similarity; n is about the members of leader a.

    Members are dealt into chunks, each of which meets the leader's text once; a task streams through its chunks in order.
    """
    dealt = pairs.select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / MEMBERS)).alias("chunk"))
    members = dealt.join(texts.select(F.col("node").alias("b"), "text"), "b").select("a", "chunk", "b", "text")
    leaders = dealt.select("a", "chunk").distinct().join(texts.select(F.col("node").alias("a"), "text"), "a")
    both = members.unionByName(leaders.select("a", "chunk", F.lit(None).cast("binary").alias("b"), "text"))
    return both.repartition("a", "chunk").sortWithinPartitions("a", "chunk", "b").select("a", "b", "text").mapInArrow(_verify, "a binary, b binary")


def _windows(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in batches(rows):
        sets = [weighted_set(t) for t in texts]
        keys = pa.array([k.view(np.int64) for k, _ in sets], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays(
            [batch.column("node"), pa.array([int(w.sum()) for _, w in sets], pa.int64()), keys, pa.array([w for _, w in sets], pa.list_(pa.int64()))], ["node", "n", "keys", "weights"]
        )


def _lists(column: pa.ChunkedArray, kind: type) -> list[np.ndarray]:
    """A column of lists of numbers as views."""
    x = column.combine_chunks()
    if isinstance(x, pa.ChunkedArray):
        x = x.chunk(0)
    values, at = x.values.to_numpy(zero_copy_only=False).view(kind), x.offsets.to_numpy()
    return [values[i:j] for i, j in zip(at, at[1:])]


def _test_slabs(key: tuple, group: pa.Table) -> pa.Table:
    """Links between components within a group (band, key, i, j): between its two slabs, or in its one slab."""
    band, one = key[0].as_py(), key[2].as_py() == key[3].as_py()
    nodes, names = group["node"].to_pylist(), group["label"].to_pylist()
    code = {x: i for i, x in enumerate(dict.fromkeys(names))}
    labels = np.array([code[x] for x in names])
    n, s, slab = (group[c].to_numpy() for c in ("n", "s", "slab"))
    bands = np.stack(_lists(group["bands"], np.int64))
    keys, weights = _lists(group["keys"], np.uint64), _lists(group["weights"], np.int64)
    up = list(range(len(code)))  # labels joined so far

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    out = []
    for i in range(len(nodes)):
        rest = slice(i + 1, None)
        able = (labels[rest] != labels[i]) & (np.minimum(s[rest], s[i]) * (1 + SIMILARITY) >= SIMILARITY * (n[rest] + n[i]) - 1e-6)
        if not one:
            able &= slab[rest] != slab[i]
        at = np.flatnonzero(able)
        if not len(at):
            continue
        at += i + 1
        at = at[(bands[at] == bands[i]).argmax(1) == band]
        for j in at.tolist():
            x, y = root(labels[i]), root(labels[j])
            if x != y and similarity((keys[i], weights[i]), (keys[j], weights[j])) >= SIMILARITY:
                up[x] = y
                out.append((nodes[i], nodes[j]))
    return pa.table({"a": pa.array([x for x, _ in out], pa.binary()), "b": pa.array([x for _, x in out], pa.binary())})


def _cross_links(open_rows: DataFrame, texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links between components of ``open_rows(band, key, node, label)``, by blocks of documents."""
    windows = settle(texts.join(open_rows.select("node").distinct(), "node", "left_semi").mapInArrow(_windows, "node binary, n long, keys array<bigint>, weights array<bigint>"), "windows")
    each = windows.select("node", F.explode(F.arrays_zip("keys", "weights")).alias("w")).select("node", "w.*")
    alone = each.groupBy("keys").agg(F.count("*").alias("df"), F.min("node").alias("node"), F.sum("weights").alias("w")).filter("df = 1").groupBy("node").agg(F.sum("w").alias("alone"))
    sizes = settle(windows.select("node", "n").join(alone, "node", "left").select("node", "n", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("s")), "shared")

    # similarity t needs an overlap of t / (1 + t) of both sizes, which s bounds; no partner is smaller than t times n or the bucket's least
    rows = settle(open_rows.join(sizes, "node"), "open-sizes")
    least = rows.groupBy("band", "key").agg(F.min("n").alias("least"))
    smallest = F.greatest(F.col("least"), SIMILARITY * F.col("n"))
    rows = rows.join(least, ["band", "key"]).filter(F.col("s") * (1 + SIMILARITY) >= SIMILARITY * (F.col("n") + smallest) - 1e-6).drop("least")
    rows = settle(rows, "open-able")
    able = rows.groupBy("band", "key").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.ceil(F.sum("n") / LOAD).alias("slabs")).filter("x <> y").drop("x", "y")
    dealt = rows.join(able, ["band", "key"]).withColumn("slab", F.pmod(F.xxhash64("node", "band"), F.col("slabs")))
    dealt = dealt.join(nodes, "node").join(windows.drop("n"), "node").withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slabs") - 1)))
    dealt = dealt.withColumn("i", F.least("slab", "with")).withColumn("j", F.greatest("slab", "with"))
    columns = ["band", "key", "i", "j", "node", "label", "n", "s", "slab", "bands", "keys", "weights"]
    return dealt.select(*columns).groupBy("band", "key", "i", "j").applyInArrow(_test_slabs, "a binary, b binary").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of all nodes in ``edges(a, b)``: the least node of the connected component."""
    edges = settle(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        # large star: greater neighbours to the least one; as u > v holds, these are the edges' ends v with their u
        large = edges.join(least.withColumnRenamed("u", "v"), "v").select("u", F.col("m").alias("v"))
        large = settle(large.distinct(), "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        # small star: lesser neighbours, and the node itself, to the least one
        small = large.join(least, "u").select("u", "v", "m", "n")
        small = small.select("n", F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("n", "e.*")
        after = settle(small.filter("u <> v").groupBy("u", "v").agg(F.max("n").alias("n")), "small-star")
        release(edges, large)
        # done when no node had two lesser neighbours and no least node has a lesser one
        if after.filter("n > 1").isEmpty() and after.join(after.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            break
        edges = settle(after.select("u", "v"), "edges")
        release(after)
    found = after.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(after.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
    labels = settle(found, "labels")
    release(after)
    return labels


def labelled(docs: DataFrame) -> DataFrame:
    """(doc_id, node, label) for each row of ``docs``, settled; node is the text's MD5, the label null where a text has no words."""
    of = docs.schema["doc_id"].dataType.simpleString()
    with scratch(docs.sparkSession) as keep:
        rows = docs.select("doc_id", "text").withColumn("node", node_of("text"))
        signed = settle(rows.mapInArrow(_sign, f"doc_id {of}, node binary, bands array<bigint>"), "signatures")
        firsts = settle(signed.filter("bands is not null").groupBy("node").agg(F.first("bands").alias("bands")), "nodes")
        keyed = firsts.select("node", F.posexplode("bands").alias("band", "key"))

        # buckets of two texts or more; the leader is another one in each band
        rank = F.struct(F.xxhash64("node", "band").alias("h"), F.col("node").alias("leader"))
        buckets = keyed.groupBy("band", "key").agg(F.min(rank)["leader"].alias("leader"), F.count("*").alias("n")).filter("n > 1")
        members = settle(keyed.join(buckets, ["band", "key"]), "members")
        texts = rows.join(members.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.first("text").alias("text"))
        texts = settle(texts, "texts")

        pairs = members.filter("node <> leader").groupBy(F.col("leader").alias("a"), F.col("node").alias("b")).agg(F.max("n").alias("n"))
        links = settle(_links(pairs, texts), "links")
        labels = components(links)
        named = members.join(labels, "node", "left").select("band", "key", "node", F.coalesce("label", "node").alias("label"))
        open_ = named.groupBy("band", "key").agg(F.min("label").alias("l"), F.max("label").alias("m")).filter("l <> m").select("band", "key")
        rest = settle(named.join(open_, ["band", "key"]), "open-buckets")
        release(members)
        more = settle(_cross_links(rest, texts, firsts), "more-links")
        if not more.isEmpty():
            labels = components(links.unionByName(more))

        found = signed.join(labels, "node", "left").select("doc_id", "node", F.when(F.col("bands").isNotNull(), F.coalesce("label", "node")).alias("label"))
        keep.append(settle(found, "classes"))
    return keep[0]


def node_of(text: str) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def near_classes(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, class_size for each row of ``docs``; class_size counts rows."""
    found = labelled(docs)
    sizes = found.filter("label is not null").groupBy("label").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
    alone = found.filter("label is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"))
    return found.join(sizes, "label").select("doc_id", "class_id", "class_size").unionByName(alone)


def deduplicate(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each class: of the least doc_id (null last), then the least MD5 of its text.

    Rows without words are classes of their own and stay. Rows equal in doc_id and text are one document; one of them,
    which needn't be the same in other columns each time, stays.
    """
    found = labelled(docs)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "node")).alias("first")
    chosen = found.filter("label is not null").groupBy("label").agg(first).select("first.doc_id", "first.node")
    times = found.filter("label is not null").groupBy("doc_id", "node").agg(F.count("*").alias("__rows"))
    times = times.select(F.col("doc_id").alias("__id"), F.col("node").alias("__node"), "__rows")
    stay = settle(times.join(chosen, F.equal_null("__id", "doc_id") & (F.col("__node") == F.col("node"))).select("__id", "__node", "__rows"), "stay")
    release(found)
    # the texts are hashed to the narrow side, not sorted
    kept = docs.join(stay.hint("shuffle_hash"), F.equal_null(docs["doc_id"], F.col("__id")) & (node_of("text") == F.col("__node")))
    if not stay.filter("__rows > 1").isEmpty():
        kept = kept.filter("__rows = 1").unionByName(kept.filter("__rows > 1").dropDuplicates(["__id", "__node"]))
    wordless = docs.filter(~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)))
    return kept.select(*docs.columns).unionByName(wordless)


def minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query: the classes of all ``documents``."""
    return near_classes(table(spark, sf_dir, "documents"))
