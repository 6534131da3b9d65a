"""New states of tables: inserts, upserts, transitions, deletes. Parquet has no MERGE: each returns the state to write."""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_type

from tessel.operators.ranks import placed
from tessel.session import release, scratch, settle

#: Of two blocks whose shared groups are counted in a task: rows of one on average, its items at most; pairs that leave at once.
ROWS, ITEMS, PAIRS = 1 << 20, 32768, 1 << 17
#: Packed rows that leave a task at once; least and greatest number of a term's rows of one side that are joined at once.
LEAVE, SIDES = 4096, (2000, 32768)


def upsert(old: DataFrame, new: DataFrame, key: str, keep_if_null: tuple[str, ...] = (), untouched: tuple[str, ...] = (), fixed: dict[str, Column] | None = None) -> DataFrame:
    """Rows of ``new`` overwrite those of ``old``.

    ``keep_if_null``: a null doesn't overwrite; ``untouched``: old values stay; ``fixed``: values that touched rows get.
    """
    o = old.select(F.col(key), F.lit(True).alias("__old"), *[F.col(c).alias(f"__o_{c}") for c in old.columns if c != key])
    n = new.select(F.col(key), F.lit(True).alias("__new"), *[F.col(c).alias(f"__n_{c}") for c in new.columns if c != key])
    both, out = o.join(n, key, "full"), []
    for c in old.columns:
        if c == key:
            out.append(F.col(key))
            continue
        was = F.col(f"__o_{c}")
        now = F.col(f"__n_{c}") if c in new.columns else was
        if c in keep_if_null:
            now = F.coalesce(now, was)
        if c in untouched:
            now = F.when(F.col("__old"), was).otherwise(now)
        if fixed and c in fixed:
            now = fixed[c]
        out.append(F.when(F.col("__new"), now).otherwise(was).alias(c))
    return both.select(*out)


def insert_or_ignore(old: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``old`` and those of ``new`` whose keys are in neither; within ``new`` the first by ``order``."""
    first = new.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("__n = 1").drop("__n")
    return old.unionByName(first.join(old, keys, "left_anti").select(*old.columns))


def insert_strict(old: DataFrame, new: DataFrame, key: str, fixed: dict[str, Column]) -> DataFrame:
    """``old`` and those of ``new`` whose key isn't taken, with ``fixed`` values; ``error`` at old rows whose key was asked for again."""
    again = new.select(key, F.lit("duplicate key").alias("error")).dropDuplicates([key])
    added = new.withColumns(fixed).join(old, key, "left_anti").select(*old.columns, F.lit(None).cast("string").alias("error"))
    return old.join(again, key, "left").select(*old.columns, "error").unionByName(added)


def update_any(rows: DataFrame, wanted: DataFrame, key: str, column: str) -> DataFrame:
    """``rows(key, column)`` after ``wanted(key, to_<column>)``, from any value to any other; unknown keys have an ``error``."""
    both = rows.withColumn("__old", F.lit(True)).join(wanted, key, "full")
    known = F.col("__old").isNotNull()
    return both.select(key, F.when(known, F.coalesce(f"to_{column}", column)).alias(column), F.when(~known, "unknown id").alias("error"))


def add_vectors(old: DataFrame, new: DataFrame, dim: int) -> DataFrame:
    """``old(id, vec)`` and ``new``, whose rows of another length or a taken id have an ``error`` and don't count as added."""
    taken = old.select("id", F.lit(True).alias("__taken")).distinct()
    fault = F.when(F.size("vec") != dim, "dimension").when(F.col("__taken"), "duplicate id")
    return old.select("id", "vec", F.lit(None).cast("string").alias("error")).unionByName(new.join(taken, "id", "left").select("id", "vec", fault.alias("error")))


def queue_outcomes(candidates: DataFrame, known: DataFrame, keys: list[str], confidence: str, order: str, least: float = 0.4) -> DataFrame:
    """``candidates`` with ``outcome``: skipped_low_confidence, skipped_already_known (in ``known`` or queued before, by ``order``), or queued.

    The first sure one of equal keys goes on; whether that is known decides for it, the later ones are known by then.
    """
    sure = F.coalesce(F.col(confidence) >= least, F.lit(False))
    first = candidates.filter(sure).groupBy(*keys).agg(F.min(order).alias("__first")).toDF(*[f"__{k}" for k in keys], "__first")
    there = known.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.lit(True).alias("__known")).distinct()
    rows = candidates.join(first, [F.equal_null(F.col(k), F.col(f"__{k}")) for k in keys], "left").join(there, [F.equal_null(F.col(k), F.col(f"__k_{k}")) for k in keys], "left")
    outcome = F.when(~sure, "skipped_low_confidence").when(F.col("__known") | (F.col(order) > F.col("__first")), "skipped_already_known").otherwise("queued")
    return rows.select(*candidates.columns, outcome.alias("outcome"))


def transition(rows: DataFrame, wanted: DataFrame, key: str, allowed: dict[str, str]) -> DataFrame:
    """``rows(key, status)`` after ``wanted(key, to_status)``, with ``error`` where a status doesn't allow it.

    ``allowed``: target status to the status it must come from.
    """
    both = rows.join(wanted, key, "left")
    source = F.create_map(*[F.lit(x) for kv in allowed.items() for x in kv])
    ok = F.col("status") == F.try_element_at(source, F.col("to_status"))
    return both.select(
        *[c for c in rows.columns if c != "status"],
        F.when(ok, F.col("to_status")).otherwise(F.col("status")).alias("status"),
        F.when(F.col("to_status").isNotNull() & ~F.coalesce(ok, F.lit(False)), "invalid transition").alias("error"),
    )


def delete_cascade(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return rows.join(gone, key, "left_anti")


def delete_set_null(rows: DataFrame, gone: DataFrame, column: str, key: str) -> DataFrame:
    """``rows`` with ``column`` null where it refers to a deleted ``key``."""
    g = gone.select(F.col(key).alias("__gone")).distinct()
    return rows.join(g, F.col(column) == F.col("__gone"), "left").withColumn(column, F.when(F.col("__gone").isNull(), F.col(column))).drop("__gone")


def keep_newest(rows: DataFrame, order: str, n: int, by: tuple[str, ...] = ()) -> DataFrame:
    """The ``n`` greatest rows by ``order``, of each group of ``by``."""
    w = W.partitionBy(*by).orderBy(F.desc(order))
    return rows.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= n).drop("__n") if by else rows.orderBy(F.desc(order)).limit(n)


def with_columns(rows: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """``rows`` with missing columns added and nulls in them filled."""
    return rows.withColumns({c: F.coalesce(F.col(c), v) if c in rows.columns else v for c, v in defaults.items()})


def diff(left: DataFrame, right: DataFrame, key: str, leave_out: tuple[str, ...] = ()) -> DataFrame:
    """(key, field, left, right, equal) for all fields of either side."""
    def long(df: DataFrame, name: str) -> DataFrame:
        fields = [c for c in df.columns if c != key and c not in leave_out]
        pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias(name)) for c in fields])
        return df.select(key, F.explode(pairs).alias("p")).select(key, "p.*")

    both = long(left, "left_value").join(long(right, "right_value"), [key, "field"], "full")
    return both.withColumn("equal", F.equal_null("left_value", "right_value"))


def shared_pairs(rows: DataFrame, group: str, item: str, least: int = 2, k: int = 1, size: int | None = None) -> DataFrame:
    """(a, b, shared): pairs a < b of items that share ``least`` groups or more, over groups of ``k`` items or more.

    Items are cut by their order into blocks of ``size``, and a task counts the pairs of two blocks from their rows in the
    groups that both have members of. So a row is sent once for each block of its group, and no pair is shuffled. What is
    written and sent is a row for each group and block, its items packed as differences, a byte or two each. ``size``
    is by default what ``ROWS`` rows hold on average, and less if that gives the cores too few pairs of blocks.
    """
    spark, of, cores = rows.sparkSession, rows.schema[item].dataType.simpleString(), rows.sparkSession.sparkContext.defaultParallelism
    raw = rows.select(F.col(group).alias("g"), F.col(item).alias("x")).filter("g IS NOT NULL AND x IS NOT NULL")
    many, different = raw.agg(F.count("*"), F.approx_count_distinct(F.struct("g", "x"))).first()
    with scratch(spark):
        items, n = placed(raw.select("x").distinct(), ["x"])
        if size is None:
            size = max(1, min(n * ROWS // max(1, different), ITEMS, -(-n // int(1 + (6 * cores) ** 0.5))))
        blocks = -(-n // size)
        firsts = [r["x"] for r in items.filter((F.col("place") - 1) % size == 0).select("x").orderBy("x").collect()]  # one row a block
    firsts = pa.array(firsts, to_arrow_type(rows.schema[item].dataType))
    packed = f"g {rows.schema[group].dataType.simpleString()}, block int, m int, xs binary"
    dealt = raw.mapInArrow(_packed_members(firsts), packed).repartition(max(2 * cores, min(-(-many // ROWS), 4096)), "g", "block").sortWithinPartitions("g", "block")
    dealt = settle(dealt.mapInArrow(_joined_members(firsts.type), packed), "dealt-members")
    held = dealt.groupBy("g").agg(F.sum("m").alias("m"), F.collect_list("block").alias("blocks"))
    held = settle(held.filter(F.col("m") >= k).select("g", "blocks"), "group-blocks")
    sent = dealt.select("g", "m", "xs", "block").join(held, "g").select("g", "m", "xs", "block", F.explode("blocks").alias("other"))
    sent = sent.select("g", "m", "xs", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    parts = max(2 * cores, min(blocks * (blocks + 1) // 2, 4096))
    return sent.repartition(parts, "i", "j").sortWithinPartitions("i", "j").mapInArrow(_pairs_of_cells(least, firsts.type), f"a {of}, b {of}, shared long")


def _pack(x: np.ndarray) -> bytes:
    """Values in ascending order: whole numbers as the first one and the differences, in as few bytes each as hold them."""
    if x.dtype.kind != "i":
        return pickle.dumps(x.tolist())
    x = x.astype(np.int64)
    steps = np.diff(x.view(np.uint64))
    return x[:1].tobytes() + steps.astype(np.min_scalar_type(steps.max(initial=0))).tobytes()


def _unpack(xs: bytes, m: int, of: pa.DataType) -> np.ndarray:
    if not pa.types.is_signed_integer(of):
        return pa.array(pickle.loads(xs), of).to_numpy(zero_copy_only=False)
    out = np.empty(m, np.uint64)
    out[0] = np.frombuffer(xs, np.uint64, 1)[0]
    if m > 1:
        out[1:] = np.frombuffer(xs, f"u{(len(xs) - 8) // (m - 1)}", offset=8)
    return np.cumsum(out, dtype=np.uint64).view(np.int64)


def _packed_members(firsts: pa.Array):
    def packed(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (g, x), ROWS of them at a time: a row for each group and block of items, each item once."""
        held, n, bounds = [], 0, firsts.to_numpy(zero_copy_only=False)
        for batch in rows:
            held.append(batch)
            n += batch.num_rows
            if n >= ROWS:
                yield from _members(held, bounds)
                held, n = [], 0
        if n:
            yield from _members(held, bounds)

    return packed


def _members(held: list[pa.RecordBatch], bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
    rows = pa.Table.from_batches(held)
    g = rows.column("g").combine_chunks().dictionary_encode()
    group, (items, slot) = g.indices.to_numpy().astype(np.int64), np.unique(rows.column("x").to_numpy(), return_inverse=True)
    of = np.searchsorted(bounds, items, "right") - 1
    both = np.unique(group * len(items) + slot)
    group, slot = both // len(items), both % len(items)
    cuts = np.flatnonzero(np.append(True, (np.diff(group) != 0) | (np.diff(of[slot]) != 0)))
    ends, x = np.append(cuts[1:], len(group)), items[slot]
    for at in range(0, len(cuts), LEAVE):
        lo, hi = cuts[at : at + LEAVE], ends[at : at + LEAVE]
        xs = pa.array([_pack(x[a:b]) for a, b in zip(lo, hi, strict=True)], pa.binary())
        yield pa.RecordBatch.from_arrays([g.dictionary.take(pa.array(group[lo])), pa.array(of[slot[lo]], pa.int32()), pa.array(hi - lo, pa.int32()), xs], ["g", "block", "m", "xs"])


def _joined_members(of: pa.DataType):
    def joined(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows in order of group and block: those of the same become one."""
        out, last, parts, size = [], None, [], 0

        def closed() -> dict:
            x = np.unique(np.concatenate([_unpack(xs, m, of) for m, xs in parts])) if len(parts) > 1 else None
            m, xs = parts[0] if x is None else (len(x), _pack(x))
            return {"g": last[0], "block": last[1], "m": m, "xs": xs}

        for batch in rows:
            for g, block, m, xs in zip(*(batch.column(c).to_pylist() for c in ("g", "block", "m", "xs")), strict=True):
                if (g, block) != last or size > ROWS:
                    if parts:
                        out.append(closed())
                    parts, size = [], 0
                    if (g, block) == last:  # many doubles: joined so far
                        r = out.pop()
                        parts, size = [(r["m"], r["xs"])], 0
                    last = (g, block)
                parts.append((m, xs))
                size += m
            if len(out) >= LEAVE:
                yield pa.RecordBatch.from_pylist(out, batch.schema)
                out = []
        if parts:
            yield pa.RecordBatch.from_pylist([*out, closed()], batch.schema)

    return joined


def _pairs_of_cells(least: int, of: pa.DataType):
    def cells(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (g, m, xs, block, i, j) in order of i and j: the pairs of each (i, j), which lie together."""
        held, now = [], None
        for batch in rows:
            at = np.stack([batch.column(c).to_numpy() for c in ("i", "j")])
            cuts = [0, *(np.flatnonzero((np.diff(at) != 0).any(0)) + 1), batch.num_rows]
            for lo, hi in zip(cuts, cuts[1:]):
                if hi > lo and tuple(at[:, lo]) != now:
                    yield from _pairs_of_cell(held, least, of)
                    held, now = [], tuple(at[:, lo])
                held.append(batch.slice(lo, hi - lo))
        yield from _pairs_of_cell(held, least, of)

    return cells


def _pairs_of_cell(held: list[pa.RecordBatch], least: int, of: pa.DataType) -> Iterator[pa.RecordBatch]:
    if not held:
        return
    rows = pa.Table.from_batches(held)
    g = rows.column("g").combine_chunks().dictionary_encode()
    codes, block, m = (c.to_numpy() for c in (g.indices, rows.column("block"), rows.column("m")))
    each = [_unpack(xs.as_py(), n, of) for xs, n in zip(rows.column("xs"), m.tolist(), strict=True)]

    def side(which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Items in order, and of each member its item's place among them and its group."""
        items, slot = np.unique(np.concatenate([each[n] for n in which]), return_inverse=True)
        return items, slot, np.repeat(codes[which], m[which])

    i, j = rows.column("i")[0].as_py(), rows.column("j")[0].as_py()
    one = i == j
    lefts, slot, group = side(np.flatnonzero(block == i))
    order = np.argsort(slot, kind="stable")
    starts, group_of = np.searchsorted(slot[order], np.arange(len(lefts) + 1)), group[order]
    rights, slot, group = (lefts, slot, group) if one else side(np.flatnonzero(block == j))
    order = np.lexsort((slot, group))
    members, bounds = slot[order], np.searchsorted(group[order], np.arange(len(g.dictionary) + 1))
    found, size = [], 0
    for a, (lo, hi) in enumerate(zip(starts, starts[1:])):
        shared = np.bincount(np.concatenate([members[bounds[n] : bounds[n + 1]] for n in group_of[lo:hi]]))
        skip = a + 1 if one else 0
        b = np.flatnonzero(shared[skip:] >= least) + skip
        found.append((a, b, shared[b]))
        size += len(b)
        if size > PAIRS:
            yield _found(lefts, rights, found, of)
            found, size = [], 0
    if size:
        yield _found(lefts, rights, found, of)


def _found(lefts: np.ndarray, rights: np.ndarray, found: list, of: pa.DataType) -> pa.RecordBatch:
    a = np.repeat([a for a, _, _ in found], [len(b) for _, b, _ in found])
    b, shared = (np.concatenate([f[n] for f in found]) for n in (1, 2))
    return pa.RecordBatch.from_arrays([pa.array(lefts[a], of), pa.array(rights[b], of), pa.array(shared, pa.int64())], ["a", "b", "shared"])


def first_matches(asked: DataFrame, known: DataFrame, size: int | None = None) -> DataFrame:
    """``asked(query_id, pos, term)`` and ``known(term, id)`` to (query_id, id, pos): the least place at which a query names an id.

    A pair is given where its first common term is, so pairs aren't shuffled: a query's row has the terms before its own, an
    id's row all of its terms, as numbers. The rows of a term are cut into blocks of about ``size`` on both sides and each two
    blocks are joined by themselves, so a term of any size is dealt over many tasks. A row is sent once for each block of the
    other side: ``size`` is by default as large as leaves the cores 16 times as many joins of blocks, within ``SIDES``.
    """
    cores = asked.sparkSession.sparkContext.defaultParallelism
    bits = lambda terms: F.aggregate(terms, F.lit(0).cast("long"), lambda b, t: b.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(t), F.lit(63)).cast("int"))))
    q = settle(asked.filter("term IS NOT NULL").groupBy("query_id", "term").agg(F.min("pos").alias("pos")), "asked-texts")
    k = settle(known.filter("term IS NOT NULL").select("id", "term").distinct(), "known-texts")
    count = lambda rows, name: rows.groupBy("term").agg(F.count("*").alias(name))
    terms = settle(count(q, "nq").join(count(k, "nk"), "term").withColumn("t", F.monotonically_increasing_id()), "terms")
    pairs = terms.agg(F.coalesce(F.sum(F.col("nq") * F.col("nk")), F.lit(0))).first()[0]
    if size is None:
        size = min(max(SIDES[0], math.isqrt(pairs // (16 * cores))), SIDES[1])
    parts = max(cores, min(-(-4 * pairs // (size * size)), 16384))
    sizes = terms.select("t", *[F.ceil(F.col(n) / size).cast("int").alias(c) for n, c in (("nq", "cq"), ("nk", "ck"))])
    own, texts = terms.select("term", "t"), (q, k)
    q = q.join(own, "term").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("pos", "t"))).alias("terms")).select("query_id", "terms", F.posexplode("terms").alias("n", "own"))
    q = q.select("query_id", "own.pos", "own.t", F.transform(F.slice("terms", F.lit(1), F.col("n")), lambda x: x["t"]).alias("earlier"))
    q = settle(q.withColumn("q_bits", bits(F.col("earlier"))), "asked-terms")
    k = k.join(own, "term").groupBy("id").agg(F.collect_set("t").alias("terms"))
    k = settle(k.select("id", "terms", bits(F.col("terms")).alias("k_bits"), F.explode("terms").alias("t")), "known-terms")
    release(*texts)

    def cut(rows: DataFrame, key: str, own: str, at: str, other: str, copies: str) -> DataFrame:
        dealt = rows.join(sizes.select("t", own, other), "t").withColumn(at, F.pmod(F.xxhash64(key), F.col(own)).cast("int"))
        return dealt.withColumn(copies, F.explode(F.sequence(F.lit(0), F.col(other) - 1))).drop(own, other).repartition(parts, "t", "i", "j")

    # in order of the blocks, so that pairs that lie together in files are alike
    both = cut(q, "query_id", "cq", "i", "ck", "j").sortWithinPartitions("t", "i", "j").join(cut(k, "id", "ck", "j", "cq", "i").hint("shuffle_hash"), ["t", "i", "j"])
    # bits that don't meet tell most pairs without a comparison of terms
    return both.filter((F.col("q_bits").bitwiseAND(F.col("k_bits")) == 0) | ~F.arrays_overlap("earlier", "terms")).select("query_id", "id", "pos")


def get_batch(rows: DataFrame, ids: list, key: str) -> DataFrame:
    """The rows of the ids given, unknown ids left out; no ids, no scan. The ids reach the scan as a predicate."""
    return rows.filter(F.col(key).isin(ids)) if ids else rows.limit(0)


def add_edges(curated: DataFrame, found: DataFrame, ids: DataFrame) -> DataFrame:
    """``curated(course_id, target, requirement)`` and ``found(course_id, code)``, whose code ``ids(code, target)`` resolves.

    References to oneself, to nothing and to a pair that is already there are left out; a pair found twice comes once.
    """
    code = F.upper(F.trim("code"))
    named = found.withColumn("code", code).join(ids, "code").filter("target <> course_id").select("course_id", "target").distinct()
    fresh = named.join(curated, ["course_id", "target"], "left_anti").withColumn("requirement", F.lit("required"))
    return curated.unionByName(fresh)


def merge_fields(old: DataFrame, new: DataFrame, key: str, fields: list[str], valid: dict[str, Column] | None = None) -> DataFrame:
    """``old`` with the listed fields of ``new`` where they hold something (no null, no empty text or list) that is ``valid``.

    Fields that aren't listed are never touched; rows of ``new`` without one in ``old`` are left out.
    """
    types = dict(new.dtypes)
    full = lambda c: F.size(c) > 0 if types[c].startswith("array") else F.trim(c) != "" if types[c] == "string" else F.col(c).isNotNull()
    ok = lambda c: full(c) & (valid or {}).get(c, F.lit(True))
    taken = new.select(F.col(key), *[F.when(ok(c), F.col(c)).alias(f"__{c}") for c in fields])
    both = old.join(taken, key, "left")
    return both.select(*[F.coalesce(f"__{c}", c).alias(c) if c in fields else F.col(c) for c in old.columns])


def violations(rows: DataFrame, key: str, checks: dict[str, Column], unique: dict[str, list[str]], refers: dict[str, tuple[str, DataFrame]]) -> DataFrame:
    """(key, rule) of each broken rule. ``checks``: must not be false (null passes); ``unique``: columns equal in no other row,
    null equal to nothing; ``refers``: a column and a table of one column that must hold its values (null passes)."""
    broken = F.array_compact(F.array(*[F.when(~c, F.lit(n)) for n, c in checks.items()]))
    out = rows.select(key, F.explode(broken).alias("rule"))
    for name, columns in unique.items():
        twice = rows.dropna(subset=columns).groupBy(*columns).agg(F.count("*").alias("__n")).filter("__n > 1").select(*columns)
        out = out.unionByName(rows.join(twice, columns, "left_semi").select(key, F.lit(name).alias("rule")))
    for name, (column, target) in refers.items():
        there = target.toDF(column)
        out = out.unionByName(rows.filter(F.col(column).isNotNull()).join(there, column, "left_anti").select(key, F.lit(name).alias("rule")))
    return out
