"""Near-duplicate texts by HyperMinHash.

A text is the set of its 5-word shingles. In its sketch a shingle's hash picks a register,
and of the least remaining hash in it the register keeps the number of leading zeros and
the 10 bits behind the first one, 16 bits in place of 64. Bands of 5 registers
are the keys by which texts meet. For that an empty register of the 256 takes the value of
a filled one that it looks for in an order of its own, so that the registers of a band agree
one by one with the similarity of the texts however few shingles these have: short texts that have only
a line in common hardly meet. 84 more registers look for a value the same way, and fill
another 17 bands. Of a finer sketch of 512 registers a text keeps four bits each, 0 for empty.
A pair that meets is estimated from those, with the share that agrees by chance taken off,
and what may reach the threshold is confirmed on the full sets.

At a similarity of exactly 0.75 two texts meet in none of the 68 bands with a
probability of 1e-6 at most (1.4e-6 for sets of three and four shingles), above that with less. Sets so small that one more shingle is too many
have no bands, as none but equal sets reach the threshold with them. An estimate is let pass down
to five standard deviations below the threshold; for sets of fewer shingles than registers they
are small, as hardly two shingles share one.

Texts of equal sets are one node, named by their smallest id. Nodes first meet
the smallest node of their buckets. What is linked is one component and is
compared no more. In buckets that still hold several components, the nodes outside the
largest meet all others, block by block and inside the tasks; only each node's best
few partners leave. Buckets that hide further ones give more of them in another round,
until none is hidden. So a hot bucket costs no list of its pairs, and still no link
between components is lost.

A text's shingles are computed again for the pairs to be confirmed, as these are few, and
are joined with them by the nodes concerned. Scratch tables go when their last reader is written.

Shingles are 64-bit hashes throughout. Null and empty texts and texts without
words have no set and are linked with nothing. A document is its id and its text: rows that
repeat both are one, texts that share an id are told apart, and each text without an id is a
document of its own, which comes after all ids. Of a component without any id the component is
null, and one of its texts is kept. An empty table gives an empty result; other columns of the
input are not used.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.llm.components import connected
from pagemill.operators.numbering import bounded
from pagemill.session import discard, materialize

SHINGLE = 5
REGISTERS = 256
MANTISSA_BITS = 10
BAND = 5
BANDS = 68
EMPTY = np.uint16(0xFFFF)
# Registers that pairs are estimated from, and the values of a filled one: four bits each.
FINE_REGISTERS = 512
VALUES = 15
# Members of a bucket that are compared in one block, and pairs of them that are estimated at once.
BLOCK = 2048
PAIRS = 8192
# Partners of a node that leave a block in the first round, and how fast that grows.
PARTNERS, GROWTH = 64, 16

_LOWER = bytes.maketrans(string.ascii_uppercase.encode(), string.ascii_lowercase.encode())
_FACTORS = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F],
    dtype=np.uint64,
)


def _mix(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers that scatters neighbours."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _search_order() -> tuple[np.ndarray, np.ndarray]:
    """Per register of the bands all registers of a sketch, in the order in which it takes
    a value from them, itself first; and, turned round, the place of each."""
    own = np.arange(REGISTERS, dtype=np.uint64)
    draws = _mix(_mix(np.arange(1, BANDS * BAND + 1, dtype=np.uint64))[:, None] + own * _FACTORS[3])
    draws[own, own] = 0
    order = np.argsort(draws, axis=1, kind="stable")
    return order, np.ascontiguousarray(np.argsort(order, axis=1).T.astype(np.uint8))


_ORDER, _PLACES = _search_order()


def shingles(text: str | None) -> np.ndarray:
    """Sorted hashes of the distinct shingles; a text of fewer words is one shingle."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    size = min(SHINGLE, len(words))
    total = np.full(len(words) - size + 1, size, dtype=np.uint64)
    for k in range(size):
        total += hashes[k : len(words) - size + 1 + k] * _FACTORS[k]
    return np.unique(_mix(total))


def sketch(hashes: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """Registers (a power of two) of a sorted set of hashes."""
    bits = np.uint64(registers.bit_length() - 1)
    out = np.full(registers, EMPTY, dtype=np.uint16)
    bucket = (hashes >> (np.uint64(64) - bits)).astype(np.int64)
    first = np.flatnonzero(np.diff(bucket, prepend=-1))
    rest = (hashes[first] << bits >> np.uint64(12)).astype(np.float64)
    fraction, exponent = np.frexp(rest)
    zeros = np.where(rest > 0, 52 - exponent, 52)
    mantissa = np.where(rest > 0, (fraction * 2 - 1) * (1 << MANTISSA_BITS), 0).astype(np.int64)
    out[bucket[first]] = (zeros << MANTISSA_BITS | mantissa).astype(np.uint16)
    return out


def fine_codes(hashes: np.ndarray) -> np.ndarray:
    """Four bits of each fine register, two registers a byte."""
    registers = sketch(hashes, FINE_REGISTERS)
    value = (_mix(registers.astype(np.uint64)) >> np.uint64(32)) % np.uint64(VALUES) + np.uint64(1)
    code = np.where(registers == EMPTY, 0, value).astype(np.uint8)
    return code[::2] << 4 | code[1::2]


def _filled(registers: np.ndarray) -> np.ndarray:
    """Rows of the registers of all bands: the first value that each finds, and where it stands."""
    every = np.arange(BANDS * BAND)
    found = np.broadcast_to(_ORDER[:, 0], (len(registers), BANDS * BAND)).copy()
    for k in range(len(registers)):
        filled = np.flatnonzero(registers[k] != EMPTY)
        if 0 < len(filled) < REGISTERS:
            found[k] = _ORDER[every, _PLACES[filled].min(axis=0)]
    value = np.take_along_axis(registers, found, axis=1).astype(np.uint64)
    return value << np.uint64(16) | found.astype(np.uint64)


def band_keys(registers: np.ndarray) -> np.ndarray:
    """A 64-bit key per row and band."""
    filled = _filled(registers).reshape(len(registers), BANDS, BAND)
    total = np.broadcast_to(_mix(np.arange(1, BANDS + 1, dtype=np.uint64)), filled.shape[:2]).copy()
    for k in range(BAND):
        total = _mix(total * _FACTORS[k] + filled[:, :, k])
    return total.view(np.int64)


def _may_fit(size_a: np.ndarray, size_b: np.ndarray, threshold: float) -> np.ndarray:
    """Whether sets of these sizes can reach the threshold."""
    return np.minimum(size_a, size_b) >= threshold * np.maximum(size_a, size_b)


def _filled_halves(codes: np.ndarray) -> np.ndarray:
    """How many halves of bytes are not zero, by row."""
    x = np.ascontiguousarray(codes).view(np.uint64)
    x = x | x >> np.uint64(1)
    x |= x >> np.uint64(2)
    x &= np.uint64(0x1111111111111111)
    return np.bitwise_count(x).sum(axis=1, dtype=np.int64)


def may_reach(
    a: np.ndarray,
    b: np.ndarray,
    size_a: np.ndarray,
    size_b: np.ndarray,
    threshold: float,
    filled: tuple[np.ndarray, np.ndarray] | None = None,
) -> tuple[np.ndarray, np.ndarray]:
    """Estimated similarities of rows of fine codes, and whether it may be at least the
    threshold: the estimate less than five deviations below, the sizes not too far apart.
    ``filled`` are the rows' filled registers, if they are known."""
    filled_a, filled_b = filled or (_filled_halves(a), _filled_halves(b))
    either = _filled_halves(a | b)
    used = np.maximum(either, 1)
    agree = either - _filled_halves(a ^ b)
    chance = 1 / VALUES
    estimate = (agree - chance * (filled_a + filled_b - used)) / (used * (1 - chance))
    # At the threshold: registers drawn of the union without repetition, and chance.
    union = (size_a + size_b) / (1 + threshold)
    variance = threshold * np.maximum(1 / used - 1 / np.maximum(union, 1), 0) + chance / used
    floor = threshold - 5 * np.sqrt((1 - threshold) * variance)
    return estimate, _may_fit(size_a, size_b, threshold) & (estimate >= floor)


def _rows(column: pa.Array) -> np.ndarray:
    """Fine codes of a batch, from a column of binaries."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(len(column), FINE_REGISTERS // 2)


# --- in tasks ---------------------------------------------------------------------------


def sketch_documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id``, ``n_shingles``, two 64-bit digests of the set, its band ``keys`` and its fine ``codes``."""
    schema = T.StructType([T.StructField("id", docs.schema[id_column].dataType)])
    schema.add("n_shingles", T.LongType()).add("d1", T.LongType()).add("d2", T.LongType())
    schema.add("keys", T.ArrayType(T.LongType())).add("codes", T.BinaryType())

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, d1, d2, registers, codes = [], [], [], [], []
            for text in batch.column("text"):
                hashes = shingles(text.as_py())
                n.append(len(hashes))
                d1.append(hashes.sum(dtype=np.uint64))
                d2.append(_mix(hashes ^ _FACTORS[0]).sum(dtype=np.uint64))
                registers.append(sketch(hashes))
                codes.append(fine_codes(hashes).tobytes())
            # A thousand rows at a time, as eight bytes are needed for each register of the bands.
            parts = [np.array(registers[k : k + 1000], dtype=np.uint16) for k in range(0, len(n), 1000)]
            keys = np.concatenate([np.zeros(0, dtype=np.int64), *(band_keys(part).ravel() for part in parts)])
            bounds = pa.array(np.arange(len(n) + 1, dtype=np.int32) * BANDS)
            yield pa.RecordBatch.from_pydict(
                {
                    "id": batch.column("id"),
                    "n_shingles": pa.array(n, pa.int64()),
                    "d1": pa.array(np.array(d1, dtype=np.uint64).view(np.int64)),
                    "d2": pa.array(np.array(d2, dtype=np.uint64).view(np.int64)),
                    "keys": pa.ListArray.from_arrays(bounds, pa.array(keys)),
                    "codes": pa.array(codes, pa.binary()),
                }
            )

    return docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).mapInArrow(compute, schema)


def _shingle_sets(docs: DataFrame) -> DataFrame:
    """``node`` and its sorted hashes as bytes."""

    @F.arrow_udf("binary")
    def sets(texts: pa.Array) -> pa.Array:
        return pa.array([shingles(text.as_py()).tobytes() for text in texts], pa.binary())

    return docs.select("node", sets("text").alias("set"))


def _estimated(pairs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """Those pairs (a, b) that may reach the threshold."""

    @F.arrow_udf("boolean")
    def passes(ra: pa.Array, rb: pa.Array, na: pa.Array, nb: pa.Array) -> pa.Array:
        _, good = may_reach(_rows(ra), _rows(rb), na.to_numpy(), nb.to_numpy(), threshold)
        return pa.array(good)

    one = nodes.select(F.col("node").alias("a"), F.col("codes").alias("ra"), F.col("n_shingles").alias("na"))
    two = nodes.select(F.col("node").alias("b"), F.col("codes").alias("rb"), F.col("n_shingles").alias("nb"))
    joined = pairs.join(one, "a").join(two, "b")
    return joined.where(passes("ra", "rb", "na", "nb")).select("a", "b")


def _confirmed(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """``a, b, linked`` of a table of pairs: whether the full sets have
    100 * intersection >= percent * union. Only texts of these pairs are looked at."""

    @F.arrow_udf("boolean")
    def linked(one: pa.Array, two: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(one.to_pylist(), two.to_pylist()):
            x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
            merged = np.concatenate([x, y])
            merged.sort(kind="stable")
            both = int(np.count_nonzero(merged[1:] == merged[:-1]))
            out.append(100 * both >= percent * (len(merged) - both))
        return pa.array(out, pa.bool_())

    concerned = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    texts = docs.join(bounded(concerned, 2 * pairs.count()), "node", "left_semi")
    sets = materialize(_shingle_sets(texts).dropDuplicates(["node"]), "sets")
    joined = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("sa")), "a")
    joined = joined.join(sets.select(F.col("node").alias("b"), F.col("set").alias("sb")), "b")
    tested = materialize(joined.select("a", "b", linked("sa", "sb").alias("linked")), "tested")
    discard(sets)
    return tested


def _block_pairs(
    component: np.ndarray,
    codes: np.ndarray,
    filled: np.ndarray,
    sizes: np.ndarray,
    tops: np.ndarray,
    top: int,
    threshold: float,
    partners: int,
    spans: list[tuple[int, int]],
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Best partners of the nodes of one bucket, or of two of its blocks.

    ``spans`` are the two blocks as ranges, or one range for pairs within a block. ``tops`` has the
    upper halves of the keys of all bands of a node, ``top`` that of this bucket; a pair belongs to its least
    common bucket, so that it is found in that alone. Yields pairs of places and whether the first has
    more partners than those given.
    """
    every = np.concatenate([np.arange(*span) for span in spans])
    values, counts = np.unique(component[every], return_counts=True)
    largest = values[np.argmax(counts)]

    def best(nodes: np.ndarray, lo: int, hi: int):
        near = _may_fit(sizes[nodes, None], sizes[lo:hi], threshold)
        i, j = np.nonzero(near & (component[nodes, None] != component[lo:hi]))
        if not len(i):
            return
        i, j = nodes[i], j + lo
        own = tops[i]
        apart = ~((own == tops[j]) & (own < top)).any(axis=1)
        i, j = i[apart], j[apart]
        counted = filled[i], filled[j]
        estimate, good = may_reach(codes[i], codes[j], sizes[i], sizes[j], threshold, counted)
        i, j, estimate = i[good], j[good], estimate[good]
        order = np.lexsort((-estimate, i))
        i, j = i[order], j[order]
        _, first, many = np.unique(i, return_index=True, return_counts=True)
        place = np.arange(len(i)) - np.repeat(first, many)
        given = place < partners
        yield i[given], j[given], np.repeat(many > partners, many)[given]

    for (start, stop), (lo, hi) in dict.fromkeys([(spans[0], spans[-1]), (spans[-1], spans[0])]):
        nodes = np.arange(start, stop)
        # Pairs with the largest component are found from their other node.
        nodes = nodes[component[start:stop] != largest]
        step = max(1, PAIRS // (hi - lo))
        for k in range(0, len(nodes), step):
            yield from best(nodes[k : k + step], lo, hi)


def _cross_pairs(alive: DataFrame, threshold: float, partners: int) -> DataFrame:
    """Best partners across components in buckets that hold several.

    ``alive`` has key, members, node, component, codes, n_shingles and ``tops``, the upper halves
    of the node's keys by band. A pair that belongs to a bucket which is not alive any more has left
    it before. A bucket of more than ``BLOCK`` members is dealt to blocks, and each pair of blocks is one
    piece of work.
    """
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    block = F.pmod(F.xxhash64("node"), blocks).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = alive.withColumns({"blocks": blocks, "block": block}).select("*", other)
    dealt = dealt.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})
    node_type = alive.schema["node"].dataType
    schema = T.StructType([T.StructField("a", node_type), T.StructField("b", node_type)])
    schema.add("key", T.LongType()).add("more", T.BooleanType())

    def compare(table: pa.Table) -> pa.Table:
        ids = table.column("node")
        component = table.column("component").to_numpy()
        if component.dtype == object:  # structs come as dicts, which numpy cannot sort
            component = np.array([str(x) for x in component.tolist()])
        component = np.unique(component, return_inverse=True)[1]
        codes = _rows(table.column("codes").combine_chunks())
        filled = _filled_halves(codes)
        sizes = table.column("n_shingles").to_numpy()
        tops = table.column("tops").combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
        block = table.column("block").to_numpy()
        group = np.stack([table.column(c).to_numpy() for c in ("key", "low", "high")])
        cuts = np.flatnonzero((group[:, 1:] != group[:, :-1]).any(axis=0)) + 1
        left, right, more = ([np.zeros(0, dtype=kind)] for kind in (np.int64, np.int64, np.bool_))
        for start, stop in zip([0, *cuts], [*cuts, table.num_rows]):
            # Rows are sorted by block within the piece of work.
            middle = start + int(np.searchsorted(block[start:stop], block[start], side="right"))
            if group[1, start] == group[2, start]:
                spans = [(start, stop)]
            elif middle == stop:
                continue
            else:
                spans = [(start, middle), (middle, stop)]
            top = group[0, start] >> 32
            for i, j, rest in _block_pairs(component, codes, filled, sizes, tops, top, threshold, partners, spans):
                left.append(i)
                right.append(j)
                more.append(rest)
        left, right, more = (pa.array(np.concatenate(x)) for x in (left, right, more))
        return pa.table({"a": ids.take(left), "b": ids.take(right), "key": table.column("key").take(left), "more": more})

    def compare_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A piece of work may reach over batches: its rows wait until its last has come.
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows == 0:
                continue
            group = np.stack([batch.column(c).to_numpy() for c in ("key", "low", "high")])
            changes = np.flatnonzero((group != group[:, -1:]).any(axis=0))
            if waiting:
                last = [waiting[-1].column(c)[-1].as_py() for c in ("key", "low", "high")]
            whole = int(changes[-1]) + 1 if len(changes) else 0
            if whole or (waiting and last != group[:, -1].tolist()):
                done = pa.Table.from_batches([*waiting, batch.slice(0, whole)])
                waiting = []
                yield from compare(done).to_batches()
            waiting.append(batch.slice(whole))
        if waiting:
            yield from compare(pa.Table.from_batches(waiting)).to_batches()

    work = ["key", "low", "high"]
    columns = [*work, "block", "node", "component", "codes", "n_shingles", "tops"]
    sorted_rows = dealt.select(*columns).repartition(*work).sortWithinPartitions(*work, "block", "node")
    found = sorted_rows.mapInArrow(compare_all, schema)
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "key", "more")


# --- the whole --------------------------------------------------------------------------


def _named(docs: DataFrame, id_column: str, text_column: str) -> Column:
    """A name for each document: its id, or if ids repeat or are missing, a struct of whether the
    ``id`` is missing (false comes first), the ``id`` and a digest of the text."""
    ids = docs.groupBy(F.col(id_column).alias("id")).count()
    if not ids.where("id is null or count > 1").limit(1).count():
        return F.col(id_column)
    return F.struct(
        F.col(id_column).isNull().alias("missing"), F.col(id_column).alias("id"), F.md5(text_column).alias("digest")
    )


def _linked(docs: DataFrame, percent: int) -> DataFrame:
    """``node, n_shingles, component`` of each row of ``docs`` (node, text), as a table."""
    threshold = percent / 100
    sketches = materialize(sketch_documents(docs, "node", "text").withColumnRenamed("id", "node"), "sketches")
    filled = sketches.where("n_shingles > 0")
    classes = filled.groupBy("n_shingles", "d1", "d2").agg(F.min("node").alias("node"))
    classes = materialize(classes, "classes")
    # One row per node, though its row may repeat.
    nodes = filled.join(classes, ["node", "n_shingles", "d1", "d2"], "left_semi")
    nodes = materialize(nodes.dropDuplicates(["node"]).drop("d1", "d2"), "nodes")

    joinable = nodes.where(100 * F.col("n_shingles") >= percent * (F.col("n_shingles") + 1))
    bands = joinable.select(F.explode_outer("keys").alias("key"), "node")
    compact = nodes.select("node", "n_shingles", "codes")
    shared = bands.groupBy("key").agg(F.count("*").alias("members"), F.min("node").alias("least"), F.max("node").alias("most"))
    shared = shared.where("least <> most")
    buckets = materialize(bands.join(shared.select("key", "members", "least"), "key"), "buckets")

    # Each node and the smallest that it meets.
    first = buckets.where("node <> least").groupBy("node").agg(F.min("least").alias("a"))
    pairs = materialize(_estimated(first.select("a", F.col("node").alias("b")), compact, threshold), "met")
    tests = [_confirmed(pairs, docs, percent)]
    tested = tests[0]
    discard(pairs)
    labels = connected(tested.where("linked"))
    rest, partners = buckets, PARTNERS
    while True:
        named = rest.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
        several = named.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"))
        alive = named.join(several.where("low <> high").select("key"), "key")
        met = F.collect_list(F.struct("key", "members")).alias("met")
        alive = alive.groupBy("node").agg(F.first("component").alias("component"), met)
        alive = alive.join(nodes.select("node", "n_shingles", "codes", "keys"), "node")
        tops = F.transform("keys", lambda k: F.shiftright(k, 32).cast("int"))
        alive = alive.withColumn("tops", tops).drop("keys").select("*", F.inline("met"))
        found = _cross_pairs(alive, threshold, partners).groupBy("a", "b")
        # Each node gives its partners, so a pair may come from both, with the bucket if it hides more.
        found = found.agg(F.collect_set(F.when(F.col("more"), F.col("key"))).alias("keys"))
        found = materialize(found, "found")
        fresh = materialize(found.select("a", "b").join(tested.select("a", "b"), ["a", "b"], "left_anti"), "met")
        tests.append(_confirmed(fresh, docs, percent))
        tested = tested.unionByName(tests[-1])
        discard(fresh)
        if tests[-1].where("linked").limit(1).count():
            discard(labels)
            labels = connected(tested.where("linked"))
        # Where every partner has left, all links between components are tested.
        hidden = materialize(found.select(F.explode("keys").alias("key")).distinct(), "hidden")
        discard(found)
        if not hidden.limit(1).count():
            break
        rest, before = materialize(rest.join(hidden, "key", "left_semi"), "buckets"), rest
        discard(hidden, before)
        partners *= GROWTH

    labelled = classes.join(labels, "node", "left")
    labelled = labelled.select("n_shingles", "d1", "d2", F.coalesce("component", "node").alias("component"))
    rows = sketches.select("node", "n_shingles", "d1", "d2").join(labelled, ["n_shingles", "d1", "d2"], "left")
    out = materialize(rows.select("node", "n_shingles", F.coalesce("component", "node").alias("component")), "linked")
    discard(sketches, classes, nodes, rest, hidden, labels, *tests)
    return out


def link_components(docs: DataFrame, percent: int = 75, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id, ``n_shingles``, ``component_id`` (smallest
    linked id) and ``kept`` (whether that is its own)."""
    name = _named(docs, id_column, text_column)
    linked = _linked(docs.select(name.alias("node"), F.col(text_column).alias("text")), percent)
    of = (lambda c: F.col(f"{c}.id")) if isinstance(linked.schema["node"].dataType, T.StructType) else F.col
    return linked.select(
        of("node").alias(id_column),
        "n_shingles",
        of("component").alias("component_id"),
        F.col("node").eqNullSafe(F.col("component")).alias("kept"),
    )


def drop_near_duplicates(docs: DataFrame, percent: int = 75, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` that are the smallest id of their component. Rows are told apart
    by id and text: of rows that repeat both, one stays, and each of several texts of one id,
    or without an id, is linked and judged by itself. A missing id comes after all others.
    Rows without an id and without words all stay.

    What is to go, and what repeats, is written first, so that its real size decides
    how it is joined: texts are shuffled only if it is too much to broadcast.
    """
    if clash := {"_node", "_id"} & set(docs.columns):
        raise ValueError(f"columns {sorted(clash)} exist already")
    named = docs.withColumn("_node", _named(docs, id_column, text_column))
    missing = F.col("node.missing") if isinstance(named.schema["_node"].dataType, T.StructType) else F.lit(False)
    verdict = _linked(named.select(F.col("_node").alias("node"), F.col(text_column).alias("text")), percent)
    kept_node = F.col("node").eqNullSafe(F.col("component"))
    dropped = materialize(verdict.where(~kept_node).select(F.col("node").alias("_id")).distinct(), "near-duplicates")
    kept = named.join(dropped, named["_node"].eqNullSafe(dropped["_id"]), "left_anti")
    counted = verdict.where(kept_node & ~(missing & (F.col("n_shingles") == 0)))
    twice = counted.groupBy(F.col("node").alias("_id")).count().where("count > 1").select("_id")
    twice = materialize(twice, "repeated-rows")
    discard(verdict)
    if not twice.limit(1).count():
        return kept.drop("_node")
    once = kept.join(twice, kept["_node"].eqNullSafe(twice["_id"]), "left_anti")
    again = kept.join(twice, kept["_node"].eqNullSafe(twice["_id"]), "left_semi")
    return once.unionByName(again.dropDuplicates(["_node"])).drop("_node")
