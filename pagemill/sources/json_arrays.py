"""JSON files with an array root, read and written in parallel.

Reading: the text source splits a file at ``}``, in as many tasks as its size gives. Whether a
``}`` ends an element depends on all that stands before it, namely on whether it is inside a
string and how deep. A first scan finds what each split does to that, for both cases of beginning
inside or outside a string; composing the splits in order, a few numbers each, says how each begins. A second
scan then cuts every split into elements. What is left at its ends, at most two pieces a
split, is joined with the neighbours' by a shuffle of these pieces alone.

Writing: a line of text per record. Brackets and commas are set by a record's place in its
file, so no file is ever a value in memory. Records are sorted in ranges of keys of bounded size; a file
that reaches over several is written range by range, and its parts are copied one behind the other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from pagemill.session import discard, materialize, scratch_path

# Bytes of a split that are looked at together.
SLICE = 1 << 22
WHITE = b" \t\r\n"
# Bytes of text, about, of a range of keys that is sorted in one task.
RANGE_BYTES = 1 << 25


class Split(NamedTuple):
    """What a split does, if it begins outside a string and if inside: whether it ends inside, how
    much deeper, and the least depth behind a ``}``, all from the depth at its start."""

    inside: tuple[int, int]
    deeper: tuple[int, int]
    least: tuple[int, int]
    opening: int  # the first byte that is no white space, 0 if there is none


NO_END = 1 << 40


def _strings(data: np.ndarray, inside: int) -> tuple[np.ndarray, int]:
    """Whether each byte is inside a string, and whether the byte after the last is. The bytes
    begin behind a ``}``, so no escape reaches into them."""
    quotes = data == ord('"')
    slashes = data == ord("\\")
    if slashes.any():
        place = np.arange(len(data))
        before = np.maximum.accumulate(np.where(slashes, -1, place))  # last byte that is no backslash
        run = place - before
        escaped = np.zeros(len(data), dtype=bool)
        escaped[1:] = run[:-1] % 2 == 1
        quotes &= ~escaped
    state = (np.cumsum(quotes) + inside) & 1
    return state.astype(bool), int(state[-1]) if len(data) else inside


def _depths(data: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Depth behind each byte, from 0 before the first."""
    opens = (data == ord("{")) | (data == ord("["))
    closes = (data == ord("}")) | (data == ord("]"))
    return np.cumsum((opens.astype(np.int8) - closes) * ~inside, dtype=np.int64)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], np.ndarray]]:
    """(file, start) of the split and some of its bytes in order, with the ``}`` that the
    reader takes away behind each row. Slices end behind a ``}``."""
    key, rows, size = None, [], 0

    def joined() -> np.ndarray:
        return np.frombuffer(b"}".join(rows) + b"}", dtype=np.uint8)

    for batch in batches:
        for text, file, start in zip(*(column.to_pylist() for column in batch.columns)):
            if rows and ((file, start) != key or size > SLICE):
                yield key, joined()
                rows, size = [], 0
            key = (file, start)
            rows.append(text.encode())
            size += len(rows[-1]) + 1
    if rows:
        yield key, joined()


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each split."""
    found: dict[tuple[str, int], Split] = {}
    for key, data in _slices(batches):
        old = found.get(key, Split((0, 1), (0, 0), (NO_END, NO_END), 0))
        inside, deeper, least = [], [], []
        for case in range(2):
            within, end = _strings(data, old.inside[case])
            depth = _depths(data, within)
            ends = depth[(data == ord("}")) & ~within]
            inside.append(end)
            deeper.append(old.deeper[case] + int(depth[-1]))
            least.append(min(old.least[case], old.deeper[case] + int(ends.min()) if len(ends) else NO_END))
        opening = old.opening
        if not opening:
            text = bytes(data[:-1]).removeprefix(b"\xef\xbb\xbf").lstrip(WHITE)
            opening = text[0] if text else 0 if len(data) == 1 else ord("}")
        found[key] = Split(tuple(inside), tuple(deeper), tuple(least), opening)
    for (file, start), split in found.items():
        row = {"file": [file], "start": [start], "opening": [split.opening]}
        for name in ("inside", "deeper", "least"):
            row |= {f"{name}{case}": [getattr(split, name)[case]] for case in range(2)}
        yield pa.RecordBatch.from_pydict(row)


SCANNED = (
    "file string, start bigint, opening bigint, inside0 bigint, inside1 bigint, deeper0 bigint, deeper1 bigint, "
    "least0 bigint, least1 bigint"
)


class Begin(NamedTuple):
    """How a split begins."""

    inside: int
    depth: int
    base: int  # depth behind an element
    owner: int  # the split in which the element began that is open at the start
    number: int  # of the split, in order


def _begins(splits: DataFrame) -> dict[tuple[str, int], Begin]:
    """How each split begins, by composing those before it: one row of numbers for each."""
    begins: dict[tuple[str, int], Begin] = {}
    rows = sorted(splits.collect(), key=lambda r: (r["file"], r["start"]))
    file = None
    for number, r in enumerate(rows):
        if r["file"] != file:
            file, inside, depth, owner = r["file"], 0, 0, r["start"]
            if r["opening"] not in (ord("["), ord("{"), 0):
                raise ValueError(f"{file} has a root that is neither an array nor an object")
            base = 1 if r["opening"] == ord("[") else 0
        begins[file, r["start"]] = Begin(inside, depth, base, owner, number)
        if depth + r[f"least{inside}"] <= base:
            owner = r["start"]
        inside, depth = r[f"inside{inside}"], depth + r[f"deeper{inside}"]
    return begins


def _text_rows(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.option("lineSep", "}").text(path)
    return rows.select("value", "_metadata.file_path", "_metadata.file_block_start")


ELEMENTS = "file string, owner bigint, position bigint, part int, text string"


def _elements(rows: DataFrame, begins: dict[tuple[str, int], Begin], whole: bool) -> DataFrame:
    """Elements of the splits: those that are whole in one, or the pieces of the others.

    A piece says where its element began and which part of it it is. ``position`` rises
    in the order of the files and of the elements in them.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, rest, count = None, None, b"", 0
        out: list[tuple] = []

        def piece(text: bytes, is_open: bool) -> None:
            nonlocal count
            begin = begins[key]
            first = count == 0 and begin.owner != key[1]
            if whole == (not is_open and not first):
                owner = begin.owner if first else key[1]
                out.append((key[0], owner, begin.number << 32 | count, begin.number, text.decode()))
            count += 1

        def batch_of() -> pa.RecordBatch:
            columns = list(zip(*out)) or [[]] * 5
            types = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string()]
            arrays = [pa.array(c, t) for c, t in zip(columns, types)]
            out.clear()
            return pa.RecordBatch.from_arrays(arrays, names=["file", "owner", "position", "part", "text"])

        for found, data in _slices(batches):
            if found != key:
                if key is not None:
                    piece(rest, True)
                key, rest, count = found, b"", 0
                state = (begins[key].inside, begins[key].depth)
            within, inside = _strings(data, state[0])
            depth = _depths(data, within) + state[1]
            ends = np.flatnonzero((data == ord("}")) & ~within & (depth == begins[key].base)) + 1
            state = (inside, int(depth[-1]))
            text, at = data.tobytes(), 0
            for end in ends.tolist():
                piece(rest + text[at:end], False)
                rest, at = b"", end
            rest += text[at:]
            if len(out) > 1000:
                yield batch_of()
        if key is not None:
            piece(rest, True)
        yield batch_of()

    return rows.mapInArrow(cut, ELEMENTS)


def read_json_array(spark: SparkSession, path: str, schema: T.StructType | str, position: str | None = None) -> DataFrame:
    """Objects of JSON files whose root is an array, or one object, in tasks of
    ``spark.sql.files.maxPartitionBytes`` even if there is one file.

    ``position`` names a BIGINT column that rises in the order of the elements, not dense. Elements
    that are no objects, and other roots, fail the job. Two scans find the elements, and one more the pieces that
    reach over splits. The driver holds a few numbers for each split.
    """
    rows = _text_rows(spark, path)
    begins = _begins(rows.mapInArrow(_scan, SCANNED))
    whole = _elements(rows, begins, True).select("position", "text")
    pieces = _elements(rows, begins, False).groupBy("file", "owner")
    pieces = pieces.agg(
        F.min("position").alias("position"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "text"))), lambda p: p["text"]), "").alias("text"),
    )
    elements = whole.unionByName(pieces.select("position", "text"))
    # What stands before the object: separators, and the bracket of the root.
    start = F.locate("{", "text")
    lead = F.translate(F.expr("left(text, locate('{', text) - 1)"), "\ufeff \t\r\n", "")
    alone = F.translate("text", "\ufeff \t\r\n}", "")
    elements = elements.where((start > 0) | ~alone.isin("", "]", "[]"))
    checked = F.when((start > 0) & lead.isin("", "[", ","), F.expr("substr(text, locate('{', text))")).otherwise(
        F.raise_error(F.concat(F.lit("elements must be objects: "), F.expr("left(text, 80)")))
    )
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    parsed = F.from_json(checked, schema, {"mode": "FAILFAST"}).alias("_row")
    names = [F.col("_row")[name].alias(name) for name in schema.fieldNames()]
    order = [F.col("position").alias(position)] if position else []
    return elements.select("position", parsed).select(*order, *names)


def _in_ranges(rows: DataFrame) -> tuple[DataFrame, int]:
    """``rows`` with ``range``, that rises with ``_key`` and has about ``RANGE_BYTES`` of text, -1 for
    null; and the number of ranges."""
    count = math.ceil((rows.agg(F.sum("_bytes")).first()[0] or 0) / RANGE_BYTES)
    if count < 2:
        return rows.withColumn("range", F.lit(0)), 1
    keys = rows.select(F.col("_key").cast("double").alias("_at"))
    shares = [k / count for k in range(1, count)]
    bounds = keys.agg(F.percentile_approx("_at", shares, 100 * count)).first()[0] or []
    splits = [-math.inf, *sorted(set(bounds)), math.inf]
    found = Bucketizer(splits=splits, inputCol="_at", outputCol="range", handleInvalid="keep").transform(
        rows.withColumn("_at", F.coalesce(F.col("_key").cast("double"), F.lit(0.0)))
    )
    return found.withColumn("range", F.when(F.col("_key").isNull(), -1).otherwise(F.col("range").cast("int"))).drop("_at"), count


def _place(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a qualified path for tasks, that reach it through ``pyarrow.fs``."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri("s3" + path.removeprefix("s3a") if path.startswith("s3a://") else path)


def _qualified(spark: SparkSession, path: str) -> str:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(folder).toString()


def _join_parts(parts: str, target: str, folder: str) -> None:
    """One file of the parts below a folder in the order of their ranges, a few MB at a time. Parts hold
    ``,`` and a line end behind each record; the last pair goes."""
    store, root = _place(f"{parts}/{folder}")
    found = [i for i in store.get_file_info(fs.FileSelector(root, recursive=True)) if i.is_file and i.base_name.startswith("part-")]
    found = sorted((i for i in found if i.size), key=lambda i: int(i.path.rsplit("range=", 1)[1].split("/")[0]))
    out_store, out_root = _place(f"{target}/{folder}")
    out_store.create_dir(out_root, recursive=True)
    with out_store.open_output_stream(f"{out_root}/_part-00000.txt") as out:
        out.write(b"[\n")
        for part in found:
            left = part.size - (2 if part is found[-1] else 0)
            with store.open_input_stream(part.path) as data:
                while left and (some := data.read(min(SLICE, left))):
                    out.write(some)
                    left -= len(some)
        out.write(b"\n]\n")
    out_store.move(f"{out_root}/_part-00000.txt", f"{out_root}/part-00000.txt")


def write_json_arrays(
    df: DataFrame, path: str, key: str = "seq", rows_per_file: int = 1000, bytes_per_file: int = 64 << 20
) -> None:
    """A folder of indented JSON files with an array root each, in folders by block of keys.

    For consumers that expect arrays. Rows are grouped by blocks of the unique BIGINT ``key``, at
    most ``rows_per_file`` each, and sorted by it inside; a block of more than ``bytes_per_file`` goes
    on in further files, so a file is longer by one record at most. Each record is one value of
    its own, so only records and ranges of about ``RANGE_BYTES`` have to fit into memory. A file that
    reaches over several ranges has one writer, that copies its parts through ``pyarrow.fs`` (a mounted
    folder, or a store that it knows; only folders are tested) and holds a few MB of them.
    """
    spark = df.sparkSession
    block: Column = F.expr(f"`{key}` div {rows_per_file} - int(`{key}` % {rows_per_file} < 0)")
    text = F.to_json(F.struct(*df.columns), {"pretty": "true", "ignoreNullFields": "false"})
    rows = df.select(block.alias("block"), F.col(key).alias("_key"), text.alias("_text"))
    rows, count = _in_ranges(rows.withColumn("_bytes", F.octet_length("_text").cast("bigint")))
    # Bytes of a block before a range: one row for each range that goes on with a block.
    earlier = Window.partitionBy("block").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("block", "range").agg(F.sum("_bytes").alias("_sum"))
    starts = totals.select("block", "range", F.sum("_sum").over(earlier).alias("_start")).where("_start > 0")
    order = Window.partitionBy("block", "range").orderBy("_key").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce("_start", F.lit(0)) + F.coalesce(F.sum("_bytes").over(order), F.lit(0))
    dealt = rows.repartition(count, "range").join(F.broadcast(starts), ["block", "range"], "left")
    dealt = dealt.withColumn("piece", F.floor(before / bytes_per_file)).select("block", "piece", "range", "_key", "_text")
    dealt = materialize(dealt, "array-lines")
    # At most one file for each range goes on in the next.
    over = dealt.groupBy("block", "piece").agg(F.min("range").alias("low"), F.max("range").alias("high")).where("low < high")
    over = materialize(over.select("block", "piece"), "array-files")
    whole = dealt.join(F.broadcast(over), ["block", "piece"], "left_anti").repartition(count, "block", "piece")
    inside = Window.partitionBy("block", "piece").orderBy("_key")
    opening = F.when(F.row_number().over(inside) == 1, "[\n").otherwise("")
    closing = F.when(F.lead(F.lit(1)).over(inside).isNull(), "\n]").otherwise(",")
    lines = whole.select("block", "piece", "_key", F.concat(opening, "_text", closing).alias("value"))
    files = lines.sortWithinPartitions("block", "piece", "_key").select("block", "piece", "value")
    files.write.partitionBy("block", "piece").text(path)
    if folders := [f"block={row['block']}/piece={row['piece']}" for row in over.collect()]:
        parts = _qualified(spark, scratch_path(spark, "array-parts"))
        target = _qualified(spark, path)
        long = dealt.join(F.broadcast(over), ["block", "piece"]).repartition(count, "range")
        long = long.sortWithinPartitions("block", "piece", "range", "_key")
        long = long.select("block", "piece", "range", F.concat("_text", F.lit(",")).alias("value"))
        long.write.option("maxRecordsPerFile", 0).partitionBy("block", "piece", "range").text(parts)

        def join(found: Iterator[str]) -> Iterator[None]:
            for folder in found:
                _join_parts(parts, target, folder)
                yield None

        spark.sparkContext.parallelize(folders, len(folders)).mapPartitions(join).count()
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(parts)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    discard(dealt, over)
