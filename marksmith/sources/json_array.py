"""A top-level JSON array read by many tasks, in element order.

A reader that wants lines sees such a file as one row. Here it is read with a comma as line
separator, which splits it by byte ranges as any text. Where a range begins, it is unknown
whether the text is inside a string and how deep the brackets are; so each range is first scanned
under both assumptions and reduced to one row: the state it ends in, the change of depth, and how
many commas it holds at each relative depth. These rows (one per range, whatever the number of
elements) are composed in order, which gives every range its true state, depth and first element
number, and the second scan cuts it into elements. Only elements that reach over a range's border
are put together by a shuffle.

A folder of part files that are one array when concatenated in the order of their names, as
``write_json_array`` leaves it, is read the same way.
"""

from __future__ import annotations

import json
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

STRING = re.compile(r'"[^"\\]*(?:\\.[^"\\]*)*"', re.DOTALL)
#: Between two commas no bracket opens behind one that closed.
REOPENED = re.compile(r"[\]}][^\[{]*[\[{]")
SCAN = T.StructType([T.StructField("file", T.StringType()), T.StructField("block", T.LongType()),
                     T.StructField("file_size", T.LongType()), T.StructField("bytes", T.LongType()),
                     T.StructField("segments", T.LongType()), T.StructField("ends", T.StringType())])
PIECE = T.StructType([T.StructField("pos", T.LongType()), T.StructField("file", T.StringType()),
                      T.StructField("block", T.LongType()), T.StructField("whole", T.BooleanType()),
                      T.StructField("item", T.StringType())])


class Depth:
    """Whether the text read so far ends inside a string, and its depth of brackets."""

    def __init__(self, inside: bool, depth: int = 0, strict: bool = False):
        self.inside, self.depth, self.strict = inside, depth, strict

    def read(self, text: str) -> None:
        if self.inside:
            text = '"' + text
        if '"' in text:
            text = STRING.sub("", text)
            at = text.find('"')
            self.inside = at >= 0
            if self.inside:
                text = text[:at]
        if self.strict and REOPENED.search(text):
            raise ValueError(f"not a JSON array: {text[:80]!r} opens a bracket behind a closed one")
        self.depth += (text.count("[") + text.count("{") - text.count("]") - text.count("}"))


def _segments(spark: SparkSession, path: str) -> DataFrame:
    """The text between commas, with the byte range that it was read from."""
    return spark.read.option("lineSep", ",").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.col("_metadata.file_size").alias("file_size"), "value")


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[str]]]:
    """``((file, block, file_size), texts)`` of runs of segments, in the order they were read."""
    for batch in batches:
        keys = list(zip(*[batch.column(c).to_pylist() for c in ("file", "block", "file_size")],
                        strict=True))
        texts = batch.column("value").to_pylist()
        start = 0
        for i in range(1, len(keys) + 1):
            if i == len(keys) or keys[i] != keys[start]:
                yield keys[start], texts[start:i]
                start = i


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per range. ``ends``: for both starts, whether it ends inside a string, the change
    of depth, and the commas behind its segments by relative depth; the last one, which may be
    the end of the file, by itself."""
    found: dict[tuple, tuple] = {}
    for key, texts in _ranges(batches):
        if key not in found:
            found[key] = ([0, 0], [(Depth(False), Counter()), (Depth(True), Counter())])
        sums, both = found[key]
        for text in texts:
            sums[0] += len(text.encode())
            sums[1] += 1
            for state, commas in both:
                state.read(text)
                if not state.inside:
                    commas[state.depth] += 1
    rows = [{"file": f, "block": b, "file_size": n, "bytes": sums[0], "segments": sums[1],
             "ends": json.dumps([[s.inside, s.depth, sorted(c.items())] for s, c in both])}
            for (f, b, n), (sums, both) in found.items()]
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema=to_arrow_schema(SCAN))


class Start(NamedTuple):
    """What holds at the start of a range: inside a string, the depth, the number of its first
    element, and whether that element starts there; whether a comma follows its last segment;
    whether it is the first range of all."""

    inside: bool
    depth: int
    pos: int
    fresh: bool
    comma: bool
    first: bool


def _compose(scanned: list, path: str) -> tuple[dict[tuple, Start], int]:
    """The start of each range, and the number of elements."""
    def malformed(why: str):
        return ValueError(f"not a JSON array: {path}: {why}")

    if not scanned:
        raise malformed("it is empty")
    per_file = defaultdict(lambda: [0, 0, 0, -1])
    for r in scanned:
        sums = per_file[r["file"]]
        sums[0] += r["bytes"]
        sums[1] += r["segments"]
        sums[2], sums[3] = r["file_size"], max(sums[3], r["block"])
    starts, inside, depth, pos, fresh = {}, False, 0, 0, True
    for r in sorted(scanned, key=lambda r: (r["file"], r["block"])):
        size, segments, file_size, last = per_file[r["file"]]
        # the reader does not tell whether a comma ends the file, but the file's size does
        if file_size - size not in (segments, segments - 1):
            raise malformed("it is not UTF-8")
        comma = r["block"] < last or file_size - size == segments
        starts[r["file"], r["block"]] = Start(inside, depth, pos, fresh, comma, not starts)
        ends, change, commas = json.loads(r["ends"])[inside]
        at = {depth + d: n for d, n in commas}
        inside, depth = ends, depth + change
        if not comma and not inside:
            at[depth] -= 1  # the end of a file, not a comma
        if any(n and d < 1 for d, n in at.items()):
            raise malformed("it goes on behind its end")
        pos += at.get(1, 0)
        fresh = comma and not inside and depth == 1
    if inside or depth:
        raise malformed("it ends inside a string or a bracket")
    return starts, pos + 1


def _cut(starts: dict[tuple, Start]):
    """The elements of each range: whole ones, and the parts at its borders."""
    arrow = to_arrow_schema(PIECE)

    def malformed(text: str):
        return ValueError(f"not a JSON array: {text[:80]!r}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = here = start = None
        held: list[str] = []
        rows: list[tuple] = []
        pos, whole = 0, True

        def leave() -> None:
            # what is held at a range's end goes on in the next one, unless a comma ends it
            if held:
                done = start.comma and not state.inside and state.depth == 1
                rows.append((pos, *here, whole and done,
                             ",".join(held) + "," * (start.comma and not done)))
                held.clear()

        def read(text: str) -> str:
            if state.depth == 0 and start.first and not held:
                text = text.lstrip("\ufeff \t\r\n")
                if not text.startswith("["):
                    raise malformed(text)
                state.depth, text = 1, text[1:]
            elif state.depth == 0 and text.strip(" \t\r\n"):
                raise malformed(text)
            was = state.depth
            state.read(text)
            if was and not state.inside and state.depth == 0:
                text = text.rstrip(" \t\r\n")
                if not text.endswith("]"):
                    raise malformed(text)
                text = text[:-1]
            return text

        for (file, block, _), texts in _ranges(batches):
            if (file, block) != here:
                leave()
                here, start = (file, block), starts[file, block]
                pos, whole = start.pos, start.fresh
                state = Depth(start.inside, start.depth, strict=True)
            for text in texts:
                if held and not state.inside and state.depth == 1:
                    # a comma of the array stood behind the last segment
                    rows.append((pos, *here, whole, ",".join(held)))
                    held.clear()
                    pos, whole = pos + 1, True
                held.append(read(text))
            if len(rows) >= 1000:
                yield _rows(rows, arrow)
                rows.clear()
        leave()
        if rows:
            yield _rows(rows, arrow)

    return run


def _rows(rows: list[tuple], arrow: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, type=f.type) for c, f in zip(zip(*rows), arrow, strict=True)], schema=arrow)


def read_json_array(spark: SparkSession, path: str) -> DataFrame:
    """``(pos, item)``: each element's JSON text by its 0-based place. A text that is not one
    array (brackets, strings or commas that do not close) is an error; what is wrong inside an
    element shows when ``parsed`` reads it."""
    segments = _segments(spark, path)
    # one row per byte range
    starts, n = _compose(segments.mapInArrow(_scan, SCAN).collect(), path)
    pieces = segments.mapInArrow(_cut(starts), PIECE)
    parts = pieces.filter("not whole").groupBy("pos").agg(
        F.array_sort(F.collect_list(F.struct("file", "block", "item"))).alias("p"))
    joined = parts.select("pos", F.array_join(F.transform("p", lambda x: x["item"]), "").alias("item"))
    items = pieces.filter("whole").select("pos", "item").unionByName(joined)
    blank = F.col("item").rlike(r"^[ \t\r\n]*$")
    if n == 1:
        return items.filter(~blank)
    return items.withColumn("item", F.when(blank, F.raise_error(F.lit(
        f"not a JSON array: {path}: an element is empty"))).otherwise(F.col("item")))


def parsed(item: Column, element: str) -> Column:
    """One element's text as the SQL type ``element``; text that is no JSON is an error."""
    one = F.from_json(F.concat(F.lit("["), item, F.lit("]")), f"array<{element}>")
    return F.when(F.size(one) == 1, one[0]).otherwise(
        F.raise_error(F.concat(F.lit("not a JSON element: "), F.left(item, F.lit(80)))))


def json_text(value: Column) -> Column:
    """A column as JSON text."""
    whole = F.to_json(F.array(value), {"ignoreNullFields": "false"})
    return F.substr(whole, F.lit(2), F.length(whole) - 2)


def write_json_array(df: DataFrame, path: str, item: Column, pos: str = "pos",
                     mode: str = "errorifexists") -> None:
    """One array over the part files of a folder, an element a line: concatenated in the order of
    their names they are one JSON text. ``pos`` is dense from 0."""
    n = df.count()
    if n == 0:
        df.sparkSession.range(1).select(F.lit("[]")).write.mode(mode).text(path)
        return
    line = F.concat(F.when(F.col(pos) == 0, "[").otherwise(""), json_text(item),
                    F.when(F.col(pos) == n - 1, "]").otherwise(","))
    (df.select(pos, line.alias("value")).repartitionByRange(pos).sortWithinPartitions(pos)
     .select("value").write.mode(mode).text(path))
