r"""Line deduplication with a log-template tree.

A line with at least ``least`` words walks a tree of fixed depth: its number of words,
then its first ``depth`` words, with every word that holds a digit read as a variable
field.  At the leaf it belongs to up to six templates: the line itself (digit fields
variable), and, from ten words on, the five templates in which one fifth of the
positions after the leading words is a variable field too; lines of one template so
agree in at least 0.8 of their words.  A line with more variable than constant words
belongs to none.  A template that occurs in at least ``min_docs``
documents is recurring, and its lines are dropped from every document but the one with
the smallest id, which keeps the passage in the corpus once.

With ``passage`` words given, repeats of so many words are dropped from two documents on,
as they don't occur by chance: templates of at least ``passage`` words, and passages
within or across lines.  For these, each passage of ``passage`` words has a window of 4/5
of its words, at a place that its words alone decide: that of its least hash of some
words, modulo the places that a window can have (so that neighbouring passages mostly
share one); texts begin and end with a window, too.  Words of recurring windows are cut
from their lines (up to 1/5 of ``passage`` words stay at either end of a passage), and a
line of which nothing is left is dropped; ``n_dropped`` counts lines that are dropped whole.

Templates and windows ("units") are 64-bit hashes.  A slice of documents is grouped by
unit before the shuffle, so a line in a third of all documents is one row a slice, with
the places where it stands; there is one shuffle of units, in which each learns how many
documents hold it and the first of them, and the places of recurring units go back to
their documents, which are named by id and text hash.  Nothing is broadcast or
recomputed, and there is one plan for all sizes.

Defined cases: a null text has no lines and stays null; an empty one has one empty
line; lines of fewer words are never dropped; repeated rows count as documents of
their own, and all rows with the smallest id keep their lines; ids are integers, or
strings of digits (others raise an error), and null ids come after all others; extra
columns pass through ``dedup``, whatever their names but for ``out``, which is replaced;
an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flightgrid.llm._words import SPACED, chunks, hash_spans, mix, split, text_bytes

PARTS = 5
LEAST_LONG = 10
VARIABLE = np.uint64(0x5BD1E995)
BLANK = b" \t\n\v\f\r"
DIGIT = np.zeros(256, bool)
DIGIT[0x30:0x3A] = True


#: Words of a passage that recurs from two documents on.
PASSAGE = 50
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def windows(col: pa.Array, passage: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the windows of all texts, with the text and the first and last byte of
    each (in its text)."""
    data, offsets = text_bytes(col)
    starts, ends, doc = split(data, offsets, SPACED)
    runs = passage // 5
    width = passage - runs + 1
    n = len(starts)
    none = np.zeros(0, np.int64)
    if n < width:
        return np.zeros(0, np.uint64), none, none, none
    digits = np.concatenate([[0], np.cumsum(DIGIT[data[: int(offsets[-1])]])])
    variable = digits[ends] > digits[starts]
    word = mix(np.where(variable, VARIABLE, hash_spans(data, starts, ends)))
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(word * np.cumprod(np.full(n, BASE)))])
        back = np.cumprod(np.full(n, INVERSE))
        within = lambda at, size: mix((total[at + size] - total[at]) * back[at] ^ VARIABLE)
        size = width % runs if width % runs > 2 else width % runs + runs
        passages = np.flatnonzero(doc[: n - passage + 1] == doc[passage - 1 :]) if n >= passage else none
        least = _least(within(np.arange(n - size + 1), size), passage - size + 1) if len(passages) else none
        heads = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
        tails = np.append(heads[1:], n) - width
        ends_of = np.concatenate([heads, tails[tails >= 0]])
        ends_of = ends_of[ends_of + width <= n]
        ends_of = ends_of[doc[ends_of] == doc[ends_of + width - 1]]
        at = np.unique(np.concatenate([passages + (least[passages] - passages) % runs if len(passages) else none, ends_of]))
        fields = np.concatenate([[0], np.cumsum(variable)])
        at = at[2 * (fields[at + width] - fields[at]) <= width]
        h = within(at, width)
    return h, doc[at], starts[at] - offsets[doc[at]], ends[at + width - 1] - offsets[doc[at]]


def _least(values: np.ndarray, size: int) -> np.ndarray:
    """The place of the least (first) value of each run of ``size``."""
    v, at, span = values, np.arange(len(values)), 1
    while span < size:
        step = min(span, size - span)
        left, right = v[:-step], v[step:]
        less = right < left
        v, at, span = np.where(less, right, left), np.where(less, at[step:], at[:-step]), span + step
    return at


def templates(col: pa.Array, least: int, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Template hashes of all lines, with the text, the line (in its text) and the words
    of each."""
    data, offsets = text_bytes(col)
    n = int(offsets[-1])
    starts, ends, doc = split(data, offsets, SPACED)
    none = np.zeros(0, np.int64)
    if not len(starts):
        return np.zeros(0, np.uint64), none, none, none
    digits = np.concatenate([[0], np.cumsum(DIGIT[data[:n]])])
    variable = digits[ends] > digits[starts]
    word = np.where(variable, VARIABLE, hash_spans(data, starts, ends))
    breaks = np.concatenate([[0], np.cumsum(data[:n] == 10)])
    in_text = breaks[starts] - breaks[offsets[doc]]
    new = np.ones(len(starts), bool)
    new[1:] = (in_text[1:] != in_text[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(starts)))
    place = np.arange(len(starts)) - np.repeat(first, size)
    part = place * PARTS // np.repeat(size, size)
    part[place < depth] = -1
    term = mix(word ^ mix(place.astype(np.uint64) + np.uint64(1)))
    total = np.add.reduceat(term, first)
    firm = 2 * np.add.reduceat(variable.astype(np.int64), first) <= size
    keys, lines = [], []
    with np.errstate(over="ignore"):
        for p in range(-1, PARTS):
            if p < 0:
                rows, h = np.flatnonzero(firm & (size >= least)), total
            else:
                rows, h = np.flatnonzero(firm & (size >= max(least, LEAST_LONG))), total - np.add.reduceat(np.where(part == p, term, np.uint64(0)), first)
            keys.append(mix(h[rows] ^ mix(size[rows].astype(np.uint64) * np.uint64(8) + np.uint64(p + 1))))
            lines.append(rows)
    line = np.concatenate(lines)
    return np.concatenate(keys), doc[first][line], in_text[first][line], size[line]


#: A place is a window's first byte * 2**32 + its last one, or -1 - a line's number.
PLACE = "id long, row long, place long"
UNIT = f"template long, long boolean, docs int, {PLACE}, rest array<struct<{PLACE.replace(' long', ': long')}>>"


def _units(part: pa.RecordBatch, least: int, depth: int, passage: int | None) -> pa.RecordBatch | None:
    """A row for each template and window of a slice (id, row, text): whether it recurs
    from two documents on, its documents, and its places, that of the least id first."""
    h, doc, line, size = templates(part.column(2), least, depth)
    place, long = -1 - line, np.zeros(len(h), bool)
    if passage is not None:
        more, of, first, last = windows(part.column(2), passage)
        h, doc, place = np.concatenate([h, more]), np.concatenate([doc, of]), np.concatenate([place, first << 32 | last])
        long = np.concatenate([size >= passage, np.ones(len(more), bool)])
    if not len(h):
        return None
    ids, rows = (part.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
    rank = np.empty(len(ids), np.int32)
    rank[np.argsort(ids, kind="stable")] = np.arange(len(ids), dtype=np.int32)
    order = np.lexsort((rank[doc], h))
    h, doc, place, long = h[order], doc[order], place[order], long[order]
    new = np.append(True, h[1:] != h[:-1])
    other = np.cumsum(new | np.append(True, doc[1:] != doc[:-1]))
    head, tail = np.flatnonzero(new), np.flatnonzero(~new)
    docs = np.diff(np.append(other[head], other[-1] + 1)).astype(np.int32)
    counts = np.diff(np.append(head, len(h))) - 1
    ends = np.append(0, np.cumsum(counts)).astype(np.int32)
    named = ["id", "row", "place"]
    inner = pa.StructArray.from_arrays([pa.array(ids[doc[tail]]), pa.array(rows[doc[tail]]), pa.array(place[tail])], named)
    rest = pa.ListArray.from_arrays(pa.array(ends), inner, mask=pa.array(counts == 0))
    values = [pa.array(h[head].view(np.int64)), pa.array(long[head]), pa.array(docs), pa.array(ids[doc[head]]), pa.array(rows[doc[head]]), pa.array(place[head])]
    found = pa.RecordBatch.from_arrays([*values, rest], ["template", "long", "docs", *named, "rest"])
    return found.take(pa.array(np.argsort(doc[head], kind="stable")))  # a document's rows together compress well


def _named(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with ``__id`` (null: the largest number) and ``__row``, a text hash."""
    return docs.withColumns({"__id": F.coalesce(F.col(key).cast("long"), F.lit(2**63 - 1)), "__row": F.xxhash64("text")})


def units(docs: DataFrame, key: str, least: int, depth: int, passage: int | None) -> DataFrame:
    """Units of each slice of ``docs`` with their documents and places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                got = _units(part, least, depth, passage)
                for at in range(0, got.num_rows if got else 0, 1 << 16):
                    yield got.slice(at, 1 << 16)

    rows = _named(docs.select(F.col(key).alias("key"), "text"), "key").where("text is not null")
    return rows.select("__id", "__row", "text").mapInArrow(run, UNIT)


def recurring(docs: DataFrame, key: str = "doc_id", min_docs: int = 10, least: int = 4, depth: int = 2, passage: int | None = None) -> DataFrame:
    """(template, docs, first): templates of at least ``min_docs`` documents, and long
    ones and windows of two."""
    found = units(docs, key, least, depth, passage).groupBy("template").agg(F.sum("docs").alias("docs"), F.min("id").alias("first"), F.bool_or("long").alias("long"))
    return found.where(F.col("docs") >= F.when(F.col("long"), 2).otherwise(min_docs)).select("template", "docs", "first")


def marked(docs: DataFrame, key: str, min_docs: int, least: int, depth: int, passage: int | None) -> DataFrame:
    """(id, row, places): places of recurring units in all documents but their first."""
    per = Window.partitionBy("template")  # as many rows as slices hold the unit
    found = units(docs, key, least, depth, passage).withColumns({"all": F.sum("docs").over(per), "first": F.min("id").over(per), "any": F.bool_or("long").over(per)})
    found = found.where(F.col("all") >= F.when(F.col("any"), 2).otherwise(min_docs))
    own = F.array(F.struct("id", "row", "place"))
    each = found.select("first", F.explode(F.when(F.col("rest").isNull(), own).otherwise(F.concat(own, "rest"))).alias("p"))
    return each.where("p.id > first").groupBy("p.id", "p.row").agg(F.collect_list("p.place").alias("places"))


RESULT = T.StructType([T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("kept", T.StringType())])


LINES = pa.struct([("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept", pa.string())])


def _without(text: str | None, places: pa.Array | None) -> dict:
    if text is None:
        return {"n_lines": 0, "n_dropped": 0, "kept": None}
    if places is None:
        return {"n_lines": text.count("\n") + 1, "n_dropped": 0, "kept": text}
    p = np.unique(places.to_numpy(zero_copy_only=False))
    gone, spans = set((-1 - p[p < 0]).tolist()), [(x >> 32, x & 0xFFFFFFFF) for x in p[p >= 0].tolist()]
    if spans:
        return _cut_out(text, gone, spans)
    lines = text.split("\n")
    return {"n_lines": len(lines), "n_dropped": len(gone), "kept": "\n".join(x for i, x in enumerate(lines) if i not in gone)}


def _cut_out(text: str, gone: set[int], spans: list[tuple[int, int]]) -> dict:
    """The text without the lines ``gone`` and the bytes of ``spans``."""
    merged: list[list[int]] = []
    for a, b in sorted(spans):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b])
    lines, at, k = text.encode().split(b"\n"), 0, 0
    kept = []
    for i, line in enumerate(lines):
        end = at + len(line)
        while k < len(merged) and merged[k][1] <= at:
            k += 1
        parts, here, j = [], at, k
        while j < len(merged) and merged[j][0] < end:
            parts.append(line[max(here - at, 0) : max(merged[j][0] - at, 0)].strip(BLANK))
            here = min(merged[j][1], end)
            j += 1
        if i not in gone:
            if j == k or not line.strip(BLANK):
                kept.append(line)
            else:
                rest = b" ".join(x for x in (*parts, line[here - at :].strip(BLANK)) if x)
                kept += [rest] if rest else []
        at = end + 1
    return {"n_lines": len(lines), "n_dropped": len(lines) - len(kept), "kept": b"\n".join(kept).decode()}


def dedup(docs: DataFrame, key: str = "doc_id", min_docs: int = 10, least: int = 4, depth: int = 2, out: str = "lines", passage: int | None = None) -> DataFrame:
    """``docs`` with a struct column ``out``: lines, lines dropped, and the kept text."""
    kept = [c for c in docs.columns if c != out]
    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField(out, RESULT)])
    marks = marked(docs, key, min_docs, least, depth, passage).select(F.col("id").alias("__id"), F.col("row").alias("__row"), F.col("places").alias("__places"))
    row = F.struct(*(F.col(c) for c in kept)).alias("__doc")
    wide = _named(docs.select(row, F.col(key).alias("key"), "text"), "key").select("__doc", "__id", "__row").join(marks, ["__id", "__row"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, places = batch.column(0), batch.column(1)
            columns = [row.field(i) for i in range(row.type.num_fields)]
            result = pa.array([_without(t.as_py(), p.values) for t, p in zip(columns[kept.index("text")], places, strict=True)], LINES)
            yield pa.RecordBatch.from_arrays([*columns, result], [*kept, out])

    return wide.select("__doc", "__places").mapInArrow(run, schema)


def digests(docs: DataFrame, passage: int | None = None) -> DataFrame:
    got = dedup(docs.select("doc_id", "text"), passage=passage)
    f = F.col("lines")
    return got.select("doc_id", f.n_lines.alias("n_lines"), f.n_dropped.alias("n_dropped"), F.sha2(F.coalesce(f.kept, F.lit("")), 256).alias("kept_sha256"))


def drop_recurring(docs: DataFrame, emptied: bool = True) -> DataFrame:
    """``docs`` with the kept text, and its length where there is a column n_chars;
    without those of which no word is left, unless ``emptied``."""
    got = dedup(docs, out="__lines", passage=PASSAGE).withColumn("text", F.col("__lines.kept"))
    if not emptied:
        got = got.where(F.coalesce(F.col("__lines.n_dropped"), F.lit(0)).eqNullSafe(0) | F.col("text").rlike(r"\S"))
    if "n_chars" in docs.columns:
        got = got.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return got.select(*docs.columns)

