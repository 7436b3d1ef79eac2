"""Audit of how word use differs between the sources of a language.

Texts are tokenized over concatenated UTF-8 buffers: a byte table finds the boundaries,
xxhash groups the slices and every slice is compared with its group's bytes. Each task
counts terms by language and source and sends them packed, a few hundred kilobytes a range
of term hashes, so one shuffle suffices: a range's task knows a term's documents in all
sources and decides which terms are kept. Distances between sources come from CSR
matrices, one a block of terms and pair of source tiles, by sums over row segments.
All numbers are whole: shares are in billionths and computed by long division.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.slices import grouped, runs
from corpusloom.llm.wordhash import fine_parts, give_back, lower_ascii, text_bytes, together
from corpusloom.plans.scratch import Scratch, partitions

#: Bytes of a term: letters, and everything outside of ASCII.
TERM = np.zeros(256, bool)
TERM[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

#: Bytes of text whose terms are counted together before they are sent.
SLICE = 8 << 20
#: Rows of a range that are held before equal ones are added up.
HELD = 1 << 20
#: Sources of a tile, and counts of a tile and block of terms, on average at most.
TILE, BLOCK_COUNTS = 128, 1 << 17


@dataclass(frozen=True)
class Audit:
    """least: documents of its language that a kept term is in. added: what each count gets. top: terms reported a group."""

    least: int = 30
    added: int = 5
    scale: int = 1000
    top: int = 50


def share_sql(count: str, total: str, terms: str, audit: Audit) -> Column:
    """1 + floor(scale**3 * (count + added) / (total + added * terms)) of columns, by long division in whole numbers.

    No step leaves 64 bits while the total stays below 9 * 10**15.
    """
    over = f"({total} + {audit.added} * {terms})"
    k = audit.scale
    one = f"(({count} + {audit.added}) * {k})"
    two = f"(({one} % {over}) * {k})"
    three = f"(({two} % {over}) * {k})"
    return F.expr(f"1 + ({one} div {over}) * {k * k} + ({two} div {over}) * {k} + ({three} div {over})")


def _counted(part: pa.RecordBatch) -> pa.Table:
    """(lang, source, term, n, docs) of a slice (lang, source, text)."""
    from xxhash import xxh3_64_intdigest

    data, offsets = text_bytes(part.column("text"))
    data = lower_ascii(data)
    raw = data.tobytes()
    codes: dict[tuple[str, str], int] = {}
    of_doc = np.array([codes.setdefault(pair, len(codes)) for pair in zip(part.column("lang").to_pylist(), part.column("source").to_pylist(), strict=True)], np.int64)
    starts, ends, hashes = [], [], []
    for a, b in runs(data, offsets, TERM):
        starts.append(a)
        ends.append(b)
        hashes.append(np.fromiter(map(xxh3_64_intdigest, [raw[x:y] for x, y in zip(a.tolist(), b.tolist(), strict=True)]), np.uint64, len(a)))
    kinds = {"lang": pa.string(), "source": pa.string(), "term": pa.string(), "n": pa.int64(), "docs": pa.int64()}
    if not starts or not sum(map(len, starts)):
        return pa.table({k: pa.array([], t) for k, t in kinds.items()})
    a, b = np.concatenate(starts), np.concatenate(ends)
    first, group = grouped(data, a, b, np.concatenate(hashes))
    terms = pa.array([raw[x:y] for x, y in zip(a[first].tolist(), b[first].tolist(), strict=True)], pa.binary()).cast(pa.string())
    width = np.int64(len(first))
    doc = np.searchsorted(offsets, a, "right") - 1
    # a text is in one group, so its terms are counted a text and then a group
    pairs, counts = np.unique(doc * width + group, return_counts=True)
    keys = of_doc[pairs // width] * width + pairs % width
    order = np.argsort(keys, kind="stable")
    found, at = np.unique(keys[order], return_index=True)
    n, docs = np.add.reduceat(counts[order], at), np.diff(np.append(at, len(order)))
    names = list(codes)
    group_of = pa.array(found // width)
    return pa.table(
        {
            "lang": pa.array([x[0] for x in names], pa.string()).take(group_of),
            "source": pa.array([x[1] for x in names], pa.string()).take(group_of),
            "term": terms.take(pa.array(found % width)),
            "n": pa.array(n.astype(np.int64)),
            "docs": pa.array(docs.astype(np.int64)),
        }
    )


def _range_of(terms: pa.ChunkedArray, parts: int) -> np.ndarray:
    """The range of each term, from its bytes alone."""
    from xxhash import xxh3_64_intdigest

    coded = terms.combine_chunks().dictionary_encode()
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    of = np.array([xxh3_64_intdigest(t, 1) % parts for t in coded.dictionary.to_pylist()], np.int64)
    return of[np.asarray(coded.indices)]


def _packed(table: pa.Table) -> bytes:
    import zstandard

    table = pa.table({c: table.column(c).dictionary_encode() if c in ("lang", "source") else table.column(c) for c in table.column_names})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return zstandard.ZstdCompressor(level=1).compress(sink.getvalue().to_pybytes())


def _unpacked(blob: bytes) -> pa.Table:
    import zstandard

    table = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(blob)).read_all()
    return pa.table({c: table.column(c).cast(pa.string()) if c in ("lang", "source") else table.column(c) for c in table.column_names})


def _added(tables: list[pa.Table]) -> pa.Table:
    found = pa.concat_tables(tables).group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("docs", "sum")])
    return found.rename_columns({"n_sum": "n", "docs_sum": "docs"}).select(["lang", "source", "term", "n", "docs"])


def term_counts(docs: DataFrame, audit: Audit, scratch: Scratch) -> DataFrame:
    """(lang, source, term, n, n_lang, first): counts of kept terms by group and by language; first marks one row a kept term of a language.

    docs: lang, source, text without nulls. The one shuffle moves packed counts, dealt by
    ranges of term hashes; ranges are added up one at a time, and a frequent term has as
    many rows there as slices have it, added up as they come.
    """
    count = partitions(docs.sparkSession)
    fine = fine_parts(count)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in together(batches, 2, SLICE):
            table = _counted(part)
            if not table.num_rows:
                continue
            of = _range_of(table.column("term"), count * fine)
            table = table.append_column("of", pa.array(of)).sort_by([("of", "ascending"), ("lang", "ascending"), ("term", "ascending"), ("source", "ascending")])
            of = np.asarray(table.column("of"))
            table = table.drop_columns(["of"])
            cuts = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(of)]
            blobs = [_packed(table.slice(x, y - x)) for x, y in zip(cuts, cuts[1:], strict=False)]
            ranges = of[cuts[:-1]]
            yield pa.RecordBatch.from_arrays([pa.array(ranges // fine), pa.array(ranges % fine), pa.array(blobs, pa.binary())], names=["part", "fine", "blob"])
        give_back()

    def keep(tables: list[pa.Table]) -> pa.Table:
        """Kept terms of a whole range."""
        rows = _added(tables).sort_by([("lang", "ascending"), ("term", "ascending"), ("source", "ascending")])
        if not rows.num_rows:
            return pa.table({c: pa.array([], t) for c, t in (("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("n_lang", pa.int64()), ("first", pa.int32()))})
        new = np.ones(rows.num_rows, bool)
        for name in ("lang", "term"):
            values = rows.column(name).combine_chunks()
            changed = np.asarray(pc.not_equal(values.slice(1), values.slice(0, len(values) - 1)))
            new[1:] = changed if name == "lang" else new[1:] | changed
        at = np.flatnonzero(new)
        sizes = np.diff(np.append(at, len(new)))
        kept = np.repeat(np.add.reduceat(np.asarray(rows.column("docs")), at) >= audit.least, sizes)
        total = np.repeat(np.add.reduceat(np.asarray(rows.column("n")), at), sizes)
        first = new.astype(np.int32)
        made = rows.select(["lang", "source", "term", "n"]).append_column("n_lang", pa.array(total)).append_column("first", pa.array(first))
        return made.filter(pa.array(kept))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        rows, now = 0, None
        for batch in batches:
            for at, blob in zip(batch.column("fine").to_pylist(), batch.column("blob"), strict=True):
                if held and at != now:
                    yield from keep(held).combine_chunks().to_batches()
                    held, rows = [], 0
                now = at
                held.append(_unpacked(blob.as_py()))
                rows += held[-1].num_rows
                if rows > HELD:
                    held = [_added(held)]
                    rows = held[0].num_rows // 2
        if held:
            yield from keep(held).combine_chunks().to_batches()
        give_back()

    sent = docs.select("lang", "source", "text").mapInArrow(send, "part long, fine long, blob binary")
    dealt = sent.repartitionById(count, F.col("part").cast("int")).sortWithinPartitions("part", "fine")
    return scratch.table(dealt.mapInArrow(gather, "lang string, source string, term string, n long, n_lang long, first int"), "counts")


def distances(left: np.ndarray, right: np.ndarray, row: np.ndarray, col: np.ndarray, p: np.ndarray, none: np.ndarray, width: int) -> np.ndarray:
    """Sums of |p of a - p of b| over ``width`` columns, for each a of left and b of right.

    row, col and p are the entries of a CSR matrix, sorted by row and column; a row's other
    columns hold its ``none``.
    """
    starts = np.searchsorted(row, np.arange(len(none) + 1))
    blank = none[row]
    filled = np.zeros(len(row) + 1, np.int64)
    out = np.zeros((len(left), len(right)), np.int64)
    for k, a in enumerate(left.tolist()):
        own = slice(starts[a], starts[a + 1])
        dense = np.full(width, none[a])
        dense[col[own]] = p[own]
        # where b has nothing all of a stands against b's share of nothing
        base = (width - (own.stop - own.start)) * np.abs(none[a] - none) + np.abs(p[own][:, None] - none[None, :]).sum(0)
        there = np.abs(dense[col] - p) - np.abs(dense[col] - blank)
        if len(row):
            filled[:-1] = there
            sums = np.add.reduceat(filled, starts[:-1])
            sums[starts[:-1] == starts[1:]] = 0
        else:
            sums = np.zeros(len(none), np.int64)
        out[k] = (base + sums)[right]
    return out


def _pair_values(counts: DataFrame, groups: DataFrame, audit: Audit, scratch: Scratch) -> DataFrame:
    """(lang, a, b, value) of sources a < b of a language.

    Counts are dealt by language, pair of source tiles and block of terms; blocks are as
    many as keep each tile's part small. A block has the tiles' sources as well, so a pair
    without any term still comes out.
    """
    tiles = groups.groupBy("lang").agg(F.ceil(F.count("*") / F.lit(TILE)).cast("long").alias("tiles"))
    tile = F.pmod(F.xxhash64("source"), F.col("tiles"))
    tiled = counts.join(tiles, "lang").groupBy("lang", "tiles", tile.alias("tile")).agg(F.count("*").alias("n"))
    blocks = tiled.groupBy("lang").agg(F.ceil(F.max("n") / F.lit(BLOCK_COUNTS)).cast("long").alias("blocks"))
    plan = scratch.table(tiles.join(blocks, "lang", "left").select("lang", "tiles", F.coalesce("blocks", F.lit(1)).alias("blocks")), "tiles")
    every = F.transform(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1), lambda x: F.struct(F.least(x, F.col("tile")).alias("i"), F.greatest(x, F.col("tile")).alias("j")))
    dealt = groups.select("lang", "source", "total", "terms").join(plan, "lang").withColumn("tile", tile)
    none = share_sql("0L", "total", "terms", audit)
    heads = dealt.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    heads = heads.select("lang", "block", "tile", F.explode(every).alias("t"), "source", F.lit("").alias("term"), F.when(F.col("terms") > 0, none).otherwise(0).alias("p"))
    rows = counts.join(groups.select("lang", "source", "total", "terms"), ["lang", "source"]).join(plan, "lang").withColumn("tile", tile)
    rows = rows.withColumn("block", F.pmod(F.xxhash64("term", F.lit(1)), F.col("blocks")))
    rows = rows.select("lang", "block", "tile", F.explode(every).alias("t"), "source", "term", share_sql("n", "total", "terms", audit).alias("p"))

    def measure(table: pa.Table) -> pa.Table:
        term = table.column("term").combine_chunks().dictionary_encode()
        source = table.column("source").combine_chunks().dictionary_encode()
        term, source = (x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in (term, source))
        names = source.dictionary.to_pylist()
        of, col, p = np.asarray(source.indices, np.int64), np.asarray(term.indices, np.int64), np.asarray(table.column("p"))
        words = term.dictionary.to_pylist()
        blank = words.index("")
        head = col == blank
        # the sources in the order of their names, the terms without the heads' blank one
        rank = np.empty(len(names), np.int64)
        rank[sorted(range(len(names)), key=lambda k: names[k].encode())] = np.arange(len(names))
        names = sorted(names, key=str.encode)
        of, col = rank[of], col - (col > blank)
        none, side = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
        none[of[head]], side[of[head]] = p[head], np.asarray(table.column("tile"))[head]
        of, col, p = of[~head], col[~head], p[~head]
        order = np.lexsort((col, of))
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        left, right = np.flatnonzero(side == i), np.flatnonzero(side == j)
        width = len(words) - 1
        found = distances(left, right, of[order], col[order], p[order], none, width)
        a, b = np.repeat(left, len(right)), np.tile(right, len(left))
        values = found.ravel()
        once = (a < b) if i == j else np.ones(len(a), bool)
        a, b, values = a[once], b[once], values[once]
        low, high = np.minimum(a, b), np.maximum(a, b)
        named = pa.array(names, pa.string())
        return pa.table(
            {
                "lang": pa.array([table.column("lang")[0].as_py()] * len(a), pa.string()),
                "a": named.take(pa.array(low)),
                "b": named.take(pa.array(high)),
                "value": pa.array(values),
                "width": pa.array(np.full(len(a), width)),
                "gap": pa.array(np.abs(none[a] - none[b])),
            }
        )

    both = rows.unionByName(heads).select("lang", "block", "t.i", "t.j", "tile", "source", "term", "p")
    parts = both.groupBy("lang", "block", "i", "j").applyInArrow(measure, "lang string, a string, b string, value long, width long, gap long")
    total = parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("width").alias("width"), F.max("gap").alias("gap"))
    terms = groups.select("lang", "terms").distinct()
    # terms that neither tile has in a block
    return total.join(terms, "lang").select("lang", "a", "b", (F.col("value") + (F.col("terms") - F.col("width")) * F.col("gap")).alias("value"))


def divergence(docs: DataFrame, audit: Audit | None = None, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(lang, source, part, item, value, rank): distances between the sources of a language, and the terms that a source uses more.

    Nulls count as empty texts and names. A group without terms has the same share for every
    term; a language without kept terms has distances of zero. Repeated rows count each.
    Ties of value go by the item's bytes. Other columns are ignored, whatever their names;
    an empty table gives no rows.
    """
    audit = audit or Audit()
    spark = docs.sparkSession
    scratch = Scratch(spark, "divergence")
    text = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    rows = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).alias("text"))
    counts = term_counts(rows, audit, scratch)
    kept = counts.groupBy("lang").agg(F.sum("first").alias("terms"), F.sum("n").alias("lang_total"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    zero = F.lit(0).cast("long")
    groups = rows.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(kept, "lang", "left")
    groups = scratch.table(groups.select("lang", "source", *[F.coalesce(c, zero).alias(c) for c in ("total", "terms", "lang_total")]), "groups")
    pairs = _pair_values(counts, groups, audit, scratch)
    pairs = pairs.select("lang", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("x"), "value")
    pairs = pairs.select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")
    p, q = share_sql("n", "total", "terms", audit), share_sql("n_lang", "lang_total", "terms", audit)
    terms = counts.join(groups, ["lang", "source"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (p - q).alias("value")).where("value > 0")
    order = Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item")
    best = terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= audit.top)
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(best)
