"""How the words of a source differ from those of other sources and of its language.

Terms are runs of letters (A-Z, a-z and all beyond ASCII), with A-Z lower-cased. A language keeps the terms of
at least ``LEAST_DOCS`` of its documents. A share is ``1 + floor(10^9 (count + 5) / (N + 5 V))``.

Tasks count terms by language and source before the shuffle, by 64-bit hashes (different terms are taken to differ).
Terms of a language with the
same counts in all sources become one weighted row; the rows of a language are dealt by hash to blocks of
about ``CELLS`` counts. In a block the rows are reordered so that equal counts lie together, the column of each
source is run-length encoded, and for a pair of sources the bounds of the runs are intersected: each common run
gives the difference of two shares times its length. All arithmetic is exact: 64-bit integers, or Python's
where a count doesn't fit, and decimals in Spark.

Defined cases: null lang and source are ''; a null, empty or letterless text has no term but its group occurs.
Repeated rows count as documents of their own. A language without kept terms gives pairs of value 0, a language
with one source no pair; an empty table gives no row. Ties go by the item's UTF-8 bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabwright.llm.arrays import Texts, mixed, ragged, slices, word_hashes, words_of
from tabwright.llm.groups import by_group, whole_groups
from tabwright.llm.rows import arrow_schema, ddl, lean
from tabwright.plans import storage

LEAST_DOCS = 30
TOP_TERMS = 50
SCALE, PRIOR = 1_000_000_000, 5
#: Counts in a block of terms by sources, words that a task holds before it hands on their counts, rows of a batch.
CELLS = 1 << 16
HELD = 1 << 21
OUT = 50_000

#: Bytes to letters: A-Z in lower case, others of ASCII a space, the rest as they are.
_LETTERS = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint8)


def _grouped(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), "text")


class _Counter:
    """Terms of some slices of rows, counted by group in one sort; memory follows their bytes."""

    def __init__(self):
        self.groups: dict[tuple[str, str], int] = {}
        self.parts, self.held, self.rows, self.bytes = [], 0, 0, 0

    def add(self, texts: Texts, langs: list[str], sources: list[str]) -> None:
        ids = np.array([self.groups.setdefault(g, len(self.groups)) for g in zip(langs, sources)], np.int64)
        letters = Texts(texts.first, _LETTERS[texts.data], texts.offsets)
        words = words_of(letters)
        group = ids[words.row]
        keys = mixed(word_hashes(letters.data, words) + mixed(group.astype(np.uint64) + np.uint64(1)))
        self.parts.append((keys, words.row + self.rows, group, words.starts + self.bytes, words.ends - words.starts, letters.data))
        self.rows += texts.rows
        self.bytes += len(letters.data)
        self.held += len(keys)

    def rows_out(self, schema: pa.Schema):
        keys, row, group, starts, lengths, data = (np.concatenate(c) for c in zip(*self.parts))
        order = np.argsort(keys, kind="stable")
        new, other = np.ones(len(keys), bool), np.ones(len(keys), bool)
        new[1:] = keys[order][1:] != keys[order][:-1]
        other[1:] = new[1:] | (row[order][1:] != row[order][:-1])
        begins = np.flatnonzero(new)
        n = np.diff(np.append(begins, len(keys)))
        docs = np.add.reduceat(other, begins, dtype=np.int64) if len(begins) else n
        first = order[begins]
        names = [pa.array(list(c), pa.string()) for c in zip(*self.groups)]
        for at in range(0, len(first), OUT):
            some = first[at:at + OUT]
            ends = np.append(0, np.cumsum(lengths[some])).astype(np.int32)
            terms = pa.StringArray.from_buffers(
                len(some), pa.py_buffer(ends), pa.py_buffer(data[ragged(starts[some], lengths[some])]))
            yield pa.RecordBatch.from_arrays(
                [*(c.take(pa.array(group[some])) for c in names), terms, pa.array(n[at:at + OUT]),
                 pa.array(docs[at:at + OUT])], schema=schema)


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (rows with it): partial counts of tasks."""
    columns = {"lang": "string", "source": "string", "term": "string", "n": "bigint", "docs": "bigint"}
    schema = arrow_schema(columns)

    def count(batches):
        counter = _Counter()
        for batch in batches:
            langs, sources = batch.column("lang").to_pylist(), batch.column("source").to_pylist()
            for texts in slices(batch.column("text")):
                here = slice(texts.first, texts.first + texts.rows)
                counter.add(texts, langs[here], sources[here])
                if counter.held > HELD:
                    yield from counter.rows_out(schema)
                    counter = _Counter()
        if counter.parts:
            yield from counter.rows_out(schema)

    return _grouped(docs).mapInArrow(lean(count), ddl(columns))


def kept_terms(docs: DataFrame) -> DataFrame:
    """lang, term and counts: its (source, n) in order of the source, for the terms that a language keeps."""
    each = term_counts(docs).groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    return each.groupBy("lang", "term").agg(
        F.sum("docs").alias("docs"), F.sort_array(F.collect_list(F.struct("source", "n"))).alias("counts"),
    ).where(F.col("docs") >= LEAST_DOCS).drop("docs")


def group_sizes(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """lang, source, size (N), lang_size (N of the language) and terms (V), for every group that occurs."""
    sizes = terms.select("lang", F.explode("counts").alias("c")).groupBy("lang", F.col("c.source").alias("source")).agg(
        F.sum("c.n").alias("size"))
    known = _grouped(docs).select("lang", "source").distinct().join(sizes, ["lang", "source"], "left")
    known = known.withColumn("size", F.coalesce("size", F.lit(0).cast("bigint")))
    langs = known.groupBy("lang").agg(F.sum("size").alias("lang_size")).join(
        terms.groupBy("lang").agg(F.count("*").alias("terms")), "lang", "left")
    return known.join(langs, "lang").withColumn("terms", F.coalesce("terms", F.lit(0).cast("bigint")))


def shares(counts: np.ndarray, size: int, terms: int) -> np.ndarray:
    """The share of each count, exactly."""
    if len(counts) and int(counts.max()) + PRIOR > (1 << 62) // SCALE:
        return np.array([1 + SCALE * (int(c) + PRIOR) // (size + PRIOR * terms) for c in counts], np.int64)
    return 1 + SCALE * (counts + PRIOR) // (size + PRIOR * terms)


def run_lengths(matrix: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """An order of the rows in which equal counts lie together, and where each column's runs begin in it.

    Columns with few different counts are sorted first, so that their runs are the longest.
    """
    different = [len(np.unique(matrix[:, s])) for s in range(matrix.shape[1])]
    keys = np.argsort(different, kind="stable")[::-1]
    order = np.lexsort(matrix[:, keys].T)
    sorted_rows = matrix[order]
    new = np.ones(matrix.shape, bool)
    new[1:] = sorted_rows[1:] != sorted_rows[:-1]
    return order, [np.flatnonzero(new[:, s]) for s in range(matrix.shape[1])]


def _pair_values(matrix: np.ndarray, weights: np.ndarray, sizes: list[int], terms: int):
    """(i, j, sum of the differences of their shares) for all pairs i < j of columns."""
    order, begins = run_lengths(matrix)
    place = np.concatenate([[0], np.cumsum(weights[order])])
    values = [shares(matrix[order[b], s], sizes[s], terms) for s, b in enumerate(begins)]
    for i in range(len(sizes)):
        for j in range(i + 1, len(sizes)):
            cuts = np.union1d(begins[i], begins[j])
            mine = values[i][np.searchsorted(begins[i], cuts, "right") - 1]
            other = values[j][np.searchsorted(begins[j], cuts, "right") - 1]
            lengths = np.diff(place[np.append(cuts, len(order))])
            yield i, j, int((np.abs(mine - other) * lengths).sum())


def pair_sums(terms: DataFrame, sizes: DataFrame) -> DataFrame:
    """lang, source, item, value for all ordered pairs of sources of a language."""
    langs = sizes.groupBy("lang").agg(
        F.first("terms").alias("terms"), F.sort_array(F.collect_list(F.struct("source", "size"))).alias("sources"))
    langs = langs.withColumn(
        "blocks", F.greatest(F.ceil(F.col("terms") * F.size("sources") / CELLS), F.lit(1)).cast("bigint"))
    patterns = terms.groupBy("lang", "counts").agg(F.count("*").alias("times"))
    none = F.lit(None)
    rows = storage.attach(patterns, langs.select("lang", "blocks"), ["lang"]).select(
        "lang", F.pmod(F.xxhash64("counts"), "blocks").alias("block"), "counts", "times",
        none.cast("bigint").alias("terms"), none.cast("array<struct<source:string,size:bigint>>").alias("sources"))
    heads = langs.select(
        "lang", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("block"),
        none.cast("array<struct<source:string,n:bigint>>").alias("counts"), none.cast("bigint").alias("times"),
        "terms", "sources")
    result = {"lang": "string", "left": "string", "right": "string", "value": "bigint"}
    schema = arrow_schema(result)

    def compare(batches):
        for table, begins in whole_groups(batches, ("lang", "block")):
            for a, b in zip(begins[:-1], begins[1:]):
                group = table.slice(a, b - a)
                head = group.slice(0, 1).to_pylist()[0]  # sorts before the terms
                names = [s["source"] for s in head["sources"]]
                body = group.slice(1)
                counts = body["counts"].combine_chunks()
                flat = counts.flatten()
                matrix = np.zeros((body.num_rows, len(names)), np.int64)
                at = pc.index_in(flat.field("source"), pa.array(names, pa.string())).to_numpy()
                matrix[np.repeat(np.arange(body.num_rows), pc.list_value_length(counts).to_numpy()), at] = \
                    flat.field("n").to_numpy()
                if body.num_rows:
                    found = _pair_values(matrix, body["times"].to_numpy(), [s["size"] for s in head["sources"]], head["terms"])
                else:
                    found = ((i, j, 0) for i in range(len(names)) for j in range(i + 1, len(names)))
                for part in _chunks(found, 50_000):
                    left, right, value = zip(*part)
                    yield pa.RecordBatch.from_arrays([
                        pa.repeat(pa.scalar(head["lang"], pa.string()), len(part)),
                        pa.array([names[i] for i in left], pa.string()),
                        pa.array([names[j] for j in right], pa.string()), pa.array(value, pa.int64())], schema=schema)

    dealt = by_group(heads.unionByName(rows), ["lang", "block"], F.col("sources").isNull())
    sums = dealt.mapInArrow(lean(compare), ddl(result)).groupBy("lang", "left", "right").agg(F.sum("value").alias("value"))
    both = F.explode(F.array(F.struct(F.col("left").alias("source"), F.col("right").alias("item")),
                             F.struct(F.col("right").alias("source"), F.col("left").alias("item"))))
    return sums.select("lang", both.alias("p"), "value").select("lang", "p.source", "p.item", "value")


def _chunks(items, size: int):
    part = []
    for item in items:
        part.append(item)
        if len(part) == size:
            yield part
            part = []
    if part:
        yield part


def _share(count: str, size: str) -> Column:
    return F.expr(f"1 + ({SCALE} * CAST({count} + {PRIOR} AS DECIMAL(24, 0))) div CAST({size} + {PRIOR} * terms AS DECIMAL(24, 0))")


def excess_terms(terms: DataFrame, sizes: DataFrame) -> DataFrame:
    """lang, source, item, value of the terms whose share in a group exceeds the one in its language."""
    total = F.aggregate("counts", F.lit(0).cast("bigint"), lambda s, c: s + c["n"])
    each = terms.select("lang", "term", total.alias("lang_n"), F.explode("counts").alias("c")).select(
        "lang", F.col("c.source").alias("source"), F.col("term").alias("item"), F.col("c.n").alias("n"), "lang_n")
    value = _share("n", "size") - _share("lang_n", "lang_size")
    return storage.attach(each, sizes, ["lang", "source"]).select("lang", "source", "item", value.alias("value")).where("value > 0")


def audit(docs: DataFrame) -> DataFrame:
    """lang, source, part, item, value, rank: every pair of sources, and the top terms of each group."""
    terms = storage.written(kept_terms(docs), "kept-terms")
    sizes = storage.written(group_sizes(docs, terms), "group-sizes")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pair_sums(terms, sizes).withColumn("rank", F.row_number().over(order))
    top = excess_terms(terms, sizes).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP_TERMS)
    columns = ("lang", "source", "part", "item", "value", "rank")
    return pairs.withColumn("part", F.lit("pair")).select(*columns).union(
        top.withColumn("part", F.lit("term")).select(*columns))
