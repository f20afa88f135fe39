"""Language identification by compression with one Zstandard dictionary for each language.

A text is reduced to its lower-case letters, other runs becoming one space, and cut into chunks; each
chunk is compressed with the raw-content dictionary of every
language, and the language with the smallest total wins. Where the runner-up comes close the
prediction is marked as rejected. Learning takes a bounded sample (``SAMPLE_TEXTS`` texts of a
language, of each at most ``SAMPLE_CHARS`` characters, ``DICTIONARY_BYTES`` in all); prediction
reads whole texts.

Defined cases: a null text, or one without a letter, is ``und`` with score 0 and rejected. With no
labelled text at all every prediction is ``und``. With a single language the score is 1. Ties go to
the first language in alphabetical order. Repeated rows get equal results; other columns are ignored.
"""

from __future__ import annotations

import re

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabwright.llm.rows import extend_texts, free_name, map_texts
from tabwright.plans import storage

SAMPLE_TEXTS, SAMPLE_CHARS, DICTIONARY_BYTES = 400, 4_096, 1 << 17
CHUNK_BYTES = 1 << 11
LEVEL = 6
MIN_MARGIN = 0.01
UNKNOWN = "und"
_OTHER = re.compile(r"[\W\d_]+")


def letters(text: str) -> bytes:
    return _OTHER.sub(" ", text).strip().lower().encode()


def learn(labelled: DataFrame) -> dict[str, bytes]:
    """Dictionary content for each non-null value of ``lang``.

    Equal texts are counted once before the sample is taken, so a large group of copies can't fill a
    dictionary. The sample is the texts with the smallest hashes.
    """
    digest = F.xxhash64("text")
    known = labelled.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    distinct = known.select("lang", digest.alias("digest")).distinct()
    distinct = storage.written(distinct, "texts")
    # a frequent language is thinned by hash to about twice the sample before its texts are ranked
    sizes = {r["lang"]: r["n"] for r in distinct.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return {}
    thin = F.create_map(*(F.lit(x) for lang, n in sizes.items() for x in (lang, max(1, n // (2 * SAMPLE_TEXTS)))))
    few = distinct.where(F.pmod("digest", F.try_element_at(thin, "lang")) == 0)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("digest"))
    chosen = few.withColumn("rank", rank).where(F.col("rank") <= SAMPLE_TEXTS)
    wanted = {(r["lang"], r["digest"]) for r in chosen.collect()}
    # equal texts have one digest, so this is at most SAMPLE_TEXTS rows of a language whatever the ids are
    sample = known.where(digest.isin(sorted({d for _, d in wanted}))).select(
        "lang", digest.alias("digest"), F.substring("text", 1, SAMPLE_CHARS).alias("text")).distinct()
    parts: dict[str, bytearray] = {lang: bytearray() for lang, _ in wanted}
    for row in sorted((r for r in sample.collect() if (r["lang"], r["digest"]) in wanted),
                      key=lambda r: (r["lang"], r["digest"])):
        if len(parts[row["lang"]]) < DICTIONARY_BYTES:
            parts[row["lang"]] += letters(row["text"]) + b"\n"
    return {lang: bytes(part[:DICTIONARY_BYTES]) for lang, part in sorted(parts.items())}


def judging(dictionaries: dict[str, bytes]):
    """For ``map_texts``: the predicted language, the score and whether it is rejected."""
    names = list(dictionaries)

    def start():
        coders = [zstandard.ZstdCompressor(level=LEVEL, dict_data=_prepared(content), write_content_size=False)
                  for content in dictionaries.values()]

        def judge(texts, _):
            found, scores = [], []
            for row in range(texts.rows):
                text = texts.text(row).decode()
                if not names or not any(map(str.isalpha, text)):
                    found.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                plain = letters(text)
                chunks = [plain[at:at + CHUNK_BYTES] for at in range(0, len(plain), CHUNK_BYTES)]
                sizes = [sum(len(coder.compress(chunk)) for chunk in chunks) for coder in coders]
                best = min(range(len(names)), key=sizes.__getitem__)
                rest = min((s for i, s in enumerate(sizes) if i != best), default=None)
                found.append(names[best])
                scores.append(1.0 if rest is None else (rest - sizes[best]) / rest)
            rejected = [name == UNKNOWN or score < MIN_MARGIN for name, score in zip(found, scores)]
            return [pa.array(found, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())]

        return judge

    return start


OUTCOME = {"lang_pred": "string", "score": "double", "rejected": "boolean"}


def predict(docs: DataFrame, dictionaries: dict[str, bytes], columns: dict[str, str]) -> DataFrame:
    """The named columns of ``docs`` (name: type) with lang_pred, score and rejected.

    ``score`` is how much smaller the best total is than the next one, as a share of the latter.
    """
    start = judging(dictionaries)

    def with_columns():
        judge = start()
        return lambda texts, rows: [*(rows.column(c) for c in columns), *judge(texts, rows)]

    return map_texts(docs.select(*dict.fromkeys([*columns, "text"])), columns | OUTCOME, with_columns)


def recognised(docs: DataFrame, dictionaries: dict[str, bytes]) -> DataFrame:
    """The rows of ``docs`` whose language isn't rejected, with their columns."""
    names = docs.columns
    added = {free_name(docs, n): kind for n, kind in OUTCOME.items()}
    judged = extend_texts(docs, added, judging(dictionaries))
    return judged.where(~F.col(list(added)[2])).select(*names)


def _prepared(content: bytes) -> zstandard.ZstdCompressionDict:
    dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    dictionary.precompute_compress(level=LEVEL)
    return dictionary


def identify(docs: DataFrame, held_out: Column) -> DataFrame:
    """Learn from the labelled rows outside ``held_out``, predict all rows."""
    marked = docs.select("doc_id", "text", "lang", held_out.alias("held_out"))
    dictionaries = learn(marked.where(~F.col("held_out")).select("doc_id", "text", "lang"))
    return predict(marked.select("doc_id", F.coalesce("held_out", F.lit(False)).alias("held_out"), "text"),
                   dictionaries, {"doc_id": "bigint", "held_out": "boolean"})
