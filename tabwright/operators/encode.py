"""Masking personal data, encoding categories, and the cleaned table for model training."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwright.functions import numeric, text
from tabwright.functions.schema import (
    as_list, categorical_columns, column, columns, is_numeric, is_scalar,
    numeric_columns, require, type_of,
)
from tabwright.operators.profile import SKEW_LIMIT, Measured, measure
from tabwright.operators.relational import most_frequent
from tabwright.operators.transforms import attach_codes, label_codes
from tabwright.plans.jobs import run_together
from tabwright.plans.quantiles import exact_quantiles

# Name parts that mark personal data, the masks, the share of "@" and the log texts.
PII_NAME_PARTS = ("email", "phone", "ssn", "credit", "card", "name", "ip_address")
NAME_MASK = "[REDACTED]"
EMAIL_MASK = "[REDACTED_EMAIL]"
EMAIL_SHARE = 0.1
NAME_LOG = "Masked entire column '{}' due to PII keyword match."
EMAIL_LOG = "Masked column '{}' due to high email density."
BINARY_LOG = "Binary Encoded '{}': '{}'->0, '{}'->1"
ONE_HOT_LOG = "One-Hot Encoded: {}"
CODES_LOG = "Label-encoded for its number of levels: {}"
NOTHING_LOG = "No categorical columns required encoding."

MAX_LEVELS = 1000
_LOG_SCHEMA = "column string, action string, detail string"
LogRow = tuple[str | None, str, str]


def _text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


@dataclass(frozen=True)
class PiiFindings:
    by_name: list[str]
    by_density: list[str]

    def log(self) -> list[LogRow]:
        return ([(n, "mask_name", NAME_LOG.format(n)) for n in self.by_name]
                + [(n, "mask_email", EMAIL_LOG.format(n)) for n in self.by_density])


def find_pii(df: DataFrame, share: float = EMAIL_SHARE) -> PiiFindings:
    """Text columns with a telling name, or with ``@`` in more than ``share`` of all rows."""
    names = _text_columns(df)
    by_name = [n for n in names if any(part in n.lower() for part in PII_NAME_PARTS)]
    others = [n for n in names if n not in by_name]
    if not others:
        return PiiFindings(by_name, [])
    row = df.agg(F.count(F.lit(1)).alias("rows"), *[
        F.count_if(text.has_at_sign(column(n))).alias(str(i)) for i, n in enumerate(others)]).first()
    dense = [n for i, n in enumerate(others) if row[str(i)] > share * row["rows"]]
    return PiiFindings(by_name, dense)


def scrub_pii(df: DataFrame, share: float = EMAIL_SHARE, mode: str = "column",
              findings: PiiFindings | None = None) -> DataFrame:
    """Mask what ``find_pii`` finds: whole columns, nulls included.

    ``mode="cell"`` replaces only the addresses inside the ``@`` columns.
    """
    if mode not in ("column", "cell"):
        raise ValueError(f"unknown mode {mode!r}; use column or cell")
    findings = findings or find_pii(df, share)
    masked = {n: F.lit(NAME_MASK) for n in findings.by_name}
    for n in findings.by_density:
        masked[n] = (F.lit(EMAIL_MASK) if mode == "column"
                     else text.mask_emails(column(n), EMAIL_MASK))
    return df.withColumns(masked) if masked else df


def pii_log(df: DataFrame, share: float = EMAIL_SHARE) -> DataFrame:
    return df.sparkSession.createDataFrame(find_pii(df, share).log(), _LOG_SCHEMA)


def levels_of(df: DataFrame, names: Sequence[str],
              limit: int = MAX_LEVELS) -> dict[str, list[str] | None]:
    """Sorted distinct non-null values as text; None for a column with more than ``limit``.

    A sketch first sets aside columns far beyond the limit, so that the exact
    lists brought to the driver are short.
    """
    if not names:
        return {}
    row = df.agg(*[F.approx_count_distinct(column(n)).alias(str(i))
                   for i, n in enumerate(names)]).first()
    listed = [n for i, n in enumerate(names) if row[i] <= 1.5 * limit + 10]
    result: dict[str, list[str] | None] = {n: [] if n in listed else None for n in names}
    if listed:
        cells = [F.struct(F.lit(n).alias("feature"), column(n).cast("string").alias("value"))
                 for n in listed]
        found = (df.select(F.inline(F.array(*cells))).where(F.col("value").isNotNull())
                 .groupBy("feature", "value").count().collect())
        for r in found:
            result[r["feature"]].append(r["value"])
    return {n: sorted(v) if v is not None and len(v) <= limit else None for n, v in result.items()}


@dataclass(frozen=True)
class Encoding:
    """Fitted levels; ``apply`` gives any table the same columns."""

    binary: Mapping[str, tuple[str, str]] = field(default_factory=dict)
    one_hot: Mapping[str, Sequence[str]] = field(default_factory=dict)
    coded: Mapping[str, DataFrame] = field(default_factory=dict)

    def apply(self, df: DataFrame) -> DataFrame:
        require(df, *self.binary, *self.one_hot, *self.coded)
        for n, lookup in self.coded.items():
            df = attach_codes(df.withColumn(n, column(n).cast("string")), n, lookup, n)
        kept = []
        for n in df.columns:
            if n in self.binary:
                low, high = self.binary[n]
                value = column(n).cast("string")
                kept.append(F.when(value == low, 0).when(value == high, 1).alias(n))
            elif n not in self.one_hot:
                kept.append(column(n))
        for n, levels in self.one_hot.items():
            value = column(n).cast("string")
            kept += [F.when(value == level, 1).otherwise(0).alias(f"{n}_{level}")
                     for level in levels[1:]]
        result = df.select(*kept)
        if len(set(result.columns)) < len(result.columns):
            raise ValueError("an encoded column would have the name of another column")
        return result

    def log(self) -> list[LogRow]:
        rows: list[LogRow] = [(n, "binary", BINARY_LOG.format(n, *pair))
                              for n, pair in self.binary.items()]
        if self.one_hot:
            rows.append((None, "one_hot", ONE_HOT_LOG.format(", ".join(self.one_hot))))
        if self.coded:
            rows.append((None, "codes", CODES_LOG.format(", ".join(self.coded))))
        return rows


def _codes(df: DataFrame, names: Sequence[str]) -> dict[str, DataFrame]:
    """Codes of the sorted levels of columns that have too many for one column each."""
    return {n: label_codes(df.select(column(n).cast("string").alias(n)), n) for n in names}


def fit_encoding(df: DataFrame, names: Sequence[str] | None = None, binary: bool = True,
                 one_hot: bool = True, max_levels: int = MAX_LEVELS) -> Encoding:
    """Two-level columns become 0/1 (lower value 0), the others one column per further level.

    A column with more than ``max_levels`` levels becomes one column of label codes instead, however
    many there are; ``max_levels`` says where a table would get too wide.
    """
    names = as_list(names) or categorical_columns(df, encodable_only=True)
    require(df, *names)
    levels = levels_of(df, names, max_levels)
    pairs = {n: tuple(v) for n, v in levels.items() if binary and v is not None and len(v) == 2}
    rest = {n: v for n, v in levels.items() if n not in pairs}
    if not one_hot:
        return Encoding(pairs)
    wide = [n for n, v in rest.items() if v is None]
    return Encoding(pairs, {n: v for n, v in rest.items() if v is not None}, _codes(df, wide))


def binary_encode(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    return fit_encoding(df, names, one_hot=False).apply(df)


def one_hot(df: DataFrame, names: Sequence[str] | None = None,
            max_levels: int = MAX_LEVELS) -> DataFrame:
    """Int columns ``{column}_{level}`` after the others; the first level has none, null is all 0."""
    return fit_encoding(df, names, binary=False, max_levels=max_levels).apply(df)


def encode(df: DataFrame, mask_pii: bool = True,
           max_levels: int = MAX_LEVELS) -> tuple[DataFrame, DataFrame]:
    """Mask, then encode: (table, log of what was done)."""
    rows: list[LogRow] = []
    if mask_pii:
        findings = find_pii(df)
        df = scrub_pii(df, findings=findings)
        rows += findings.log()
    encoding = fit_encoding(df, max_levels=max_levels)
    rows += encoding.log()
    rows = rows or [(None, "none", NOTHING_LOG)]
    return encoding.apply(df), df.sparkSession.createDataFrame(rows, _LOG_SCHEMA)


def encoding_log(df: DataFrame, mask_pii: bool = True, max_levels: int = MAX_LEVELS) -> DataFrame:
    return encode(df, mask_pii, max_levels)[1]


def encoded_preview(df: DataFrame, order_by: str | Sequence[str], n: int = 5,
                    max_levels: int = MAX_LEVELS) -> DataFrame:
    """First ``n`` rows of the masked and encoded table; levels come from the whole table."""
    encoded, _ = encode(df, True, max_levels)
    require(encoded, *as_list(order_by))
    return encoded.orderBy(*columns(as_list(order_by))).limit(n)


def _medians(df: DataFrame, measured: Mapping[str, Measured],
             accuracy: int | None) -> dict[str, float]:
    if accuracy and measured:
        row = df.agg(*[F.percentile_approx(column(n).cast("double"), 0.5, accuracy).alias(str(i))
                       for i, n in enumerate(measured)]).first()
        return dict(zip(measured, row))
    known = {n: (m.count, m.min, m.max) for n, m in measured.items()}
    return {n: v[0] for n, v in exact_quantiles(df, list(known), [0.5], known).items()}


@dataclass(frozen=True)
class Cleaning:
    """What ``fit_clean`` found out about a table; ``apply`` does the same to any table with its columns."""

    medians: Mapping[str, float]
    tops: Mapping[str, str]
    shifts: Mapping[str, float | None]
    encoding: Encoding
    keep: tuple[str, ...] = ()
    masks: PiiFindings = PiiFindings([], [])

    def filled(self, df: DataFrame) -> DataFrame:
        require(df, *self.medians, *self.tops, *self.shifts, *self.keep)
        df = scrub_pii(df, findings=self.masks)
        fills = {n: F.coalesce(column(n).cast("double"), F.lit(v)) for n, v in self.medians.items()}
        fills |= {n: F.coalesce(column(n), F.lit(v).cast(type_of(df, n))) for n, v in self.tops.items()}
        return df.withColumns(fills) if fills else df

    def apply(self, df: DataFrame) -> DataFrame:
        df = self.filled(df)
        logs = {n: numeric.log1p(column(n).cast("double"), None if shift is None else F.lit(shift))
                for n, shift in self.shifts.items()}
        return self.encoding.apply(df.withColumns(logs) if logs else df)


def auto_clean(df: DataFrame, mask_pii: bool = False, max_levels: int = MAX_LEVELS,
               accuracy: int | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """A table ready for model training.

    Numeric nulls become the median and other nulls the mode; numeric columns
    with |skewness| > 1.5 after that get the shifted log; two-level columns
    become 0/1 and other text columns one-hot, or label codes beyond
    ``max_levels``. Columns in ``keep`` stay as they are. Small aggregates fit
    the parameters, then one projection over the table applies them all.
    """
    return fit_clean(df, mask_pii, max_levels, accuracy, keep).apply(df)


def fit_clean(df: DataFrame, mask_pii: bool = False, max_levels: int = MAX_LEVELS,
              accuracy: int | None = None, keep: Sequence[str] = ()) -> Cleaning:
    """The parameters of ``auto_clean``, for use on other tables too.

    There, a null of a column that had none here stays, and so does a level that was
    not seen here: as null of two-level columns and codes, as all 0 of one-hot columns.
    """
    require(df, *keep)
    masks = find_pii(df) if mask_pii else PiiFindings([], [])
    df = scrub_pii(df, findings=masks)
    worked = df.drop(*keep)
    measured = {m.feature: m for m in measure(worked)}
    gaps = [n for n, m in measured.items() if m.null_count and m.count]
    numbers = [n for n in gaps if is_numeric(type_of(df, n))]
    others = [n for n in gaps if is_scalar(type_of(df, n)) and n not in numbers]
    names = [n for n in categorical_columns(worked) if is_scalar(type_of(df, n))]
    medians, tops, levels = run_together(df.sparkSession, lambda fit: fit(), [
        lambda: _medians(df, {n: measured[n] for n in numbers}, accuracy),
        lambda: most_frequent(df, others) if others else {},
        lambda: levels_of(df, names, max_levels),
    ])
    filled = Cleaning(medians, tops, {}, Encoding()).filled(df)
    if numbers:
        measured.update({m.feature: m for m in measure(filled, numbers)})
    shifts = {}
    for n in (n for n in numeric_columns(filled) if n not in keep):
        skew, low = measured[n].skew, measured[n].min
        if skew is not None and abs(skew) > SKEW_LIMIT:
            shifts[n] = 1.0 - low if low <= 0 else None
    pairs = {n: tuple(v) for n, v in levels.items() if v is not None and len(v) == 2}
    rest = [n for n in names if n not in pairs and isinstance(type_of(df, n), T.StringType)]
    listed = {n: levels[n] for n in rest if levels[n] is not None}
    coded = _codes(filled, [n for n in rest if n not in listed])
    return Cleaning(medians, tops, shifts, Encoding(pairs, listed, coded), tuple(keep), masks)
