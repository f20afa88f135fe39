"""Personal data by weak supervision, in DataFrame functions alone.

Base patterns give spans that always stay. Wider patterns propose further candidates. Labelers vote on
each one (1, 0 or -1): a regular expression for the strict form, a gazetteer (domains, prefixes, names of
settings), the words in front, and the shape. The votes of all candidates are counted by pattern; on that
table, whose size is bounded by kinds and labelers, expectation-maximisation estimates how reliable each
labeler is for each kind, and a logistic classifier is trained on the resulting probabilities. It then
decides on every candidate; one that overlaps a base span, or an earlier accepted one, adds nothing.

Defined cases: a null text is empty; no candidates train no classifier, and nothing is added; positions
count code points, the end is exclusive; repeated rows get equal results.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.plans import storage

#: Fixed patterns of the base spans, without superfluous retries: a match can't begin inside a run whose
#: start has failed, so looking behind saves quadratic time on long runs and changes nothing.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?+[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret", "id")

#: Candidates beyond the base, each with the kind it may be.
WIDER = (
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?[\[(](?:at|AT)[\])]\x20?[A-Za-z0-9-]{1,63}+"
              r"(?:\x20?(?:[\[(](?:dot|DOT)[\])]|\.)\x20?[A-Za-z0-9-]{1,63}+){1,8}+"),
    ("phone", r"(?<![0-9+.-])(?:\([0-9]{2,4}\)\x20?|[0-9]{2,4}[\x20.-])[0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9.-])"),
    ("secret", r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{20,200}+(?![A-Za-z0-9_+/=-])"),
    ("id", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
)

#: Gazetteers and context words, fixed values in natural order.
DOMAINS = ("com", "org", "net", "edu", "gov", "io", "info", "de", "fr", "es", "uk", "eu", "us", "ch", "at")
CALLING_CODES = ("1", "33", "34", "39", "41", "43", "44", "49", "52", "54", "61", "81", "86", "91")
CUES = {
    "email": "e-?mail|mail|contact|kontakt|correo|courriel|write|schreib",
    "ip": r"\bip\b|address|adresse|host|server|dirección|addr",
    "card": "card|karte|tarjeta|carte|visa|mastercard|amex|konto",
    "phone": "phone|call|tel|mobile|fax|handy|llam|appel|anruf",
    "secret": "token|key|secret|passw|credential|auth|bearer",
    "id": "ssn|social|ident|passport|ausweis|dni|sécurité",
}
CONTEXT_CHARS = 32
LABELERS = ("regex", "gazetteer", "context", "shape")
LENGTHS = (8, 16, 32)
ROUNDS, SMOOTHING, ACCEPT = 50, 1.0, 0.9


def located(text: Column, pattern: str) -> Column:
    """All matches as an array of (start, end, found), in code points."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    steps = F.zip_with(F.slice(between, F.lit(1), F.size(found)), found, lambda gap, hit: F.struct(
        F.length(gap).cast("long").alias("gap"), F.length(hit).cast("long").alias("size"), hit.alias("found")))
    start = F.struct(F.lit(0).cast("long").alias("at"),
                     F.expr("cast(array() as array<struct<start:bigint,`end`:bigint,found:string>>)").alias("out"))
    done = F.aggregate(steps, start, lambda held, step: F.struct(
        (held["at"] + step["gap"] + step["size"]).alias("at"),
        F.concat(held["out"], F.array(F.struct(
            (held["at"] + step["gap"]).alias("start"), (held["at"] + step["gap"] + step["size"]).alias("end"),
            step["found"].alias("found")))).alias("out")))
    return F.when(F.size(found) > 0, done["out"]).otherwise(start["out"])


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def base_spans(text: Column) -> dict[str, Column]:
    """The base spans of each kind, as arrays of (start, end, found)."""
    return {
        "email": located(text, EMAIL),
        "ip": F.filter(located(text, IP), lambda s: s["found"].rlike(rf"^(?:{_OCTET}\.){{3}}{_OCTET}$")),
        "card": F.filter(located(text, CARD), lambda s: F.length(_digits(s["found"])).between(13, 19)
                         & F.call_function("luhn_check", _digits(s["found"]))),
        "phone": F.filter(located(text, PHONE), lambda s: F.length(_digits(s["found"])).between(9, 15)),
    }


def _overlaps(span: Column, others: Column) -> Column:
    return F.exists(others, lambda o: (o["start"] < span["end"]) & (span["start"] < o["end"]))


def _votes(kind: str, span: Column, before: Column, is_base: bool) -> Column:
    """What each labeler says about a span: 1, 0 or -1."""
    found, digits = span["found"], _digits(span["found"])

    def vote(yes: Column, no: Column) -> Column:
        return F.when(yes, 1).when(no, -1).otherwise(0)

    different = F.size(F.array_distinct(F.split(F.lower(F.regexp_replace(found, "[^A-Za-z0-9]", "")), "")))
    strict = {
        "email": r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,24}$",
        "ip": r"^(?:[1-9][0-9]?|1[0-9]{2}|2[01][0-9]|22[0-3])(?:\.(?:0|[1-9][0-9]{0,2})){3}$",
        "card": r"^(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7})$",
        "phone": r"^(?:\+|\()",
        "secret": r"^(?:[0-9a-f]{32,128}|[0-9A-F]{32,128}|(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9_+/-]{20,})$",
        "id": r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$",
    }[kind]
    listed = {
        "email": F.lower(F.regexp_extract(found, r"([A-Za-z]+)$", 1)).isin(*DOMAINS),
        "ip": ~found.rlike(r"^(?:0|127|22[4-9]|2[3-9][0-9])\."),
        "card": digits.rlike("^(?:4|5[1-5]|2[2-7]|3[47]|6)"),
        "phone": found.rlike(rf"^\+(?:{'|'.join(CALLING_CODES)})"),
        "secret": before.rlike(r"(?i)(?:token|key|secret|passw\w*|auth)\w*[\"']?\s*[=:]\s*[\"']?$"),
        "id": F.lit(False),
    }[kind]
    glued = F.substring(before, -1, 1).rlike(r"[\p{L}\p{N}_]")
    return F.struct(
        vote(found.rlike(strict), ~found.rlike(strict)).alias("regex"),
        vote(listed, ~listed & F.lit(kind not in ("id", "phone"))).alias("gazetteer"),
        vote(before.rlike(f"(?i)(?:{CUES[kind]})"), glued).alias("context"),
        vote(different >= 5, different <= 2).alias("shape"),
        F.lit(is_base).alias("base"),
        F.aggregate(F.array(*(F.length(found) > n for n in LENGTHS)), F.lit(0),
                    lambda a, b: a + b.cast("int")).alias("length"),
        F.lit(kind).alias("kind"), span["start"].alias("start"), span["end"].alias("end"))


def annotated(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The kept columns, ``pii_base`` (a struct of spans by kind) and ``pii_votes`` (all candidates)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(*keep, text.alias("pii_text"), F.struct(
        *(spans.alias(kind) for kind, spans in base_spans(text).items())).alias("pii_base"))
    taken = F.concat(*(F.col(f"pii_base.{kind}") for kind in BASE))
    wide = base.withColumns({
        "pii_taken": taken,
        **{f"pii_wide_{i}": located(F.col("pii_text"), pattern) for i, (_, pattern) in enumerate(WIDER)}})

    def before(span: Column) -> Column:
        width = F.least(span["start"], F.lit(CONTEXT_CHARS)).cast("int")
        return F.substr(F.col("pii_text"), (span["start"] - width + 1).cast("int"), width)

    def voted(spans: Column, kind: str, is_base: bool) -> Column:
        return F.transform(spans, lambda s: _votes(kind, s, before(s), is_base))

    votes = [voted(F.col(f"pii_base.{kind}"), kind, True) for kind in BASE]
    votes += [voted(F.filter(F.col(f"pii_wide_{i}"), lambda s: ~_overlaps(s, F.col("pii_taken"))), kind, False)
              for i, (kind, _) in enumerate(WIDER)]
    return wide.select(*keep, "pii_text", "pii_base", F.concat(*votes).alias("pii_votes"))


FEATURES = tuple(f"{name}{sign}" for name in LABELERS for sign in ("+", "-")) + tuple(f"length>{n}" for n in LENGTHS)


def _row_features(row) -> list[float]:
    return ([float(row[name] == sign) for name in LABELERS for sign in (1, -1)]
            + [float(row["length"] > i) for i in range(len(LENGTHS))])


def reliabilities(rows: list[dict]) -> np.ndarray:
    """Posterior probability of each vote pattern of one kind, by expectation-maximisation.

    Votes are taken to be independent given the truth. The start is the mean vote.
    """
    weight = np.array([r["n"] for r in rows], float)
    votes = np.array([[r[name] + 1 for name in LABELERS] for r in rows])
    truth = np.clip(0.5 + (votes - 1).sum(axis=1) / (2 * len(LABELERS)), 0.05, 0.95)
    for _ in range(ROUNDS):
        odds = np.zeros(len(rows))
        prior = (weight * truth).sum() / weight.sum()
        odds += math.log(max(prior, 1e-9)) - math.log(max(1 - prior, 1e-9))
        for labeler in range(len(LABELERS)):
            for vote in range(3):
                here = votes[:, labeler] == vote
                yes = ((weight * truth)[here].sum() + SMOOTHING) / ((weight * truth).sum() + 3 * SMOOTHING)
                no = ((weight * (1 - truth))[here].sum() + SMOOTHING) / ((weight * (1 - truth)).sum() + 3 * SMOOTHING)
                odds[here] += math.log(yes / no)
        truth = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return truth


def train(votes: DataFrame) -> dict[str, list[float]]:
    """A weight for each feature, and the bias, of the final classifier of each kind."""
    counted = votes.groupBy("kind", *LABELERS, "length").agg(F.count("*").alias("n")).collect()
    models = {}
    for kind in sorted({r["kind"] for r in counted}):
        rows = sorted((r.asDict() for r in counted if r["kind"] == kind), key=lambda r: [r[x] for x in (*LABELERS, "length")])
        target, weight = reliabilities(rows), np.array([r["n"] for r in rows], float)
        x = np.array([[*_row_features(r), 1.0] for r in rows])
        share, w = weight / weight.sum(), np.zeros(len(FEATURES) + 1)
        for _ in range(500):
            p = 1 / (1 + np.exp(-x @ w))
            hessian = (x * (share * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(w))
            step = np.linalg.solve(hessian, x.T @ (share * (target - p)) - 1e-3 * w)
            w += np.clip(step, -1, 1)
            if np.abs(step).max() < 1e-6:
                break
        models[kind] = [float(v) for v in w]
    return models


def _probability(vote: Column, weights: list[float]) -> Column:
    parts = [vote[name] == sign for name in LABELERS for sign in (1, -1)] + [vote["length"] > i for i in range(len(LENGTHS))]
    total = F.lit(weights[-1])
    for part, weight in zip(parts, weights):
        total = total + F.when(part, weight).otherwise(0.0)
    return 1 / (1 + F.exp(-total))


def ranked_base() -> Column:
    """The base spans as one array of (rank of the kind, start, end), in that order."""
    def ranked(i: int) -> Column:
        return F.transform(F.col(f"pii_base.{BASE[i]}"), lambda s: F.struct(
            F.lit(i).alias("rank"), s["start"].alias("start"), s["end"].alias("end")))

    return F.concat(*(ranked(i) for i in range(len(BASE))))


def decided(marked: DataFrame, models: dict[str, list[float]]) -> DataFrame:
    """``pii_spans``: base spans and accepted candidates as an array of (rank of the kind, start, end)."""
    def accepted(vote: Column) -> Column:
        found = F.lit(False)
        for kind, weights in models.items():
            found = found | ((vote["kind"] == kind) & (_probability(vote, weights) >= ACCEPT))
        return ~vote["base"] & found

    order = F.create_map(*(F.lit(x) for i, kind in enumerate(KINDS) for x in (kind, i)))
    added = F.transform(F.filter("pii_votes", accepted), lambda v: F.struct(
        order[v["kind"]].alias("rank"), v["start"].alias("start"), v["end"].alias("end")))
    return marked.withColumn("pii_added", F.array_sort(added)).withColumn(
        "pii_added", F.filter("pii_added", lambda s, i: ~F.exists(
            F.slice("pii_added", F.lit(1), i), lambda o: (o["start"] < s["end"]) & (s["start"] < o["end"])))
    ).withColumn("pii_spans", F.array_sort(F.concat(ranked_base(), F.col("pii_added")))).drop("pii_added")


def as_text(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))))


def find(docs: DataFrame) -> DataFrame:
    """doc_id, the number of base spans of each kind, base_sha256, spans and the number of added ones."""
    marked = storage.written(annotated(docs, ["doc_id"]).drop("pii_text"), "votes")
    models = train(marked.select(F.explode("pii_votes").alias("v")).select("v.*"))
    base = ranked_base()
    return decided(marked, models).select(
        "doc_id", *(F.size(f"pii_base.{kind}").cast("long").alias(f"n_{kind}") for kind in BASE),
        F.sha2(as_text(base).cast("binary"), 256).alias("base_sha256"), as_text(F.col("pii_spans")).alias("spans"),
        (F.size("pii_spans") - F.size(base)).cast("long").alias("n_added"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of its texts replaced by the name of its kind in brackets.

    Overlapping spans are replaced as one, named after the one that begins first. ``n_chars`` follows the
    new text where there is such a column; texts without a span, null ones too, stay as they are.
    """
    names = docs.columns
    plain = docs.select(*(F.col(n).alias(f"c{i}") for i, n in enumerate(names)), "text")
    models = train(annotated(docs.select("text"), []).select(F.explode("pii_votes").alias("v")).select("v.*"))
    marked = decided(annotated(plain, plain.columns), models)
    by_start = F.array_sort(F.transform("pii_spans", lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), s["rank"].alias("rank"))))
    labels = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<string>)").alias("out"))
    pieces = F.aggregate(by_start, begin, lambda held, s: F.struct(
        F.greatest(held["at"], s["end"]).alias("at"),
        F.when(s["start"] < held["at"], held["out"]).otherwise(F.concat(held["out"], F.array(
            F.substr(F.col("pii_text"), (held["at"] + 1).cast("int"), (s["start"] - held["at"]).cast("int")),
            F.get(labels, s["rank"])))).alias("out")))
    some = F.size("pii_spans") > 0
    fixed = marked.withColumn("pii_new", F.when(some, F.concat(
        F.array_join(pieces["out"], ""),
        F.substr(F.col("pii_text"), (pieces["at"] + 1).cast("int"), F.length("pii_text")))).otherwise(F.col("text")))

    def column(i: int, name: str) -> Column:
        if name == "text":
            return F.col("pii_new")
        if name == "n_chars":
            return F.when(some, F.length("pii_new").cast(docs.schema[name].dataType)).otherwise(F.col(f"c{i}"))
        return F.col(f"c{i}")

    return fixed.select(*(column(i, n).alias(n) for i, n in enumerate(names)))
