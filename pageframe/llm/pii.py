"""Personal data by weak supervision, with built-in functions only.

1. Finders propose spans of four kinds.  Strict ones follow fixed rules and always stay;
   loose ones (spelled-out mail signs, phone numbers without a plus) need the classifier.
2. Five labelers vote 1, 0 or -1 on each span: rule, gazetteer, context, shape, surroundings.
3. Spans are counted by kind and vote pattern (at most 4 * 3**5 rows, which go to the driver).
   Expectation-maximisation gives each labeler's reliability and each pattern's posterior;
   a logistic span classifier is trained on them, weighted by the counts.
4. The classifier's verdict per pattern is applied in the row.

Positions are code points, the end exclusive.  Defined results: a null or empty text has no
spans; repeated rows are treated alike, each on its own; an empty table gives an empty table;
input columns travel in one struct, so their names never clash.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("rule", "gazetteer", "context", "shape", "surroundings")

# Possessive repeats and look-behinds keep the time linear in the text and do not change
# what is found: a match can only begin where a run of its characters begins, or where the
# match before it ended.
STRICT = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?[\[(](?:at|AT)[\])]\x20?"
    r"[A-Za-z0-9-]{1,63}+(?:\x20?(?:\.|[\[(](?:dot|DOT)[\])])\x20?[A-Za-z0-9-]{1,63}+){1,8}+",
    "phone": r"(?<![0-9+(.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])",
}
#: A text without these has no span of the kind.
NEEDS = {"email": r"@|[\[(](?:at|AT)[\])]", "ip": r"[0-9]\.[0-9]", "card": r"[0-9]", "phone": r"[0-9]"}

_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
# Gazetteers and cue words.
KNOWN = {
    "email": r"\.(?:com|org|net|edu|gov|io|info|de|fr|es|uk|eu|ch|at|it|nl)$",
    "ip": r"^(?!0+\.|127\.|2[4-5][0-9]\.)",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6)",
    "phone": r"^(?:\+(?:1|7|2[07]|3[0-9]|4[0-9]|5[1-8]|6[0-6]|8[1-6]|9[0-8])|\(?[2-9])",
}
CUES = {
    "email": "mail|contact|write to|reach|courriel|correo|kontakt",
    "ip": "\\bip\\b|address|host|server|adresse|direcci",
    "card": "card|visa|credit|payment|carte|karte|tarjeta",
    "phone": "phone|tel|call|mobile|fax|ruf|appel|llam",
}
AGAINST = "version|isbn|order no|invoice|page|serial|release|chapter"
SHAPES = {
    "email": r"^[A-Za-z0-9]",
    "ip": r"^[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}$",
    "card": r"^(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7})$",
    "phone": r"^\+?[0-9]{0,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[ .-]?[0-9]{2,4}){1,4}$",
}


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    """The check sum of a card number: every second digit from the right counts twice."""
    backwards = F.split(F.reverse(_digits(value)), "")
    points = F.transform(
        F.filter(backwards, lambda d: d != ""),
        lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
            d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)
        ),
    )
    return F.aggregate(points, F.lit(0), lambda a, b: a + b) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return _luhn(value)
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


_SPAN = "array<struct<start:int,end:int,value:string>>"


def _matches(text: Column, pattern: str) -> Column:
    """All matches with their places: the text between matches, and the matches, in turn."""
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    steps = F.zip_with(
        hits, F.slice(gaps, 1, F.size(hits)),
        lambda h, g: F.struct(F.length(g).alias("gap"), h.alias("value")),
    )

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.length(x["value"])
        one = F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value"))
        return F.struct(end.alias("at"), F.concat(acc["all"], F.array(one)).alias("all"))

    begin = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("all"))
    return F.aggregate(steps, begin, add)["all"]


def _votes(kind: str, text: Column, span: Column, strict: bool) -> Column:
    """The labelers' votes as one string of +, 0 and -."""
    value, start = span["value"], span["start"]
    before = F.lower(F.substring(text, F.greatest(start - 39, F.lit(1)), F.least(start, F.lit(40))))
    near = F.substring(text, start, 1)
    after = F.substring(text, span["end"] + 1, 1)

    def vote(yes: Column, no: Column) -> Column:
        return F.when(yes, "+").when(no, "-").otherwise("0")

    plain = (start == 0) | near.rlike(r"[\s\"'<(\[:,;]")
    ends = after.rlike(r"^$|[\s\"'>)\],;:.!?]")
    known = value.rlike(KNOWN[kind])
    shaped = value.rlike(SHAPES[kind])
    return F.concat(
        F.lit("+" if strict else "0"),
        vote(known, ~known),
        vote(before.rlike(CUES[kind]), before.rlike(AGAINST)),
        vote(shaped, ~shaped),
        vote(plain & ends, ~plain & ~ends),
    )


def _spans_of(kind: str, text: Column, strict: bool) -> Column:
    found = _matches(text, (STRICT if strict else LOOSE)[kind])
    if strict:
        found = F.filter(found, lambda s: _valid(kind, s["value"]))
    spans = F.transform(
        found,
        lambda s: F.struct(
            F.lit(KINDS.index(kind)).alias("kind"),
            s["start"].alias("start"),
            s["end"].alias("end"),
            F.lit(strict).alias("base"),
            F.concat(F.lit(f"{kind}:"), _votes(kind, text, s, strict)).alias("pattern"),
        ),
    )
    none = F.array().cast("array<struct<kind:int,start:int,end:int,base:boolean,pattern:string>>")
    return F.when(text.rlike(NEEDS[kind]), spans).otherwise(none)


def candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """Columns ``row``, ``_t`` (the text, null as empty) and ``spans``: strict spans, and loose
    ones that overlap no strict span of their kind."""
    staged = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_t"),
    )
    staged = staged.select(
        "row", "_t",
        F.concat(*[_spans_of(k, F.col("_t"), True) for k in KINDS]).alias("_strict"),
        F.concat(*[_spans_of(k, F.col("_t"), False) for k in LOOSE]).alias("_loose"),
    )
    free = F.filter(
        "_loose",
        lambda x: ~F.exists(
            "_strict",
            lambda s: (s["kind"] == x["kind"]) & (s["start"] < x["end"]) & (x["start"] < s["end"]),
        ),
    )
    return staged.select("row", "_t", F.array_sort(F.concat("_strict", free)).alias("spans"))


@dataclass
class SpanModel:
    """Posterior of the classifier by pattern, and what expectation-maximisation found."""

    scores: dict[str, float] = field(default_factory=dict)
    reliability: dict[str, dict[str, float]] = field(default_factory=dict)
    threshold: float = 0.5

    def accepted(self) -> list[str]:
        return sorted(p for p, s in self.scores.items() if s >= self.threshold)


def fit(docs: DataFrame, text: str = "text") -> SpanModel:
    """Counts of vote patterns over all rows, then the model of them."""
    patterns = candidates(docs, text).select(F.explode("spans.pattern").alias("pattern"))
    return fit_patterns({r["pattern"]: r["n"] for r in patterns.groupBy("pattern").agg(F.count("*").alias("n")).collect()})


def _sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def fit_patterns(counts: dict[str, int], rounds: int = 60) -> SpanModel:
    """Two-class Dawid-Skene model per kind, then a logistic model on its posteriors."""
    model, by_kind = SpanModel(), defaultdict(dict)
    for pattern, n in counts.items():
        kind, votes = pattern.split(":")
        by_kind[kind][votes] = n
    for kind, table in by_kind.items():
        post = {v: _sigmoid(1.5 * (v.count("+") - v.count("-"))) for v in table}
        rate: list[dict[tuple[str, int], float]] = []
        for _ in range(rounds):
            mass = [1.0, 1.0]
            seen = [defaultdict(lambda: 0.5) for _ in LABELERS]
            for v, n in table.items():
                for y, p in ((1, post[v]), (0, 1 - post[v])):
                    mass[y] += n * p
                    for j, vote in enumerate(v):
                        seen[j][vote, y] += n * p
            rate = [{(u, y): s[u, y] / (mass[y] + 0.5) for u in "+0-" for y in (0, 1)} for s in seen]
            # A labeler never counts as worse than chance: a vote for stays a vote for.
            for v in table:
                odds = math.log(mass[1] / mass[0])
                for j, vote in enumerate(v):
                    step = math.log(rate[j][vote, 1] / rate[j][vote, 0])
                    odds += max(step, 0) if vote == "+" else min(step, 0) if vote == "-" else 0
                post[v] = _sigmoid(odds)
        model.reliability[kind] = {
            name: rate[j]["+", 1] / (rate[j]["+", 1] + rate[j]["-", 1]) for j, name in enumerate(LABELERS)
        }
        model.scores |= {f"{kind}:{v}": s for v, s in _logistic(table, post).items()}
    return model


def _logistic(table: dict[str, int], post: dict[str, float], rounds: int = 400) -> dict[str, float]:
    """Weights for each labeler's votes for and against, by gradient descent on soft labels."""
    weight: dict[tuple[int, str], float] = defaultdict(float)
    total = sum(table.values())
    active = {v: [(-1, "")] + [(j, u) for j, u in enumerate(v) if u != "0"] for v in table}
    score = {}
    for _ in range(rounds):
        step: dict[tuple[int, str], float] = defaultdict(float)
        for v, n in table.items():
            score[v] = _sigmoid(sum(weight[f] for f in active[v]))
            for f in active[v]:
                step[f] += n / total * (post[v] - score[v])
        for f, g in step.items():
            weight[f] += 2.0 * (g - 0.001 * weight[f])
    return score


def annotated(docs: DataFrame, model: SpanModel, text: str = "text") -> DataFrame:
    """``candidates`` with only the strict spans and those that the classifier accepts."""
    good = model.accepted() or [""]  # no pattern is empty
    return candidates(docs, text).withColumn(
        "spans", F.filter("spans", lambda s: s["base"] | s["pattern"].isin(good))
    )


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )


def redacted(docs: DataFrame, model: SpanModel, text: str = "text") -> DataFrame:
    """The rows with each span replaced by its kind in angle brackets; other columns stay,
    ``n_chars``, if there, is the new length."""
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    found = annotated(docs, model, text)
    # In reading order; a span that begins inside the one before only adds its tail.
    ordered = F.array_sort(
        F.transform(
            "spans",
            lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.get(names, s["kind"]).alias("mark")),
        )
    )

    def add(acc: Column, s: Column) -> Column:
        inside = s["start"] < acc["at"]
        gap = F.substring(F.col("_t"), acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        out = F.concat(acc["out"], gap, F.when(inside, "").otherwise(s["mark"]))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    clean = F.aggregate(
        ordered, begin, add, lambda a: F.concat(a["out"], F.substring(F.col("_t"), a["at"] + 1, 2**31 - 1))
    )
    found = found.withColumn("_clean", F.when(F.size("spans") > 0, clean).otherwise(F.col(f"row.`{text}`")))
    columns = []
    for c in docs.columns:
        if c == text:
            columns.append(F.col("_clean").alias(c))
        elif c == "n_chars":
            new = F.length("_clean").cast(docs.schema[c].dataType)
            columns.append(F.when(F.size("spans") > 0, new).otherwise(F.col("row.n_chars")).alias(c))
        else:
            columns.append(F.col(f"row.`{c}`").alias(c))
    return found.select(*columns)
