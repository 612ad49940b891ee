"""Personal data by weak supervision (operator 3), with DataFrame functions only.

Base spans (email, ip, card, phone) follow fixed patterns. The method looks for more candidates
(telephone numbers without a plus sign, obfuscated addresses, social security numbers, IBANs, credentials)
and lets five labelers vote yes, no or nothing on every span: its form, a gazetteer, cue words before
it, its surroundings, and placeholder digits. Expectation-maximisation on the histogram of vote
patterns estimates how reliable each labeler is; its posteriors train a logistic span classifier on kind,
votes and length. The driver sees only that histogram, whose size has a bound. Base spans always stay; other
candidates stay if the classifier gives them ``MIN_PROBABILITY``.

Patterns are written so that no run of characters is scanned twice: a match begins at a run's start or
where the last match ended, which finds the same leftmost matches.

Defined cases: a null text counts as empty and has no spans (the digest is that of the empty string);
repeated rows give repeated results and count as often in the histogram; an empty table, or one without
candidates, gives no added spans; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

BASE = {
    "email": "(?:\\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++",
    "ip": "(?:\\G|(?<![0-9]))[0-9]++(?:\\.[0-9]++){3}",
    "card": "[0-9](?:[\\x20-]?[0-9])++",
    "phone": "\\+[0-9][\\x20().0-9-]+[0-9]",
}
ADDED = {
    "email": "(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:\\[at\\]|\\(at\\)| at ) ?[A-Za-z0-9-]++ ?(?:\\[dot\\]|\\(dot\\)| dot ) ?[A-Za-z]{2,}+",
    "phone": "(?<![0-9A-Za-z+.\\-])(?:\\([0-9]{3}\\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])",
    "ssn": "(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "iban": "(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}+(?![0-9A-Za-z])",
    "secret": "(?<![A-Za-z])(?:token|api_?key|secret|password|passwd)\\x20{0,4}[=:]\\x20{0,4}[\"'][^\"'\\s]{8,}+[\"']",
}
HINTS = {"email": "@", "phone": "+"}  # a base pattern needs this character
KINDS = ["email", "ip", "card", "phone", "ssn", "iban", "secret"]
LABELERS = ["form", "gazetteer", "cue", "surroundings", "placeholder"]
LENGTHS = [8, 12, 16, 24, 40]
MIN_PROBABILITY = 0.5
CONTEXT = 40
RUN = 128
SPAN = "struct<start:int,end:int,text:string>"

TOP_DOMAINS = "com|net|org|edu|gov|info|io|de|fr|es|it|nl|uk|eu|ch|at|us|ca|au|jp"
CUES = {
    "email": "e-?mails?|mail|contact|write|reach|address",
    "ip": "ip|host|server|address|ping|from",
    "card": "card|visa|mastercard|amex|credit|debit|payment|account",
    "phone": "phone|tel|telephone|call|mobile|cell|fax|contact|reach|whatsapp",
    "ssn": "ssn|social security|social",
    "iban": "iban|account|bank|transfer",
    "secret": "token|key|secret|password|passwd",
}
COUNTER_CUES = "isbn|version|figure|fig|page|pages|order|invoice|article|section|chapter"


def gaps(text: Column, pattern: str) -> Column:
    """The matches of ``pattern``, each with the number of code points between it and the one before."""
    found = F.zip_with(F.split(text, pattern), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda gap, m: F.struct(F.char_length(gap).alias("gap"), m.alias("m")))
    return F.filter(found, lambda x: x["m"].isNotNull())


def runs(found: Column, valid) -> Column:
    """Valid matches of each ``RUN`` matches on, with offsets from the run's beginning, and the run's length.

    An array that grows by one is copied each time: in runs, what is copied grows with the matches and not with their square.
    """

    def step(done: Column, x: Column) -> Column:
        start = done["at"] + x["gap"]
        end = start + F.char_length(x["m"])
        span = F.struct(start.alias("start"), end.alias("end"), x["m"].alias("text"))
        return F.struct(end.alias("at"), F.when(valid(x["m"]), F.concat(done["out"], F.array(span))).otherwise(done["out"]).alias("out"))

    empty = F.struct(F.lit(0).alias("at"), none().alias("out"))
    firsts = F.filter(F.sequence(F.lit(1), F.greatest(F.size(found), F.lit(1)), F.lit(RUN)), lambda i: i <= F.size(found))
    return F.transform(firsts, lambda i: F.aggregate(F.slice(found, i, F.lit(RUN)), empty, step))


def shifted(pieces: Column) -> Column:
    """The runs' spans with their code point offsets in the text; the end is exclusive."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    starts = F.aggregate(pieces, zero, lambda done, p: F.struct((done["at"] + p["at"]).alias("at"), F.concat(done["out"], F.array(done["at"])).alias("out")), lambda done: done["out"])

    def move(p: Column, by: Column) -> Column:
        return F.transform(p["out"], lambda s: F.struct((s["start"] + by).alias("start"), (s["end"] + by).alias("end"), s["text"].alias("text")))

    return F.flatten(F.zip_with(pieces, starts, move))


def with_spans(rows: DataFrame, name: str, pattern: str, gate: Column, valid) -> DataFrame:
    """Add array ``name``: the valid matches of ``pattern`` in ``_text`` where ``gate`` holds."""
    rows = rows.withColumn("_gaps", F.when(gate, gaps(F.col("_text"), pattern)))
    rows = rows.withColumn("_runs", F.when(F.size("_gaps") > 0, runs(F.col("_gaps"), valid)))
    return rows.withColumn(name, F.coalesce(F.when(F.col("_runs").isNotNull(), shifted(F.col("_runs"))), none())).drop("_gaps", "_runs")


def none() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def passes_luhn(number: Column) -> Column:
    n = F.char_length(number)

    def step(total: Column, i: Column) -> Column:
        d = F.substr(number, n - i, F.lit(1)).cast("int")
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return total + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), step) % 10 == 0


def valid_base(kind: str, text: Column) -> Column:
    """The fixed rules on a base match; one that fails is dropped, not retried."""
    if kind == "ip":
        return F.forall(F.split(text, "\\."), lambda p: F.char_length(F.regexp_replace(p, "^0+(?=[0-9])", "")) <= 3) & F.forall(F.split(text, "\\."), lambda p: F.substr(F.concat(F.lit("00"), p), F.lit(-3)).cast("int") <= 255)
    number = digits(text)
    n = F.char_length(number)
    if kind == "card":
        return F.when(n.between(14, 19), passes_luhn(number)).otherwise(False)
    if kind == "phone":
        return n.between(10, 15)
    return F.lit(True)


def word_in(words: str, context: Column) -> Column:
    return context.rlike(f"(?i)(?<![A-Za-z])(?:{words})(?![A-Za-z])")


def vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def votes(kind: str, base: bool, text: Column, s: Column) -> Column:
    """The five labelers' votes on span ``s`` of ``text``: 1 yes, -1 no, 0 nothing."""
    span, number = s["text"], digits(s["text"])
    left = F.substr(text, F.greatest(s["start"] - CONTEXT, F.lit(0)) + 1, F.least(s["start"], F.lit(CONTEXT)))
    right = F.substr(text, s["end"] + 1, F.lit(2))
    distinct = F.char_length(number) - F.char_length(F.regexp_replace(number, "([0-9])(?=.*\\1)", ""))
    repeated = (F.char_length(number) >= 8) & (F.char_length(number) - distinct <= 2)
    form = {
        "email": vote(span.rlike("\\.[A-Za-z]{2,24}$"), F.lit(True)),
        "ip": vote(~span.rlike("(^|\\.)0[0-9]"), F.lit(True)),
        "card": vote(F.lit(base), F.lit(True)),
        "phone": vote(F.char_length(number) >= 10, F.lit(True)),
        "ssn": vote(~span.rlike("^(000|666|9)|-00-|-0000$"), F.lit(True)),
        "iban": vote(F.length(number) >= 10, F.lit(True)),
        "secret": vote(span.rlike("[0-9]") & span.rlike("[A-Za-z]{2}"), F.lit(True)),
    }[kind]
    gazetteer = {
        "email": vote(span.rlike(f"(?i)[. ](?:{TOP_DOMAINS})$"), F.lit(False)),
        "ip": vote(F.lit(False), span.rlike("^(0|127|255)\\.")),
        "card": vote(number.rlike("^(4|5[1-5]|2[2-7]|3[47]|6(011|5))"), F.lit(False)),
        "phone": vote(span.rlike("^\\+(1|7|2[0-9]|3[0-9]|4[0-9]|5[0-9]|6[0-9]|8[0-9]|9[0-9])"), span.rlike("^[(]?[01]")),
        "ssn": vote(F.lit(False), span.rlike("^(123-45-6789|078-05-1120)$")),
        "iban": vote(span.rlike("^(AT|BE|CH|DE|DK|ES|FI|FR|GB|IE|IT|LU|NL|NO|PL|PT|SE)"), F.lit(True)),
        "secret": vote(span.rlike("[0-9a-f]{16}|[A-Za-z0-9+/]{24}"), span.rlike("(?i)example|changeme|your[_-]")),
    }[kind]
    cue = vote(word_in(CUES[kind], left), word_in(COUNTER_CUES, left))
    inside = left.rlike("[0-9A-Za-z]$") | right.rlike("^([0-9A-Za-z]|[.-][0-9])")
    around = vote((F.char_length(left) == 0) | left.rlike("[\\s(\\[,;:\"'|]$"), inside)
    placeholder = vote(F.lit(False), repeated | number.contains("123456789"))
    bucket = sum(((F.char_length(span) >= n).cast("int") for n in LENGTHS), F.lit(0))
    parts = [form, gazetteer, cue, around, placeholder]
    return F.struct(F.lit(kind).alias("kind"), F.lit(base).alias("base"), s["start"].alias("start"), s["end"].alias("end"), *[v.cast("int").alias(n) for v, n in zip(parts, LABELERS, strict=True)], bucket.alias("bucket"))


def candidates(docs: DataFrame, *keep: str) -> DataFrame:
    """``keep`` columns and ``found``: every document's spans with their votes."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.withColumn("_text", text)
    for kind, pattern in BASE.items():
        gate = F.contains(F.col("_text"), F.lit(HINTS[kind])) if kind in HINTS else F.lit(True)
        rows = with_spans(rows, f"_b_{kind}", pattern, gate, lambda m, kind=kind: valid_base(kind, m))
    hints = {"email": F.col("_text").rlike("\\bat\\b"), "secret": F.col("_text").rlike("[=:]\\x20{0,4}[\"']")}
    for kind, pattern in ADDED.items():
        rows = with_spans(rows, f"_a_{kind}", pattern, hints.get(kind, F.col("_text").rlike("[0-9]{2}")), lambda m: F.lit(True))

    def judged(kind: str, base: bool):
        return lambda s: votes(kind, base, F.col("_text"), s)

    def apart_from(base: str):
        return lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))

    found = [F.transform(f"_b_{kind}", judged(kind, True)) for kind in BASE]
    for kind in ADDED:
        extra = F.col(f"_a_{kind}")
        if kind in BASE:  # what overlaps a base span of its kind is that span
            extra = F.filter(extra, apart_from(f"_b_{kind}"))
        found.append(F.transform(extra, judged(kind, False)))
    return rows.withColumn("found", F.concat(*found)).select(*keep, "found")


class SpanModel:
    """Labeler reliabilities by expectation-maximisation, and a logistic classifier trained on its posteriors."""

    def __init__(self, patterns: list[tuple]):
        """``patterns``: kind, votes of the labelers, length bucket, count."""
        self.weights = np.zeros(len(KINDS) + 2 * len(LABELERS) + len(LENGTHS) + 1)
        self.reliability: dict[str, tuple[float, float]] = {}
        if not patterns:
            return
        kinds = np.array([KINDS.index(p[0]) for p in patterns])
        v = np.array([p[1 : 1 + len(LABELERS)] for p in patterns])
        buckets = np.array([p[1 + len(LABELERS)] for p in patterns])
        n = np.array([p[-1] for p in patterns], float)
        posterior = self.maximise(kinds, v, n)
        self.fit(self.features(kinds, v, buckets), posterior, n)

    def maximise(self, kinds: np.ndarray, v: np.ndarray, n: np.ndarray, rounds: int = 100) -> np.ndarray:
        """Posterior of each pattern; a labeler has its own rates of yes, no and nothing in either class."""
        q = np.clip(0.5 + 0.15 * v.sum(1), 0.05, 0.95)
        for _ in range(rounds):
            logit = np.zeros(len(n))
            for k in range(len(KINDS)):
                at = kinds == k
                if at.any():
                    prior = ((n * q)[at].sum() + 2) / (n[at].sum() + 4)
                    logit[at] = np.log(prior / (1 - prior))
            for j in range(v.shape[1]):
                for value in (-1, 0, 1):
                    at = v[:, j] == value
                    yes = ((n * q)[at].sum() + 1) / ((n * q).sum() + 3)
                    no = ((n * (1 - q))[at].sum() + 1) / ((n * (1 - q)).sum() + 3)
                    logit[at] += np.log(yes / no)
                right = (n * q)[v[:, j] == 1].sum() + (n * (1 - q))[v[:, j] == -1].sum()
                cast = n[v[:, j] != 0].sum()
                self.reliability[LABELERS[j]] = (float((right + 1) / (cast + 2)), float(cast / n.sum()))
            new = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
            if np.abs(new - q).max() < 1e-9:
                break
            q = new
        return q

    @staticmethod
    def features(kinds: np.ndarray, v: np.ndarray, buckets: np.ndarray) -> np.ndarray:
        lengths = buckets[:, None] > np.arange(len(LENGTHS))
        return np.hstack([np.eye(len(KINDS))[kinds], v > 0, v < 0, lengths, np.ones((len(v), 1))]).astype(float)

    def fit(self, x: np.ndarray, target: np.ndarray, n: np.ndarray, penalty: float = 1.0) -> None:
        """Newton's method for the ridge-penalised logistic likelihood of soft targets."""
        w = self.weights
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            gradient = x.T @ (n * (target - p)) - penalty * w
            hessian = (x * (n * p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(w))
            step = np.linalg.solve(hessian, gradient)
            w = w + step
            if np.abs(step).max() < 1e-9:
                break
        self.weights = w

    def accepts(self, s: Column) -> Column:
        """Whether the classifier gives span ``s`` the least probability."""
        w = [float(round(x, 12)) for x in self.weights]
        k, m = len(KINDS), len(LABELERS)
        score = F.lit(w[-1])
        for i, kind in enumerate(KINDS):
            score = score + F.when(s["kind"] == kind, w[i]).otherwise(0.0)
        for j, name in enumerate(LABELERS):
            score = score + F.when(s[name] > 0, w[k + j]).when(s[name] < 0, w[k + m + j]).otherwise(0.0)
        for b in range(len(LENGTHS)):
            score = score + F.when(s["bucket"] > b, w[k + 2 * m + b]).otherwise(0.0)
        return score >= float(np.log(MIN_PROBABILITY / (1 - MIN_PROBABILITY)))


def train(found: DataFrame) -> SpanModel:
    """Fit on the vote patterns of all spans: at most kinds x 3^labelers x lengths rows reach the driver."""
    each = found.select(F.inline("found"))
    keys = ["kind", *LABELERS, "bucket"]
    return SpanModel([tuple(r) for r in each.groupBy(*keys).count().orderBy(*keys).collect()])


def order_of(s: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, KINDS)), s["kind"])


def render(selected: Column) -> Column:
    """``kind:start:end`` by start, then by kind as listed, joined by commas."""
    keyed = F.array_sort(F.transform(selected, lambda s: F.struct(s["start"].alias("start"), order_of(s).alias("o"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(keyed, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_private(docs: DataFrame) -> DataFrame:
    """Operator 3: counts and digest of each text's base spans, and all spans."""
    found = materialise(candidates(docs.select(F.col("doc_id").cast("long"), "text"), "doc_id"), "spans")
    model = train(found)
    base = F.filter("found", lambda s: s["base"])
    kept = F.filter("found", lambda s: s["base"] | model.accepts(s))

    def of_kind(kind: str):
        return lambda s: s["base"] & (s["kind"] == kind)

    counts = [F.size(F.filter("found", of_kind(k))).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(render(base), 256).alias("base_sha256"), render(kept).alias("spans"))


def mask(docs: DataFrame) -> DataFrame:
    """``docs`` with every span's text replaced by its kind in brackets; overlapping spans become one."""
    names = docs.columns
    packed = docs.select(F.struct(*names).alias("_row"), "text")
    rows = materialise(candidates(packed, "_row"), "spans")
    model = train(rows)
    text = F.col("_row.text")
    chosen = F.array_sort(F.transform(F.filter("found", lambda s: s["base"] | model.accepts(s)), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def step(done: Column, s: Column) -> Column:
        gap = F.substr(text, done["at"] + 1, s["start"] - done["at"])
        more = F.when(s["start"] >= done["at"], F.concat(done["out"], gap, F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise(done["out"])
        return F.struct(F.greatest(done["at"], s["end"]).alias("at"), more.alias("out"))

    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    masked = F.aggregate("_chosen", begin, step, lambda done: F.concat(done["out"], F.substr(text, done["at"] + 1, F.char_length(text))))
    rows = rows.withColumn("_chosen", chosen).withColumn("_text", F.when(F.size("_chosen") > 0, masked).otherwise(text))
    kept = {n: F.col(f"_row.{n}") for n in names}
    kept["text"] = F.col("_text")
    if "n_chars" in names:
        kept["n_chars"] = F.coalesce(F.char_length("_text"), F.lit(0)).cast(docs.schema["n_chars"].dataType)
    return rows.select(*[c.alias(n) for n, c in kept.items()])
