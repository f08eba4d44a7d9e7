"""Personal data by weak supervision, in DataFrame functions only.

Four base kinds have exact rules. Further candidates (credentials, spelled-out
mail addresses, phone numbers without a plus) get votes from labelers: patterns
of shape, word lists of what stands before, and signs of context. Expectation
maximisation over the counts of vote patterns estimates how reliable each
labeler is and how likely each pattern is personal data. A logistic span
classifier is fitted to these likelihoods and decides; a candidate is added if
it is likelier than not and touches no base span. Only the table of vote
patterns, whose size is bounded by the number of labelers, reaches the driver.

Defined cases: null text counts as empty; a text without spans has the digest of
the empty string; repeated rows stay repeated; with no candidates, or candidates
without votes, nothing is added.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mapweave.sources.tables import stage

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("contact", "number", "secret")

# The base patterns. Possessive quantifiers and the condition on
# what stands before keep long runs linear; they do not change what is found.
_LOCAL = "A-Za-z0-9._%+-"
_EMAIL = rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"
_CARD = r"[0-9](?:[\x20-]?[0-9])++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

_CANDIDATE = (
    r"(?:\G|(?<![A-Za-z0-9+/_-]))[A-Za-z0-9+/_-]{20,}+"
    rf"|(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]{{1,64}}+(?:\x20?[\[(]at[\])]\x20?|\x20at\x20)[A-Za-z0-9-]{{1,64}}+"
    r"(?:(?:\x20?[\[(]dot[\])]\x20?|\x20dot\x20)[A-Za-z0-9-]{1,64}+)++"
    r"|(?<![0-9+.(-])\(?[0-9]{2,4}\)?[\x20.-][0-9]{2,4}[\x20.-][0-9]{3,4}(?![0-9])")
_BEFORE, _AFTER = 24, 4

_NAMES_DATA = (r"(?i)\b(token|secret|passwords?|passwd|pwd|api|key|auth|bearer|credentials?|tel|telephone|phone|mobile|"
               r"fax|call|sms|mail|email|contact|write|reach)[^A-Za-z0-9]{0,6}$")
_NAMES_OTHER = (r"(?i)\b(isbn|issn|pages?|vol|volume|version|figure|table|chapter|nr|year|build|commit|sha|hash|md5|"
                r"checksum|doi|date)[^A-Za-z0-9]{0,6}$")


def _found(text: Column, pattern: str, hint: Column) -> Column:
    """Matches with their code point range and what stands around them."""
    pieces = F.split(text, pattern, -1)
    zipped = F.arrays_zip(pieces.alias("p"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"),
                          F.slice(pieces, 2, F.size(pieces)).alias("q"))
    zipped = F.transform(zipped, lambda z: F.struct(
        F.char_length(z["p"]).alias("gap"), z["m"].alias("m"), F.right(z["p"], F.lit(_BEFORE)).alias("before"),
        F.left(z["q"], F.lit(_AFTER)).alias("after")))
    kind = "array<struct<s:int,e:int,m:string,before:string,after:string>>"
    start = F.struct(F.lit(0).alias("pos"), F.array().cast(kind).alias("out"))

    def step(acc: Column, z: Column) -> Column:
        s = acc["pos"] + z["gap"]
        e = s + F.char_length(z["m"])
        one = F.struct(s.alias("s"), e.alias("e"), z["m"].alias("m"), z["before"].alias("before"),
                       z["after"].alias("after"))
        return F.when(z["m"].isNull(), acc).otherwise(
            F.struct(e.alias("pos"), F.array_append(acc["out"], one).alias("out")))

    return F.when(hint, F.aggregate(zipped, start, step, lambda acc: acc["out"])).otherwise(F.array().cast(kind))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the check digit is right: every second digit from the right doubles."""
    def value(c: Column, i: Column) -> Column:
        d = F.coalesce(c.try_cast("int"), F.lit(0)) * F.when(i % 2 == 1, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    total = F.aggregate(F.transform(F.split(F.reverse(digits), ""), value), F.lit(0), lambda a, d: a + d)
    return total % 10 == 0


def _small_part(p: Column) -> Column:
    p = F.regexp_replace(p, "^0+(?=.)", "")
    return (F.length(p) <= 3) & (p.try_cast("int") <= 255)


def base_spans(text: Column) -> dict[str, Column]:
    """Array of spans per base kind, after the checks."""
    email = _found(text, _EMAIL, text.contains("@"))
    ip = F.filter(_found(text, _IP, text.rlike(r"[0-9]\.[0-9]")),
                  lambda x: F.forall(F.split(x["m"], r"\."), _small_part))
    card = F.filter(_found(text, _CARD, text.rlike(r"[0-9](?:[\x20-]?[0-9]){15}")),
                    lambda x: F.length(_digits(x["m"])).between(16, 19) & _luhn(_digits(x["m"])))
    phone = F.filter(_found(text, _PHONE, text.rlike(r"\+[0-9]")), lambda x: F.length(_digits(x["m"])).between(8, 15))
    return dict(zip(BASE_KINDS, (email, ip, card, phone)))


def _kind(m: Column) -> Column:
    return (F.when(m.rlike(r"^[0-9()\x20.-]+$"), "number").when(m.rlike(r"[\[(\x20]at[\])\x20]"), "contact")
            .otherwise("secret"))


def _vote(yes: Column, no: Column) -> Column:
    return F.when(F.coalesce(yes, F.lit(False)), 1).when(F.coalesce(no, F.lit(False)), -1).otherwise(0)


def votes(c: Column) -> list[Column]:
    """One vote per labeler on a candidate: 1 personal, -1 not, 0 no opinion."""
    m, before, after = c["m"], c["before"], c["after"]
    number, contact = m.rlike(r"^[0-9()\x20.-]+$"), m.rlike(r"[\[(\x20]at[\])\x20]")
    code = ~number & ~contact
    mixed = m.rlike("[0-9]") & m.rlike("[A-Za-z]")
    kinds_used = F.size(F.array_distinct(F.split(F.lower(m), "")))
    return [
        _vote(code & (m.rlike("^(?:[0-9a-f]{32,}|[0-9A-F]{32,})$") | mixed & m.rlike("[A-Z]") & m.rlike("[a-z]"))
              | contact | m.rlike(r"^\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}$"),
              code & ~mixed | m.rlike(r"^(?:19|20)[0-9]{2}[.-][0-9]{2}[.-]")),
        _vote(before.rlike(_NAMES_DATA), before.rlike(_NAMES_OTHER)),
        _vote(before.rlike("[=:]\\s*[\"']?$"), before.rlike(r"[/?&#]$") | m.contains("/")),
        _vote(before.rlike("[\"'<]$") & after.rlike("^[\"'>]"), after.rlike("^[/=]")),
        _vote(code & (kinds_used >= 10) & mixed, code & ~m.rlike("[0-9]") | number & m.contains(".")),
    ]


N_LABELERS = 5
#: Weight of the first guess of a labeler's reliability, in votes.
PRIOR_VOTES = 20


def reliabilities(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200):
    """Likelihood of each vote pattern, by expectation maximisation.

    Labelers are taken as independent given the truth; each has a table of vote
    probabilities for either truth. It starts at five right votes to one wrong
    one, which also stands in as `PRIOR_VOTES` observed votes.
    """
    table = np.empty((2, patterns.shape[1], 3))
    table[1], table[0] = (0.1, 0.4, 0.5), (0.5, 0.4, 0.1)
    start = table.copy()
    prior = 0.5
    chosen = patterns + 1
    each = np.arange(patterns.shape[1])
    for _ in range(rounds):
        logs = np.log(table[:, each, chosen]).sum(axis=2)
        odds = np.clip(np.log(prior / (1 - prior)) + logs[1] - logs[0], -50, 50)
        likely = 1 / (1 + np.exp(-odds))
        prior = float(((counts * likely).sum() + PRIOR_VOTES / 2) / (counts.sum() + PRIOR_VOTES))
        for truth, weight in ((1, counts * likely), (0, counts * (1 - likely))):
            for vote in range(3):
                seen = (weight[:, None] * (chosen == vote)).sum(axis=0) + PRIOR_VOTES * start[truth, :, vote]
                table[truth, :, vote] = seen / (weight.sum() + PRIOR_VOTES)
    return likely, table


def fit_span_classifier(patterns: np.ndarray, kinds: np.ndarray, likely: np.ndarray, counts: np.ndarray,
                        ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Logistic weights on constant, votes for, votes against and kind (Newton steps)."""
    x = np.hstack([np.ones((len(patterns), 1)), patterns == 1, patterns == -1, kinds]).astype(float)
    share = counts / counts.sum()
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (share * (p - likely)) + ridge * w
        curve = (x * (share * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w = w - np.linalg.solve(curve, gradient)
    return w


def _train(candidates: DataFrame) -> tuple[np.ndarray | None, np.ndarray | None]:
    """Weights of the span classifier from counts of (kind, votes)."""
    rows = candidates.groupBy("kind", "votes").count().collect()  # at most 3 * 3**5 rows
    rows = [r for r in rows if any(r.votes)]
    if not rows:
        return None, None
    patterns = np.array([r.votes for r in rows])
    counts = np.array([r["count"] for r in rows], float)
    kinds = np.array([[r.kind == k for k in ADDED_KINDS] for r in rows])
    likely, table = reliabilities(patterns, counts)
    return fit_span_classifier(patterns, kinds, likely, counts), table


def find_personal_data(docs: DataFrame, *kept: str) -> DataFrame:
    """(doc_id, base kinds, added): arrays of spans (s, e); ``kept`` columns go along.

    Each base kind is a column named after it; ``added`` has (kind, s, e).
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    spans = docs.select(F.col("doc_id"), *kept, text.alias("text"))
    hint = F.col("text").rlike(_CANDIDATE)
    found = spans.select("doc_id", *kept, *[v.alias(k) for k, v in base_spans(F.col("text")).items()],
                         _found(F.col("text"), _CANDIDATE, hint).alias("found"))
    flat = F.concat(*[F.transform(k, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))) for k in BASE_KINDS])
    found = found.withColumn("base", flat)
    # Candidates have to be clear of base spans; only texts with both are looked at.
    free = F.when((F.size("found") > 0) & (F.size("base") > 0), F.filter(
        "found", lambda c: ~F.exists(F.col("base"), lambda b: (b["s"] < c["e"]) & (c["s"] < b["e"])))).otherwise(
            F.col("found"))
    voted = F.transform(free, lambda c: F.struct(
        _kind(c["m"]).alias("kind"), c["s"].alias("s"), c["e"].alias("e"), F.array(*votes(c)).alias("votes")))
    slim = [F.transform(k, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))).alias(k) for k in BASE_KINDS]
    table = stage(found.select("doc_id", *kept, *slim, voted.alias("candidates")), "personal-data")
    weights, _ = _train(table.select(F.explode("candidates").alias("c")).select("c.kind", "c.votes"))
    if weights is None:
        accept = lambda c: F.lit(False)
    else:
        accept = _accepts(weights)
    chosen = F.transform(F.filter("candidates", accept), lambda c: F.struct(
        c["kind"].alias("kind"), c["s"].alias("s"), c["e"].alias("e")))
    return table.select("doc_id", *kept, *BASE_KINDS, chosen.alias("added"))


def _accepts(weights: np.ndarray):
    """The classifier as a column function; a candidate needs some vote."""
    w = [float(x) for x in weights]

    def accept(c: Column) -> Column:
        score = F.lit(w[0])
        for i in range(N_LABELERS):
            v = c["votes"][i]
            score = score + F.when(v == 1, w[1 + i]).when(v == -1, w[1 + N_LABELERS + i]).otherwise(0.0)
        for i, kind in enumerate(ADDED_KINDS):
            score = score + F.when(c["kind"] == kind, w[1 + 2 * N_LABELERS + i]).otherwise(0.0)
        return (score > 0) & F.exists(c["votes"], lambda v: v == 1)

    return accept


def _of_kind(kind: str) -> Column:
    return F.filter("added", lambda x: x["kind"] == kind)


def _ranges(spans: str, kind: str) -> Column:
    return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(kind).alias("kind")))


def _named(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda x: F.concat_ws(":", F.lit(kind), x["s"], x["e"]))


def report(docs: DataFrame) -> DataFrame:
    """Counts per base kind, digest of the base spans and all spans as text."""
    found = find_personal_data(docs)
    base = F.concat(*[_named(k, F.col(k)) for k in BASE_KINDS])
    more = [_named(k, _of_kind(k)) for k in ADDED_KINDS]
    return found.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
        F.array_join(F.concat(base, *more), ",").alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """Documents with each span replaced by its kind in angle brackets.

    Overlapping base spans are merged; the first one names the mark. The text
    is staged with its spans, so that rows need no join.
    """
    names = docs.columns
    whole = docs.select(F.struct(*[F.col(f"`{n}`") for n in names]).alias("row"), "doc_id", "text")
    found = find_personal_data(whole, "row")
    labelled = [_ranges(k, k) for k in BASE_KINDS]
    labelled.append(F.transform("added", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"),
                                                           x["kind"].alias("kind"))))
    spans = F.array_sort(F.concat(*labelled))
    text = F.col("row.text").cast("string")
    zero = F.struct(F.lit(0).alias("pos"), F.array().cast("array<struct<a:int,b:int,mark:string>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        one = F.struct(acc["pos"].alias("a"), x["s"].alias("b"), x["kind"].alias("mark"))
        return F.when(x["s"] < acc["pos"], F.struct(F.greatest(acc["pos"], x["e"]).alias("pos"), acc["out"].alias("out"))
                      ).otherwise(F.struct(x["e"].alias("pos"), F.array_append(acc["out"], one).alias("out")))

    cut = found.select("row", F.aggregate(spans, zero, step).alias("cut"))
    parts = F.transform("cut.out", lambda x: F.concat(
        F.substring(text, x["a"] + 1, x["b"] - x["a"]), F.lit("<"), F.upper(x["mark"]), F.lit(">")))
    clean = F.when(F.size("cut.out") == 0, text).otherwise(
        F.concat(F.array_join(parts, ""), F.substring(text, F.col("cut.pos") + 1, F.char_length(text))))
    out = cut.select(*[F.col(f"row.`{n}`").alias(n) if n != "text" else
                       clean.cast(docs.schema["text"].dataType).alias(n) for n in names])
    if "n_chars" in names:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars"))
                             .otherwise(F.char_length("text")).cast(kind))
    return out

