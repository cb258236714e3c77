"""Personal data by weak supervision, in DataFrame functions only.

Base patterns (e-mail, IP address, card, phone) always count. Looser patterns
propose further spans. On every span seven labelers vote yes, no or nothing:
format, gazetteer, context (words, or the place of a field's value), counter-context (words, or a list of numbers), neighbours (other spans
close by), boundary and variety. The votes' patterns are counted; expectation-
maximisation over those counts estimates how reliable each labeler is, and a
logistic span classifier is trained on its posteriors, from the votes, the kind
and features of the span itself (length, share of digits, letters, separators and
what stands before and after). Proposed spans that it takes and that don't overlap
base ones are added.

A pattern's matches come from ``regexp_extract_all`` and their places from running
sums of the lengths of what ``split`` leaves between them; contexts come from those
gaps too. Running folds work in blocks of the square root of their length, so n
matches cost n times its root, and text is never scanned from its start again.
Patterns begin only where a match can, and use possessive loops, so long runs cost
linear time and no stack.

Cases: a null text counts as empty and has no spans; places are in code points,
ends exclusive; a very long text is read whole; repeated rows and ids are annotated
alike; an empty table gives no rows and trains nothing; ``redact`` keeps all
columns, whatever their names, ``annotate`` id and spans.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import durable, fresh, quoted

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("spelled_email", "local_phone", "ssn", "iban", "credential")
KINDS = BASE_KINDS + ADDED_KINDS
LABELERS = ("format", "gazetteer", "context", "counter", "neighbours", "boundary", "variety")
#: Code points of context, and how near another span is a neighbour.
BEFORE, NEAR = 40, 40

# Patterns and word lists.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
OCTET = r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$"
SPELLED_EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]++(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]++)++"
LOCAL_PHONE = r"(?<![0-9+.-])(?<!\+[0-9] )\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-][0-9]{4}(?![0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}+(?: ?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])"
CREDENTIAL = r"(?:AKIA[0-9A-Z]{16}(?![0-9A-Za-z])|(?i:password|passwd|token|secret|api_key|apikey) ?[=:] ?[\x22']?[A-Za-z0-9_+/-]{8,}+[\x22']?)"
CREDENTIAL_HINT = r"AKIA|(?i:password|passwd|token|secret|api_?key) ?[=:]"
TOP_DOMAINS = ("com", "org", "net", "edu", "gov", "io", "info", "de", "fr", "es", "uk", "eu")
IBAN_COUNTRIES = ("AT", "BE", "CH", "DE", "DK", "ES", "FI", "FR", "GB", "IE", "IT", "LU", "NL", "NO", "PL", "PT", "SE")
CARD_PREFIXES = r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))"
CONTEXT_WORDS = ("mail", "email", "e-mail", "contact", "phone", "tel", "call", "mobile", "fax", "card", "visa", "credit", "ip", "address", "ssn", "social", "iban", "account", "login", "user", "key", "password", "token", "telefon", "telefono", "courriel", "correo", "konto", "adresse", "kennwort", "carte", "tarjeta")
COUNTER_WORDS = ("version", "license", "page", "isbn", "figure", "fig", "section", "chapter", "order", "invoice", "id", "no")
#: What stands before the value of a field (a cell, an assignment, a quotation), and before one of several numbers.
FIELD, NUMBER_LIST = r"[:=|<(\[\x22']\s*$", r"[0-9][\s,;/]*$"
#: Patterns of votes and features that the model is fitted on: the most frequent ones.
PATTERNS = 65_536

_SPAN = "array<struct<start:int,rank:int,end:int,kind:string,body:string,before:string,after:string>>"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, also inside lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(values: Column, zero: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """Folds of the first 0, 1, ... n - 1 values, for each of n values."""

    def upto(items: Column, count: Column) -> Column:
        return F.aggregate(F.slice(items, 1, count), zero, merge)

    def over(items: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(items))).cast("int")
        starts = F.sequence(F.lit(1), F.size(items), width)
        blocks = F.transform(starts, lambda at: F.slice(items, at, width))

        def inside(block: Column, before: Column) -> Column:
            return F.transform(block, lambda _, i: merge(before, upto(block, i)))

        sums = F.transform(blocks, lambda b: F.aggregate(b, zero, merge))
        before = _let(sums, lambda own: F.transform(own, lambda _, i: upto(own, i)))
        return F.flatten(F.zip_with(blocks, before, inside))

    return F.when(F.size(values) > 0, _let(values, over)).otherwise(F.array().cast("array<int>"))


def _digits(body: Column) -> Column:
    return F.regexp_replace(body, "[^0-9]", "")


def luhn(body: Column) -> Column:
    figures = F.reverse(F.filter(F.split(_digits(body), ""), lambda d: d != ""))
    doubled = F.transform(figures, lambda d, i: d.cast("int") * (1 + i % 2))
    return F.aggregate(doubled, F.lit(0), lambda s, d: s + F.when(d > 9, d - 9).otherwise(d)) % 10 == 0


def _between(low: int, high: int) -> Callable[[Column], Column]:
    return lambda body: F.char_length(_digits(body)).between(low, high)


def _octets(body: Column) -> Column:
    return F.forall(F.split(body, r"\."), lambda p: p.rlike(OCTET))


def _always(body: Column) -> Column:
    return F.lit(True)


def spans(text: Column, kind: str, pattern: str, valid: Callable[[Column], Column], guard: Column) -> Column:
    """Valid matches of a pattern, leftmost and non-overlapping, in order."""
    rank = KINDS.index(kind)
    none = F.array().cast(_SPAN)

    def built(bodies: Column) -> Column:
        def placed(gaps: Column) -> Column:
            n = F.size(bodies)
            sizes = F.zip_with(F.slice(gaps, 1, n), bodies, lambda g, b: F.char_length(g) + F.char_length(b))
            parts = F.arrays_zip(running(sizes, F.lit(0), lambda x, y: x + y).alias("at"), F.slice(gaps, 1, n).alias("gap"), bodies.alias("body"), F.slice(gaps, 2, n).alias("next"))

            def span(part: Column) -> Column:
                start = part["at"] + F.char_length(part["gap"])
                return F.struct(
                    start.alias("start"), F.lit(rank).alias("rank"), (start + F.char_length(part["body"])).alias("end"), F.lit(kind).alias("kind"), part["body"].alias("body"),
                    F.right(part["gap"], F.lit(BEFORE)).alias("before"), F.left(part["next"], F.lit(1)).alias("after"),
                )

            return F.transform(F.filter(parts, lambda p: valid(p["body"])), span).cast(_SPAN)

        return F.when(F.size(bodies) > 0, _let(F.split(text, pattern, -1), placed)).otherwise(none)

    return F.when(guard, _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), built)).otherwise(none)


def base_spans(text: Column) -> Column:
    some = text.rlike("[0-9]")
    return F.concat(
        spans(text, "email", EMAIL, _always, F.contains(text, F.lit("@"))),
        spans(text, "ip", IP, _octets, F.contains(text, F.lit(".")) & some),
        spans(text, "card", CARD, luhn, some),
        spans(text, "phone", PHONE, _between(10, 15), F.contains(text, F.lit("+"))),
    )


def proposed_spans(text: Column) -> Column:
    some = text.rlike("[0-9]")
    at = F.contains(text, F.lit("(at)")) | F.contains(text, F.lit("[at]"))
    words = text.rlike(CREDENTIAL_HINT)
    return F.concat(
        spans(text, "spelled_email", SPELLED_EMAIL, _always, at),
        spans(text, "local_phone", LOCAL_PHONE, _always, some),
        spans(text, "ssn", SSN, _always, some & F.contains(text, F.lit("-"))),
        spans(text, "iban", IBAN, _between(8, 34), some),
        spans(text, "credential", CREDENTIAL, _always, words),
    )


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def votes(span: Column) -> Column:
    """A vote of each labeler: 1 yes, -1 no, 0 nothing."""
    kind, body = span["kind"], span["body"]
    last = F.lower(F.regexp_extract(body, r"(?<![A-Za-z])([A-Za-z]++)[^A-Za-z]*+$", 1))
    shaped = (
        F.when(kind == "card", luhn(body))
        .when(kind == "local_phone", body.rlike(r"^\(?[2-9][0-9]{2}\)?[ .-]?[2-9]"))
        .when(kind == "ssn", ~body.rlike("^(?:000|666|9)|-00-|-0000$"))
        .when(kind == "iban", F.char_length(F.regexp_replace(body, " ", "")).between(15, 34))
        .when(kind == "credential", body.rlike("[0-9]"))
        .otherwise(F.lit(True))
    )
    listed = (
        F.when(kind.isin("email", "spelled_email"), last.isin(*TOP_DOMAINS))
        .when(kind == "card", _digits(body).rlike(CARD_PREFIXES))
        .when(kind == "iban", F.substring(body, 1, 2).isin(*IBAN_COUNTRIES))
        .when(kind == "credential", F.lower(body).rlike("^(?:akia|password|token|secret|api)"))
        .when(kind == "phone", body.rlike(r"^\+[1-9]"))
        .otherwise(F.lit(False))
    )
    near = lambda words: span["before"].rlike(rf"(?i)\b(?:{'|'.join(words)})\b[^A-Za-z0-9]{{0,12}}$")
    joined = span["before"].rlike(r"[\p{L}\p{N}_]$") | span["after"].rlike(r"^[\p{L}\p{N}_]")
    varied = F.size(F.array_distinct(F.split(body, "")))
    no = F.lit(False)
    field, listing_ = span["before"].rlike(FIELD), span["before"].rlike(NUMBER_LIST)
    return F.array(
        _vote(shaped, ~shaped), _vote(listed, no), _vote(near(CONTEXT_WORDS) | field, no), _vote(no, near(COUNTER_WORDS) | listing_), _vote(span["near"], no), _vote(~joined, joined), _vote(varied >= 5, varied < 4)
    )


#: Features of a span itself, each with few values.
FEATURES = ("length", "digits", "letters", "spaces", "marks", "before", "after")


def features(span: Column) -> Column:
    """Values of FEATURES: buckets of length and digit share, flags, and classes of
    the characters before and after."""
    body, size = span["body"], F.char_length(span["body"])
    digits = F.char_length(_digits(body))
    kind_of = lambda c: F.when(c == "", 0).when(c.rlike(r"[\s]"), 1).when(c.rlike(r"[\p{L}\p{N}]"), 2).otherwise(3)
    return F.array(
        F.when(size < 10, 0).when(size < 16, 1).when(size < 32, 2).otherwise(3), F.when(digits * 4 < size, 0).when(digits * 4 < 3 * size, 1).otherwise(2),
        body.rlike("[A-Za-z]").cast("int"), body.rlike(r"[\x20]").cast("int"), body.rlike(r"[-.()\[\]=:@]").cast("int"), kind_of(F.right(span["before"], F.lit(1))), kind_of(span["after"]),
    )


@dataclass(frozen=True)
class Model:
    """Reliabilities by labeler, and the span classifier's weights: of each labeler's
    vote, of each kind, and of each value of each feature."""

    reliability: dict[str, float]
    weights: dict[tuple[str, object], float]

    def takes(self, span: Column) -> Column:
        """Whether the classifier gives the span a probability of at least 1/2."""
        score = F.lit(self.weights.get(("bias", 0), 0.0))
        for (name, value), w in self.weights.items():
            if name in LABELERS:
                score = score + span["votes"][LABELERS.index(name)] * F.lit(w)
            elif name == "kind":
                score = score + F.when(span["kind"] == value, w).otherwise(0.0)
            elif name in FEATURES:
                score = score + F.when(span["features"][FEATURES.index(name)] == value, w).otherwise(0.0)
        return score >= 0


def _inputs(kind: str, votes_: Sequence[int], features_: Sequence[int]) -> dict[tuple[str, object], float]:
    found = {("bias", 0): 1.0, ("kind", kind): 1.0} | {(name, 0): float(v) for name, v in zip(LABELERS, votes_, strict=True) if v}
    return found | {(name, v): 1.0 for name, v in zip(FEATURES, features_, strict=True)}


def expectation_maximisation(patterns: Sequence[tuple[tuple[int, ...], float]], rounds: int = 60) -> tuple[list[float], list[dict[int, tuple[float, float]]]]:
    """Posteriors of the patterns, and P(vote | no), P(vote | yes) by labeler.

    Votes are independent given the class; the first posteriors are majorities."""
    posterior = [1 / (1 + math.exp(-sum(v))) for v, _ in patterns]
    tables: list[dict[int, tuple[float, float]]] = []
    for _ in range(rounds):
        mass = [sum(n * (1 - p) for (_, n), p in zip(patterns, posterior, strict=True)), sum(n * p for (_, n), p in zip(patterns, posterior, strict=True))]
        tables = []
        for j in range(len(LABELERS)):
            seen = {v: [1.0, 1.0] for v in (-1, 0, 1)}
            for (votes_, n), p in zip(patterns, posterior, strict=True):
                seen[votes_[j]][0] += n * (1 - p)
                seen[votes_[j]][1] += n * p
            tables.append({v: (a / (mass[0] + 3), b / (mass[1] + 3)) for v, (a, b) in seen.items()})
        prior = (mass[1] + 1) / (mass[0] + mass[1] + 2)
        posterior = []
        for votes_, _ in patterns:
            logit = math.log(prior / (1 - prior)) + sum(math.log(t[v][1] / t[v][0]) for v, t in zip(votes_, tables, strict=True))
            posterior.append(1 / (1 + math.exp(-max(-50.0, min(50.0, logit)))))
    return posterior, tables


def train(found: DataFrame, rounds: int = 300) -> Model | None:
    """The model of a table with columns base and proposed (arrays of voted
    spans). Only counts leave the cluster: of the ``PATTERNS`` most frequent patterns
    of kind, votes and features, which is the sample that the model is fitted on (there
    are 15 on 51,282 documents)."""
    seen = found.select(F.explode(F.concat("base", "proposed")).alias("s")).groupBy(F.col("s.kind").alias("kind"), F.col("s.votes").alias("votes"), F.col("s.features").alias("features")).agg(F.count("*").alias("n"))
    most = seen.orderBy(F.desc("n"), "kind", "votes", "features").limit(PATTERNS)
    rows = sorted((r.kind, tuple(r.votes), tuple(r.features), r.n) for r in most.collect())
    if not rows:
        return None
    by_votes: Counter[tuple[int, ...]] = Counter()
    for _, v, _, n in rows:
        by_votes[v] += n
    patterns = sorted(by_votes.items())
    posterior, tables = expectation_maximisation(patterns)
    chance = {v: p for (v, _), p in zip(patterns, posterior, strict=True)}
    reliability = {}
    for name, t in zip(LABELERS, tables, strict=True):
        right, wrong = t[1][1] + t[-1][0], t[1][0] + t[-1][1]
        reliability[name] = right / (right + wrong)
    inputs = [(_inputs(kind, v, f), n, chance[v]) for kind, v, f, n in rows]
    weights = dict.fromkeys(sorted({k for x, _, _ in inputs for k in x}, key=str), 0.0)
    total = sum(n for *_, n in rows)
    for _ in range(rounds):
        slope = dict.fromkeys(weights, 0.0)
        for x, n, p in inputs:
            z = sum(weights[k] * value for k, value in x.items())
            error = n / total * (p - 1 / (1 + math.exp(-max(-50.0, min(50.0, z)))))
            for k, value in x.items():
                slope[k] += error * value
        weights = {k: w + slope[k] - 1e-3 * w for k, w in weights.items()}
    return Model(reliability, weights)


def _text(text_col: str) -> Column:
    return F.coalesce(quoted(text_col), F.lit(""))


def _voted(base: Column, proposed: Column) -> Column:
    """Struct of base and proposed: spans by start, with votes, features, and clear:
    whether no base span overlaps."""
    wide = F.array_sort(F.concat(base, proposed))
    far, none = F.lit(-NEAR - 1), F.lit(0)
    is_base = lambda s: s["rank"] < len(BASE_KINDS)

    def judged(all_: Column) -> Column:
        ends, back = running(F.transform(all_, lambda s: F.when(is_base(s), s["end"]).otherwise(none)), none, lambda x, y: F.greatest(x, y)), F.reverse(all_)
        last = F.lit((1 << 31) - 1)
        starts = F.reverse(running(F.transform(back, lambda s: F.when(is_base(s), s["start"]).otherwise(last)), last, lambda x, y: F.least(x, y)))
        n = F.size(all_)
        before = F.concat(F.array(far), F.transform(F.slice(all_, 1, n - 1), lambda s: s["end"]))
        after = F.concat(F.transform(F.slice(all_, 2, n), lambda s: s["start"]), F.array(last))
        rows = F.arrays_zip(all_.alias("s"), ends.alias("base_end"), starts.alias("base_start"), before.alias("before_end"), after.alias("after_start"))

        def row(r: Column) -> Column:
            s = r["s"]
            near = (s["start"] - r["before_end"]).between(0, NEAR) | (r["after_start"] - s["end"]).between(0, NEAR)
            known = F.struct(s["kind"].alias("kind"), s["body"].alias("body"), s["before"].alias("before"), s["after"].alias("after"), near.alias("near"))
            clear = (r["base_end"] <= s["start"]) & (r["base_start"] >= s["end"])
            return F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"), votes(known).alias("votes"), features(known).alias("features"), clear.alias("clear"))

        return F.transform(rows, row)

    empty = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,votes:array<int>,features:array<int>,clear:boolean>>")
    return F.when(F.size(wide) > 0, _let(wide, lambda a: F.when(F.size(a) > 0, judged(a)))).otherwise(empty)


def found_in(text: Column) -> Column:
    """Voted spans of a text, base and proposed ones, by start."""
    return _let(base_spans(text), lambda base: _let(proposed_spans(text), lambda proposed: F.when(F.size(base) + F.size(proposed) > 0, _voted(base, proposed))))


def _split(all_: str) -> list[Column]:
    spans_ = F.coalesce(F.col(all_), F.array())
    is_base = lambda s: s["rank"] < len(BASE_KINDS)
    return [F.filter(spans_, is_base).alias("base"), F.filter(spans_, lambda s: ~is_base(s)).alias("proposed")]


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, base, proposed: voted spans of each text."""
    return docs.select(quoted(id_col).alias("id"), found_in(_text(text_col)).alias("found")).select(F.col("id").alias(id_col), *_split("found"))


def chosen(model: Model | None, base: Column, proposed: Column) -> Column:
    """All spans by start and kind: base ones, and what the model adds."""
    if model is None:
        return F.array_sort(base)
    return F.array_sort(F.concat(base, F.filter(proposed, lambda s: s["clear"] & model.takes(s))))


def annotate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, Model | None]:
    """id, base and spans of each document, and the model that chose them."""
    found = durable(find(docs, id_col, text_col), "spans")
    model = train(found)
    return found.select(quoted(id_col), F.array_sort("base").alias("base"), chosen(model, F.col("base"), F.col("proposed")).alias("spans")), model


def count_of(column: str, kind: str) -> Column:
    return F.size(F.filter(column, lambda s: s["kind"] == kind)).cast("long")


def listing(column: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


#: Code points of a block that masks its own spans.
BLOCK = 8192


def masked(text: Column, spans_: Column) -> Column:
    """``text`` with sorted spans replaced by their kinds in brackets; of overlapping
    ones the first counts, and what a later one covers beyond it goes too."""
    blocks = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{BLOCK}}}"), F.lit(0))

    def of(block: Column, number: Column) -> Column:
        low, high = number * BLOCK, (number + 1) * BLOCK
        own = F.filter(spans_, lambda s: (s["end"] > low) & (s["start"] < high))

        def step(acc: Column, s: Column) -> Column:
            kept = F.substring(block, acc["at"] - low + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
            mark = F.when((s["start"] >= low) & (s["start"] >= acc["at"]), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise("")
            return F.struct(F.concat(acc["out"], kept, mark).alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

        begin = F.struct(F.lit("").alias("out"), low.cast("int").alias("at"))
        rest = lambda acc: F.concat(acc["out"], F.when(acc["at"] < high, F.substring(block, acc["at"] - low + 1, F.lit(BLOCK))).otherwise(""))
        return F.when(F.size(own) > 0, F.aggregate(own, begin, step, rest)).otherwise(block)

    return F.when(F.size(spans_) > 0, F.array_join(F.transform(blocks, of), "")).otherwise(text)


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; overlapping
    spans are replaced once, by the first one's kind. A null text stays null. The
    spans are found once, and written beside the rows."""
    found, base, proposed, spans_ = fresh(docs, "span_found", "span_base", "span_proposed", "span_chosen")
    own = [quoted(c) for c in docs.columns]
    wide = durable(docs.select(*own, found_in(_text(text_col)).alias(found)), "spans")
    model = train(wide.select(*_split(found)))
    parts = wide.select(*own, *(c.alias(n) for c, n in zip(_split(found), (base, proposed), strict=True)))
    parts = parts.select(*own, chosen(model, F.col(base), F.col(proposed)).alias(spans_))
    text = quoted(text_col)
    return parts.select(*(F.when(text.isNotNull(), masked(text, F.col(spans_))).alias(c) if c == text_col else quoted(c) for c in docs.columns))
