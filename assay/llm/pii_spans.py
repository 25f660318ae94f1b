"""Personal data by weak supervision, in DataFrame and SQL functions alone.

Fixed patterns give the base spans of four kinds; whatever follows only adds to them. Candidates
are all matches of these patterns, failed ones included, and looser forms in the text between them
(spelled-out addresses, national telephone numbers, cards with other separators, long or bracketed
addresses of hosts). Four labelers vote -1, 0 or 1 on each candidate: its form and check digits, a
gazetteer (endings, issuers, dialling codes, address ranges), trigger words before it in four
languages, and the characters it touches. Expectation-maximisation on the counts of vote patterns,
at most 81 of a kind, estimates how far each labeler can be relied upon, and gives every pattern the
probability of being personal data. With these as soft labels a logistic regression is trained on
one-hot span features; a candidate whose own check did not fail is added if it gives ``ADDED`` or
more.

Texts are read once. What is kept of a row, on shared files, are its spans and candidates, so a
row is never joined to anything; statistics are sums over patterns. Positions are running sums of
the lengths of matches and of what lies between them, in blocks, so a text of millions of numbers
costs k * sqrt(k). Patterns are linear: no repeated group can be given back, and a run is tried
from its start only.

Results for unusual input: null and empty texts have no spans, and base_sha256 is that of the
empty string; rows that repeat each get their spans; a row without doc_id keeps it null; no rows
give no rows; without candidates there is no classifier and nothing is added; other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, functions as F

from assay.llm.common import cut_lineage, text_rows
from assay.llm.quality_rules import let

KINDS = ("email", "ip", "card", "phone")
ADDED = 0.9
ROUNDS = 30
CONTEXT_CHARS = 48
#: Java patterns of the base spans. A run starts where no character of the run stands before it,
#: or where the match before it ended. Cards and telephone numbers are checked for digits after.
_LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": (r"(?i)(?<![\w.+-])[a-z0-9._+-]{1,64}+\x20?[(\[{](?:at|@)[)\]}]\x20?[a-z0-9-]{1,63}+"
              r"(?:(?:\x20?[(\[{](?:dot|punkt|point|punto)[)\]}]\x20?|\.)[a-z0-9-]{1,63}+){1,8}+"),
    "ip": (r"(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![\w:])"
           r"|(?<![0-9.])[0-9]{1,3}+(?:\[\.\]|\(\.\))[0-9]{1,3}+(?:\[\.\]|\(\.\))[0-9]{1,3}+(?:\[\.\]|\(\.\))[0-9]{1,3}+(?![0-9])"),
    "card": r"(?<![\w.])[0-9]{4}(?:[._/ ][0-9]{4}){3}(?![\w])",
    "phone": (r"(?<![\w+(.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[-.\x20])[0-9]{3}[-.\x20][0-9]{4}(?![\w-])"
              r"|(?<![\w+])00[1-9][0-9]{0,2}[\x20/-][0-9\x20/()-]{6,18}[0-9](?![\w-])"),
}
#: Texts in which a pattern can match at all.
HINTS = {"email": ("@", r"(?i)[(\[{](?:at|@)[)\]}]"), "ip": (r"[0-9]\.[0-9]", r":[0-9A-Fa-f]{1,4}:|[0-9][(\[]\.[)\]]"),
         "card": ("[0-9]", r"[0-9]{4}[._/ ][0-9]{4}"), "phone": (r"\+[0-9]", r"[0-9]{3}[-.\x20][0-9]{4}|00[1-9]")}
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: Fixed words: what stands before personal data, and before numbers that are none.
TRIGGERS = {
    "email": "mail|contact|kontakt|correo|courriel|write|schreib|escrib",
    "ip": r"\bip\b|address|adresse|dirección|host|server|servidor|serveur",
    "card": "card|karte|tarjeta|carte|visa|credit|kredit|crédito|crédit|payment|zahlung|pago",
    "phone": "phone|telefon|teléfono|téléphone|\\btel\\b|call|mobile|handy|móvil|fax|anruf|llam|appel",
}
COUNTERS = r"version|isbn|order|invoice|rechnung|factura|facture|token|serial|page|seite|página|\bid\b|\bv\.?$|hash|commit"
#: What the gazetteer knows: [pattern for, pattern against], on the value.
GAZETTEER = {
    "email": (r"(?i)(?:\.|[)\]}]\x20?)(?:com|org|net|edu|gov|info|io|eu|de|at|ch|fr|es|mx|ar|uk|us|ca|it|nl)$", r"[0-9]$"),
    "ip": (r"^(?:[1-9]|[1-9][0-9]|1[0-9][0-9]|2[01][0-9]|22[0-3])\D", r"^0*(?:0|127|22[4-9]|2[3-9][0-9])\D"),
    "card": (r"^(?:4|5[1-5]|3[47]|35|6011|65|2[2-7])", r"^[0789]"),
    "phone": (r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])|^\(?[2-9][0-9]{2}\)?\D", r"^\+0|^\(?[01]"),
}
LABELERS = 4
#: One-hot features: kind and form, then the votes, digits and length.
_SIZES = (2 * len(KINDS), 3, 3, 3, 3, 6, 6)
N_FEATURES = sum(_SIZES)


def running(lengths: Column) -> Column:
    """Running sums of an array, in blocks of about the square root of its size."""
    def sums(a: Column) -> Column:
        return F.aggregate(a, F.lit(0), lambda s, x: s + x)

    def within(a: Column, base: Column) -> Column:
        return F.transform(a, lambda _, i: base + sums(F.slice(a, F.lit(1), i + 1)))

    def blocks(a: Column, size: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / size).cast("int")),
                           lambda b: F.slice(a, b * size + 1, size))

    def of(parts: Column) -> Column:
        return let(F.transform(parts, sums), lambda totals: F.flatten(F.transform(
            parts, lambda part, b: within(part, sums(F.slice(totals, F.lit(1), b))))))

    return F.when(F.size(lengths) == 0, lengths).otherwise(
        let(F.ceil(F.sqrt(F.size(lengths))).cast("int"), lambda size: of(blocks(lengths, size))))


def matches(text: Column, pattern: str) -> Column:
    """Array of start, end, value, before and after of the leftmost matches, in order."""
    def placed(pieces: Column, values: Column) -> Column:
        lengths = F.transform(values, lambda v, i: F.length(v) + F.length(F.get(pieces, i)))
        return let(running(lengths), lambda ends: F.transform(values, lambda v, i: F.struct(
            (F.get(ends, i) - F.length(v)).alias("start"), F.get(ends, i).alias("end"), v.alias("value"),
            F.right(F.get(pieces, i), F.lit(CONTEXT_CHARS)).alias("before"), F.left(F.get(pieces, i + 1), F.lit(1)).alias("after"))))

    return let(F.split(text, pattern, -1), lambda pieces: let(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda values: placed(pieces, values)))


def between(text: Column, found: Column, base: str, pattern: str) -> Column:
    """Matches of ``pattern`` in the pieces of the text that the matches of ``base`` leave."""
    ends = F.concat(F.array(F.lit(0)), F.transform(found, lambda m: m["end"]))
    pieces = let(ends, lambda e: F.transform(F.split(text, base, -1), lambda piece, i: F.struct(
        F.get(e, i).alias("at"), piece.alias("piece"))))
    pieces = F.filter(pieces, lambda p: p["piece"].rlike(pattern))
    return F.flatten(F.transform(pieces, lambda p: F.transform(matches(p["piece"], pattern), lambda m: F.struct(
        (m["start"] + p["at"]).alias("start"), (m["end"] + p["at"]).alias("end"), m["value"].alias("value"),
        m["before"].alias("before"), m["after"].alias("after")))))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def is_base(kind: str, value: Column) -> Column:
    """Whether a match of a base pattern is a base span."""
    if kind == "ip":
        return value.rlike(rf"^{_PART}\.{_PART}\.{_PART}\.{_PART}$")
    if kind == "card":
        return F.call_function("luhn_check", digits(value))
    if kind == "phone":
        return F.length(digits(value)).between(9, 15)
    return F.lit(True)


def _vote(good: Column, bad: Column) -> Column:
    return F.when(good, 1).when(bad, -1).otherwise(0)


def _votes(kind: str, loose: bool, m: Column) -> list[Column]:
    value, before, after = m["value"], F.lower(m["before"]), m["after"]
    checks = {
        "email": F.lit(0) if loose else _vote(value.rlike(r"\.[A-Za-z]{2,24}$"), value.rlike("[0-9-]$")),
        "ip": F.lit(0) if loose else _vote(is_base("ip", value), F.lit(True)),
        "card": _vote(F.call_function("luhn_check", digits(value)), F.lit(True)),
        "phone": _vote(F.length(digits(value)).between(10 if loose else 9, 15), F.lit(True)),
    }
    known, unknown = GAZETTEER[kind]
    return [checks[kind], _vote(value.rlike(known), value.rlike(unknown)),
            _vote(before.rlike(TRIGGERS[kind]), before.rlike(COUNTERS)),
            _vote(~before.rlike(r"[\w/=#\"']$") & ~after.rlike(r"[\w/=#\"']"), before.rlike(r"[\w/=#]$") | after.rlike(r"[\w/=#]"))]


def _bucket(value: Column, *limits: int) -> Column:
    out = F.lit(len(limits))
    for i, limit in reversed(list(enumerate(limits))):
        out = F.when(value <= limit, i).otherwise(out)
    return out


def _candidate(kind: str, loose: bool, m: Column) -> Column:
    """Span, votes and the indices of the features that are one."""
    def row(votes: Column) -> Column:
        values = [F.lit(2 * KINDS.index(kind) + loose), *[F.get(votes, F.lit(i)) + 1 for i in range(LABELERS)],
                  _bucket(F.length(digits(m["value"])), 0, 3, 8, 12, 16), _bucket(F.length(m["value"]), 8, 12, 16, 24, 40)]
        active, at = [], 0
        for value, size in zip(values, _SIZES):
            active.append((value + at).cast("int"))
            at += size
        return F.struct(m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), m["end"].alias("end"),
                        (F.lit(not loose) & is_base(kind, m["value"])).alias("base"), votes.alias("votes"),
                        F.array(*active).alias("active"))
    return let(F.array(*_votes(kind, loose, m)), row)


def _of_kind(text: Column, kind: str) -> Column:
    """Candidates of one kind, whatever the base pattern finds and the loose one between."""
    nothing = F.expr("CAST(array() AS array<struct<start:int,end:int,value:string,before:string,after:string>>)")
    hint, loose_hint = HINTS[kind]

    def both(found: Column) -> Column:
        more = F.when(text.rlike(loose_hint), between(text, found, PATTERNS[kind], LOOSE[kind])).otherwise(nothing)
        return F.concat(F.transform(found, lambda x: _candidate(kind, False, x)),
                        F.transform(more, lambda x: _candidate(kind, True, x)))
    return let(F.when(text.rlike(hint), matches(text, PATTERNS[kind])).otherwise(nothing), both)


def candidates(text: Column) -> Column:
    """All candidates of a text, base spans marked."""
    kinds = "start:int,kind:int,end:int,base:boolean,votes:array<int>,active:array<int>"
    return F.when(text.rlike("[0-9@]|[(\\[{]at[)\\]}]"), F.concat(*[_of_kind(text, k) for k in KINDS])).otherwise(
        F.expr(f"CAST(array() AS array<struct<{kinds}>>)"))


def reliabilities(counts: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """kind, prior, hit, miss: P(vote | personal data or not) of each labeler, by EM.

    ``counts`` has kind, votes and n, at most 3 ** LABELERS rows of a kind.
    """
    start = F.struct(F.lit(0.5).alias("prior"), *[
        F.array(*[F.array(*map(F.lit, p)) for _ in range(LABELERS)]).alias(name)
        for name, p in (("hit", (0.1, 0.3, 0.6)), ("miss", (0.6, 0.3, 0.1)))])

    def step(patterns: Column) -> Callable[[Column, Column], Column]:
        def share(q: Column, side: str, j: int, v: int) -> Column:
            return F.aggregate(q, F.lit(0.5), lambda s, x: s + F.when(F.get(x["votes"], F.lit(j)) == v, x[side]).otherwise(0.0)) / (
                F.aggregate(q, F.lit(1.5), lambda s, x: s + x[side]))

        def shares(q: Column, side: str) -> Column:
            return F.array(*[F.array(*[share(q, side, j, v) for v in (-1, 0, 1)]) for j in range(LABELERS)])

        def one(state: Column, _: Column) -> Column:
            q = F.transform(patterns, lambda p: let(posterior(state, p["votes"]), lambda y: F.struct(
                p["votes"].alias("votes"), (p["n"] * y).alias("yes"), (p["n"] * (1 - y)).alias("no"))))
            return let(q, lambda x: F.struct(
                ((F.aggregate(x, F.lit(1.0), lambda s, e: s + e["yes"]))
                 / (F.aggregate(x, F.lit(2.0), lambda s, e: s + e["yes"] + e["no"]))).alias("prior"),
                shares(x, "yes").alias("hit"), shares(x, "no").alias("miss")))
        return one

    patterns = counts.groupBy("kind").agg(F.sort_array(F.collect_list(
        F.struct("votes", F.col("n").cast("double").alias("n")))).alias("patterns"))
    return patterns.select("kind", F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step(F.col("patterns"))).alias("m")
                           ).select("kind", "m.*")


def posterior(state: Column, votes: Column) -> Column:
    """P(personal data | votes) under the state of the EM."""
    yes, no = state["prior"], 1 - state["prior"]
    for j in range(LABELERS):
        yes = yes * F.get(F.get(state["hit"], F.lit(j)), F.get(votes, F.lit(j)) + 1)
        no = no * F.get(F.get(state["miss"], F.lit(j)), F.get(votes, F.lit(j)) + 1)
    return let(F.array(yes, no), lambda x: F.get(x, F.lit(0)) / (F.get(x, F.lit(0)) + F.get(x, F.lit(1))))


def classifier(kept: DataFrame, rounds: int = ROUNDS) -> list[float] | None:
    """Intercept and weights of the span classifier; None without candidates."""
    patterns = cut_lineage(kept.select(F.explode("candidates").alias("c")).groupBy("c.kind", "c.votes", "c.active").agg(
        F.count("*").alias("n")))
    votes = patterns.groupBy("kind", "votes").agg(F.sum("n").alias("n"))
    state = F.struct("prior", "hit", "miss")
    soft = patterns.join(reliabilities(votes, rounds), "kind").select("active", "n", posterior(state, F.col("votes")).alias("p"))
    one_hot = F.transform(F.sequence(F.lit(0), F.lit(N_FEATURES - 1)), lambda i: F.array_contains("active", i).cast("double"))
    rows = soft.select(array_to_vector(one_hot).alias("features"), F.explode(F.array(
        F.struct(F.lit(1.0).alias("label"), (F.col("n") * F.col("p")).alias("weight")),
        F.struct(F.lit(0.0).alias("label"), (F.col("n") * (1 - F.col("p"))).alias("weight")))).alias("e")).select("features", "e.*")
    rows = cut_lineage(rows.filter("weight > 0"))
    if rows.isEmpty():
        return None
    model = LogisticRegression(maxIter=100, regParam=1e-3, weightCol="weight", standardization=False).fit(rows)
    return [model.intercept, *model.coefficients.toArray().tolist()]


def detect(docs: DataFrame, added: float = ADDED) -> DataFrame:
    """doc_id, base and spans: arrays of start, kind (number in ``KINDS``) and end, in order."""
    rows = text_rows(docs)
    kept = cut_lineage(rows.select("doc_id", candidates(F.col("text")).alias("candidates")))
    weights = classifier(kept)

    def good(c: Column) -> Column:
        if weights is None:
            return c["base"]
        table = F.array(*map(F.lit, weights[1:]))
        logit = F.aggregate(c["active"], F.lit(weights[0]), lambda s, i: s + F.get(table, i))
        return c["base"] | ((F.get(c["votes"], F.lit(0)) >= 0) & (1 / (1 + F.exp(-logit)) >= added))

    def spans(test: Callable[[Column], Column]) -> Column:
        return F.sort_array(F.transform(F.filter("candidates", test), lambda c: F.struct(
            c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"))))

    return kept.select("doc_id", spans(lambda c: c["base"]).alias("base"), spans(good).alias("spans"))


def as_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, mark: str = "█", **options) -> DataFrame:
    """doc_id and text, every character of a span replaced by ``mark``; one row per input row.

    The spans of a text are found for each distinct text and joined to it by its hashes.
    """
    rows = text_rows(docs)
    keys = ["h1", "h2"]
    keyed = rows.select("doc_id", "text", F.xxhash64("text").alias("h1"), F.hash("text").alias("h2"))
    distinct = keyed.groupBy(*keys).agg(F.any_value("text").alias("text"))
    numbered = cut_lineage(distinct.withColumn("doc_id", F.monotonically_increasing_id()))
    found = detect(numbered.select("doc_id", "text"), **options).select("doc_id", "spans")

    def hidden(text: Column, spans: Column) -> Column:
        starts = F.transform(spans, lambda s: s["start"])
        reach = F.transform(spans, lambda s, i: F.array_max(F.transform(F.slice(spans, F.lit(1), i + 1), lambda x: x["end"])))
        before = F.concat(F.array(F.lit(0)), reach)
        parts = F.transform(before, lambda e, i: F.concat(
            F.substring(text, e + 1, F.greatest(F.coalesce(F.get(starts, i), F.length(text)) - e, F.lit(0))),
            F.when(i < F.size(spans), F.repeat(F.lit(mark), F.greatest(
                F.get(reach, i) - F.greatest(F.get(starts, i), e), F.lit(0)))).otherwise("")))
        return F.when(F.size(spans) == 0, text).otherwise(F.array_join(parts, ""))

    clean = numbered.join(found, "doc_id").select(*keys, hidden(F.col("text"), F.col("spans")).alias("clean"))
    return keyed.join(clean, keys).select("doc_id", F.col("clean").alias("text"))
