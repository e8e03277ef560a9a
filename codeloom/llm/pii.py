"""Personal data and secrets: weak-supervision aggregation in DataFrame functions only.

Four fixed patterns (e-mail, address of a host, payment card, phone) always
count.  Beyond them there are candidates of five kinds: tokens that mix letters
and digits (secrets), bank accounts, national numbers, names of persons and
postal addresses.  For each kind labelers vote on each candidate: its form
(regex and checksums), gazetteers (names of secrets, countries, titles and given
names, words for streets) and what stands ahead of it (context).
Expectation-maximisation over the counts of vote patterns estimates the
labelers' reliabilities; the posteriors then train the final span classifier, a
naive Bayes model over the candidate's shape and context, which decides also
where every labeler abstains.

To the driver go only counts by kind, vote pattern and feature value, whose
number is bounded by the labelers and features, not by the input.

The work on a text grows with its length and the number of its hits: offsets are
running sums and overlaps running maxima over sorted spans, both in blocks.

Defined results: a null text counts as empty; a null id stays; repeated rows
give repeated rows; added spans may overlap each other, but no fixed one.
Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, stored
from .quality import fit

# Possessive forms of the contract's patterns: nothing follows the repeated groups, so what they
# match is the same, and neither a long run nor a long text makes the matcher recurse or start over.
_LOCAL = "[A-Za-z0-9._%+-]"
EMAIL = rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")

#: Cheap tests that a text must pass before the pattern is tried.
_MAY = {"email": lambda t: t.contains("@"), "ip": lambda t: t.rlike(r"[0-9]\.[0-9]++\.[0-9]"), "card": lambda t: t.rlike(r"(?:[0-9][\x20-]?){16}"), "phone": lambda t: t.rlike(r"\+[0-9]")}
_PATTERNS = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}

#: Candidates for secrets: at least 12 characters of these, among them a digit and a letter.
_TOKEN = "[A-Za-z0-9+/_=-]"
CANDIDATE = rf"(?<!{_TOKEN})(?=[A-Za-z+/_=-]*+[0-9])(?=[0-9+/_=-]*+[A-Za-z]){_TOKEN}{{12,}}+"

# Prefixes of published key formats, and names under which secrets are stored.
KEY_SHAPE = r"^(?:AKIA[0-9A-Z]{16}|ASIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk-[A-Za-z0-9-]{20,}|AIza[A-Za-z0-9_-]{30,}|[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64})$"
IBAN_COUNTRIES = "AD AE AL AT AZ BA BE BG BH BR CH CY CZ DE DK DO EE ES FI FO FR GB GE GI GL GR HR HU IE IL IS IT JO KW KZ LB LI LT LU LV MC MD ME MK MT MU NL NO PK PL PS PT QA RO RS SA SE SI SK SM TN TR UA VG XK".split()
TITLES = "Mr Mrs Ms Miss Dr Prof Herr Frau Madame Mme Monsieur Señor Señora Sr Sra".split()
GIVEN_NAMES = "Anna Carlos David Elena Elizabeth Emma Fatima Hans James Jean Jennifer John Jose Juan Julia Karl Laura Linda Lucas Luis Maria Marie Mary Michael Mohammed Olivia Patricia Peter Pierre Robert Sarah Sofia Thomas William".split()
STREETS = "Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Boulevard|Blvd|Court|Square|Way"
SECRET_NAMES = r"(?i)(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|auth|credential)"


#: Forms of the other kinds' candidates.
_CAP = r"\p{Lu}[\p{L}'-]++"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
NATIONAL = r"(?<![0-9A-Za-z.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"
NAME = rf"(?<!\p{{L}})(?:(?:{'|'.join(TITLES)})\.?|{'|'.join(GIVEN_NAMES)})\x20{_CAP}(?:\x20{_CAP})?"
ADDRESS = rf"(?<![\p{{L}}0-9])(?:[0-9]{{1,5}}\x20{_CAP}(?:\x20{_CAP})?\x20(?:{STREETS})(?!\p{{L}})|\p{{Lu}}\p{{Ll}}++(?<=stra[sß]e|strasse|weg|platz)\x20[0-9]{{1,4}}|[0-9]{{1,4}},?\x20(?:rue|avenue|boulevard)\x20(?:de\x20(?:la\x20)?|du\x20|des\x20)?{_CAP}|(?:Calle|Avenida)\x20{_CAP},?\x20[0-9]{{1,4}})"
#: kind: (pattern, cheap test of the text)
MORE = {
    "secret": (CANDIDATE, lambda t: t.rlike("[0-9]")),
    "iban": (IBAN, lambda t: t.rlike("[A-Z]{2}[0-9]{2}")),
    "national": (NATIONAL, lambda t: t.rlike("[0-9]{3}-[0-9]{2}-")),
    "name": (NAME, lambda t: t.rlike("|".join([*TITLES, *GIVEN_NAMES]))),
    "address": (ADDRESS, lambda t: t.rlike(f"[0-9] {_CAP}|{_CAP}[ ,]{{1,2}}[0-9]|[0-9],? (?:rue|avenue|boulevard) ")),
}
_NONE = "cast(array() as array<struct<kind:string,start:int,end:int,value:string,ahead:string>>)"
AHEAD = 24


#: Hits that are added up together; then these blocks' results are.
TOGETHER = 128


def running(values: Column, op: Callable[[Column, Column], Column], zero: int) -> Column:
    """The running results of an associative ``op`` over an array of int: within blocks, then over the blocks.

    (An array that grows by one copies itself each time, so only short ones do.)
    """

    def scan(xs: Column) -> Column:
        start = F.struct(F.lit(zero).alias("at"), F.expr("cast(array() as array<int>)").alias("out"))
        step = lambda acc, v: let(op(acc["at"], v), lambda x: F.struct(x.alias("at"), F.concat(acc["out"], F.array(x)).alias("out")))
        return F.aggregate(xs, start, step, lambda acc: acc["out"])

    def whole(x: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor((F.size(x) - 1) / TOGETHER).cast("int"))
        blocks = F.transform(starts, lambda b: scan(F.slice(x, b * TOGETHER + 1, TOGETHER)))
        return let(blocks, lambda bs: let(scan(F.transform(bs, lambda y: F.element_at(y, -1))), lambda ends: F.flatten(F.transform(bs, lambda y, b: F.transform(y, lambda v: op(v, F.when(b == 0, F.lit(zero)).otherwise(F.get(ends, b - 1))))))))

    return let(values, lambda x: F.when(F.size(x) == 0, x).otherwise(whole(x)))


def found(text: Column, pattern: str, kind: str, before: int = 0) -> Column:
    """Every match of ``pattern`` as (kind, start, end, value, ahead).

    Java's matcher gives no offsets to SQL, but the pieces between matches do:
    a match ends after all pieces and matches up to it.  ``ahead``: the last
    ``before`` characters in front of the match.
    """
    none = F.expr(_NONE)

    def place(both: Column) -> Column:
        sizes = F.transform(both["hits"], lambda h, i: F.length(h) + F.length(F.get(both["gaps"], i)))

        def spans(ends: Column) -> Column:
            return F.transform(
                both["hits"],
                lambda h, i: F.struct(F.lit(kind).alias("kind"), (F.get(ends, i) - F.length(h)).alias("start"), F.get(ends, i).alias("end"), h.alias("value"), F.right(F.get(both["gaps"], i), F.lit(before)).alias("ahead")),
            )

        return let(running(sizes, lambda a, b: a + b, 0), spans)

    hits = F.regexp_extract_all(text, F.lit(pattern), 0)
    return F.when(text.rlike(pattern), let(F.struct(hits.alias("hits"), F.split(text, pattern, -1).alias("gaps")), place)).otherwise(none)


def _luhn(digits: Column) -> Column:
    def step(acc: Column, k: Column) -> Column:
        d = F.substring(digits, F.length(digits) - k, F.lit(1)).cast("int") * (1 + k % 2)
        return acc + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), step) % 10 == 0


def _valid(kind: str, x: Column) -> Column:
    digits = F.regexp_replace(x["value"], "[^0-9]", "")
    if kind == "ip":
        parts = F.transform(F.split(x["value"], r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
        return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.coalesce(p.try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def _test(kind: str) -> Callable[[Column], Column]:
    return lambda x: _valid(kind, x)


def _is(kind: str) -> Callable[[Column], Column]:
    return lambda x: x["kind"] == kind


def base_spans(text: Column) -> Column:
    """The spans of the four fixed patterns, by kind as listed and start."""
    none = F.expr(_NONE)
    return F.concat(*(F.when(_MAY[k](text), F.filter(found(text, _PATTERNS[k], k), _test(k))).otherwise(none) for k in KINDS))


def candidates(text: Column) -> Column:
    """Spans that may be personal data or secrets, by kind and start, with the characters ahead of each."""
    none = F.expr(_NONE)
    return F.concat(*(F.when(may(text), found(text, pattern, kind, AHEAD)).otherwise(none) for kind, (pattern, may) in MORE.items()))


def free(base: Column, more: Column) -> Column:
    """Those of ``more`` that overlap no span of ``base``, in their order.

    Over all spans by start, the furthest end of fixed ones so far and the next
    start of one tell of an overlap.
    """
    never = 2**31 - 1
    mine = F.transform(more, lambda x, i: F.struct(x["start"].alias("start"), x["end"].alias("end"), i.alias("k")))
    fixed = F.transform(base, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(-1).alias("k")))

    def sweep(s: Column) -> Column:
        reach = running(F.transform(s, lambda x: F.when(x["k"] < 0, x["end"]).otherwise(0)), F.greatest, 0)
        ahead = F.reverse(running(F.transform(F.reverse(s), lambda x: F.when(x["k"] < 0, x["start"]).otherwise(never)), F.least, never))

        def left(both: Column) -> Column:
            clear = F.filter(s, lambda x, i: (x["k"] >= 0) & (F.get(both["reach"], i) <= x["start"]) & (F.get(both["ahead"], i) >= x["end"]))
            return F.transform(F.array_sort(F.transform(clear, lambda x: x["k"])), lambda k: F.get(more, k))

        return let(F.struct(reach.alias("reach"), ahead.alias("ahead")), left)

    return F.when((F.size(base) == 0) | (F.size(more) == 0), more).otherwise(let(F.sort_array(F.concat(mine, fixed)), sweep))


def _mod97(value: Column) -> Column:
    """Remainder of a bank account's number, its first four characters behind the others and letters as 10 to 35."""
    v = F.regexp_replace(value, " ", "")
    v = F.concat(F.substring(v, 5, 40), F.substring(v, 1, 4))

    def step(acc: Column, c: Column) -> Column:
        digit = F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
        return (acc * F.when(digit > 9, 100).otherwise(10) + digit) % 97

    return F.aggregate(F.split(v, ""), F.lit(0), step)


def _labelers(kind: str, value: Column, ahead: Column) -> tuple[Column, ...]:
    """The votes of five labelers on a candidate: form, gazetteer, context, make-up, and likeness to other things."""
    if kind == "secret":
        body = F.element_at(F.split(value, "="), -1)
        digits = F.length(F.regexp_replace(body, "[^0-9]", ""))
        size = F.greatest(F.length(body), F.lit(1))
        word = body.rlike("^[A-Za-z]*[0-9]{1,4}$|^[0-9]{1,4}[A-Za-z]*$")
        return (
            F.when(body.rlike(KEY_SHAPE), "g").when(word, "b"),
            F.when(F.concat(ahead, value).rlike(SECRET_NAMES), "g"),
            F.when(value.rlike("^[A-Za-z_-]+=") | ahead.rlike("[=:]\\s*[\"']?$"), "g").when(ahead.rlike("[/@#?]$") | value.contains("/"), "b"),
            F.when((digits / size).between(0.15, 0.85) & (size >= 16), "g").when((digits / size < 0.08) | (size < 8), "b"),
            F.when(body.rlike("^(?:[a-z]+|[A-Z]?[a-z]+)(?:[-_][A-Za-z]+)+[0-9-]*$|^[0-9]+-[0-9]+-[0-9]+"), "b"),
        )
    if kind == "iban":
        return (
            F.when(_mod97(value) == 1, "g").otherwise("b"),
            F.when(F.substring(value, 1, 2).isin(IBAN_COUNTRIES), "g").otherwise("b"),
            F.when(ahead.rlike("(?i)iban|account|konto|compte|cuenta"), "g"),
            F.when((_mod97(value) == 1) & (F.length(F.regexp_replace(value, "[^0-9]", "")) >= 10), "g").otherwise("b"),
            F.when(ahead.rlike("(?i)(?:part|serial|model|order) (?:no|number|id)?[.:# ]*$"), "b"),
        )
    if kind == "national":
        return (
            F.when(value.rlike("^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$"), "g").otherwise("b"),
            F.when(ahead.rlike("(?i)ssn|social security"), "g"),
            F.when(ahead.rlike("(?i)national|insurance|tax|taxpayer|citizen"), "g"),
            F.when(ahead.rlike("[:#]\\s*$"), "g"),
            F.when(ahead.rlike("(?i)(?:part|serial|model|order|isbn|phone|call|tel)[a-z. :#]*$"), "b"),
        )
    if kind == "name":
        return (
            F.when(value.rlike(rf"^[^ ]+ {_CAP} {_CAP}$"), "g"),
            F.when(value.rlike(rf"^(?:{'|'.join(TITLES)})\.? "), "g"),
            F.when(value.rlike(rf"(?:^|\. | )(?:{'|'.join(GIVEN_NAMES)}) "), "g"),
            F.when(ahead.rlike("(?i)(?:name is|name:|contact|dear|signed|sincerely|by|ask for|call)[\\s,:]*$"), "g"),
            F.when(value.rlike("(?<!\\p{L})(\\p{L}+)\\.? \\1(?!\\p{L})|(?i) (?:street|st|avenue|road|university|hospital|school|company|inc)$"), "b"),
        )
    return (
        F.when(value.rlike(f"^[0-9]+ .* (?:{STREETS})$|stra[sß]s?e |Calle|Avenida|rue "), "g"),
        F.when(value.rlike("(?i)street|avenue|road|lane|drive|boulevard|court|stra[sß]|weg|platz|rue|calle|avenida"), "g"),
        F.when(ahead.rlike("(?i)address|lives? at|living at|resid|ship(?:ped)? to|deliver|wohn|domicil|habit"), "g"),
        F.when(ahead.rlike("[,:\\n]\\s*$|(?i)(?: at| in)\\s*$"), "g"),
        F.when(value.rlike("^0|^(?:1[5-9]|20)[0-9]{2} .* (?:Way|Court|Square|Drive)$"), "b"),
    )


def votes(x: Column) -> Column:
    """What the labelers of its kind say of a candidate: g (it is one), b (it is not), - (abstains)."""
    said = lambda kind: F.concat(*(F.coalesce(v, F.lit("-")) for v in _labelers(kind, x["value"], x["ahead"])))
    out = F.lit("-----")
    for kind in MORE:
        out = F.when(x["kind"] == kind, said(kind)).otherwise(out)
    return out


def features(x: Column) -> Column:
    """The span classifier's features, each with few values."""
    value = x["value"]
    share = lambda p: F.floor(4 * F.length(F.regexp_replace(value, p, "")) / F.length(value)).cast("string")
    return F.array(
        F.concat(F.lit("length:"), F.least(F.length(value) / 8, F.lit(8)).cast("int").cast("string")),
        F.concat(F.lit("digits:"), share("[^0-9]")),
        F.concat(F.lit("upper:"), share("[^A-Z]")),
        F.concat(F.lit("marks:"), share("[A-Za-z0-9]")),
        F.concat(F.lit("ahead:"), F.when(x["ahead"] == "", "none").when(x["ahead"].rlike("[=:]\\s*[\"']?$"), "assign").when(x["ahead"].rlike("[\"']$"), "quote").when(x["ahead"].rlike("\\s$"), "space").otherwise("other")),
        F.concat(F.lit("equals:"), value.contains("=").cast("string")),
    )


def _with_spans(text: Column) -> Column:
    """(base, more) of a text, each of ``more`` with its votes and features."""

    def judged(both: Column) -> Column:
        more = F.transform(free(both["base"], both["more"]), lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), votes(x).alias("votes"), features(x).alias("features")))
        base = F.transform(both["base"], lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
        return F.struct(base.alias("base"), more.alias("more"))

    return let(text, lambda t: let(F.struct(base_spans(t).alias("base"), candidates(t).alias("more")), judged))


def train(spans: DataFrame, rounds: int = 30) -> dict[str, dict]:
    """By kind, reliabilities by expectation-maximisation, then the span classifier.

    ``spans``: one row per candidate with ``kind``, ``votes`` and ``features``.
    """
    seen: dict[str, list] = {}
    for r in spans.select("kind", "votes", F.explode("features").alias("feature")).groupBy("kind", "votes", "feature").count().collect():
        seen.setdefault(r["kind"], []).append(r)
    return {kind: _train(rows, rounds) for kind, rows in seen.items()}


def _train(seen: list, rounds: int) -> dict:
    counts: dict[str, int] = {}
    for r in seen:
        if r["feature"].startswith("length:"):
            counts[r["votes"]] = counts.get(r["votes"], 0) + r["count"]
    model = fit(counts, rounds, start=(0.5, 0.8, 0.3))
    weight = {v: _posterior(model, v) for v in counts}
    yes: dict[str, float] = {}
    no: dict[str, float] = {}
    for r in seen:
        yes[r["feature"]] = yes.get(r["feature"], 0.5) + r["count"] * weight[r["votes"]]
        no[r["feature"]] = no.get(r["feature"], 0.5) + r["count"] * (1 - weight[r["votes"]])
    n_yes = sum(n * weight[v] for v, n in counts.items()) + 2
    n_no = sum(n * (1 - weight[v]) for v, n in counts.items()) + 2
    log_odds = {f: math.log(yes[f] / n_yes) - math.log(no[f] / n_no) for f in yes}
    return {"labelers": model, "prior": math.log(n_yes / n_no), "features": log_odds}


def _posterior(model: dict, v: str) -> float:
    odds = math.log(model["share"] / (1 - model["share"]))
    for j, c in enumerate(v):
        g, b = model["good"][j], model["bad"][j]
        odds += 0 if c == "-" else math.log(g / b) if c == "g" else math.log((1 - g) / (1 - b))
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))


def _adding(weights: Column) -> Callable[[Column, Column], Column]:
    return lambda total, f: total + F.coalesce(F.try_element_at(weights, f), F.lit(0.0))


def _accept(models: dict[str, dict], x: Column, threshold: float) -> Column:
    """The verdict of its kind's classifier on a candidate: its features and its labelers' votes, half each."""
    out = F.lit(False)
    for kind, model in models.items():
        odds = F.aggregate(x["features"], F.lit(model["prior"]), _adding(F.create_map(*(F.lit(v) for pair in model["features"].items() for v in pair))))
        said = F.lit(0.0)
        for j, (g, b) in enumerate(zip(model["labelers"]["good"], model["labelers"]["bad"], strict=True)):
            v = F.substring(x["votes"], j + 1, 1)
            said = said + F.when(v == "g", F.lit(math.log(g / b))).when(v == "b", F.lit(math.log((1 - g) / (1 - b)))).otherwise(F.lit(0.0))
        out = F.when(x["kind"] == kind, 1 / (1 + F.exp(-(odds + said) / 2)) >= threshold).otherwise(out)
    return out


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def _accepted(rows: DataFrame, threshold: float) -> DataFrame:
    """``rows``, which have ``spans`` stored, with the accepted ones of ``more``."""
    models = train(rows.select(F.explode("spans.more").alias("x")).select("x.kind", "x.votes", "x.features"))
    more = F.transform(F.filter("spans.more", lambda x: _accept(models, x, threshold)), lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    return rows.withColumn("spans", F.struct(F.col("spans.base").alias("base"), more.alias("more")))


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row per input row: id, counts, digests and all spans of its text."""
    got = stored(df.select(F.col(id_col).alias("doc_id"), _with_spans(F.coalesce(F.col(text_col), F.lit(""))).alias("spans")), "pii")
    got = _accepted(got, threshold).select("doc_id", "spans.base", "spans.more")
    count = lambda c, k: F.size(F.filter(c, _is(k))).cast("long").alias(f"n_{k}")
    digest = F.sha2(_written(F.col("base")).cast("binary"), 256)
    return got.select("doc_id", *(count("base", k) for k in KINDS), digest.alias("base_sha256"), _written(F.concat("base", "more")).alias("spans"), *(count("more", k) for k in MORE), F.concat("base", "more").alias("found"))


BLOCK = 1024


def _replaced(text: Column, spans: Column) -> Column:
    """``text`` with each span replaced by its kind; overlapping ones together, under the kind of the first."""

    def piece(blocks: Column, a: Column, b: Column) -> Column:
        # SQL's substring walks from the text's beginning, so the text is cut into blocks once
        i, j = F.floor(a / BLOCK).cast("int"), F.floor(b / BLOCK).cast("int")
        across = F.concat(F.substring(F.get(blocks, i), a % BLOCK + 1, F.lit(BLOCK)), F.array_join(F.slice(blocks, i + 2, j - i - 1), ""), F.coalesce(F.substring(F.get(blocks, j), F.lit(1), b % BLOCK), F.lit("")))
        return F.when(a >= b, "").when(i == j, F.substring(F.get(blocks, i), a % BLOCK + 1, b - a)).otherwise(across)

    def cut(c: Column) -> Column:
        s, reach, blocks = c["spans"], c["reach"], c["blocks"]
        past = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(reach, i - 1))
        heads = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: past(i) <= F.get(s, i)["start"])
        parts = F.transform(heads, lambda i: F.concat(piece(blocks, past(i), F.get(s, i)["start"]), F.lit("<"), F.upper(F.get(s, i)["kind"]), F.lit(">")))
        return F.concat(F.array_join(parts, ""), piece(blocks, F.element_at(reach, -1), c["size"]))

    ordered = F.sort_array(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    whole = lambda s: let(F.struct(s.alias("spans"), running(F.transform(s, lambda x: x["end"]), F.greatest, 0).alias("reach"), F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), 0).alias("blocks"), F.length(text).alias("size")), cut)
    return F.when(F.size(spans) == 0, text).otherwise(let(ordered, whole))


def redact(df: DataFrame, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``df`` with each span in its text replaced by its kind, as in ``<EMAIL>``; a null text stays null.

    The rows are stored once with their candidates, so that texts are searched once.
    """
    columns = df.columns
    rows = stored(df.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"), _with_spans(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("spans")), "pii-rows")
    rows = _accepted(rows, threshold)
    text = F.col("row").getField(text_col)
    spans = F.concat("spans.base", "spans.more")
    new = F.when(text.isNull(), text).otherwise(let(spans, lambda x: _replaced(text, x)))
    return rows.select(*((new if c == text_col else F.col("row").getField(c)).alias(c) for c in columns))
