"""Personal data by weak supervision, in DataFrame functions only.

Candidates come from one pattern for each kind.  Three labelers vote on each
(for, against, or nothing): the *form* (checksum, ranges, number of digits), a
*gazetteer* (known endings, prefixes, names) and the *context* (words beside
it).  Expectation-maximisation over the counts of vote patterns estimates how
reliable each labeler is; the counts are a few hundred rows whatever the input.
Its posteriors weigh the features of all candidates for a final naive-Bayes
span classifier, whose weights are again a bounded table.  Spans that pass the
base rules always stay; the classifier decides on the others.

Places of matches: `split` gives the gaps and `regexp_extract_all` the matches,
and their lengths add up to code-point offsets.  Quantifiers are possessive and
starts are anchored by look-behind where that leaves the matches unchanged, so
long runs neither recurse nor rescan.

Edge cases: a null or empty text has no spans and the hash of the empty string;
repeated rows are kept; an empty table gives an empty result; where spans of two
kinds tie in their start, the order of KINDS decides; a column of the input comes
back only if it is asked for, and one called base, spans or cands only by another
name.  Work is in proportion to a text's bytes and matches, however many these are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import running_sums, written

_LOCAL = r"[A-Za-z0-9._%+-]"

_CAPITAL, _SMALL, _LETTER = r"[A-ZÀ-ÖØ-Þ]", r"[a-zß-öø-ÿ]", r"[A-Za-zÀ-ÖØ-öø-ÿ]"
_TITLE = r"(?:Mrs|Mr|Ms|Miss|Dr|Prof|Sir|Herr|Frau|Mme|Mlle|Monsieur|Madame|Sra|Srta|Sr|Don|Doña|Señora|Señor)\.?"

#: (kind, pattern, cheap test, in the base) in the order that spans are listed.
KINDS = (
    ("email", rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda t: F.contains(t, F.lit("@")), True),
    ("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", lambda t: F.contains(t, F.lit(".")) & t.rlike(r"[0-9]\.[0-9]"), True),
    ("card", r"(?<![0-9][\x20-])(?<![0-9])[0-9](?:[\x20-]?[0-9]){13,}+", lambda t: t.rlike(r"[0-9][\x20-]?[0-9]"), True),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda t: F.contains(t, F.lit("+")), True),
    ("local_phone", r"(?<![0-9+().-])(?<!\+[0-9]{1,3}[\x20.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9.-])", lambda t: t.rlike(r"[0-9]{3}[.-][0-9]{4}"), False),
    ("national_id", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", lambda t: t.rlike(r"-[0-9]{2}-"), False),
    ("name", rf"(?<!{_LETTER}){_TITLE}\x20{_CAPITAL}{_SMALL}++(?:[\x20-]{_CAPITAL}{_SMALL}++)?", lambda t: t.rlike(rf"{_TITLE}\x20{_CAPITAL}"), False),
    ("secret", r"(?i)(?<![A-Za-z0-9])(?:api[_-]?key|access[_-]?key|private[_-]?key|secret|token|passw(?:or)?d)[\"']?\x20?[=:]\x20?[\"']?[A-Za-z0-9+/_=.-]{12,}+", lambda t: t.rlike(r"(?i)(?:key|secret|token|passw[a-z]*)[\"']?\x20?[=:]"), False),
)
_BASE = [k for k, *_, base in KINDS if base]

#: Given and family names that are common where the four languages are spoken.
NAMES = (
    "Adam Andrew Anna Anthony Barbara Brian Charles Daniel David Edward Elizabeth Emily Emma George Helen Henry James Jane Jennifer John Joseph Karen Laura Linda Lisa Mark Mary Michael Nancy Patricia Paul "
    "Peter Richard Robert Ruth Sarah Susan Thomas William Adams Baker Brown Clark Davis Green Hill Johnson Jones Miller Moore Smith Taylor Walker White Williams Wilson Wright "
    "Andreas Angelika Bernd Birgit Christian Dieter Erika Frank Gabriele Hans Heike Jürgen Karl Katrin Klaus Markus Monika Petra Sabine Stefan Thorsten Ursula Uwe Wolfgang Bauer Becker Fischer Hoffmann Klein "
    "Koch Meyer Müller Richter Schmidt Schneider Schröder Schulz Wagner Weber Wolf Antoine Brigitte Camille Catherine Céline Claire François Françoise Guillaume Hélène Isabelle Jacques Jean Julien Louis Marie "
    "Nathalie Nicolas Philippe Pierre Sophie Sylvie Bernard Dubois Durand Fournier Laurent Lefebvre Leroy Martin Michel Moreau Petit Roux Simon Alejandro Ana Antonio Carlos Carmen Elena Francisco Isabel Javier "
    "José Juan Lucía Luis Manuel María Miguel Pablo Pedro Rosa Álvarez Díaz Fernández García Gómez González Hernández López Martínez Pérez Rodríguez Sánchez Torres"
).split()

#: Gazetteers: what follows or opens an entity of a kind.
GAZETTEER = {
    "email": r"\.(?:com|org|net|edu|gov|info|io|de|fr|es|it|uk|eu|us|ch|at|nl|pl|jp|cn|br)$", "ip": r"^(?:[1-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])\.", "card": r"^[2-6]",
    "phone": r"^\+(?:1|7|2[0-9]|3[0-9]|4[0-9]|5[0-9]|6[0-9]|8[1-6]|9[0-8])",
    "local_phone": r"^\(?(?:201|202|206|212|213|214|215|303|305|310|312|313|404|408|412|415|503|512|602|612|617|619|702|713|718|800|818|877|888|916|917)",
    "national_id": r"^(?:00[1-9]|0[1-9][0-9]|[1-6][0-9]{2}|7[0-6][0-9]|77[0-2])", "name": r"[\x20-](?:" + "|".join(NAMES) + rf")(?!{_LETTER})",
    "secret": r"[=:]\x20?[\"']?(?:sk-|sk_|pk_|gh[pousr]_|xox[abp]-|AKIA|eyJ|[0-9a-fA-F]{32,}$)",
}
CUES = {
    "email": "mail|contact|write|kontakt|correo|courriel", "ip": r"\bip\b|host|server|address|adresse", "card": "card|visa|credit|karte|carte|tarjeta|payment",
    "phone": "tel|phone|call|mobil|fax|anruf|llam", "local_phone": "tel|phone|call|mobil|fax|anruf|llam", "national_id": "ssn|social|security|insurance", "name": "name|nom|by|from|dear|signed|geehrte|cher|estimad",
    "secret": "config|env|export|auth|login|bearer|credential",
}
#: Words that follow a title without being a name.
_NO_NAME = r"\x20(?:President|Chairman|Speaker|Minister|Secretary|Director|Right|Wrong|Who|No|Präsident|Bundeskanzler|Doktor|Direktor|Président|Ministre|Directeur|Presidente|Ministro)$"
AGAINST = r"version|build|isbn|order\s|token|serial|sku|[=\"/]\s*$"
_VOTES = (-1, 0, 1)


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def step(total, i):
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 0, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), step) % 10 == 0


def _form(kind: str, m: Column) -> Column:
    """The kind's own validity test of a matched text."""
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.coalesce(F.regexp_replace(F.right(p, F.lit(3)), "^$", "0").cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    if kind == "local_phone":  # neither part of a North American number begins with 0 or 1, nor is either a service code
        return digits.rlike("^[2-9](?!11)[0-9]{2}[2-9](?!11)[0-9]{2}")
    if kind == "national_id":
        return ~digits.rlike("^(?:000|666|9)|^[0-9]{3}00|0000$")
    if kind == "name":
        return ~m.rlike(_NO_NAME)
    if kind == "email":
        return F.lit(True)
    value = F.regexp_extract(m, r"[=:]\x20?[\"']?(.*)$", 1)  # a secret is no plain word or number
    return value.rlike("[0-9]") & value.rlike("[A-Za-z]")


def _case(kind: Column, of: dict[str, Column]) -> Column:
    out = None
    for k, v in of.items():
        out = F.when(kind == k, v) if out is None else out.when(kind == k, v)
    return out


def _describe(i: int, kind: str, base: bool):
    """Votes and features of a placed match."""

    def describe(placed):
        x, end = placed["x"], placed["end"].cast("int")
        ok = F.coalesce(_form(kind, x["m"]), F.lit(False))
        near = F.lower(F.concat_ws(" ", x["pre"], x["post"]))
        return F.struct(
            (end - F.length(x["m"])).alias("start"), F.lit(i).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"),
            (ok & F.lit(base)).alias("base"), F.when(ok, 1).otherwise(-1).alias("form"),
            F.when(x["m"].rlike(GAZETTEER[kind]), 1).otherwise(F.lit(-1 if kind == "name" else 0)).alias("gazetteer"),
            F.when(F.lower(x["pre"]).rlike(AGAINST), -1).when(near.rlike(CUES[kind]), 1).otherwise(0).alias("context"),
            F.least(F.floor(F.length(x["m"]) / 4), F.lit(7)).cast("int").alias("size"),
            F.when(x["pre"].rlike(r"[\s(\[{<\"':;,]$") | (x["pre"] == ""), 1).otherwise(0).alias("opens"),
            F.when(x["post"].rlike(r"^[\s)\]}>\"':;,.!?]") | (x["post"] == ""), 1).otherwise(0).alias("closes"),
        )

    return describe


def _lengths(gaps: Column):
    return lambda x, j: F.length(F.get(gaps, j)) + F.length(x)


def _beside(gaps: Column):
    return lambda x, j: F.struct(x.alias("m"), F.right(F.get(gaps, j), F.lit(24)).alias("pre"), F.left(F.get(gaps, j + 1), F.lit(12)).alias("post"))


def candidates(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """`keep` columns and cands: array of (start, rank, end, kind, base, and the votes and features)."""
    t = F.col("__text")
    df = docs.select(*[docs[c] for c in keep], F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__text"))
    none = F.array().cast("array<string>")
    df = df.select(*keep, *[F.when(test(t), F.split(t, regex, -1)).otherwise(none).alias(f"__g{i}") for i, (_, regex, test, _) in enumerate(KINDS)], *[F.when(test(t), F.regexp_extract_all(t, F.lit(regex), F.lit(0))).otherwise(none).alias(f"__m{i}") for i, (_, regex, test, _) in enumerate(KINDS)])
    arrays = []
    for i, (kind, _, _, base) in enumerate(KINDS):
        g, m = F.col(f"__g{i}"), F.col(f"__m{i}")
        # A match starts where the gaps up to it and the matches before it end.
        ends = running_sums(F.transform(m, _lengths(g)))
        arrays.append(F.transform(F.arrays_zip(F.transform(m, _beside(g)).alias("x"), ends.alias("end")), _describe(i, kind, base)))
    return df.select(*keep, F.array_sort(F.concat(*arrays)).alias("cands"))


def reliabilities(patterns: list[tuple], rounds: int = 30) -> tuple[dict, dict]:
    """Dawid-Skene over (kind, form, gazetteer, context, count): posterior of each pattern, and vote rates by labeler and truth."""
    rate = {(j, truth): {v: (0.7 if v == (1 if truth else -1) else 0.15) for v in _VOTES} for j in range(3) for truth in (0, 1)}
    prior = {k: 0.7 for k, *_ in patterns}
    post: dict = {}
    for _ in range(rounds):
        for k, *votes, _n in patterns:
            yes, no = prior[k], 1 - prior[k]
            for j, v in enumerate(votes):
                yes, no = yes * rate[j, 1][v], no * rate[j, 0][v]
            post[k, *votes] = yes / (yes + no)
        for k in prior:
            own = [(n, post[kk, *votes]) for kk, *votes, n in patterns if kk == k]
            prior[k] = (sum(n * p for n, p in own) + 7) / (sum(n for n, _ in own) + 10)
        for (j, truth), r in rate.items():
            w = {v: 1 + 10 * (v == (1 if truth else -1)) for v in _VOTES}  # a labeler is held to be better than chance
            for k, *votes, n in patterns:
                w[votes[j]] += n * (post[k, *votes] if truth else 1 - post[k, *votes])
            total = sum(w.values())
            for v in _VOTES:
                r[v] = w[v] / total
    return post, rate


_FEATURES = ("form", "gazetteer", "context", "size", "opens", "closes")


def _literal_map(values: dict[str, float]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv]) if values else F.create_map().cast("map<string,double>")


def find_pii(docs: DataFrame, keep: list[str], text: str = "text", threshold: float = 0.5) -> DataFrame:
    """`keep` columns, base (array of spans by the base rules) and spans (all); a span is (start, rank, end, kind)."""
    found = written(candidates(docs, keep, text), "pii-candidates")
    rows = found.select(F.explode("cands").alias("c")).select("c.*")
    # Bounded by kinds x votes, whatever the input.
    patterns = [tuple(r) for r in rows.groupBy("kind", "form", "gazetteer", "context").count().sort("kind", "form", "gazetteer", "context").collect()]
    post, _ = reliabilities(patterns)
    key = F.concat_ws("|", "kind", "form", "gazetteer", "context")
    believed = _literal_map({"|".join(map(str, k)): float(p) for k, p in post.items()})
    soft = rows.select("kind", F.element_at(believed, key).alias("p"), F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).alias("v")) for f in _FEATURES])).alias("x"))
    sums = soft.groupBy("kind", "x.f", "x.v").agg(F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no")).collect()
    total = {k: [sum(r.yes for r in sums if r.kind == k and r.f == "form") + 1, sum(r.no for r in sums if r.kind == k and r.f == "form") + 1] for k in {r.kind for r in sums}}
    weights = {k: math.log(y / n) for k, (y, n) in total.items()}
    weights |= {f"{r.kind}|{r.f}|{r.v}": math.log((r.yes + 0.5) / (total[r.kind][0] + 0.5)) - math.log((r.no + 0.5) / (total[r.kind][1] + 0.5)) for r in sums}
    w = _literal_map(weights)
    of = lambda k: F.coalesce(F.try_element_at(F.col("__w"), k), F.lit(0.0))
    score = lambda c: sum((of(F.concat_ws("|", c["kind"], F.lit(f), c[f].cast("string"))) for f in _FEATURES), of(c["kind"]))
    span = lambda c: F.struct(c["start"].alias("start"), c["rank"].alias("rank"), c["end"].alias("end"), c["kind"].alias("kind"))
    cut = math.log(threshold / (1 - threshold))
    free = F.filter("cands", lambda c: c["base"] | ((c["form"] > 0) & (score(c) > cut)))
    return found.select(*keep, "cands", w.alias("__w")).select(*keep, F.transform(F.filter("cands", lambda c: c["base"]), span).alias("base"), F.transform(free, span).alias("spans"))


def span_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def span_counts(spans: Column) -> list[Column]:
    return [F.array_size(F.filter(spans, _is(k))).cast("long").alias(f"n_{k}") for k in _BASE]


def _is(kind: str):
    return lambda s: s["kind"] == kind
