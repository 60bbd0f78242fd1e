"""Personal data by weak supervision. DataFrame and SQL functions (and MLlib for the last fit) only.

Candidates are the matches of a base pattern per kind and of a wider pattern per kind (addresses written with "at" and
"dot", with a local part of at most 64 characters as mail allows; dotted numbers, long digit runs, telephone numbers without
a plus). Three labelers vote yes (1), no (-1) or nothing (0) on each candidate: a strict regular expression, gazetteers
(registered endings, issuer ranges, networks nobody is reached in, calling codes) and the words before it: up to `CONTEXT`
characters, not further back than the match before it. Expectation-maximisation estimates, per kind, how often each labeler
votes how on true and on false spans; its input is the count of every vote pattern (at most 27 per kind), summed by Spark. The
posteriors are the soft labels of a logistic regression on votes and shape, and a wider candidate that the regression scores
at `threshold` or more becomes a span. Base spans stay whatever the model says. Of candidates that overlap, base spans win,
then the earlier one of a kind.

Texts are passed over once: what is written for each are the matches and the lengths of the gaps between them. Matches then
are rows. Their places are running sums over a text's rows, and a wider candidate is free if the base span that reaches
furthest before it ends in time and the next one begins late enough, two running extremes. All of it is linear in the
number of matches (but for sorting), so a text with a million numbers is no special case. The driver sees counts of vote
patterns and coefficients.

Positions are code points, from 0, end exclusive. The patterns are possessive and anchored at the start of a run, so a
text that is one long run of digits or letters takes linear time and no recursion; they find the same spans as the plain forms.

Defined cases: NULL counts as empty text and has no spans; repeated rows get a row each; without any candidate no model is
fitted; an empty table gives an empty result. Other columns may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.core.scale import written

KINDS = ("email", "ip", "card", "phone")

_LOCAL = "A-Za-z0-9._%+-"
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: Equal to the plain forms; \G lets a match begin where the one before it ended.
BASE = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_AT, _DOT = r"(?: ?[\[(](?:at|@)[\])] ?| @ ?|@ )", r"(?: ?[\[(](?:dot|\.)[\])] ?| dot )"
_HOST, _TOP = "[a-z0-9-]{2,63}+", r"[a-z]{2,12}\b"
WIDE = {
    "email": rf"(?i)(?<![{_LOCAL}])[{_LOCAL}]{{1,64}}+(?:{_AT}{_HOST}(?:\.{_TOP})++|(?:{_AT}|@| at ){_HOST}(?:{_DOT}{_TOP})++)",
    "ip": r"(?<![0-9.])[0-9]{1,3}+(?:\.[0-9]{1,3}+){3}+(?![0-9.])",
    "card": r"(?<![0-9])[0-9]{4}[\x20./-]?[0-9]{4,6}[\x20./-]?[0-9]{4,5}(?:[\x20./-]?[0-9]{1,4})?(?![0-9])",
    "phone": r"(?<![0-9+])(?:00[0-9]{1,3}[\x20.-])?\(?[0-9]{2,5}\)?[\x20./-][0-9]{3,4}[\x20.-][0-9]{3,5}(?![0-9])",
}
#: A text without this has no match of either pattern of the kind.
NEEDS = {"email": "(?i)@|\\bat\\b", "ip": "[0-9]\\.[0-9]", "card": "[0-9]", "phone": "[0-9]"}

STRICT = {
    "email": rf"^[{_LOCAL}]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+$",
    "ip": rf"^{_OCTET}(?:\.{_OCTET}){{3}}$",
    "phone": r"^(?:\+|00)[0-9][\x20().0-9-]+[0-9]$",
}
# Fixed values of the gazetteers: endings of host names, ranges of the first four digits of cards by issuer, networks that
# no public host is in (first and last address, as numbers of the first three parts), and calling codes.
ENDINGS = """com org net edu gov mil int info biz name pro io ai app dev co me tv cc xyz online site shop blog cloud tech store
ac ad ae ar at au az ba be bg bo br by ca ch ci cl cm cn cr cu cy cz de dk do dz ec ee eg es eu fi fr ge gh gr gt hk hr hu id ie il
in iq ir is it jo jp ke kr kw kz lb li lk lt lu lv ly ma md mk mt mx my ng nl no np nz om pa pe ph pk pl pt py qa ro rs ru sa se sg
si sk sn su sv th tn tr tw ua ug uk us uy uz ve vn za zw example""".split()
ISSUERS = ((4000, 4999), (5100, 5599), (2221, 2720), (3400, 3499), (3700, 3799), (6011, 6011), (6440, 6599), (6200, 6299),
           (3528, 3589), (3000, 3059), (3600, 3699), (3800, 3999), (5000, 5099), (5600, 5899), (6304, 6304), (6759, 6763))
RESERVED = ((0, 0, 0, 0, 255, 255), (127, 0, 0, 127, 255, 255), (169, 254, 0, 169, 254, 255), (192, 0, 2, 192, 0, 2),
            (198, 51, 100, 198, 51, 100), (203, 0, 113, 203, 0, 113), (224, 0, 0, 255, 255, 255))
CALLING = r"^(?:\+|00)(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|21[1-8]|2[2-6][0-9]|29[0-9]|35[0-9]|37[0-9]|38[0-9]|42[0-3]|50[0-9]|59[0-9]|67[0-9]|68[0-9]|69[0-2]|85[0-6]|88[06]|96[0-8]|97[0-7]|99[2-8])"
NATIONAL = r"^\(?(?:0[1-9]|[2-9][0-9]{2}\)?[\x20./-])"
CUES = {
    "email": r"(?i)(?:e-?mail|mail|contact|write|kontakt|courriel|correo)\W*\w{0,8}\W*$",
    "ip": r"(?i)(?:\bip\b|address|adresse|host|server|login|from)\W*\w{0,8}\W*$",
    "card": r"(?i)(?:card|visa|mastercard|amex|credit|karte|carte|tarjeta|account)\W*\w{0,8}\W*$",
    "phone": r"(?i)(?:phone|tel|telefon|mobile|fax|call|cell|t[ée]l[ée]phone|tel[ée]fono)\W*\w{0,8}\W*$",
}
AGAINST = {
    "email": r"(?i)(?:look|arrive|stay|meet)\W*$",
    "ip": r"(?i)(?:version|release|section|chapter|v)\W*$",
    "card": r"(?i)(?:isbn|order|invoice|serial|ticket|part|item|id|no)\W*$",
    "phone": r"(?i)(?:isbn|order|invoice|version|pages|part|item|years?)\W*$",
}
CONTEXT = 40
LABELERS = ("strict", "gazetteer", "context")


def _pieces(text: Column, pattern: str, needs: str) -> Column:
    """All matches in order with the length of the gap before each and its last characters. One more piece, without a match,
    is what comes after the last."""
    steps = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit")
    )
    pieces = F.transform(
        steps, lambda x: F.struct(F.length(x["gap"]).alias("skipped"), x["hit"].alias("hit"), F.right(x["gap"], F.lit(CONTEXT)).alias("before"))
    )
    empty = F.array().cast("array<struct<skipped:int,hit:string,before:string>>")
    return F.when(F.rlike(text, F.lit(needs)), pieces).otherwise(empty)


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(x: Column) -> Column:
    return F.call_function("luhn_check", _digits(x))


def _holds(kind: str, hit: Column) -> Column:
    """Whether a base match passes the check of its kind."""
    if kind == "ip":
        return F.rlike(hit, F.lit(STRICT["ip"]))
    if kind == "card":
        return F.length(_digits(hit)).between(16, 19) & _luhn(hit)
    if kind == "phone":
        return F.length(_digits(hit)).between(8, 15)
    return F.lit(True)


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, F.lit(1)).when(no, F.lit(-1)).otherwise(F.lit(0))


def _in_gazetteer(kind: str, hit: Column) -> Column:
    """Vote of the gazetteer of a kind."""
    if kind == "email":
        return _vote(F.lower(F.regexp_extract(hit, "([A-Za-z]+)$", 1)).isin(ENDINGS), F.lit(False))
    if kind == "card":
        first = F.substring(_digits(hit), 1, 4).cast("int")
        return _vote(_any(first.between(a, b) for a, b in ISSUERS), F.lit(True))
    if kind == "ip":
        a, b, c = (F.split_part(hit, F.lit("."), F.lit(i)).try_cast("int") for i in (1, 2, 3))
        network = a * 65536 + b * 256 + c
        nobody = _any(network.between(x[0] * 65536 + x[1] * 256 + x[2], x[3] * 65536 + x[4] * 256 + x[5]) for x in RESERVED)
        return _vote(F.coalesce(network.isNotNull() & ~nobody & (a <= 255), F.lit(False)), F.coalesce(nobody, F.lit(False)))
    return _vote(F.rlike(hit, F.lit(CALLING)) | F.rlike(hit, F.lit(NATIONAL)), F.lit(False))


def _any(tests: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def _by_kind(value: Callable[[str], Column]) -> Column:
    out = F.when(F.col("kind") == KINDS[0], value(KINDS[0]))
    for k in KINDS[1:]:
        out = out.when(F.col("kind") == k, value(k))
    return out


def _matches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row per document with the pieces of all patterns; written once, without the texts. `row` tells documents with one id
    apart."""
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    text = F.col("text")
    found = [_pieces(text, p[k], NEEDS[k]).alias(f"{k}_{n}") for n, p in (("base", BASE), ("wide", WIDE)) for k in KINDS]
    return written(rows.select("row", "doc_id", *found), "matches")


def candidates(matches: DataFrame) -> DataFrame:
    """One row per base span and wider candidate with its place, votes and shape; written once, without the words."""

    def labelled(kind: str, base: bool) -> Column:
        return F.transform(
            f"{kind}_{'base' if base else 'wide'}",
            lambda x, i: F.struct(F.lit(kind).alias("kind"), F.lit(base).alias("base"), i.alias("i"), x["skipped"].alias("skipped"), x["hit"].alias("hit"), x["before"].alias("before")),
        )

    rows = matches.select("row", F.inline(F.concat(*[labelled(k, base) for base in (True, False) for k in KINDS])))
    # all rows of a text in one place: every window below finds them there
    rows = rows.filter("hit IS NOT NULL").repartition("row")
    so_far = Window.partitionBy("row", "kind", "base").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum(F.col("skipped") + F.length("hit")).over(so_far).cast("int"))
    rows = rows.withColumn("start", F.col("end") - F.length("hit"))
    hit = F.col("hit")
    rows = rows.filter(~F.col("base") | _by_kind(lambda k: _holds(k, hit)))

    text = Window.partitionBy("row")
    earlier = text.orderBy("start").rangeBetween(Window.unboundedPreceding, 0)
    later = text.orderBy(F.desc("start")).rangeBetween(Window.unboundedPreceding, 0)
    reach = F.max(F.when(F.col("base"), F.col("end"))).over(earlier)
    following = F.min(F.when(F.col("base"), F.col("start"))).over(later)
    rows = rows.withColumns({"reach": reach, "following": following})
    taken = F.coalesce(F.col("reach") > F.col("start"), F.lit(False)) | F.coalesce(F.col("following") < F.col("end"), F.lit(False))
    rows = rows.filter(F.col("base") | ~taken)

    def strict(kind: str) -> Column:
        if kind == "card":
            return _vote(F.length(_digits(hit)).between(13, 19) & _luhn(hit), F.lit(True))
        return _vote(F.rlike(hit, F.lit(STRICT[kind])), F.lit(kind == "ip"))

    before = F.col("before")
    return written(
        rows.select(
            "row", "kind", "base", "start", "end",
            _by_kind(strict).alias("strict"),
            _by_kind(lambda k: _in_gazetteer(k, hit)).alias("gazetteer"),
            _by_kind(lambda k: _vote(F.rlike(before, F.lit(CUES[k])), F.rlike(before, F.lit(AGAINST[k])))).alias("context"),
            F.least(F.length(_digits(hit)), F.lit(20)).alias("digits"),
            F.least(F.floor(F.length(hit) / 4), F.lit(10)).cast("int").alias("length"),
        ),
        "candidates",
    )


def fit_labelers(patterns: list[tuple[tuple[int, ...], float]], rounds: int = 50) -> dict[tuple[int, ...], float]:
    """Expectation-maximisation over counts of vote patterns; returns P(true | votes) for every pattern seen. Labelers
    are taken as independent given the truth; each outcome has one imagined vote, and they start as mostly right."""
    votes = (-1, 0, 1)
    n = len(patterns[0][0])
    rate = {t: [{v: (0.6 if v == (1 if t else -1) else 0.2) for v in votes} for _ in range(n)] for t in (True, False)}
    prior = 0.5
    posterior: dict[tuple[int, ...], float] = {}
    for _ in range(rounds):
        for p, _count in patterns:
            yes = math.log(prior) + sum(math.log(rate[True][j][v]) for j, v in enumerate(p))
            no = math.log(1 - prior) + sum(math.log(rate[False][j][v]) for j, v in enumerate(p))
            posterior[p] = 1 / (1 + math.exp(min(700.0, no - yes)))
        weight = {True: [(p, c * posterior[p]) for p, c in patterns], False: [(p, c * (1 - posterior[p])) for p, c in patterns]}
        total = sum(c for _, c in patterns)
        prior = (sum(w for _, w in weight[True]) + 1) / (total + 2)
        for t in (True, False):
            for j in range(n):
                # the imagined votes lean the way the labelers are meant, so that true and false cannot change places
                seen = {v: 3.0 if v == (1 if t else -1) else 1.0 for v in votes}
                for p, w in weight[t]:
                    seen[p[j]] += w
                whole = sum(seen.values())
                rate[t][j] = {v: s / whole for v, s in seen.items()}
    return posterior


FEATURES = [f"{x}_{v}" for x in LABELERS for v in ("yes", "no")] + [f"is_{k}" for k in KINDS] + ["n_digits", "n_length"]


def _features() -> dict[str, Column]:
    out = {f"{x}_yes": (F.col(x) == 1).cast("double") for x in LABELERS}
    out |= {f"{x}_no": (F.col(x) == -1).cast("double") for x in LABELERS}
    out |= {f"is_{k}": (F.col("kind") == k).cast("double") for k in KINDS}
    return out | {"n_digits": F.col("digits") / 20.0, "n_length": F.col("length") / 10.0}


def fit_classifier(found: DataFrame) -> tuple[dict[str, float], float] | None:
    """Coefficients and intercept of the span classifier, or None without candidates."""
    counted = found.groupBy("kind", *LABELERS, "digits", "length").agg(F.count(F.lit(1)).cast("double").alias("n"))
    counted = written(counted, "votes")  # at most a few thousand combinations
    patterns: dict[str, list[tuple[tuple[int, ...], float]]] = {}
    for r in counted.groupBy("kind", *LABELERS).agg(F.sum("n").alias("n")).orderBy("kind", *LABELERS).collect():
        patterns.setdefault(r.kind, []).append(((r.strict, r.gazetteer, r.context), r.n))
    if not patterns:
        return None
    soft = [(k, *p, q) for k, rows in patterns.items() for p, q in fit_labelers(rows).items()]
    posterior = found.sparkSession.createDataFrame(soft, "kind string, strict int, gazetteer int, context int, q double")
    rows = counted.join(posterior, ["kind", *LABELERS])
    rows = rows.select(
        *[c.alias(n) for n, c in _features().items()],
        F.explode(F.array(F.struct(F.lit(1.0).alias("label"), (F.col("n") * F.col("q")).alias("w")),
                          F.struct(F.lit(0.0).alias("label"), (F.col("n") * (1 - F.col("q"))).alias("w")))).alias("x"),
    ).select(*FEATURES, "x.label", F.col("x.w").alias("weight"))
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows)
    model = LogisticRegression(weightCol="weight", regParam=0.001, standardization=False, maxIter=60).fit(vectors.coalesce(1))
    return dict(zip(FEATURES, model.coefficients.toArray().tolist())), model.intercept


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """Counts and digest of the base spans of every document, and all spans."""
    matches = _matches(docs, id_col, text_col)
    found = candidates(matches)
    model = fit_classifier(found)
    score: Column = F.lit(0.0)
    if model is not None:
        weights, intercept = model
        logit = F.lit(intercept)
        for name, value in _features().items():
            logit = logit + F.lit(weights[name]) * value
        score = 1.0 / (1.0 + F.exp(-logit))
    place = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    span = F.struct(place.alias("place"), "start", "end", "kind")
    kept = found.filter(F.col("base") | (score >= threshold))
    spans = kept.groupBy("row").agg(
        *[F.count_if(F.col("base") & (F.col("kind") == k)).alias(f"n_{k}") for k in KINDS],
        F.sort_array(F.collect_list(F.when(F.col("base"), span))).alias("base"),
        F.sort_array(F.collect_list(span)).alias("all"),
    )

    def listed(spans: str) -> Column:
        return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))

    out = matches.select("row", "doc_id").join(spans, "row", "left")
    return out.select(
        "doc_id",
        *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.coalesce(listed("base"), F.lit("")), 256).alias("base_sha256"),
        F.coalesce(listed("all"), F.lit("")).alias("spans"),
    )
