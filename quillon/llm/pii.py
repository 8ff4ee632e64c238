"""Personal data by candidate gradient boosting, with DataFrame functions alone.

Base detectors (email, ip, card, phone) find validated spans. High-recall generators propose further,
overlapping candidates; boosted trees score them from their format and context; per-kind thresholds,
calibrated on held-out documents, select what is redacted besides the base spans.

Training needs no hand-made labels, and its labels are not the base patterns. Positives: each validated span is
rewritten as people write such data to evade or by habit (``@`` and dots spelt out, bracketed, spaced or as entities; a
phone behind 00 or without its country; groups of a card joined otherwise), in its own context; those rewritten spans
that a generator proposes count, and each span counts once, shared among its forms. Negatives: the same spans with their
check broken (a card that fails Luhn, an address beyond 255) in the same forms; candidates of the texts that overlap a
date, a version, a price, or a base match that failed its test while they fail it too. Other candidates of the texts are
unlabelled: as many of them with some features as there are rewritten spans with these are left out of the count, and
only those beyond are negatives.

Forms come in two families a kind (`forms`). Documents of fold 0 teach the trees with one family, those of fold 1 set the
thresholds with the other, so that ``precision`` is asked of forms that the trees have never seen; and it is asked of
the lower end of a confidence interval (Wilson, one-sided, ``Z``), so that few examples select nothing. Features are
small integers; what training gathers is one row per combination of them (``CELLS`` at most), counted over the candidates
of all documents. Trees are fitted to these counts on the driver and become CASE expressions, so that scoring is JVM-only.

Long texts: arrays are built, compared and cut in blocks of ``BLOCK`` spans, and contexts are taken from the pieces
between matches, so that no step looks at the whole text or all spans once per span.

Positions are code points, ends exclusive. Edge cases: null text is empty and has no spans; empty
tables and corpora without candidates give base spans only; very long runs of one character class are
scanned once (possessive patterns, each run started once); rows with equal texts get equal spans;
null ids count as fold 0; further columns never clash, they travel in a struct.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.shared import crc_mod

KINDS = ("email", "ip", "card", "phone")

#: Base patterns. Each equals its plain form; possessive quantifiers and the guard before a run
#: (not inside a run, unless the last match ended there) only spare the scan its retries.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without these has no match of the kind.
HINT = {"email": r"@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){11}", "phone": r"\+[0-9]"}
_OPEN, _SHUT = r"\x20?[(\[{<]\x20?", r"\x20?[)\]}>]"
_AT = rf"(?:\x20?@\x20?|{_OPEN}(?i:at){_SHUT}\x20?|&#64;|&commat;|%40)"
_SPELT = rf"(?:{_OPEN}(?:\.|(?i:dot)){_SHUT}\x20?|\x20(?i:dot)\x20)"
_DOT = rf"(?:\x20?\.\x20?|{_OPEN}(?:\.|(?i:dot)){_SHUT}\x20?|\x20(?i:dot)\x20|&#46;)"
_JOIN = r"[\x20._/-]"
#: Generators of further candidates, wider than the base patterns. Behind a bare word ``at`` a dot isn't spaced.
WIDE = {
    "email": rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._+-]++(?:\x20(?i:at)\x20[A-Za-z0-9-]++(?:(?:\.|{_SPELT})[A-Za-z0-9-]++)++|{_AT}[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++)++)",
    "ip": rf"(?<![0-9.])[0-9]{{1,3}}+(?:{_DOT}[0-9]{{1,3}}+){{3}}(?![0-9])",
    "card": rf"(?<![0-9-])(?:[0-9]{{12,19}}+|[0-9]{{4}}{_JOIN}[0-9]{{4}}{_JOIN}[0-9]{{4}}{_JOIN}[0-9]{{4}}|[0-9]{{4}}{_JOIN}[0-9]{{6}}{_JOIN}[0-9]{{5}})(?![0-9-])",
    "phone": r"(?<![0-9(])(?:\+?[0-9]{1,3}[\x20./-]?|00[0-9]{1,3}[\x20./-]?)?(?:\([0-9]{2,5}\)[\x20/-]?|[0-9]{3,5}[\x20./-])(?:[0-9]{6,8}|[0-9]{3,4}[\x20./-][0-9]{3,4})(?![0-9])",
}
WIDE_HINT = {
    "email": r"@|(?i:[(\[{<]\x20?at\x20?[)\]}>])|(?i:\x20at\x20[a-z0-9-]++(?:\.[a-z0-9]|\x20?[(\[{<]?\x20?dot))|&#64;|&commat;|%40",
    "ip": r"[0-9]\x20?(?:\.|[(\[{<]|(?i:dot)|&#46;)[^0-9]{0,6}[0-9]", "card": r"[0-9]{12}|[0-9]{4}[\x20._/-][0-9]{4}", "phone": r"[0-9]{2,5}\)?[\x20./-]?[0-9]{3}",
}
#: What looks like such data and isn't: dates, versions, prices.
OTHER = r"(?<![0-9])(?:[12][0-9]{3}[./-][0-9]{1,2}[./-][0-9]{1,2}|[0-9]{1,2}[./-][0-9]{1,2}[./-][12][0-9]{3})(?![0-9])|(?i:\bv(?:ersion|er)?\.?\x20?)[0-9]++(?:\x20?\.\x20?[0-9]++)++|[$€£]\x20?[0-9][0-9.,]*+"
OTHER_HINT = r"[0-9][./-][0-9]|(?i:\bv)[a-z]*\.?\x20?[0-9]|[$€£]\x20?[0-9]"
#: Spans in a block.
BLOCK = 128
#: Words near a span that speak of its kind.
NEAR = r"(?i)(?:mail|kontakt|contact|phone|tel|call|fax|card|visa|konto|iban|addr|host|server|\bip\b)"

FEATURES = ("kind", "digits", "luhn", "style", "dots", "left", "right", "near", "octets", "tail")
LEVELS = (4, 8, 2, 6, 5, 4, 4, 2, 2, 3)
#: Standard errors below an observed precision at which its confidence interval begins.
Z = 1.28
CELLS = math.prod(LEVELS)


_SPAN = "struct<start:int,kind:int,end:int,match:string,left:string,right:string>"
_NONE = f"cast(array() as array<{_SPAN}>)"


def _bound(value: Column, body) -> Column:
    """body(value) with the value computed once, however often the body's own lambdas look at it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _blocks(spans: Column) -> Column:
    """array<struct<items, lo, hi>>: runs of BLOCK spans with their least start and greatest end (null: no items)."""
    begins = F.sequence(F.lit(0), F.greatest(F.size(spans) - 1, F.lit(0)), F.lit(BLOCK))
    cut = F.transform(begins, lambda b: F.slice(spans, b + 1, F.lit(BLOCK)))
    return F.transform(cut, lambda x: F.struct(x.alias("items"), F.array_min(F.transform(x, lambda s: s["start"])).alias("lo"), F.array_max(F.transform(x, lambda s: s["end"])).alias("hi")))


def _meets(x: Column, blocks: Column, also=None) -> Column:
    """Whether one of the blocks' spans overlaps x and fulfils ``also``."""
    def hit(o: Column) -> Column:
        met = (o["start"] < x["end"]) & (x["start"] < o["end"])
        return met & also(o) if also else met

    return F.coalesce(F.exists(blocks, lambda b: (b["lo"] < x["end"]) & (x["start"] < b["hi"]) & F.exists(b["items"], hit)), F.lit(False))


def _found(text: str, pattern: str, hint: str, kind: int) -> Column:
    """Spans (_SPAN) of the leftmost non-overlapping matches in the column ``text``. left: up to 24 code points before,
    back to the start of the match before; right: up to 8 after, as far as the end of the next match.

    The parts between the matches and the matches are zipped (the last part has no match), cut in blocks, and each
    block is laid out from its own position on."""
    sql = """
    CASE WHEN {text} RLIKE r'{hint}' THEN
      element_at(transform(array(named_struct('hits', regexp_extract_all({text}, r'{pattern}', 0), 'parts', split({text}, r'{pattern}', -1))), v ->
      element_at(transform(array(arrays_zip(v.hits, v.parts, concat(array(''), v.hits), slice(v.parts, 2, size(v.parts)), slice(v.hits, 2, greatest(size(v.hits), 1)))), pairs ->
      element_at(transform(array(transform(sequence(0, size(pairs) - 1, {block}), b -> slice(pairs, b + 1, {block}))), blocks ->
        flatten(zip_with(blocks, slice(aggregate(
            transform(blocks, b -> aggregate(b, 0, (a, x) -> a + length(x.parts) + coalesce(length(x.hits), 0))),
            array(0), (a, n) -> concat(a, array(element_at(a, -1) + n))), 1, size(blocks)),
          (b, at) -> aggregate(b, named_struct('at', at, 'out', {none}), (acc, x) -> named_struct(
            'at', acc.at + length(x.parts) + coalesce(length(x.hits), 0),
            'out', CASE WHEN x.hits IS NULL THEN acc.out ELSE concat(acc.out, array(named_struct(
              'start', acc.at + length(x.parts), 'kind', {kind}, 'end', acc.at + length(x.parts) + length(x.hits), 'match', x.hits,
              'left', right(concat(right(x.`2`, 24), right(x.parts, 24)), 24),
              'right', left(concat(left(coalesce(x.`3`, ''), 8), left(coalesce(x.`4`, ''), 8)), 8)))) END),
            acc -> acc.out)))), 1)), 1)), 1)
    ELSE {none} END"""
    return F.expr(sql.format(text=text, pattern=pattern, hint=hint, kind=kind, block=BLOCK, none=_NONE))


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(match: Column) -> Column:
    return F.coalesce(F.call_function("luhn_check", _digits(match)), F.lit(False))


def _valid(kind: str, match: Column) -> Column:
    """Whether a base match passes its kind's test."""
    n = F.length(_digits(match))
    if kind == "ip":
        return match.rlike(r"^(?:0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.|$)){4}$")
    if kind == "card":
        return n.between(12, 19) & _luhn(match)
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def base_spans(text: str) -> Column:
    """All base spans of the column, sorted by start, then kind."""
    def valid(kind: str):
        return lambda x: _valid(kind, x["match"])

    return F.array_sort(F.concat(*(F.filter(_found(text, BASE[k], HINT[k], i), valid(k)) for i, k in enumerate(KINDS))))


def candidates(text: str) -> Column:
    """What the generators propose in the column."""
    return F.array_sort(F.concat(*(_found(text, WIDE[k], WIDE_HINT[k], i) for i, k in enumerate(KINDS))))


def forms(kind: str, x: Column, broken: bool = False) -> list[tuple[Column, Column]]:
    """(left context, span) of a base span written in other ways; those at even places are one family, those at odd ones the other.
    ``broken``: with a check that fails (null where the kind has none)."""
    m, left, d = x["match"], x["left"], _digits(x["match"])
    if broken:
        if kind == "card":  # another last digit
            d = F.concat(F.expr("''"), F.substring(d, F.lit(1), F.length(d) - 1), ((F.substring(d, -1, 1).cast("int") + 1) % 10).cast("string"))
        elif kind == "ip":
            m = F.regexp_replace(m, r"^[0-9]+", "999")
        else:
            return []
    if kind == "email":
        user, host = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)
        ways = [("[at]", "[dot]"), (" (at) ", " (dot) "), (" [at] ", "."), (" @ ", "."), (" at ", " dot "), (" AT ", " DOT "), ("&#64;", "."), ("%40", "."), ("<at>", "."), ("{at}", "{dot}"), (" at ", "."), (" (AT) ", ".")]
        return [(left, F.concat(user, F.lit(at), F.replace(host, F.lit("."), F.lit(dot)))) for at, dot in ways]
    if kind == "ip":
        return [(left, F.replace(m, F.lit("."), F.lit(dot))) for dot in (" . ", ". ", "[.]", "(.)", " dot ", "[dot]")]
    if kind == "card":
        groups = [F.substring(d, i, 4) for i in (1, 5, 9, 13)]
        joined = [F.when(F.length(d) == 16, F.concat_ws(c, *groups)) for c in (".", "_", "/")]
        return [(F.concat(left, F.lit(" 12 ")), d), (F.concat(left, F.lit(" 7 ")), d), *((left, j) for j in joined)]
    area, first, last = (F.substring(d, i, n) for i, n in ((-10, 3), (-7, 3), (-4, 4)))
    country = F.substring(d, F.lit(1), F.length(d) - 10)
    abroad = F.concat(F.lit("00"), F.when(F.length(country).between(1, 3), country))
    ways = [F.concat(F.lit("("), area, F.lit(") "), first, F.lit("-"), last), F.concat(F.lit("("), area, F.lit(")"), first, last), F.concat_ws("-", area, first, last), F.concat_ws(".", area, first, last),
            F.concat_ws(" ", area, first, last), F.concat_ws("/", area, F.concat(first, last)), F.concat_ws(" ", area, F.concat(first, last)), F.concat(abroad, F.lit(" "), area, F.lit(" "), first, last),
            F.concat(abroad, F.lit(" "), area, F.lit("-"), first, F.lit("-"), last)]
    return [(left, F.when(F.length(d) >= 10, f)) for f in ways]


def rewritten(kind: str, x: Column, fold: Column) -> Column:
    """array<struct<left, form, y, w, own>>: a base span's forms, and those with a broken check (y = 0); own: of the fold's family."""
    def made(ways: list, y: float, own: bool) -> Column:
        mine = [F.when(fold == i % 2 if own else fold != i % 2, f) for i, (_, f) in enumerate(ways)]
        every = F.array(*(F.struct(a.alias("left"), f.alias("form")) for (a, _), f in zip(ways, mine)))
        return _bound(F.filter(every, lambda v: v["form"].isNotNull()), lambda some: F.transform(some, lambda v: F.struct(v["left"].alias("left"), v["form"].alias("form"), F.lit(y).alias("y"), (1.0 / F.size(some)).alias("w"), F.lit(own).alias("own"))))

    good, bad = forms(kind, x), forms(kind, x, broken=True)
    return F.concat(made(good, 1.0, True), made(good, 1.0, False), *([made(bad, 0.0, True)] if bad else []))


def _char_class(c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit("")) == "", 0).when(c.rlike(r"^[\x20\x09-\x0D]"), 0).when(c.rlike(r"^\p{L}"), 1).when(c.rlike("^[0-9]"), 2).otherwise(3)


def features(x: Column) -> Column:
    """struct of FEATURES of a span, each an integer below its level."""
    m, n = x["match"], F.length(_digits(x["match"]))
    at = F.when(m.rlike(r"(?i)[(\[{<]\x20?at\b"), 2).when(m.rlike(r"(?i)\x20at\x20"), 3).when(m.rlike("&#64;|&commat;|%40"), 4).when(m.rlike(r"\x20@|@\x20"), 1).otherwise(0)
    values = {
        "kind": x["kind"],
        "digits": F.when(n < 7, 0).when(n < 10, 1).when(n == 10, 2).when(n == 11, 3).when(n < 16, 4).when(n == 16, 5).when(n < 20, 6).otherwise(7),
        "luhn": _luhn(m).cast("int"),
        "style": F.when(x["kind"] == 0, at).when((x["kind"] == 1) | m.contains("("), 0).when(m.contains(" "), 1).when(m.contains("-"), 2).when(m.contains("."), 3).when(m.rlike("[_/]"), 4).otherwise(5),
        "dots": F.when(x["kind"] > 1, 0).when(m.rlike(r"(?i)\x20dot\x20"), 4).when(m.rlike(r"(?i)[(\[{<]\x20?(?:\.|dot)|&#46;"), 3).when(m.rlike(r"\x20\.|\.\x20"), 2).when(m.contains("."), 1).otherwise(0),
        "left": _char_class(F.substring(x["left"], -1, 1)),
        "right": _char_class(F.substring(x["right"], 1, 1)),
        "near": x["left"].rlike(NEAR).cast("int"),
        "octets": _valid("ip", F.regexp_replace(m, "[^0-9]+", ".")).cast("int"),
        "tail": F.when(m.rlike(r"(?:[.\])}>;]|(?i:dot))\x20?[A-Za-z]{2,6}$"), 2).when(m.rlike("[A-Za-z]$"), 1).otherwise(0),
    }
    return F.struct(*(F.coalesce(v, F.lit(0)).cast("int").alias(k) for k, v in values.items()))


@dataclass
class Trees:
    """Boosted trees over FEATURES: splits as nested tuples (feature, limit, below, above), leaves as numbers."""

    prior: float = -20.0
    trees: list = field(default_factory=list)
    thresholds: dict[int, float] = field(default_factory=dict)  # by kind; absent: nothing is selected

    def margin(self, f: str) -> str:
        """SQL of the log odds of the struct of features that the expression ``f`` names."""
        def walk(t) -> str:
            if not isinstance(t, tuple):
                return f"{float(t)!r}D"
            return f"CASE WHEN {f}.{FEATURES[t[0]]} <= {t[1]} THEN {walk(t[2])} ELSE {walk(t[3])} END"

        return " + ".join([f"{float(self.prior)!r}D", *map(walk, self.trees)])

    def value(self, cell: tuple[int, ...]) -> float:
        def walk(t):
            return t if not isinstance(t, tuple) else walk(t[2] if cell[t[0]] <= t[1] else t[3])

        return self.prior + sum(walk(t) for t in self.trees)


def _grow(rows: list[tuple[tuple, float, float]], depth: int, rate: float, least: float):
    """One regression tree on (cell, gradient, hessian)."""
    g, h = sum(r[1] for r in rows), sum(r[2] for r in rows)
    leaf = rate * g / (h + 1.0)
    best = (1e-9, None)
    for j in range(len(FEATURES)) if depth else ():
        for limit in range(LEVELS[j] - 1):
            gl = sum(r[1] for r in rows if r[0][j] <= limit)
            hl = sum(r[2] for r in rows if r[0][j] <= limit)
            if hl >= least and h - hl >= least:
                gain = gl * gl / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g * g / (h + 1)
                if gain > best[0]:
                    best = (gain, (j, limit))
    if best[1] is None:
        return leaf
    j, limit = best[1]
    return (j, limit, _grow([r for r in rows if r[0][j] <= limit], depth - 1, rate, least), _grow([r for r in rows if r[0][j] > limit], depth - 1, rate, least))


def boost(cells: list[tuple[tuple[int, ...], float, float]], n_trees: int = 16, depth: int = 3, rate: float = 0.4) -> Trees:
    """Trees by logistic gradient boosting on (cell, candidates, positives)."""
    n, y = sum(c[1] for c in cells), sum(c[2] for c in cells)
    model = Trees(math.log((y + 0.5) / (n - y + 0.5)) if n else -20.0)
    f = [model.prior] * len(cells)
    for _ in range(n_trees if 0 < y < n else 0):
        p = [1 / (1 + math.exp(-min(max(x, -30), 30))) for x in f]
        tree = _grow([(c[0], c[2] - c[1] * q, c[1] * q * (1 - q)) for c, q in zip(cells, p)], depth, rate, 0.05)
        model.trees.append(tree)
        one = Trees(0.0, [tree])
        f = [x + one.value(c[0]) for x, c in zip(f, cells)]
    return model


def lower_bound(y: float, n: float, z: float = Z) -> float:
    """Lower end of Wilson's interval of a share y / n."""
    if n <= 0:
        return 0.0
    p = y / n
    return (p + z * z / (2 * n) - z * math.sqrt(max(0.0, p * (1 - p) / n + z * z / (4 * n * n)))) / (1 + z * z / n)


def calibrate(model: Trees, cells: list[tuple[tuple[int, ...], float, float]], precision: float) -> None:
    """Per kind the lowest margin from which on the held-out candidates surely reach ``precision``."""
    for kind in range(len(KINDS)):
        ranked = sorted(((model.value(c[0]), c[1], c[2]) for c in cells if c[0][0] == kind), reverse=True)
        n = y = 0.0
        for i, (m, count, positives) in enumerate(ranked):
            n, y = n + count, y + positives
            if (i + 1 == len(ranked) or ranked[i + 1][0] < m) and lower_bound(y, n) >= precision and m > 0:
                model.thresholds[kind] = m - 1e-9


def examples(texts: DataFrame) -> DataFrame:
    """fold, f (features), w (weight), y (1: a rewritten span, 0: none, null: unlabelled), own (not of the other fold's family)
    of the training candidates of ``texts`` (fold, text)."""
    t = texts.withColumn("every", F.array_sort(F.concat(*(_found("text", BASE[k], HINT[k], i) for i, k in enumerate(KINDS)))))
    passes = lambda x: F.coalesce(*(F.when(x["kind"] == i, _valid(k, x["match"])) for i, k in enumerate(KINDS)))
    t = t.withColumn("base", F.filter("every", passes)).withColumn("failed", F.filter("every", lambda x: ~passes(x)))
    t = t.withColumn("other", _found("text", OTHER, OTHER_HINT, len(KINDS)))
    free = _bound(_blocks(F.col("base")), lambda blocks: F.filter(candidates("text"), lambda x: ~_meets(x, blocks)))
    fails = lambda x: F.coalesce(F.when(x["kind"] == 1, ~_valid("ip", F.regexp_replace(x["match"], "[^0-9]+", "."))).when(x["kind"] == 2, ~_valid("card", x["match"])), F.lit(False))

    def label(others: Column, failed: Column):
        def one(x: Column) -> Column:
            wrong = _meets(x, others) | (fails(x) & _meets(x, failed, lambda o: o["kind"] == x["kind"]))
            return F.struct(x.alias("x"), F.lit(None).cast("string").alias("left"), F.lit(None).cast("string").alias("form"), F.when(wrong, 0.0).alias("y"), F.lit(1.0).alias("w"), F.lit(True).alias("own"))

        return one

    natural = _bound(F.struct(_blocks(F.col("other")).alias("o"), _blocks(F.col("failed")).alias("b")), lambda v: F.transform(free, label(v["o"], v["b"])))

    def made(i: int, kind: str) -> Column:
        each = lambda x: F.transform(rewritten(kind, x, F.col("fold")), lambda a: F.struct(x.alias("x"), a["left"].alias("left"), a["form"].alias("form"), a["y"].alias("y"), a["w"].alias("w"), a["own"].alias("own")))
        return F.flatten(F.transform(F.filter("base", lambda x: x["kind"] == i), each))

    t = t.select("fold", F.explode(F.concat(natural, *(made(i, k) for i, k in enumerate(KINDS)))).alias("e"))
    t = t.select("fold", "e.*", F.concat("e.left", "e.form", "e.x.right").alias("local"))
    # a rewritten span counts if a generator of its kind proposes just it
    proposed = F.lit(None).cast(f"array<{_SPAN}>")
    for i, k in enumerate(KINDS):
        proposed = F.when(F.col("x.kind") == i, _found("local", WIDE[k], WIDE_HINT[k], i)).otherwise(proposed)
    whole = F.filter(proposed, lambda c: (c["start"] == F.length("left")) & (c["match"] == F.col("form")))
    t = t.select("fold", "w", "y", "own", F.explode(F.when(F.col("form").isNull(), F.array("x")).otherwise(whole)).alias("x"))
    return t.select("fold", features(F.col("x")).alias("f"), "w", "y", "own")


def train(docs: DataFrame, precision: float = 0.9) -> Trees:
    """Fit on the candidates of documents in fold 0, calibrate on fold 1 (crc32 of the id, modulo 2)."""
    t = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), crc_mod("doc_id", 2).alias("fold"))
    hint = "|".join([*WIDE_HINT.values(), *HINT.values()])
    c = examples(t.filter(F.col("text").rlike(hint)))
    sums = [F.sum(F.when(c, F.col("w")).otherwise(0.0)).alias(k) for k, c in (("yes", F.expr("y = 1 and own")), ("kin", F.expr("y = 1 and not own")), ("no", F.col("y") == 0), ("open", F.col("y").isNull()))]
    rows = c.groupBy("fold", "f").agg(*sums).collect()  # two rows a cell at most
    total = lambda r: r["yes"] + r["no"] + max(0.0, r["open"] - r["yes"] - r["kin"])
    folds = {k: sorted((tuple(r["f"]), total(r), r["yes"]) for r in rows if r["fold"] == k and total(r) > 0) for k in (0, 1)}
    model = boost(folds[0])
    calibrate(model, folds[1], precision)
    return model


def with_spans(docs: DataFrame, model: Trees | None = None) -> DataFrame:
    """row (struct of the columns of docs), doc_id, text, base and spans: arrays of (start, kind, end, match, left, right)."""
    model = train(docs) if model is None else model
    t = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    t = t.withColumn("base", base_spans("text"))
    if not model.thresholds:
        return t.withColumn("spans", F.col("base"))

    def longer(x: Column, o: Column) -> Column:
        n, m = o["end"] - o["start"], x["end"] - x["start"]
        return (n > m) | ((n == m) & (F.struct(o["start"], o["kind"]) < F.struct(x["start"], x["kind"])))

    free = _bound(_blocks(F.col("base")), lambda blocks: F.filter(candidates("text"), lambda x: ~_meets(x, blocks)))
    t = t.withColumn("scored", F.transform(free, lambda x: F.struct(x.alias("x"), features(x).alias("f"))))
    at = " ".join(f"WHEN {kind} THEN {value!r}D" for kind, value in model.thresholds.items())
    t = t.withColumn("more", F.expr(f"transform(filter(scored, c -> {model.margin('c.f')} >= CASE c.x.kind {at} END), c -> c.x)"))
    alone = _bound(_blocks(F.col("more")), lambda blocks: F.filter("more", lambda x: ~_meets(x, blocks, lambda o: longer(x, o))))
    return t.withColumn("spans", F.array_sort(F.concat("base", alone))).drop("scored", "more")


def _named(x: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, KINDS)), x["kind"] + 1)


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", _named(x), x["start"].cast("string"), x["end"].cast("string"))), ",")


def find_pii(docs: DataFrame, model: Trees | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base), base_sha256, spans of each row."""
    t = with_spans(docs, model)
    kinds = F.transform("base", lambda x: x["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return t.select("doc_id", *counts, F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, model: Trees | None = None, mark: str = "[{}]") -> DataFrame:
    """docs with each span of the text replaced by its kind's mark; overlapping spans are replaced as one. A null text stays null."""
    t = with_spans(docs, model)
    text, before, after = F.col("text"), *mark.split("{}")

    def block(w: Column) -> Column:
        """The pieces of a block of spans: the text between them and their marks."""
        at, b = w["at"], w["block"]
        stretch = F.substring(text, at + 1, F.greatest(b["hi"] - at, F.lit(0)))

        def pieces(part: Column) -> Column:
            def step(acc: Column, x: Column) -> Column:
                piece = F.array(F.substring(part, acc["at"] - at + 1, x["start"] - acc["at"]), F.concat(F.lit(before), F.upper(_named(x)), F.lit(after)))
                return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.when(x["start"] >= acc["at"], F.concat(acc["out"], piece)).otherwise(acc["out"]).alias("out"))

            start = F.struct(at.alias("at"), F.expr("cast(array() as array<string>)").alias("out"))
            return F.aggregate(b["items"], start, step, lambda a: a["out"])

        return _bound(stretch, pieces)

    def whole(v: Column) -> Column:
        each = F.zip_with(v["blocks"], F.slice(v["at"], 1, F.size(v["blocks"])), lambda b, a: F.struct(a.alias("at"), b.alias("block")))
        tail = F.substring(text, F.element_at(v["at"], -1) + 1, F.length(text))
        return F.array_join(F.concat(F.flatten(F.transform(each, block)), F.array(tail)), "")

    reached = lambda blocks: F.aggregate(blocks, F.array(F.lit(0)), lambda a, b: F.concat(a, F.array(F.greatest(F.element_at(a, -1), b["hi"]))))
    marked = _bound(_blocks(F.col("spans")), lambda blocks: _bound(F.struct(blocks.alias("blocks"), reached(blocks).alias("at")), whole))
    t = t.withColumn("clean", F.when(F.size("spans") == 0, F.col("row")["text"]).otherwise(marked))
    return t.select(*(F.col("clean").alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns))
