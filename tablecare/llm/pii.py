"""Personal data by weak supervision, in DataFrame functions only.

Patterns propose spans of four kinds: strict ones (``base``: they pass the kind's own test and
always stay) and looser ones (spelt-out addresses, numbers that miss a test or a prefix). Five
labelers vote +1, -1 or 0 on every proposed span: the pattern, its format, a gazetteer of
prefixes and endings, the words before it, and its edges. Counts of vote patterns over all spans
(at most ``3**5`` a kind) are all that expectation-maximisation needs to estimate how reliable
each labeler is and how probable each pattern is to be personal data. These probabilities are the
labels of the final span classifier, a naive Bayes model over shape, edge, context and vote
features, whose counts come from the same small table. Loose spans with a probability of at
least one half that do not overlap a base span are added.

Positions are code points, the end exclusive. Null texts are empty and have no spans. Rows keep
their other columns; repeated rows are treated alike. Without any proposed span nothing is added.
Java's possessive repeats keep matching linear and free of recursion on very long texts; they
match what the greedy forms match, as what follows each repeat is not in its class.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablecare.llm.frames import durable, fresh

KINDS = ["email", "ip", "card", "phone"]
PIECE = 1000  # code points
RUN = 128  # values that a fold runs over at a time
FAR = 2**31 - 1
LABELERS = ["pattern", "format", "gazetteer", "context", "edge"]
MARK, STAND_IN = "\ue000", "\ue001"
LOCAL = "[A-Za-z0-9._%+-]"
LABEL = "[A-Za-z0-9-]"
# Strict patterns. A match can only begin where the run of its first class begins, or where the last match ended.
STRICT = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@{LABEL}++(?:\.{LABEL}++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9]){12,}+",  # shorter runs pass no test
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
LOOSE = {
    "email": rf"(?i)(?<!{LOCAL}){LOCAL}{{1,64}}+ ?(?:\(at\)|\[at\]|@) ?{LABEL}++(?: ?(?:\(dot\)|\[dot\]|\.) ?{LABEL}++)++",
    "phone": r"(?<![0-9+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9-])",
}
GATE = r"(?i)@|\(at\)|\[at\]"  # what every match of the loose e-mail pattern holds
TLDS = "com|org|net|edu|gov|info|io|de|fr|es|it|uk|us|ch|at|be|nl|eu|ca|mx|ar|br|in|cn|jp|ru|pl|se|no|dk|fi|pt"
ISSUERS = "^(?:4|5[1-5]|2[2-7]|3[47]|6011|6[245])"
CONTEXT = {
    "email": ("mail|contact|write|correo|courriel|kontakt|reply", "^$"),
    "ip": r"\bip\b|host|server|addr|ping|dns|login;version|release|section|chapter".split(";"),
    "card": r"card|visa|master|credit|tarjeta|carte|karte|payment;\bid\b|order|isbn|serial|invoice".split(";"),
    "phone": r"phone|tel|call|fax|mobile|cell|movil|telefon|appel|anruf|whatsapp;\bid\b|isbn|serial".split(";"),
}
SPAN = "struct<start:int,stop:int,value:string,before:string,after:string>"
CANDIDATE = "struct<kind:int,start:int,stop:int,base:boolean,votes:string,features:array<string>>"


def _parts(text: Column, pattern: str) -> Column:
    """The text cut at the matches; the odd parts are the matches."""
    return F.split(F.regexp_replace(text, F.lit(pattern), F.lit(f"{MARK}$0{MARK}")), MARK, -1)


def with_running(frame: DataFrame, wanted: dict[str, str], zero: int, join: Callable[[Column, Column], Column]) -> DataFrame:
    """For each entry (new column: array column) the running fold of what stands before each value.

    Arrays are cut into blocks of ``RUN``: an array that a fold lets grow is copied at each step, so
    the work is the number of values times the block's length, not times their number.
    """
    start = F.lit(zero)
    nested = "array<array<int>>"

    def folded(values: Column, first: Column) -> Column:
        step = lambda s, v: F.struct(join(s["at"], v).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out"))
        return F.aggregate(values, F.struct(first.alias("at"), F.array().cast("array<int>").alias("out")), step)["out"]

    cut = {new: fresh([*frame.columns, *wanted], f"blocks_{n}") for n, new in enumerate(wanted)}
    ahead = {new: fresh([*frame.columns, *wanted], f"ahead_{n}") for n, new in enumerate(wanted)}

    def in_blocks(old: str) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(old) - 1) / RUN).cast("int"))
        whole = F.transform(numbers, lambda b: F.slice(F.col(old), b * RUN + 1, F.lit(RUN)))
        return F.when(F.size(old) > 0, whole).otherwise(F.array().cast(nested))

    blocks = {cut[new]: in_blocks(old) for new, old in wanted.items()}
    totals = {new: F.transform(F.col(cut[new]), lambda x: F.aggregate(x, start, lambda a, b: join(a, b))) for new in wanted}
    frame = frame.withColumns(blocks).withColumns({ahead[new]: folded(totals[new], start) for new in wanted})
    flat = {new: F.flatten(F.zip_with(F.col(cut[new]), F.col(ahead[new]), folded)) for new in wanted}
    return frame.withColumns(flat).drop(*cut.values(), *ahead.values())


def _spans(cut: str, starts: str) -> Column:
    """The matches with positions and their surroundings; ``starts`` are the places of all parts."""
    parts, places = F.col(cut), F.col(starts)

    def span(i: Column) -> Column:
        part, start = F.get(parts, i), F.get(places, i)
        before, after = F.right(F.get(parts, i - 1), F.lit(24)), F.left(F.get(parts, i + 1), F.lit(1))
        return F.struct(
            start.alias("start"), (start + F.length(part)).alias("stop"), part.alias("value"), before.alias("before"), after.alias("after")
        )

    found = F.transform(F.sequence(F.lit(1), F.size(parts) - 1, F.lit(2)), span).cast(f"array<{SPAN}>")
    return F.when(F.size(parts) > 1, found).otherwise(F.array().cast(f"array<{SPAN}>"))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def passes(kind: str, value: Column) -> Column:
    """The test of a strict match."""
    if kind == "ip":
        small = lambda p: (F.length(p) <= 3) & (F.left(p, F.lit(3)).cast("int") <= 255)
        return F.forall(F.split(value, r"\."), lambda p: small(F.regexp_replace(p, "^0+(?=.)", "")))
    digits = _digits(value)
    if kind == "card":
        return F.when(F.length(digits).between(16, 19), F.call_function("luhn_check", digits)).otherwise(False)
    return F.length(digits).between(8, 15) if kind == "phone" else F.lit(True)


def _sign(condition: Column, no: int = -1) -> Column:
    return F.when(condition, 1).otherwise(no)


def _votes(kind: str, span: Column, strict: bool, base: Column) -> list[Column]:
    """One vote per labeler, in their order."""
    value, digits = span["value"], _digits(span["value"])
    if kind == "email":
        pattern, form = F.lit(1 if strict else 0), value.rlike(rf"[A-Za-z]{{2,24}}$")
        known = F.lower(value).rlike(rf"(?:\.|dot[)\]] ?)(?:{TLDS})$")
    elif kind == "ip":
        pattern, form = _sign(base), value.rlike(r"^(?:[1-9]?[0-9]{1,2}\.?|1[0-9]{2}\.?|2[0-9]{2}\.?){4}$")
        known = ~value.rlike(r"^(?:0|22[4-9]|2[3-9][0-9])\.|\.0$")
    elif kind == "card":
        pattern, form = _sign(F.length(digits).between(16, 19)), base
        known = digits.rlike(ISSUERS)
    else:
        pattern, form = F.lit(1 if strict else 0), F.length(digits).between(10, 15)
        known = digits.rlike("^[1-9]") if strict else digits.rlike("^[2-9][0-9]{2}[2-9]")
    for_it, against = CONTEXT[kind]
    near = F.lower(span["before"])
    context = F.when(near.rlike(for_it), 1).when(near.rlike(against), -1).otherwise(0)
    edge = _sign(~span["before"].rlike(r"[A-Za-z0-9_]$") & ~span["after"].rlike("^[A-Za-z0-9_]"))
    return [pattern, _sign(form), _sign(known), context, edge]


def _features(votes: list[Column], span: Column) -> Column:
    """Named features: the votes, the shape, both edges and the word before."""
    shape = F.regexp_replace(F.regexp_replace(span["value"], "[A-Za-z]+", "a"), "[0-9]+", "9")
    shape = F.left(F.regexp_replace(shape, "[^a9@. +()-]", "?"), F.lit(12))
    word = F.regexp_extract(F.lower(span["before"]), "([a-z]{2,})[^a-z]*$", 1)
    named = [F.concat(F.lit(f"{n}="), v.cast("string")) for n, v in zip(LABELERS, votes, strict=True)]
    return F.array(
        *named,
        F.concat(F.lit("shape="), (F.crc32(shape.cast("binary")) % 16).cast("string")),
        F.concat(F.lit("size="), F.least(F.length(span["value"]) / 4, F.lit(8)).cast("int").cast("string")),
        F.concat(F.lit("word="), (F.crc32(word.cast("binary")) % 32).cast("string")),
    )


def with_candidates(docs: DataFrame, text: str, to: str) -> DataFrame:
    """``docs`` with all proposed spans of each row in column ``to``."""
    columns = docs.columns
    plain = fresh(columns, "plain")
    found = docs.withColumn(plain, F.translate(F.coalesce(F.col(text), F.lit("")), MARK, STAND_IN))
    sources = [(k, True, STRICT[k]) for k in KINDS] + [(k, False, p) for k, p in LOOSE.items()]
    cuts = []
    for n, (kind, strict, pattern) in enumerate(sources):
        cut = fresh(columns, f"cut_{n}")
        # what every match needs spares most texts the pattern
        if kind == "email":
            needs = F.col(plain).contains("@") if strict else F.col(plain).rlike(GATE)
        else:
            needs = F.col(plain).contains("+") if (kind, strict) == ("phone", True) else F.col(plain).rlike("[0-9]")
        found = found.withColumn(cut, F.when(needs, _parts(F.col(plain), pattern)).otherwise(F.array(F.lit(""))))
        cuts.append(cut)
    sizes = {fresh(columns, f"sizes_{n}"): cut for n, cut in enumerate(cuts)}
    found = found.withColumns({size: F.transform(F.col(cut), F.length) for size, cut in sizes.items()})
    starts = {fresh(columns, f"starts_{n}"): size for n, size in enumerate(sizes)}
    found = with_running(found, starts, 0, lambda a, b: a + b)
    spans = [fresh(columns, f"span_{n}") for n in range(len(cuts))]
    found = found.withColumns({span: _spans(cut, start) for span, cut, start in zip(spans, cuts, starts, strict=True)})
    found = found.drop(plain, *cuts, *sizes, *starts)

    def candidate(kind: str, strict: bool):
        def build(span: Column) -> Column:
            base = passes(kind, span["value"]) if strict else F.lit(False)
            votes = _votes(kind, span, strict, base)
            return F.struct(
                F.lit(KINDS.index(kind)).alias("kind"),
                span["start"].alias("start"),
                span["stop"].alias("stop"),
                base.alias("base"),
                F.concat_ws(",", *(v.cast("string") for v in votes)).alias("votes"),
                _features(votes, span).alias("features"),
            )

        return build

    every = [F.transform(F.col(s), candidate(k, strict)) for s, (k, strict, _) in zip(spans, sources, strict=True)]
    found = found.withColumn(to, F.concat(*every).cast(f"array<{CANDIDATE}>")).drop(*spans)
    # Loose spans are proposed where no base span lies, and card-like ones from 13 digits on. In order
    # of their starts, a span meets a base span if one before it stops later or one after it starts earlier.
    taken = [*columns, to]
    stops, upto, later, starts = (fresh(taken, n) for n in ("stops", "upto", "later", "base_starts"))
    by_place = lambda c: F.struct(c["start"].alias("start"), c["stop"].alias("stop"), c.alias("c"))
    found = found.withColumn(to, F.transform(F.array_sort(F.transform(F.col(to), by_place)), lambda p: p["c"]))
    base_stop = F.transform(F.col(to), lambda c: F.when(c["base"], c["stop"]).otherwise(0))
    base_start = F.transform(F.reverse(F.col(to)), lambda c: F.when(c["base"], c["start"]).otherwise(FAR))
    found = found.withColumns({stops: base_stop, starts: base_start})
    found = with_running(found, {upto: stops}, 0, F.greatest)
    found = with_running(found, {later: starts}, FAR, F.least)
    # side by side, as a column that a lambda takes from outside may be computed anew for each element
    beside = F.zip_with(F.col(to), F.col(upto), lambda c, u: F.struct(c.alias("c"), u.alias("upto")))
    beside = F.zip_with(beside, F.reverse(F.col(later)), lambda t, n: F.struct(t["c"].alias("c"), t["upto"].alias("upto"), n.alias("next")))

    def open_place(t: Column) -> Column:
        c = t["c"]
        clash = (t["upto"] > c["start"]) | (t["next"] < c["stop"])
        long_enough = (c["kind"] != KINDS.index("card")) | (c["stop"] - c["start"]).between(13, 40)
        return c["base"] | (long_enough & ~clash)

    return found.withColumn(to, F.transform(F.filter(beside, open_place), lambda t: t["c"])).drop(stops, upto, later, starts)


@dataclass
class PiiModel:
    """Reliabilities by (kind, labeler), and the classifier's prior and feature log-odds by kind."""

    reliability: dict[tuple[int, int], tuple[float, float]] = field(default_factory=dict)
    prior: dict[int, float] = field(default_factory=dict)
    weights: dict[tuple[int, str], float] = field(default_factory=dict)


def _posterior(votes: list[int], prior: float, kind: int, reliability: dict) -> float:
    z = math.log(prior / (1 - prior))
    for n, v in enumerate(votes):
        right, wrong = reliability[kind, n]  # P(+1 | personal), P(+1 | not)
        if v:
            z += math.log(right / wrong) if v > 0 else math.log((1 - right) / (1 - wrong))
    return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def estimate(patterns: dict[tuple[int, str], int], rounds: int = 50) -> tuple[dict, dict, dict]:
    """EM over counts of vote patterns: reliabilities, priors, and the probability of each pattern."""
    own = {key: [int(v) for v in key[1].split(",")] for key in patterns}
    belief = {key: 0.9 if sum(v) > 0 else 0.1 for key, v in own.items()}
    reliability: dict = {}
    prior: dict = {}
    for _ in range(rounds):
        for kind in {k for k, _ in patterns}:
            keys = [key for key in patterns if key[0] == kind]
            yes = sum(patterns[k] * belief[k] for k in keys)
            total = sum(patterns[k] for k in keys)
            prior[kind] = (yes + 1) / (total + 2)
            for n in range(len(LABELERS)):
                cast = [k for k in keys if own[k][n]]
                plus = [k for k in cast if own[k][n] > 0]
                p = sum(patterns[k] * belief[k] for k in plus) + 2
                q = sum(patterns[k] * (1 - belief[k]) for k in plus) + 1
                # smoothing starts every labeler off as better than chance
                right = p / (sum(patterns[k] * belief[k] for k in cast) + 3)
                wrong = q / (sum(patterns[k] * (1 - belief[k]) for k in cast) + 3)
                reliability[kind, n] = (min(right, 0.999), min(max(wrong, 0.001), 0.999))
        belief = {k: _posterior(own[k], prior[k[0]], k[0], reliability) for k in patterns}
    return reliability, prior, belief


def fit_pii(candidates: DataFrame, column: str) -> PiiModel:
    """Fit from the proposed spans of all rows; what reaches the driver is bounded by kinds, vote patterns and feature values."""
    one = candidates.select(F.explode(column).alias("c")).select("c.kind", "c.votes", F.explode("c.features").alias("feature"))
    rows = one.groupBy("kind", "votes", "feature").agg(F.count("*").alias("n")).collect()
    patterns: dict[tuple[int, str], int] = defaultdict(int)
    for r in rows:
        if r["feature"].startswith("size="):  # one such feature per span
            patterns[r["kind"], r["votes"]] += r["n"]
    reliability, prior, belief = estimate(patterns)
    yes: dict = defaultdict(float)
    no: dict = defaultdict(float)
    for r in rows:
        p = belief[r["kind"], r["votes"]]
        yes[r["kind"], r["feature"]] += p * r["n"]
        no[r["kind"], r["feature"]] += (1 - p) * r["n"]
    total = {k: sum(n for (kind, _), n in patterns.items() if kind == k) for k in prior}
    sure = {k: sum(n * belief[key] for key, n in patterns.items() if key[0] == k) for k in prior}
    model = PiiModel(reliability, {k: math.log((sure[k] + 1) / (total[k] - sure[k] + 1)) for k in prior})
    for key in yes:
        p = (yes[key] + 0.5) / (sure[key[0]] + 1)
        q = (no[key] + 0.5) / (total[key[0]] - sure[key[0]] + 1)
        model.weights[key] = math.log(p / q)
    return model


def chosen_spans(column: Column, model: PiiModel) -> Column:
    """The base spans and the loose ones that the classifier takes for personal data, by kind and start."""
    known = [x for key, w in sorted(model.weights.items()) for x in (F.lit(f"{key[0]}|{key[1]}"), F.lit(w))]
    weights = F.create_map(*known) if known else F.create_map(F.lit(""), F.lit(0.0))
    priors = F.array(*(F.lit(float(model.prior.get(k, 0.0))) for k in range(len(KINDS))))

    def taken(c: Column) -> Column:
        key = lambda f: F.concat(c["kind"].cast("string"), F.lit("|"), f)
        odds = F.aggregate(c["features"], F.get(priors, c["kind"]), lambda s, f: s + F.coalesce(weights[key(f)], F.lit(0.0)))
        return c["base"] | (odds >= 0)

    cut = lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["stop"].alias("stop"), c["base"].alias("base"))
    return F.array_sort(F.transform(F.filter(column, taken), cut))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    one = lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def redact(docs: DataFrame, text: str = "text", size: str | None = "n_chars") -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; ``size``, if it exists, is counted anew.

    Proposed spans are computed twice, so that texts need not be stored or shuffled: once for the
    model, from a written table of the spans alone (a filter on an exploded list would otherwise
    be pushed below the matching and repeat it), and once for the result.
    """
    spans = fresh(docs.columns, "pii")
    marked = with_candidates(docs, text, spans)
    model = fit_pii(durable(marked.select(spans), "proposed"), spans)
    by_place = lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind"))
    placed = marked.withColumn(spans, F.array_sort(F.transform(chosen_spans(F.col(spans), model), by_place)))
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))

    # the text in pieces of equal length, so that what lies between two spans is found without a search
    pieces = fresh(placed.columns, "pieces")
    cut = F.regexp_extract_all(F.col(text), F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    placed = placed.withColumn(pieces, F.when(F.size(spans) > 0, cut))

    def between(start: Column, stop: Column) -> Column:
        first = F.floor(start / PIECE).cast("int")
        number = F.floor((stop - 1) / PIECE).cast("int") - first + 1
        around = F.array_join(F.slice(F.col(pieces), first + 1, F.greatest(number, F.lit(0))), "")
        return F.when(stop > start, F.substring(around, start - first * PIECE + 1, stop - start)).otherwise("")

    stops, upto, last = (fresh(placed.columns, n) for n in ("stops", "upto", "last"))
    placed = placed.withColumn(stops, F.transform(F.col(spans), lambda s: s["stop"]))
    placed = with_running(placed, {upto: stops}, 0, F.greatest)
    placed = placed.withColumn(last, F.coalesce(F.array_max(F.col(stops)), F.lit(0)))

    def replaced(s: Column, at: Column) -> Column:
        return F.when(s["start"] >= at, F.concat(between(at, s["start"]), F.get(names, s["kind"]))).otherwise("")

    rest = F.concat(F.array_join(F.zip_with(F.col(spans), F.col(upto), replaced), ""), between(F.col(last), F.length(F.col(text))))
    clean = F.when(F.size(spans) > 0, rest).otherwise(F.col(text))
    done = placed.withColumn(text, clean).drop(spans, pieces, stops, upto, last)
    counted = size and size.lower() in {c.lower() for c in docs.columns}
    return done.withColumn(size, F.length(text).cast(docs.schema[size].dataType)) if counted else done
