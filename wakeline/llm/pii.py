"""Personal data: high-recall generators, boosted trees over format and context, calibrated thresholds.

Everything that touches the corpus is DataFrame functions. Base spans (emails, IPv4 addresses, payment cards, telephone
numbers) follow fixed patterns and always stay. Generators propose further spans, which may overlap: obfuscated emails,
grouped or long digit runs, token-like strings. Each gets features of its format (digits, separators, shapes, check
digit) and of its context (the words before it, the characters beside it). Gradient-boosted trees of depth two, trained
on a synthetic set whose spans are known, become CASE expressions; a threshold for each kind, calibrated on the part of
that set that the trees have not seen, decides. An added span that overlaps a base span, or an added one with a higher
score, is dropped.

The patterns equal the base patterns but are written so that Java's matcher neither recurses nor backtracks over long
runs (possessive quantifiers; a run is entered at its start or where the last match ended). Running sums over the
matches of a text and comparisons between its spans go by blocks of `BLOCK`, so that the time of a text with very many
matches grows little faster than its length.

Edge cases: a null text is empty and has no spans; empty, blank and very long texts are ordinary; a null doc_id is kept;
repeated rows are treated alike; other columns, whatever their names, pass through `redact` and are ignored by
`find_pii`.
"""

from __future__ import annotations

import json
import math
import random
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.llm.common import spare

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "id", "secret")
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Cheap tests that a text must pass to hold a span of the kind or generator at all.
GATE = {"email": "@", "ip": ".", "phone": "+"}
GENERATORS = {
    "mail_marked": r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:\[at\]|\(at\)|\{at\}) ?[A-Za-z0-9-]++(?: ?(?:\.|\[dot\]|\(dot\)|\{dot\}) ?[A-Za-z0-9-]++)++",
    "mail_spoken": r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ at [A-Za-z0-9-]++(?: dot [A-Za-z0-9-]++(?= dot [A-Za-z]{2}))*+ dot [A-Za-z]{2,}+",
    "digits_grouped": r"(?<![0-9A-Za-z+])\(?[0-9]{2,4}+\)?(?:[\x20./-]{1,2}+[0-9]{2,7}+){2,4}+(?![0-9A-Za-z])",
    "digits_long": r"(?<![0-9A-Za-z])[0-9]{9,}+(?![0-9A-Za-z])",
    "token": r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}+",
    "token_base64": r"(?<![A-Za-z0-9_+/-])(?=[A-Za-z0-9_-]*+[+/=])[A-Za-z0-9_+/-]{20,}+={0,2}+",
}
CONTEXT, BLOCK = 32, 64
WORDS = {
    "phone": r"phone|tel|call|mobile|cell|fax|whatsapp",
    "card": r"card|visa|credit|debit|mastercard|amex|pan\b",
    "mail": r"mail|contact|write|reach",
    "id": r"ssn|social|passport|national id|tax id|id no",
    "secret": r"key|token|secret|password|passwd|pwd|bearer|credential",
    "other": r"order|invoice|isbn|version|commit|sha|hash|date|ref|sku|part|serial|article",
}
FEATURES = ("digits", "length", "letters", "separators", "luhn", "shape_phone", "shape_id", "shape_card", "shape_date", "distinct", "hex", "capitals", "changes", *(f"near_{k}" for k in WORDS), *(f"by_{g}" for g in GENERATORS), "beside", "zeros")
TREES, RATE, PRECISION, TRAINING, SEED = 60, 0.3, 0.99, 3600, 11


def luhn(digits: Column) -> Column:
    r = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substr(r, i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0))

    return (F.length(digits) > 0) & (F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1))), F.lit(0), add) % 10 == 0)


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, as lambdas would otherwise repeat its expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def in_blocks(items: Column) -> Column:
    """An array cut into arrays of at most BLOCK items; a single empty one for none."""
    last = F.greatest(F.ceil(F.size(items) / BLOCK).cast("int") - 1, F.lit(0))
    return F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(items, b * BLOCK + 1, BLOCK))


def running(items: Column, kind: str, value, plus, zero: int = 0) -> Column:
    """array<struct<before: int, item: kind>>: each item with what the values of those before it come to."""
    at = F.lit(zero)

    def offsets(blocks: Column) -> Column:
        start = F.struct(F.array().cast("array<int>").alias("all"), at.alias("at"))
        return F.aggregate(blocks, start, lambda acc, b: F.struct(F.concat(acc["all"], F.array(acc["at"])).alias("all"), plus(acc["at"], F.aggregate(b, at, lambda x, i: plus(x, value(i)))).alias("at")))["all"]

    def within(block: Column, before: Column) -> Column:
        start = F.struct(F.array().cast(f"array<struct<before:int,item:{kind}>>").alias("all"), before.alias("at"))
        step = lambda acc, i: F.struct(F.concat(acc["all"], F.array(F.struct(acc["at"].alias("before"), i.alias("item")))).alias("all"), plus(acc["at"], value(i)).alias("at"))
        return F.aggregate(block, start, step)["all"]

    return let(items, lambda x: let(in_blocks(x), lambda b: F.flatten(F.zip_with(b, offsets(b), within))))


def located(text: Column, pattern: str, gate: str | None = None) -> Column:
    """array<struct<start, end, match, before, next>> of the matches of a pattern, left to right, in code points, end
    exclusive; `before` is the text since the match before it (the last CONTEXT characters), `next` the character behind.

    The pieces between the matches come from splitting by the same pattern, so each match starts where its piece ends.
    """
    matches, pieces = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    if gate:
        passes = F.contains(F.lower(text), F.lit(gate))
        matches, pieces = (F.when(passes, x).otherwise(F.array().cast("array<string>")) for x in (matches, pieces))

    def span(x: Column) -> Column:
        i = x["item"]
        start = x["before"] + F.length(i["piece"])
        context = F.lower(F.substring(i["piece"], -CONTEXT, CONTEXT))
        return F.struct(start.alias("start"), (start + F.length(i["match"])).alias("end"), i["match"].alias("match"), context.alias("before"), i["next"].alias("next"))

    def found(m: Column) -> Column:
        def paired(p: Column) -> Column:
            follow = F.transform(F.slice(p, 2, F.size(m)), lambda x: F.substring(x, 1, 1))
            return F.zip_with(F.arrays_zip(m.alias("match"), F.slice(p, 1, F.size(m)).alias("piece")), follow, lambda x, n: F.struct(x["match"].alias("match"), x["piece"].alias("piece"), n.alias("next")))

        return F.transform(running(let(pieces, paired), "struct<match:string,piece:string,next:string>", lambda i: F.length(i["piece"]) + F.length(i["match"]), lambda a, b: a + b), span)

    none = F.array().cast("array<struct<start:int,end:int,match:string,before:string,next:string>>")
    return let(matches, lambda m: F.when(F.size(m) == 0, none).otherwise(found(m)))


def untouched(spans: Column, others: Column, beats) -> Column:
    """The spans, by start, that overlap none of `others` with beats(other, span). Both must have start and end first."""

    def bounded(block: Column) -> Column:
        ends = F.aggregate(block, F.lit(0), lambda a, x: F.greatest(a, x["end"]))
        return F.struct(F.coalesce(F.get(block, F.lit(0))["start"], F.lit(0)).alias("lo"), ends.alias("hi"), block.alias("items"))

    def blocks(x: Column) -> Column:
        return F.transform(in_blocks(x), bounded)

    def left(o: Column, s: Column) -> Column:
        def alone(b: Column) -> Column:
            near = F.filter(o, lambda c: (c["lo"] < b["hi"]) & (b["lo"] < c["hi"]))
            return let(near, lambda n: F.filter(b["items"], lambda x: ~F.exists(n, lambda c: F.exists(c["items"], lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"]) & beats(y, x)))))

        return F.flatten(F.transform(blocks(s), alone))

    return let(F.array_sort(others), lambda o: F.when(F.size(o) == 0, spans).otherwise(let(blocks(o), lambda c: let(F.array_sort(spans), lambda s: left(c, s)))))


def base_spans(text: Column, kind: str) -> Column:
    def part(p: Column) -> Column:
        q = F.ltrim(p, F.lit("0"))
        return (F.length(q) <= 3) & (F.coalesce(q.try_cast("int"), F.lit(0)) <= 255)

    valid = {
        "email": lambda s: F.lit(True),
        "ip": lambda s: F.forall(F.split(s["match"], r"\."), part),
        "card": lambda s: F.length(_digits(s["match"])).between(13, 19) & luhn(_digits(s["match"])),
        "phone": lambda s: F.length(_digits(s["match"])).between(9, 15),
    }[kind]
    spans = located(text, BASE[kind], GATE.get(kind))
    return F.transform(F.filter(spans, valid), lambda s: F.struct(F.lit(KINDS.index(kind)).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def candidates(text: Column) -> Column:
    """array<struct<start, end, match, before, next, generator>> of all that the generators propose."""
    gates = {"mail_spoken": " dot ", "mail_marked": "at"}
    named = lambda name: lambda s: F.struct(*(s[c].alias(c) for c in ("start", "end", "match", "before", "next")), F.lit(name).alias("generator"))
    return F.concat(*(F.transform(located(text, pattern, gates.get(name)), named(name)) for name, pattern in GENERATORS.items()))


def features(c: Column) -> dict[str, Column]:
    m, d = c["match"], _digits(c["match"])
    is_ = lambda x: F.when(x, 1.0).otherwise(0.0)
    out = {
        "digits": F.length(d), "length": F.length(m), "letters": F.length(F.regexp_replace(m, "[^A-Za-z]", "")), "separators": F.length(F.regexp_replace(m, r"[A-Za-z0-9]", "")),
        "luhn": is_(F.length(d).between(13, 19) & luhn(d)),
        "shape_phone": is_(F.regexp_like(m, F.lit(r"^\(?[0-9]{3}\)?[ .-]{1,2}[0-9]{3}[ .-][0-9]{4}$"))),
        "shape_id": is_(F.regexp_like(m, F.lit("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"))),
        "shape_card": is_(F.regexp_like(m, F.lit("^[0-9]{4}([ -]?)[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{1,7}$"))),
        "shape_date": is_(F.regexp_like(m, F.lit(r"^((19|20)[0-9]{2}[-/. ][0-9]{1,2}[-/. ][0-9]{1,2}|[0-9]{1,2}[-/. ][0-9]{1,2}[-/. ](19|20)[0-9]{2})\b"))),
        "distinct": F.size(F.array_distinct(F.split(m, ""))), "hex": is_(F.regexp_like(m, F.lit("^[0-9a-f]+$"))),
        "capitals": F.length(F.regexp_replace(m, "[^A-Z]", "")), "changes": F.length(F.regexp_replace(m, "[0-9]+|[a-z]+|[A-Z]+", "x")),
        "beside": is_(F.regexp_like(F.concat(F.substr(c["before"], F.length(c["before"]), F.lit(1)), c["next"]), F.lit("[0-9A-Za-z_/]"))),
        "zeros": is_(F.startswith(m, F.lit("0"))),
    }
    out |= {f"near_{k}": is_(F.regexp_like(c["before"], F.lit(rf"({p})[^0-9]*$"))) for k, p in WORDS.items()}
    out |= {f"by_{g}": is_(c["generator"] == g) for g in GENERATORS}
    return {k: out[k].cast("double") for k in FEATURES}


def kind_of(c: Column) -> Column:
    """The kind that a proposed span would have."""
    n, k = F.length(_digits(c["match"])), KINDS.index
    digits = F.when(F.regexp_like(c["match"], F.lit("^[0-9]{3}-[0-9]{2}-[0-9]{4}$")), k("id")).when(n >= 13, k("card")).otherwise(k("phone"))
    return F.when(F.startswith(c["generator"], F.lit("mail")), k("email")).when(F.startswith(c["generator"], F.lit("token")), k("secret")).otherwise(digits)


@dataclass
class PiiModel:
    constant: float
    trees: list  # (feature, cut, left, right), where left and right are (feature, cut, value, value)
    thresholds: dict[int, float]  # by kind, on the score


def synthetic(n: int = TRAINING, seed: int = SEED) -> list[tuple[str, int, int, int]]:
    """(text, start, end, label) of texts with one span each that is personal data or only looks like it."""
    r = random.Random(seed)
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice(["an", "ber", "tion", "re", "lo", "mi", "che", "ou", "st", "ka"]) for _ in range(r.randint(1, 4)))
    words = lambda k: " ".join(word() for _ in range(k))
    long_word = lambda k: "".join(word() for _ in range(k))[:k]
    token = lambda k: "".join(r.choice(r.choice(["0123456789abcdef", "abcdefghijklmnopqrstuvwxyz0123456789"])) for _ in range(k))

    def card() -> str:
        body = r.choice("3456") + digits(r.choice([12, 14, 14, 14, 15]))
        total = sum(d if i % 2 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(body))))
        full = body + str(-total % 10)
        return full if r.random() < 0.5 else " ".join(full[i : i + 4] for i in range(0, len(full), 4))

    says = {"phone": ["phone", "tel", "call", "mobile", "fax"], "card": ["card", "visa", "credit card"], "mail": ["mail", "contact", "write to"], "id": ["SSN", "social security", "passport"], "secret": ["api_key =", "token =", "secret:", "password ="], "other": ["order", "invoice", "ISBN", "version", "commit", "ref", "serial", "sku"]}
    lead = lambda k, p=0.8: f"{r.choice(says[k])}{r.choice([' ', ': ', ' '])}" if r.random() < p else ""
    yes = [
        lambda: (lead("mail", 0.4), f"{word()}{r.choice(['.', '_', ''])}{word()}{r.choice([' [at] ', '[at]', ' (at) ', '{at}'])}{word()}{r.choice([' [dot] ', '.', '(dot)'])}{r.choice(['com', 'org', 'net', 'de'])}"),
        lambda: (lead("mail", 0.8), f"{word()} at {word()} dot {r.choice(['com', 'org', 'net'])}"),
        lambda: (lead("phone", 0.7), r.choice(["({}) {}-{}", "{}-{}-{}", "{}.{}.{}"]).format(r.choice("23456789") + digits(2), digits(3), digits(4))),
        lambda: (lead("phone", 1), digits(10)),
        lambda: (lead("card", 0.6), card()),
        lambda: (lead("card", 1), digits(16)),
        lambda: (lead("id", 0.7), f"{digits(3)}-{digits(2)}-{digits(4)}"),
        lambda: (lead("secret", 1) + r.choice(['"', "'", ""]), token(r.choice([24, 32, 40, 256]))),
        lambda: (lead("secret", 0.3), r.choice(["AK", "AKIA", "SK"]) + "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(r.choice([16, 20, 28])))),
        lambda: (lead("secret", 1), "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(r.choice([24, 40, 88]) - 2)) + "=="),
    ]
    no = [
        lambda: (lead("other", 0.5), digits(r.randint(9, 19))),
        lambda: ("", digits(16)),
        lambda: (lead("other", 0.3), f"{r.randint(1950, 2030)}{r.choice('-/.')}{r.randint(1, 12):02}-{r.randint(1, 28):02}"),
        lambda: (lead("other", 0.5), f"{r.randint(1, 28):02}.{r.randint(1, 12):02}.{r.randint(1950, 2030)}"),
        lambda: (lead("other", 0.6), f"{digits(2)} {digits(3)} {digits(3)}"),
        lambda: (lead("other", 0.8), f"978-{digits(1)}{digits(1)}-{digits(5)}-{digits(3)}"),
        lambda: (lead("other", 0.8), token(40)),
        lambda: ("", "".join(word() for _ in range(8)) + "tionstber"),
        lambda: (lead("other", 0.2), long_word(r.randint(20, 60)) + r.choice(["", "s", "en"])),
        lambda: (lead("secret", 0.1), long_word(r.randint(20, 40)).capitalize()),
        lambda: ("", "_".join(word() for _ in range(6)) + r.choice(["_maximum_value", "_2"])),
        lambda: ("", "".join(word().capitalize() for _ in range(r.randint(5, 9))) + r.choice(["", "V2"])),
        lambda: ("", "/".join(word() for _ in range(8)) + "/index"),
        lambda: (r.choice(["/", "v", "#"]), f"{digits(2)}.{digits(2)}.{digits(3)}.{digits(2)}.{digits(2)}"),
    ]
    out = []
    for i in range(n):
        label = i % 2
        before, span = r.choice(yes if label else no)()
        head = f"{words(r.randint(2, 6))} {before}"
        out.append((f"{head}{span}{r.choice([' ', '.', ', ', '; '])}{words(3)}", len(head), len(head) + len(span), label))
    return out


def _stump(x: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[float, int, float]:
    """(gain, feature, cut) of the best split of these rows by the second-order gain."""
    best = (0.0, 0, math.inf)
    score = lambda a, b: a * a / (b + 1.0)
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, cg, ch = x[order, f], np.cumsum(g[order]), np.cumsum(h[order])
        at = np.flatnonzero(v[1:] > v[:-1])
        if len(at):
            gain = score(cg[at], ch[at]) + score(cg[-1] - cg[at], ch[-1] - ch[at]) - score(cg[-1], ch[-1])
            k = int(gain.argmax())
            if gain[k] > best[0] + 1e-9:
                best = (float(gain[k]), f, float((v[at[k]] + v[at[k] + 1]) / 2))
    return best


def boost(x: np.ndarray, y: np.ndarray) -> tuple[float, list]:
    """Gradient boosting for the logistic loss; trees of depth two."""
    p0 = float(np.clip(y.mean(), 0.01, 0.99))
    constant = math.log(p0 / (1 - p0))
    f, trees = np.full(len(y), constant), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-f))
        g, h = y - p, p * (1 - p)
        gain, a, cut = _stump(x, g, h)
        if not gain:
            break
        sides = []
        for rows in (x[:, a] < cut, x[:, a] >= cut):
            _, b, c = _stump(x[rows], g[rows], h[rows])
            low = rows & (x[:, b] < c)
            high = rows & (x[:, b] >= c)
            values = [RATE * float(g[s].sum() / (h[s].sum() + 1.0)) for s in (low, high)]
            f[low] += values[0]
            f[high] += values[1]
            sides.append((b, min(c, 1e300), *values))
        trees.append((a, cut, *sides))
    return constant, trees


def raw_score(model: PiiModel, x: dict[str, Column]) -> Column:
    """The trees' score; the features are computed once, not wherever a tree asks for one."""
    names = sorted({FEATURES[f] for a, _, low, high in model.trees for f in (a, low[0], high[0])})

    def total(v: Column) -> Column:
        side = lambda s: F.when(v[FEATURES[s[0]]] < s[1], s[2]).otherwise(s[3])
        return sum((F.when(v[FEATURES[a]] < cut, side(low)).otherwise(side(high)) for a, cut, low, high in model.trees), F.lit(model.constant))

    return let(F.struct(*(x[k].alias(k) for k in names)), total) if names else F.lit(model.constant)


def fit_pii(spark: SparkSession, n: int = TRAINING, seed: int = SEED) -> PiiModel:
    """Train on the synthetic set (n texts): trees on two thirds, thresholds on the rest."""
    rows = [{"i": i, "text": t, "lo": a, "hi": b, "label": y} for i, (t, a, b, y) in enumerate(synthetic(n, seed))]
    data = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), "array<struct<i:int,text:string,lo:int,hi:int,label:int>>")).alias("r")).select("r.*")
    cand = data.select("i", "lo", "hi", "label", F.explode(candidates(F.col("text"))).alias("c"))
    hit = (F.col("label") == 1) & (F.col("c.start") < F.col("hi")) & (F.col("c.end") > F.col("lo"))
    got = cand.select("i", hit.cast("double").alias("y"), kind_of(F.col("c")).alias("kind"), *(v.alias(k) for k, v in features(F.col("c")).items())).orderBy("i", *FEATURES).collect()
    x, y = np.array([[r[k] for k in FEATURES] for r in got]), np.array([r["y"] for r in got])
    i, kind = np.array([r["i"] for r in got]), np.array([r["kind"] for r in got])
    train = (i // 2) % 3 != 0
    constant, trees = boost(x[train], y[train])
    model = PiiModel(constant, trees, {})
    score = np.full(len(y), constant)
    for a, cut, low, high in trees:
        side = [np.where(x[:, s[0]] < s[1], s[2], s[3]) for s in (low, high)]
        score += np.where(x[:, a] < cut, *side)
    for k in range(len(KINDS)):
        own = ~train & (kind == k)
        order = np.argsort(-score[own], kind="stable")
        s, good = score[own][order], y[own][order]
        ok = np.flatnonzero(np.cumsum(good) >= PRECISION * np.arange(1, len(good) + 1))
        model.thresholds[k] = max(0.0, float(s[ok[-1]])) if len(ok) else math.inf
    return model


def added_spans(text: Column, base: Column, model: PiiModel) -> Column:
    """array<struct<start, end, kind, score, generator>> of the proposed spans that pass their thresholds and touch no base span."""
    scored = lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), kind_of(c).alias("kind"), raw_score(model, features(c)).alias("score"), c["generator"].alias("generator"))
    cut = F.create_map(*(x for k, v in model.thresholds.items() for x in (F.lit(k), F.lit(min(v, 1e300)))))
    return F.filter(F.transform(untouched(candidates(text), base, lambda b, c: F.lit(True)), scored), lambda s: s["score"] >= F.element_at(cut, s["kind"]))


def with_spans(docs: DataFrame, model: PiiModel, text: str, base: str, spans: str) -> DataFrame:
    """`docs` with columns of these names: the text (null: empty), the base spans (a struct with one array for each kind) and
    all spans as array<struct<start, end, kind>> by start."""
    flat, added = spare([*docs.columns, text, base, spans], "_flat", "_added")
    df = docs.withColumn(text, F.coalesce(F.col("text"), F.lit("")))
    df = df.withColumn(base, F.struct(*(base_spans(F.col(text), k).alias(k) for k in BASE_KINDS)))
    by_start = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))
    df = df.withColumn(flat, F.transform(F.concat(*(F.col(f"{base}.{k}") for k in BASE_KINDS)), by_start))
    df = df.withColumn(added, added_spans(F.col(text), F.col(flat), model))
    rank = lambda s: F.struct(s["score"], s["end"] - s["start"], -s["start"], -s["kind"], s["generator"])
    better = lambda o, s: rank(o) > rank(s)
    alone = F.transform(untouched(F.col(added), F.col(added), better), by_start)
    return df.withColumn(spans, F.array_sort(F.concat(flat, alone))).drop(flat, added)


def joined(spans: Column) -> Column:
    name = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"], s["end"])), ",")


def find_pii(docs: DataFrame, model: PiiModel) -> DataFrame:
    """doc_id, the number of base spans of each kind, the SHA-256 of the base spans and all spans."""
    df = with_spans(docs.select("doc_id", "text"), model, "_text", "_base", "_spans")
    base = joined(F.concat(*(F.col(f"_base.{k}") for k in BASE_KINDS)))
    by_kind = F.array_sort(F.transform("_spans", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))))
    return df.select("doc_id", *(F.size(f"_base.{k}").cast("long").alias(f"n_{k}") for k in BASE_KINDS), F.sha2(base, 256).alias("base_sha256"), joined(by_kind).alias("spans"))


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span, or run of overlapping spans, replaced by the kind of its first in capitals and brackets."""
    mark = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))

    def block(part: Column) -> Column:
        # One cut of the text for a block of spans, so that positions within it are near its start.
        lo = F.get(part, F.lit(0))["before"]
        hi = F.aggregate(part, lo, lambda a, x: F.greatest(a, x["item"]["end"]))

        def put(cut: Column) -> Column:
            piece = lambda x: F.when(x["item"]["start"] >= x["before"], F.concat(F.substr(cut, x["before"] - lo + 1, x["item"]["start"] - x["before"]), F.get(mark, x["item"]["kind"]))).otherwise("")
            return F.array_join(F.transform(part, piece), "")

        return let(F.substr(text, lo + 1, hi - lo), put)

    end = F.aggregate(spans, F.lit(0), lambda a, x: F.greatest(a, x["end"]))
    done = let(running(spans, "struct<start:int,end:int,kind:int>", lambda i: i["end"], lambda a, b: F.greatest(a, b)), lambda x: F.array_join(F.transform(in_blocks(x), block), ""))
    return F.concat(done, F.substr(text, end + 1, F.length(text)))


def redact(docs: DataFrame, model: PiiModel) -> DataFrame:
    """`docs` with each span of its text replaced by its kind in capitals and brackets; a null text stays null."""
    text, base, spans = spare(docs.columns, "_text", "_base", "_spans")
    df = with_spans(docs, model, text, base, spans)
    new = F.when(F.col("text").isNull(), None).when(F.size(spans) == 0, F.col("text")).otherwise(redacted(F.col(text), F.col(spans)))
    return df.withColumn("text", new).select(*(F.col(f"`{c}`") for c in docs.columns))
