"""Personal data: patterns propose spans, boosted trees choose among them; DataFrame functions only.

Base spans (e-mail, IP, card, phone) follow fixed patterns and checks and always stay. Generators of high recall propose
further, overlapping spans: e-mail addresses written out in words or signs, phone numbers without a country code or with
a leading zero, account and social security numbers, assigned secrets of any length, bare keys, private key blocks. Each
candidate gets features of its form and its surroundings, and gradient-boosted trees, written out as CASE expressions,
give it a score. A candidate above its kind's threshold is added unless it overlaps a base span or a longer one (of equal
length the one with the better score) that is added. The trees are trained on the driver on a fixed number of generated examples (EXAMPLES), whose features come
from the same expressions; half of the examples set the thresholds.

Every pattern runs in time proportional to the text: where the plain form of a pattern would try each character of a
long run, the form used starts at a run's first character only, with the same matches. Offsets are running sums of the
lengths of gaps and matches, made in pieces of STEP, so that a text of many thousand matches takes time in proportion;
overlaps are settled within runs of spans that touch. Offsets are code points. Null text counts as empty. Nothing is
shuffled, so repeated rows and null ids need no care; columns of the input with the name of an output are replaced.
"""

from __future__ import annotations

import random
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.llm.common import others

#: The base patterns; possessive and anchored at the start of a run, with the contract's matches.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be tried.
HINT = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
EDGE, NO_EDGE = r"(?<![A-Za-z0-9])", r"(?![A-Za-z0-9])"
_AT, _DOT = r"(?:\x20?(?:\[at\]|\(at\)|\{at\}|<at>)\x20?|\x20at\x20)", r"(?:\.|\x20?(?:\[dot\]|\(dot\)|\{dot\}|<dot>)\x20?|\x20dot\x20)"
PROPOSED = {
    "email_words": r"(?i)" + EDGE + r"[A-Za-z0-9._%+-]++" + _AT + r"[A-Za-z0-9-]++(?:" + _DOT + r"[A-Za-z0-9-]++)++(?!\x20at\x20)",
    "iban": EDGE + r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?" + NO_EDGE,
    "phone_local": r"(?<![A-Za-z0-9+.-])(?:\(?[0-9]{3}\)?[\x20.-]?[0-9]{3}[\x20.-][0-9]{4}|\(?0[0-9]{1,4}\)?(?:[\x20./-][0-9]{2,7}){1,4})" + NO_EDGE,
    "secret": r"(?i)" + EDGE + r"(?:[A-Za-z0-9]{1,20}[_-]){0,4}(?:api[_-]?key|access[_-]?key|private[_-]?key|auth[_-]?key|key|token|bearer|secret|passwd|passphrase|password|pwd)\"?\x20?(?::=|=>|[=:])\x20?[\"']?[A-Za-z0-9_/+.!@#$%^&*~-][A-Za-z0-9_/+.!@#$%^&*~=-]{5,}+[\"']?",
    "ssn": r"(?<![A-Za-z0-9-])[0-9]{3}[\x20-][0-9]{2}[\x20-][0-9]{4}(?![A-Za-z0-9-])",
    "bare_key": r"(?<![A-Za-z0-9_/+.=-])(?:(?:AKIA|ASIA)[A-Z0-9]{16}+|gh[pousr]_[A-Za-z0-9]{20,}+|(?:sk|pk|rk)[_-][A-Za-z0-9_-]{16,}+|xox[abprs]-[A-Za-z0-9-]{10,}+|eyJ[A-Za-z0-9_-]{8,}+(?:\.[A-Za-z0-9_-]++){1,4}|[A-Za-z0-9_/+-]{32,}+={0,2})" + NO_EDGE,
    "private_key": r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY(?: BLOCK)?-----[A-Za-z0-9+/=:,.\s()-]*+",
}
PROPOSED_HINT = {"email_words": r"(?i)(?:[\[({<]at[\])}>]|\x20at\x20[A-Za-z0-9-]++(?:\.|\x20dot\x20|\x20?[\[({<]dot))", "iban": r"[A-Z]{2}[0-9]{2}", "phone_local": r"[0-9]{3}[\x20./-]?[0-9]{2}|0[0-9]{1,4}\)?[\x20./-][0-9]", "secret": r"(?i)(?:key|token|bearer|secret|passwd|passphrase|password|pwd)\"?\x20?[=:]", "ssn": r"[0-9]{3}[\x20-][0-9]{2}[\x20-]", "bare_key": r"[A-Za-z0-9_/+-]{16}", "private_key": r"PRIVATE KEY"}
CUES = r"(?i)(?:mail|contact|write|call|phone|tel|mobile|fax|reach|account|iban|bank|pay|ssn|social|security|insurance|login|key|auth|secret|token|credential|bearer|whatsapp|sms)"
OTHER_CUES = r"(?i)(?:order|invoice|version|isbn|ref|item|part|serial|build|commit|sha|hash|md5|checksum|digest|page|room|track|score|ticket|case|model|date|id)\b[^A-Za-z]*$"
DOMAIN = r"(?i)[^a-z](?:com|org|net|edu|gov|info|io|ai|app|dev|co|eu|de|fr|es|it|nl|ch|at|be|pl|se|no|dk|fi|pt|uk|us|ca|au|in|jp|cn|br|mx|ru)$"
SPAN = "array<struct<s:int,e:int,m:string,left:string,right:string>>"
AROUND, STEP = 24, 256
EXAMPLES, TREES, RATE, PRECISION = 3500, 60, 0.3, 0.98


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value worked out once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def running(values: Column, plus: Callable[[Column, Column], Column]) -> Column:
    """For each of the integers in an array, what plus makes of those before it, from 0 on."""
    def scan(piece: Column, start: Column) -> Column:
        return F.slice(F.aggregate(piece, F.array(start), lambda acc, x: F.array_append(acc, plus(F.element_at(acc, -1), x))), F.lit(1), F.size(piece))

    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / STEP).cast("int")), lambda k: F.slice(values, k * STEP + 1, F.lit(STEP)))
    return _let(cut, lambda pieces: F.flatten(F.zip_with(pieces, scan(F.transform(pieces, lambda p: F.aggregate(p, F.lit(0), plus)), F.lit(0)), scan)))


def spans(text: Column, pattern: str, hint: str) -> Column:
    """All matches of a pattern from the left, as (s, e, m, left, right): the offsets, the match, what is before it (up to
    the match before) and the character behind it."""
    def placed(pairs: Column) -> Column:
        lengths = F.transform(pairs, lambda x: F.char_length(x["gap"]) + F.char_length(x["m"]))
        begins = _let(lengths, lambda n: running(n, lambda a, b: a + b))

        def span(x: Column, at: Column) -> Column:
            s = at + F.char_length(x["gap"])
            return F.struct(s.alias("s"), (s + F.char_length(x["m"])).alias("e"), x["m"].alias("m"), F.right(x["gap"], F.lit(AROUND)).alias("left"), F.left(x["next"], F.lit(1)).alias("right"))

        return F.zip_with(pairs, begins, span)

    def paired(v: Column) -> Column:
        before, after = (F.slice(v["g"], F.lit(i), F.size(v["f"])) for i in (1, 2))
        one = F.zip_with(v["f"], before, lambda m, gap: F.struct(m.alias("m"), gap.alias("gap")))
        return F.zip_with(one, after, lambda x, n: F.struct(x["m"].alias("m"), x["gap"].alias("gap"), n.alias("next")))

    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("f"), F.split(text, pattern, -1).alias("g"))
    found = _let(_let(both, paired), placed)
    return F.when(text.rlike(hint), found.cast(SPAN)).otherwise(F.array().cast(SPAN))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


VALID = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: F.forall(F.split(m, r"\."), lambda p: F.coalesce(p.try_cast("int") <= 255, F.lit(False))),
    "card": lambda m: F.char_length(_digits(m)).between(13, 19) & F.call_function("luhn_check", _digits(m)),
    "phone": lambda m: F.char_length(_digits(m)).between(9, 15),
}


def base_spans(text: Column) -> dict[str, Column]:
    def valid(kind: str) -> Column:
        right = F.filter(spans(text, BASE[kind], HINT[kind]), lambda x: VALID[kind](x["m"]))
        return F.transform(right, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))

    return {kind: valid(kind) for kind in BASE}


FEATURES = ["kind", "length", "digits", "letters", "upper", "runs", "variety", "zeros", "first", "cue", "other_cue", "glued_left", "glued_right", "quoted", "mixed", "marked", "words", "domain"]


def _features(kind: int, x: Column) -> Column:
    """The features of candidate x as doubles, in the order of FEATURES."""
    m = x["m"]
    tail = F.regexp_replace(m, r"^[^=:]*[=:][=>]?\x20?[\"']?", "")  # of an assignment, what is assigned
    count = lambda c, r: F.char_length(F.regexp_replace(c, r, ""))
    yes = lambda c: c.cast("double")
    first = F.coalesce(F.substring(_digits(m), 1, 3).try_cast("double"), F.lit(-1.0))
    made = [F.lit(float(kind)), F.char_length(tail), F.char_length(_digits(tail)), count(tail, "[^A-Za-z]"), count(tail, "[^A-Z]"),
            F.size(F.split(tail, r"[^A-Za-z0-9]+")), F.size(F.array_distinct(F.split(F.left(tail, F.lit(64)), ""))), count(tail, "[^0]"), first, yes(x["left"].rlike(CUES)), yes(x["left"].rlike(OTHER_CUES)),
            yes(x["left"].rlike("[A-Za-z0-9]$")), yes(x["right"].rlike("^[A-Za-z0-9]")), yes(m.rlike("[\"']")), yes(tail.rlike("[0-9][A-Za-z]") & tail.rlike("[A-Za-z][0-9]")),
            yes(m.rlike(r"^(?:AKIA|ASIA|gh[pousr]_|(?:sk|pk|rk)[_-]|xox[abprs]-|eyJ)|[\[({<]|(?i)\x20dot\x20")), yes(tail.rlike("^[a-z]+(?:[_.-][a-z]+)*[\"']?$")), yes(m.rlike(DOMAIN))]
    return F.array(*(F.coalesce(c.cast("double"), F.lit(0.0)) for c in made))


def candidates(text: Column) -> Column:
    """All proposed spans, as (kind, s, e, f: features)."""
    def proposed(n: int, kind: str) -> Column:
        found = spans(text, PROPOSED[kind], PROPOSED_HINT[kind])
        return F.transform(found, lambda x: F.struct(F.lit(kind).alias("kind"), x["s"].alias("s"), x["e"].alias("e"), _features(n, x).alias("f")))

    return F.concat(*(proposed(n, kind) for n, kind in enumerate(PROPOSED)))


def examples(n: int = EXAMPLES, seed: int = 5) -> list[tuple[str, str, float]]:
    """Generated texts with one candidate each: (text, kind, 1 for personal data)."""
    r = random.Random(seed)
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("abcdefghijklmnoprstuvw") for _ in range(r.randint(2, 9)))
    words = lambda k: " ".join(word() for _ in range(k))
    code = lambda k, letters: "".join(r.choice(letters) for _ in range(k))
    # Half of the secrets are longer, up to some thousand characters, plain or in parts or padded; they have their own source of chance.
    own = random.Random(seed + 1)
    part = lambda k: "".join(own.choice("0123456789abcdefABCDEFghkmz") for _ in range(k))

    def longer() -> str:
        k = int(2 ** own.uniform(5.5, 12))
        return own.choice([part(k), part(k), part(k) + own.choice(["=", "=="]), f"eyJ{part(k // 3)}.eyJ{part(k // 2)}.{part(43)}", f"{part(k)}_{part(9)}-{part(9)}"])

    hexes, mixed = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"

    def one(kind: str, good: bool) -> str:
        if kind == "email_words":
            at, dot = r.choice([("[at]", "[dot]"), ("(at)", "(dot)"), (" [at] ", " [dot] "), (" (at) ", "."), ("{at}", "{dot}"), (" at ", " dot "), (" AT ", " DOT "), (" <at> ", " <dot> ")])
            if good:
                return f"{r.choice([word() + '.' + word(), word(), word() + digits(2)])}{at}{word()}{dot}{r.choice(['com', 'org', 'net', 'io', 'co', 'de', 'fr', 'uk'])}"
            return r.choice([f"{word()}{at}{word()} dot {word()}", f"{digits(2)} at {digits(2)}.{digits(1)}", f"{word()} at {word()}.{word()}", f"{word()} at {digits(1)}.{digits(2)}", f"{digits(2)}[at]{digits(2)}.{digits(1)}"])
        if kind == "iban":
            return r.choice(["DE", "GB", "FR", "ES", "NL", "IT", "CH"]) + digits(2) + (" " * r.randint(0, 1)).join(["", *(digits(4) for _ in range(r.randint(3, 6)))]) + r.choice(["", digits(2)]) if good else code(2, "ABX") + digits(2) + code(r.choice([12, 16]), "ABCDEFXYZ")
        if kind == "phone_local":
            area, zero = str(r.randint(200, 999)), "0" + digits(r.randint(2, 4))
            if good:
                return r.choice([f"({area}) {digits(3)}-{digits(4)}", f"{area}-{digits(3)}-{digits(4)}", f"{area}.{digits(3)}.{digits(4)}", f"{area} {digits(3)} {digits(4)}", f"{zero} {digits(3)} {digits(4)}", f"{zero}/{digits(7)}", f"({zero}) {digits(6)}", f"0{digits(1)} {digits(2)} {digits(2)} {digits(2)} {digits(2)}"])
            return r.choice([f"{r.choice(['000', '001'])} {r.choice(['000', '100'])} {digits(1)}000", f"{area}-{digits(3)}-{digits(4)}", f"0{digits(1)}.{digits(2)}.{r.randint(1950, 2030)}", f"0{digits(1)}/{digits(2)}/{r.randint(1950, 2030)}", f"0{digits(1)}-{digits(2)}", f"0{digits(1)}.{digits(2)}"])
        if kind == "secret":
            name, sign = r.choice(["token", "api_key", "secret", "password", "auth_key", "client_secret", "access-key", "DB_PASSWORD", "pwd", "Bearer"]), r.choice([" = ", "=", ": ", ":=", " => "])
            value = r.choice([code(r.randint(16, 44), "0123456789abcdefABCDEFghkmz"), code(r.randint(16, 40), hexes), code(r.randint(12, 40), mixed), word().title() + code(4, "0123456789") + r.choice("!@#$%") + word(), word() + digits(4), word() + digits(2) + word(), code(r.randint(3, 5), mixed) + r.choice("!@#$%&") + code(r.randint(4, 8), mixed) + digits(1)]) if good else r.choice(["required", "optional", "undefined", word() + word() + "ab", word() + "_" + word() + "_name", word() + "-" + word(), "********", "<your.key>", "None.None", "example"])
            value = longer() if good and own.random() < 0.4 else value
            return f'{name}{sign}"{value}"' if r.random() < 0.5 else f"{name}{sign}{value}"
        if kind == "bare_key":
            if good:
                return r.choice([r.choice(["AKIA", "ASIA"]) + code(16, "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), f"gh{r.choice('pousr')}_{code(36, mixed)}", f"sk-{code(r.randint(24, 48), mixed)}", f"sk_live_{code(24, mixed)}", f"xoxb-{digits(11)}-{code(24, mixed)}", f"eyJ{code(30, mixed)}.eyJ{code(60, mixed)}.{code(43, mixed)}", code(r.randint(32, 64), mixed), code(r.choice([32, 40, 64]), hexes)])
            return r.choice([code(r.choice([32, 40, 64]), hexes), word() * 8, "-".join(word() for _ in range(8)), "_" * 40, digits(36), "/".join(word() for _ in range(9)), "x" * 40])
        if kind == "private_key":
            lead, body = r.choice(["RSA ", "EC ", "OPENSSH ", ""]), code(r.randint(64, 400), mixed)
            return f"-----BEGIN {lead}PRIVATE KEY-----\n{body}\n-----END {lead}PRIVATE KEY-----" if good else f"-----BEGIN {lead}PRIVATE KEY-----"
        sep = r.choice("-- ")
        return f"{r.randint(1, 665):03d}{sep}{r.randint(1, 99):02d}{sep}{r.randint(1, 9999):04d}" if good else r.choice([f"{r.choice(['000', '999', '950'])}-{digits(2)}-{digits(4)}", f"{digits(3)} {digits(2)} {digits(4)}"])

    made = []
    cues = {"email_words": ["contact", "mail me:", "write to"], "iban": ["iban", "account", "pay to"], "phone_local": ["call", "tel.", "phone:", "reach me on"], "secret": ["auth", "login with", "the key"], "ssn": ["ssn", "social security number", "insured under"], "bare_key": ["key", "the secret", "auth token", "credentials"], "private_key": ["key", "secret"]}
    others = {"phone_local": ["order", "invoice", "part", "item no."], "bare_key": ["commit", "sha", "md5", "checksum", "build"], "ssn": ["order", "ref", "item"]}
    for i in range(n):
        kind, good = list(PROPOSED)[i % len(PROPOSED)], r.random() < 0.5
        lead = r.choice(cues[kind]) if good and (kind == "ssn" or r.random() < 0.6) or not good and r.random() < 0.1 else word()
        said = one(kind, good)
        if not good and kind in others and (said[:1] not in "0_x" or kind == "bare_key" and r.random() < 0.8):
            lead = r.choice(others[kind])
        if good and kind == "bare_key" and not set(said) - set(hexes):
            lead = r.choice(cues[kind])  # digits and letters a to f are a key only where something says so
        made.append((f"{words(r.randint(0, 4))} {lead} {said} {words(3)}", kind, float(good)))
    return made


@dataclass
class Trees:
    """Trees of depth two: (feature, bound, left, right), where left and right are (feature, bound, low, high)."""

    start: float
    trees: list[tuple]
    thresholds: dict[str, float]

    def score(self, f: Column) -> Column:
        def leaf(part) -> Column:
            i, bound, low, high = part
            return F.when(f[i] <= bound, low).otherwise(high)

        return reduce(lambda a, b: a + b, [F.when(f[i] <= bound, leaf(left)).otherwise(leaf(right)) for i, bound, left, right in self.trees], F.lit(self.start))

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        for i, bound, left, right in self.trees:
            for side, (j, b, low, high) in ((x[:, i] <= bound, left), (x[:, i] > bound, right)):
                out += np.where(side, np.where(x[:, j] <= b, low, high), 0.0)
        return out


def _split(x: np.ndarray, residual: np.ndarray, weight: np.ndarray) -> tuple[int, float]:
    """The (feature, bound) with the largest gain for a logistic loss."""
    best = (0, 0.0, -1.0)
    for i in range(x.shape[1]):
        order = np.argsort(x[:, i], kind="stable")
        g, h = np.cumsum(residual[order]), np.cumsum(weight[order])
        cut = np.flatnonzero(np.diff(x[order, i]) > 0)
        if len(cut):
            gain = g[cut] ** 2 / (h[cut] + 1) + (g[-1] - g[cut]) ** 2 / (h[-1] - h[cut] + 1)
            k = int(gain.argmax())
            if gain[k] > best[2]:
                best = (i, float((x[order[cut[k]], i] + x[order[cut[k] + 1], i]) / 2), float(gain[k]))
    return best[:2]


def boost(x: np.ndarray, y: np.ndarray, kinds: list[str], trees: int = TREES) -> Trees:
    """Gradient boosting on the even rows; each kind's threshold is the lowest with PRECISION on the odd rows."""
    fit = np.arange(len(x)) % 2 == 0
    rows, labels = x[fit], y[fit]
    model = Trees(float(np.log((labels.mean() + 1e-6) / (1 - labels.mean() + 1e-6))), [], {})
    at = np.full(len(rows), model.start)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-at))
        residual, weight = labels - p, p * (1 - p)
        i, bound = _split(rows, residual, weight)
        parts = []
        for side in (rows[:, i] <= bound, rows[:, i] > bound):
            j, b = _split(rows[side], residual[side], weight[side]) if side.any() else (0, 0.0)
            leaves = [RATE * residual[m].sum() / (weight[m].sum() + 1) for m in (side & (rows[:, j] <= b), side & (rows[:, j] > b))]
            parts.append((j, b, float(leaves[0]), float(leaves[1])))
        model.trees.append((i, bound, *parts))
        at = model.predict(rows)
    scores = model.predict(x)
    for kind in PROPOSED:
        mine = ~fit & np.array([k == kind for k in kinds])
        order = np.argsort(-scores[mine], kind="stable")
        s, right = scores[mine][order], np.cumsum(y[mine][order]) / np.arange(1, mine.sum() + 1)
        enough = np.flatnonzero(right >= PRECISION)
        model.thresholds[kind] = max(0.0, float(s[enough[-1]])) if len(enough) else float("inf")
    return model


def train(spark: SparkSession, n: int = EXAMPLES) -> Trees:
    """The trees, from n generated examples whose features Spark computes."""
    made = pd.DataFrame([(i, *x) for i, x in enumerate(examples(n))], columns=["i", "text", "kind", "y"])
    # One local relation of n short rows: no reader and no Python on the executors.
    rows = spark.createDataFrame(made).select("i", "kind", "y", F.get(F.filter(candidates(F.col("text")), lambda c: c["kind"] == F.col("kind")), F.lit(0))["f"].alias("f"))
    got = [r for r in rows.orderBy("i").collect() if r["f"] is not None]
    return boost(np.array([r["f"] for r in got]), np.array([r["y"] for r in got]), [r["kind"] for r in got])


def _listed(kind: str | Column, found: Column) -> Column:
    name = F.lit(kind) if isinstance(kind, str) else kind
    return F.transform(found, lambda x: F.concat_ws(":", name, x["s"].cast("string"), x["e"].cast("string")))


def find(docs: DataFrame, model: Trees, text: str = "text", out: tuple[str, str] = ("base", "added")) -> DataFrame:
    """docs with base, a struct of an array of spans for each base kind, and added, an array of (kind, s, e, score)."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in others(docs, *out))).alias("__row"), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    body = F.col("__text")
    rows = rows.select("__row", F.struct(*(c.alias(kind) for kind, c in base_spans(body).items())).alias("__base"), candidates(body).alias("__candidates"))
    bounds = F.create_map(*(F.lit(x) for kind, t in model.thresholds.items() for x in (kind, t)))
    scored = F.transform(F.col("__candidates"), lambda c: F.struct((-model.score(c["f"])).alias("cost"), c["s"].alias("s"), c["e"].alias("e"), c["kind"].alias("kind")))
    rows = rows.select("__row", "__base", F.filter(scored, lambda c: -c["cost"] >= F.element_at(bounds, c["kind"])).alias("__scored"))
    fixed = F.transform(F.concat(*(F.col(f"__base.{kind}") for kind in BASE)), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(None).cast("double").alias("cost"), F.lit(None).cast("string").alias("kind")))
    every = F.array_sort(F.concat(fixed, F.transform(F.col("__scored"), lambda c: F.struct(c["s"].alias("s"), c["e"].alias("e"), c["cost"].alias("cost"), c["kind"].alias("kind")))))
    meets = lambda a, b: (a["s"] < b["e"]) & (b["s"] < a["e"])
    none = F.array().cast("array<struct<less:int,cost:double,s:int,e:int,kind:string>>")

    def best(run: Column) -> Column:
        free = F.filter(run, lambda c: c["cost"].isNotNull() & ~F.exists(run, lambda b: b["cost"].isNull() & meets(b, c)))
        ordered = F.array_sort(F.transform(free, lambda c: F.struct((c["s"] - c["e"]).alias("less"), c["cost"].alias("cost"), c["s"].alias("s"), c["e"].alias("e"), c["kind"].alias("kind"))))
        return F.aggregate(ordered, none, lambda acc, c: F.when(F.exists(acc, lambda b: meets(b, c)), acc).otherwise(F.array_append(acc, c)))

    kept = F.flatten(F.transform(_runs(every), best))
    added = F.transform(kept, lambda c: F.struct(c["kind"].alias("kind"), c["s"].alias("s"), c["e"].alias("e"), (-c["cost"]).alias("score")))
    return rows.select("__row.*", F.col("__base").alias(out[0]), F.when(F.size("__scored") > 0, added).otherwise(F.array().cast("array<struct<kind:string,s:int,e:int,score:double>>")).alias(out[1]))


def _runs(ordered: Column) -> Column:
    """Spans in order of their start, as arrays of spans that overlap in steps."""
    def cut(x: Column) -> Column:
        reach = _let(F.transform(x, lambda v: v["e"]), lambda e: running(e, lambda a, b: F.greatest(a, b)))
        firsts = _let(reach, lambda before: F.filter(F.sequence(F.lit(0), F.size(x) - 1), lambda i: F.get(before, i) <= F.get(x, i)["s"]))
        ends = lambda at: F.concat(F.slice(at, F.lit(2), F.size(at)), F.array(F.size(x)))
        return _let(firsts, lambda at: F.zip_with(at, ends(at), lambda i, to: F.slice(x, i + 1, to - i)))

    return _let(ordered, lambda x: F.when(F.size(x) > 0, cut(x)).otherwise(F.slice(F.array(x), F.lit(1), F.lit(0))))


def listing(base: str = "base", added: str | None = None) -> Column:
    """kind:start:end, comma-joined: base spans by kind, then start; then the added ones by kind, then start."""
    parts = [_listed(kind, F.col(f"{base}.{kind}")) for kind in BASE]
    if added:
        ordered = F.array_sort(F.transform(F.col(added), lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e"))))
        parts.append(F.transform(ordered, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))))
    return F.array_join(F.concat(*parts), ",")


def redact(docs: DataFrame, text: str, base: str = "base", added: str = "added") -> Column:
    """text with every span replaced by its kind in brackets; spans that overlap are one, named by the first."""
    def called(kind: str) -> Column:
        return F.transform(F.col(f"{base}.{kind}"), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(kind).alias("kind")))

    named = [called(kind) for kind in BASE]
    named.append(F.transform(F.col(added), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind"))))
    body = F.coalesce(F.col(text), F.lit(""))
    one = lambda run: F.struct(F.get(run, F.lit(0))["s"].alias("s"), F.array_max(F.transform(run, lambda x: x["e"])).alias("e"), F.get(run, F.lit(0))["kind"].alias("kind"))

    def written(v: Column) -> Column:
        # Characters as an array: a part of it is found at once, where a part of a string is counted from its start.
        part = lambda at, to: F.array_join(F.slice(v["chars"], at + 1, to - at), "")
        before = F.concat(F.array(F.lit(0)), F.transform(v["found"], lambda x: x["e"]))
        parts = F.zip_with(v["found"], F.slice(before, F.lit(1), F.size(v["found"])), lambda x, at: F.concat(part(at, x["s"]), F.lit("["), x["kind"], F.lit("]")))
        return F.concat(F.array_join(parts, ""), part(F.element_at(before, -1), F.size(v["chars"])))

    spans_of = F.array_sort(F.concat(*named))
    both = F.struct(F.transform(_runs(spans_of), one).alias("found"), F.split(body, "").alias("chars"))
    return F.when(F.size(spans_of) > 0, _let(both, written)).otherwise(body)
