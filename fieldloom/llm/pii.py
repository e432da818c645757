"""Personal data: generators propose spans, boosted trees choose among them, all in built-in expressions.

Base kinds (email, ip, card, phone) are patterns with checks and always stay. Two high-recall
generators propose more, overlapping spans: runs of digits and separators (`number`) and mixed tokens
(`secret`). Each candidate has features of its format (lengths, shares of character kinds, check
digits, octets) and of its context (words before it, quotes, assignments). Gradient-boosted trees are
fitted on the candidates of all documents, which are labelled by the base checks and by unmistakable
contexts: every candidate's features are placed between fixed cuts (CUTS), and equal places are counted,
so the fit reads a table of exact counts that grows far slower than the documents. The trees split at
these cuts alone, which go to the learner as features of two values, so it seeks no splits in a sample
of its own. A caller may bound the candidates of each generator and label (`sample`); the queries
don't. Each generator's threshold is the smallest that keeps the wanted precision on the candidates
that were held out of the fit. The trees are then compiled into one expression over the candidates of
each row, so scoring every document is a projection without shuffle.

Positions are code points, end exclusive. A pattern's gaps (split) and matches (extract_all) give its
spans by running totals, in two levels so that a text with very many matches stays near linear; where
a class repeats without bound the patterns are possessive and start only at the run's start or where
the last match ended, which finds the same matches without going back.

Defined results: a null or empty text has no spans; repeated rows get repeated results; where the
whole table has fewer than 8 candidates of a label to fit on (or is empty) only base spans are found;
other columns are not looked at.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import table

KINDS = ("email", "ip", "card", "phone", "number", "secret")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "number": r"(?<![A-Za-z0-9])\+?[0-9][0-9()./\x20-]{5,30}(?<=[0-9])(?![A-Za-z])",
    "secret": r"(?<![A-Za-z0-9_+/.@-])(?=[A-Za-z_+/.@-]*+[0-9])(?=[0-9_+/.@-]*+[A-Za-z])[A-Za-z0-9_+/.@-]{12,}+",
}
SECRET_CONTEXT = r"(?i)(?:pass(?:word|wd)?|pwd|token|secret|api[_-]?key|access[_-]?key|auth|credential)s?[\"']?\x20{0,2}[:=]\x20{0,2}[\"']?$"
NUMBER_CONTEXT = r"(?i)(?:tel|phone|call|fax|mobile|card|account|iban|ssn|passport)[^\n]{0,12}$"
ROUNDS, DEPTH, PRECISION = 16, 3, 0.98
#: Counted rows that are put in one order in one task, so that sums of the same table are the same; more stay spread.
ORDERED = 1 << 16
CONTEXT = 32
STEP = 64


def _with_matches(df: DataFrame, kind: str, text: Column, maybe: Column) -> DataFrame:
    """df with __<kind>: array of (s, e, m): start, end and match of the kind's pattern, in text order."""
    p, m, lens, sums, base = PATTERNS[kind], f"__m_{kind}", f"__l_{kind}", f"__c_{kind}", f"__b_{kind}"
    df = df.withColumn(m, F.when(maybe, F.regexp_extract_all(text, F.lit(p), F.lit(0))))
    df = df.withColumn(f"__g_{kind}", F.when(F.size(m) > 0, F.split(text, p, -1)))
    df = df.withColumn(lens, F.transform(F.col(m), lambda x, i: F.length(x) + F.length(F.get(F.col(f"__g_{kind}"), i))))
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    steps = F.sequence(F.lit(0), F.floor((F.size(m) - 1) / STEP).cast("int"))
    df = df.withColumn(sums, F.when(F.size(m) > 0, F.transform(steps, lambda c: total(F.slice(F.col(lens), c * STEP + 1, F.lit(STEP))))))
    df = df.withColumn(base, F.transform(F.col(sums), lambda _, c: total(F.slice(F.col(sums), F.lit(1), c))))
    start = lambda i: F.get(F.col(base), F.floor(i / STEP).cast("int")) + total(F.slice(F.col(lens), F.floor(i / STEP).cast("int") * STEP + 1, i % STEP))
    spans = F.transform(F.col(m), lambda x, i: F.struct((start(i) + F.length(F.get(F.col(f"__g_{kind}"), i))).cast("long").alias("s"), (start(i) + F.get(F.col(lens), i)).cast("long").alias("e"), x.alias("m")))
    empty = F.from_json(F.lit("[]"), "array<struct<s:bigint,e:bigint,m:string>>")
    return df.withColumn(f"__{kind}", F.coalesce(F.when(F.size(m) > 0, spans), empty)).drop(m, f"__g_{kind}", lens, sums, base)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a right check digit."""
    n = F.length(digits)

    def part(i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int") * (1 + i % 2)
        return F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda a, i: a + part(i.cast("int"))) % 10 == 0


def _octets(m: Column) -> Column:
    part = lambda x: F.regexp_replace(x, "^0+(?=[0-9])", "")
    return F.forall(F.split(m, r"\.", -1), lambda x: (F.length(part(x)) <= 3) & (F.coalesce(F.try_to_number(part(x), F.lit("999")), F.lit(999)) <= 255))


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return _octets(m)
    if kind == "card":
        n = F.length(_digits(m))
        return F.when(n.between(12, 19), luhn(_digits(m))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    return F.lit(True)


def _passes(kind: str, x: Column) -> Column:
    return _valid(kind, x["m"])


def base_spans(df: DataFrame, text: str = "text", generators: bool = True) -> DataFrame:
    """df with __email, __ip, __card, __phone: the spans that pass their checks, and the generators' __number and __secret."""
    whole = F.coalesce(F.col(text), F.lit(""))
    digit = whole.rlike("[0-9]")
    maybe = {"email": F.contains(whole, F.lit("@")), "phone": F.contains(whole, F.lit("+")), "ip": whole.rlike(r"[0-9]\.[0-9]")}
    for kind in KINDS if generators else KINDS[:4]:
        df = _with_matches(df, kind, whole, maybe.get(kind, digit))
    for kind in KINDS[1:4]:
        df = df.withColumn(f"__{kind}", F.filter(F.col(f"__{kind}"), partial(_passes, kind)))
    return df


def _features(x: Column) -> dict[str, Column]:
    """Format and context of a candidate x (s, e, m, before, after, kind)."""
    m, n = x["m"], F.length(x["m"]).cast("double")
    count = lambda p: F.regexp_count(m, F.lit(p)).cast("double")
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    d = _digits(m)
    return {
        "secret": flag(x["kind"] == "secret"),
        "length": n,
        "digits": F.length(d).cast("double"),
        "digit_share": F.length(d) / n,
        "upper_share": count("[A-Z]") / n,
        "lower_share": count("[a-z]") / n,
        "marks": count("[^A-Za-z0-9]"),
        "turns": count("(?<=[A-Za-z])[0-9]|(?<=[0-9])[A-Za-z]") / n,
        "hex": flag(m.rlike("^[0-9a-f]+$")),
        "dots": count(r"\."),
        "plus": flag(m.startswith("+")),
        "at": flag(m.contains("@")),
        "check_digit": flag(F.when(F.length(d).between(12, 19), luhn(d)).otherwise(False)),
        "octets": flag(m.rlike(r"^[0-9]+(\.[0-9]+){3}$") & _octets(m)),
        "secret_context": flag(x["before"].rlike(SECRET_CONTEXT)),
        "number_context": flag(x["before"].rlike(NUMBER_CONTEXT)),
        "assigned": flag(x["before"].rlike("[=:][\"']?$")),
        "quoted": flag(x["before"].rlike("[\"']$") & x["after"].rlike("^[\"']")),
    }


_SHARES, _FLAG = [i / 16 for i in range(16)], [0.0]
_LENGTHS = [*range(7, 21), 22, 24, 26, 28, 30, 32, 36, 40, 44, 48, 56, 64, 80, 96, 128, 192, 256]
#: Where the trees may split each feature of _features, in its order: values up to a cut go left.
CUTS = [
    [float(v) for v in cuts]
    for cuts in (
        _FLAG, _LENGTHS, [*range(6), *_LENGTHS], _SHARES, _SHARES, _SHARES, [*range(9), 12, 16, 24, 32], _SHARES,
        _FLAG, range(7), _FLAG, _FLAG, _FLAG, _FLAG, _FLAG, _FLAG, _FLAG, _FLAG,
    )
]
FEATURES = len(CUTS)


def _candidates(text: str) -> Column:
    """The generators' spans with their surroundings."""
    whole = F.coalesce(F.col(text), F.lit(""))

    def around(kind: str) -> Column:
        return F.transform(
            F.col(f"__{kind}"),
            lambda x: F.struct(
                x["s"], x["e"], x["m"], F.lit(kind).alias("kind"),
                F.substring(whole, F.greatest(x["s"] - CONTEXT + 1, F.lit(1)).cast("int"), F.least(x["s"], F.lit(CONTEXT)).cast("int")).alias("before"),
                F.substring(whole, (x["e"] + 1).cast("int"), F.lit(2)).alias("after"),
            ),
        )

    return F.concat(around("number"), around("secret"))


def _overlaps(x: Column, spans: Column) -> Column:
    return F.exists(spans, lambda y: (y["s"] < x["e"]) & (x["s"] < y["e"]))


class Chooser:
    """Boosted trees as an expression, and the thresholds that they were calibrated to."""

    def __init__(self, trees: list[tuple[float, object]]) -> None:
        self.trees = trees
        #: One for each generator.
        self.thresholds = {"number": 0.9, "secret": 0.9}

    def score(self, features: list[Column]) -> Column:
        def walk(node: object) -> Column:
            if isinstance(node, float):
                return F.lit(node)
            feature, at, left, right = node
            return F.when(features[feature] <= F.lit(at), walk(left)).otherwise(walk(right))

        total = sum((F.lit(w) * walk(t) for w, t in self.trees), F.lit(0.0))
        return 1 / (1 + F.exp(-2 * total))


def _labelled(docs: DataFrame) -> DataFrame:
    """One row a candidate, of all: x, label, held, take (its place in [0, 1), for callers that bound the fit)."""
    spans = base_spans(docs.select("doc_id", "text"))
    base = F.concat(*[F.col(f"__{k}") for k in KINDS[:4]])
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), "text")) % 4 == 0
    # No filter on the arrays themselves: it would be pushed below the projections that make them, with these in it many times over.
    rows = spans.select("doc_id", held.alias("held"), base.alias("base"), F.explode(_candidates("text")).alias("x"))
    x = F.col("x")
    take = F.pmod(F.xxhash64(F.lit("take"), "doc_id", x["s"], x["m"]), F.lit(1 << 31)) / F.lit(1 << 31)
    certain = F.when(x["kind"] == "number", _overlaps(x, F.col("base"))).otherwise(x["before"].rlike(SECRET_CONTEXT) | x["m"].rlike("^(AKIA|ASIA|ghp_|sk-|xox)") | _overlaps(x, F.col("base")))
    return rows.select("held", F.when(certain, 1.0).otherwise(0.0).alias("label"), "x", take.alias("take"))


def _counted(docs: DataFrame, sample: int | None = None) -> DataFrame:
    """label, held, share, q (between which cuts each feature lies) and n: how many candidates have them, of all or of those taken."""
    candidates, share = _labelled(docs), F.lit(1.0)
    if sample is not None:
        for r in candidates.groupBy("x.kind", "label").count().collect():  # at most 4 rows
            share = F.when((F.col("x.kind") == r["kind"]) & (F.col("label") == r["label"]), min(1.0, sample / r["count"])).otherwise(share)
        candidates = candidates.withColumn("share", share).filter(F.col("take") < F.col("share"))
    else:
        candidates = candidates.withColumn("share", share)
    cuts = F.array(*[F.array(*map(F.lit, c)) for c in CUTS])
    rows = candidates.select("label", "held", "share", F.array(*_features(F.col("x")).values()).alias("f"))
    place = F.zip_with("f", cuts, lambda v, c: F.size(F.filter(c, lambda at: at < v)))
    return rows.select("label", "held", "share", place.alias("q")).groupBy("label", "held", "share", "q").agg(F.count(F.lit(1)).alias("n"))


def fit(docs: DataFrame, sample: int | None = None) -> Chooser | None:
    """Trees fitted on all candidates, or on about `sample` at most of each generator and label; None where all documents hold too few."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector

    counted = _counted(docs, sample).persist()
    rows = None
    try:
        strata = counted.groupBy("label", "held").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("rows")).collect()  # at most 4 rows
        seen = {(r["label"], r["held"]): r["n"] for r in strata}
        if min(seen.get((y, False), 0) for y in (0.0, 1.0)) < 8:
            return None
        # One feature a cut: whether the value lies beyond it.
        which = [(j, at) for j, cuts in enumerate(CUTS) for at in cuts]
        sizes = F.array(*[F.lit(len(cuts)) for cuts in CUTS])
        beyond = F.flatten(F.zip_with("q", sizes, lambda v, n: F.transform(F.sequence(F.lit(0), n - 1), lambda k: (k < v).cast("double"))))
        kinds = {"ml_attr": {"attrs": {"binary": [{"idx": i} for i in range(len(which))]}, "num_attrs": len(which)}}
        few = sum(r["rows"] for r in strata) <= ORDERED
        rows = (counted.coalesce(1) if few else counted).sortWithinPartitions("label", "held", "share", "q")
        rows = rows.select("label", "held", "q", (F.col("n") / F.col("share")).alias("weight"), array_to_vector(beyond).alias("features", metadata=kinds)).persist()
        model = GBTClassifier(maxIter=ROUNDS, maxDepth=DEPTH, seed=9, maxBins=32, weightCol="weight").fit(rows.filter(~F.col("held")))

        def walk(node):
            if node.subtreeDepth() == 0:
                return float(node.prediction())
            s, left, right = node.split(), walk(node.leftChild()), walk(node.rightChild())
            return *which[int(s.featureIndex())], *((left, right) if 0.0 in list(s.leftCategories()) else (right, left))

        chooser = Chooser([(float(w), walk(t._call_java("rootNode"))) for w, t in zip(model.treeWeights, model.trees, strict=True)])
        # Any value between the same cuts has the same score: that of the upper one, and beyond the last one infinity's.
        tops = F.array(*[F.array(*map(F.lit, [*cuts, float("inf")])) for cuts in CUTS])
        held = rows.filter("held").select("label", "weight", F.zip_with("q", tops, lambda v, c: F.get(c, v)).alias("f"))
        score = chooser.score([F.get("f", F.lit(i)) for i in range(FEATURES)])
        scored = held.select("label", "weight", (F.get("f", F.lit(0)) > 0).alias("secret"), (F.floor(score * 100) / 100).alias("p"))
        steps = scored.groupBy("secret", "p").agg(F.sum("weight").alias("n"), F.sum(F.col("label") * F.col("weight")).alias("good")).collect()  # at most 202 rows
        for kind in chooser.thresholds:
            by = sorted((r["p"], r["n"], r["good"]) for r in steps if r["secret"] == (kind == "secret"))
            for i, (p, _, _) in enumerate(by):
                if p >= 0.5 and sum(g for _, _, g in by[i:]) >= PRECISION * sum(n for _, n, _ in by[i:]):
                    chooser.thresholds[kind] = float(p)
                    break
        return chooser
    finally:
        for df in filter(None, (rows, counted)):
            df.unpersist()


#: The columns that find() adds.
FOUND = frozenset([*(f"n_{k}" for k in KINDS[:4]), "base", "spans"])


def find(docs: DataFrame, chooser: Chooser | None, text: str = "text") -> DataFrame:
    """docs with n_email, n_ip, n_card, n_phone, base and spans: arrays of (s, k, e) by start, then kind (its place in KINDS), in place of docs' columns of those names."""
    names = [c for c in docs.columns if c not in FOUND]
    out = base_spans(docs, text, generators=chooser is not None)
    tagged = lambda k: F.transform(F.col(f"__{k}"), lambda x: F.struct(x["s"].alias("s"), F.lit(KINDS.index(k)).alias("k"), x["e"].alias("e")))
    out = out.withColumn("base", F.sort_array(F.concat(*[tagged(k) for k in KINDS[:4]])))
    if chooser is None:
        out = out.withColumn("spans", F.col("base"))
    else:
        out = out.withColumn("__x", F.filter(_candidates(text), lambda x: ~_overlaps(x, F.col("base"))))
        out = out.withColumn("__f", F.transform("__x", lambda x: F.array(*_features(x).values())))
        score = lambda f: chooser.score([F.get(f, F.lit(i)) for i in range(FEATURES)])
        chosen = F.filter(F.col("__x"), lambda x, i: score(F.get(F.col("__f"), i)) >= F.when(x["kind"] == "secret", chooser.thresholds["secret"]).otherwise(chooser.thresholds["number"]))
        added = F.transform(chosen, lambda x: F.struct(x["s"].alias("s"), F.when(x["kind"] == "number", F.lit(4)).otherwise(F.lit(5)).alias("k"), x["e"].alias("e")))
        out = out.withColumn("spans", F.sort_array(F.concat("base", F.when(F.size("__x") > 0, added).otherwise(F.slice("base", 1, 0)))))
    counts = [F.size(f"__{k}").cast("long").alias(f"n_{k}") for k in KINDS[:4]]
    return out.select(*names, *counts, "base", "spans")


def as_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def redact(docs: DataFrame, chooser: Chooser | None, text: str = "text") -> DataFrame:
    """docs with each run of overlapping spans of the text replaced by the name of its first span's kind in angle brackets."""
    if FOUND & set(docs.columns):  # columns of the caller's that find() would replace travel as one
        whole = redact(docs.select(F.struct("*").alias("__given"), F.col(text).alias("__text")), chooser, "__text")
        return whole.select(*[F.col("__text" if c == text else f"__given.{c}").alias(c) for c in docs.columns])
    kinds = F.array(*[F.lit(k) for k in KINDS])
    found = find(docs, chooser, text)
    state = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    piece = lambda a, x: F.concat(a["out"], F.substring(F.col(text), (a["at"] + 1).cast("int"), (x["s"] - a["at"]).cast("int")), F.lit("<"), F.get(kinds, x["k"]), F.lit(">"))
    step = lambda a, x: F.when(x["s"] < a["at"], F.struct(F.greatest(a["at"], x["e"]).alias("at"), a["out"].alias("out"))).otherwise(F.struct(x["e"].alias("at"), piece(a, x).alias("out")))
    whole = F.aggregate("spans", state, step, lambda a: F.concat(a["out"], F.substring(F.col(text), (a["at"] + 1).cast("int"), F.lit(2**31 - 1))))
    return found.withColumn(text, F.when(F.size("spans") > 0, whole).otherwise(F.col(text))).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: the personal data in every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find(docs, fit(docs))
    base = F.sha2(as_text(F.col("base")), 256).alias("base_sha256")
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", base, as_text(F.col("spans")).alias("spans"))
