r"""Personal data by candidate gradient boosting, in DataFrame expressions only (operator 1).

*Base spans* (always kept): the leftmost non-overlapping matches of four patterns,
less those that fail a check: email; ip, parts at most 255; card, 16 to 19 digits
that pass Luhn; phone, 8 to 15 digits. The patterns here are written with
look-arounds and possessive quantifiers so that they match in linear time; they
find the same spans as the plain forms.

*Candidates.* High-recall patterns propose further spans of each kind (spelled-out
"(at)" and "(dot)", other separators, missing plus signs, ...); they may overlap.

*Trees.* Each candidate has small integer features of its format (digits, length,
groups, separators, brackets, ...) and context (neighbouring characters, words
such as "call" or "card" before it). What defines a base span (the "@", the plus
sign, the Luhn sum) is no feature. A candidate over a base span of its kind is a
positive example, any other a negative one: gradient-boosted trees learn which
formats and contexts look like personal data even where the strict check fails.
The examples of the whole table are first counted by feature vector, so training
sees every candidate, yet a table bounded by the feature space.

*Calibration.* Per kind, the threshold is the least score above which, over the whole
table, at least ``PRECISION`` of the examples are positive. Candidates above it that
overlap no base span become added spans; of overlapping ones the best scored stays.

*Plan.* Splitting a text by a pattern gives the gaps between its matches; running sums
of their lengths give positions. All of this happens within a row, so the text is
never shuffled; only the feature counts are.

NULL text counts as empty (no spans). Rows are independent: repeated rows get equal
results. An empty table, or one without examples of both kinds, adds no spans.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoplens.llm.store import stored, unwrapped, wrapped

KINDS = ("email", "ip", "card", "phone")
PRECISION = 0.95
TREES, DEPTH, STEP = 6, 3, 0.3

_LOCAL, _DOMAIN = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_DOMAIN}++(?:\.{_DOMAIN}++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WIDE = {
    "email": rf"(?<!{_LOCAL}){_LOCAL}++(?:@|\x20?[(\[](?:at|AT)[)\]]\x20?){_DOMAIN}++(?:(?:\.|\x20?[(\[](?:dot|DOT)[)\]]\x20?){_DOMAIN}++)++",
    "ip": r"(?<![0-9.])[0-9]{1,3}+(?:(?:\[\.\]|\.|,|\x20\.\x20)[0-9]{1,3}+){3}(?![0-9])",
    "card": r"(?<![0-9])(?<![0-9][\x20./_-])[0-9](?:[\x20./_-]{0,2}+[0-9]){12,22}+(?![0-9])",
    "phone": r"(?<![0-9+(])(?:\+\x20?)?(?:\([0-9]|[0-9])(?:[\x20()./-]{0,2}+[0-9]){6,16}+(?![0-9])",
}
#: What a text must hold for a kind's patterns to be tried at all.
_WORTH = {"email": r"@|[(\[](?:at|AT)[)\]]", "ip": r"[0-9][.,\]\x20]", "card": r"[0-9]", "phone": r"[0-9]"}
_WORDS = {"email": r"mail|contact|write|reach", "ip": r"\bip\b|host|addr|server|login", "card": r"card|visa|credit|paid|account",
          "phone": r"phone|call|tel|mobile|fax|contact"}
FEATURES = ("kind", "digits", "length", "groups", "brackets", "dots", "dashes", "spaces", "letters", "last_group", "left", "right", "word")
_BLOCK = 256


def _running(steps: Column) -> Column:
    """Sums of the steps before each; in blocks, so that the cost stays near linear for very many matches."""
    def sums(a: Column) -> Column:
        none = F.struct(F.lit(0).alias("s"), F.array().cast("array<int>").alias("r"))
        return F.aggregate(a, none, lambda acc, x: F.struct((acc["s"] + x).alias("s"), F.concat(acc["r"], F.array(acc["s"])).alias("r")))["r"]

    count = F.ceil(F.size(steps) / _BLOCK).cast("int")
    starts = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    blocks = F.transform(starts, lambda b: F.slice(steps, b * _BLOCK + 1, _BLOCK))
    before = sums(F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda acc, x: acc + x)))
    return F.flatten(F.zip_with(blocks, before, lambda b, at: F.transform(sums(b), lambda s: s + at)))


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the check sum of a string of digits is a multiple of 10."""
    n = F.length(digits)

    def add(acc: Column, i: Column) -> Column:
        d = F.substr(digits, i, F.lit(1)).cast("int")
        twice = F.when((n - i) % 2 == 1, 2 * d).otherwise(d)
        return acc + F.when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def _valid(kind: str, hit: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        def small(part: Column) -> Column:
            bare = F.regexp_replace(part, "^0+", "")
            return (F.length(bare) < 3) | ((F.length(bare) == 3) & (bare <= "255"))
        return F.forall(F.split(hit, r"\."), small)
    n = F.length(_digits(hit))
    if kind == "card":
        return n.between(16, 19) & F.when(n.between(16, 19), _luhn(_digits(hit))).otherwise(False)
    return n.between(8, 15)


def _matches(frame: DataFrame, name: str, pattern: str, worth: Column) -> DataFrame:
    """Adds ``name``: the pattern's matches with start, end, hit, and the text around it."""
    frame = frame.withColumns({f"{name}_gaps": F.when(worth, F.split("__text", pattern, -1)),
                               f"{name}_hits": F.when(worth, F.regexp_extract_all("__text", F.lit(pattern), F.lit(0)))})
    gaps, hits = F.col(f"{name}_gaps"), F.col(f"{name}_hits")
    frame = frame.withColumn(f"{name}_at", F.when(F.size(hits) > 0, _running(F.transform(hits, lambda h, i: F.length(h) + F.length(F.get(gaps, i))))))

    def span(h: Column, i: Column) -> Column:
        gap = F.get(gaps, i)
        start = F.get(F.col(f"{name}_at"), i) + F.length(gap)
        return F.struct(start.alias("start"), (start + F.length(h)).alias("end"), h.alias("hit"), F.right(gap, F.lit(24)).alias("left"),
                        F.left(F.get(gaps, i + 1), F.lit(1)).alias("right"))

    found = F.when(F.size(hits) > 0, F.transform(hits, span)).otherwise(
        F.array().cast("array<struct<start:int,end:int,hit:string,left:string,right:string>>"))
    return frame.withColumn(name, found).drop(f"{name}_gaps", f"{name}_hits", f"{name}_at")


def _char(c: Column) -> Column:
    """0 none, 1 white space, 2 letter, 3 digit, 4 other."""
    return (F.when(c == "", 0).when(c.rlike(r"^\s"), 1).when(c.rlike(r"^\p{L}"), 2).when(c.rlike("^[0-9]"), 3).otherwise(4))


def _features(kind: int, s: Column) -> Column:
    hit = s["hit"]

    def count(pattern: str, most: int) -> Column:
        return F.least(F.length(hit) - F.length(F.regexp_replace(hit, pattern, "")), F.lit(most))

    groups = F.filter(F.split(hit, "[^0-9A-Za-z]+"), lambda g: g != "")
    values = {"kind": F.lit(kind), "digits": count("[0-9]", 24), "length": F.floor(F.least(F.length(hit), F.lit(48)) / 4), "groups": F.least(F.size(groups), F.lit(8)),
              "brackets": count(r"[()\[\]]", 4), "dots": count(r"[.,]", 5), "dashes": count(r"[-/_]", 5), "spaces": count(r"\x20", 5), "letters": F.floor(count("[A-Za-z]", 32) / 8),
              "last_group": F.least(F.length(F.element_at(groups, -1)), F.lit(8)), "left": _char(F.right(s["left"], F.lit(1))), "right": _char(F.coalesce(s["right"], F.lit(""))),
              "word": F.lower(s["left"]).rlike(_WORDS[KINDS[kind]])}
    return F.struct(*[values[f].cast("int").alias(f) for f in FEATURES])


def _meets(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def _checked(kind: str):
    return lambda s: _valid(kind, s["hit"])


def _as_base(kind: int):
    return lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))


def _as_candidate(kind: int, base: Column):
    return lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"),
                              F.exists(base, lambda b: _meets(b, s)).cast("int").alias("label"), _features(kind, s).alias("f"))


def _of_kind(kind: int):
    return lambda s: s["kind"] == kind


def with_candidates(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with __base (valid base spans) and __cands (candidates with features and weak labels)."""
    out = docs.withColumn("__text", F.coalesce(F.col(text_col), F.lit("")))
    for k in KINDS:
        worth = F.col("__text").rlike(_WORTH[k])
        out = _matches(_matches(out, f"__b_{k}", BASE[k], worth), f"__w_{k}", WIDE[k], worth)
    bases, cands = [], []
    for i, k in enumerate(KINDS):
        own = F.col(f"__b_{k}")
        out = out.withColumn(f"__b_{k}", F.filter(own, _checked(k)))
        bases.append(F.transform(own, _as_base(i)))
        cands.append(F.transform(f"__w_{k}", _as_candidate(i, own)))
    out = out.withColumns({"__base": F.concat(*bases), "__cands": F.concat(*cands)})
    return out.drop(*[f"__{x}_{k}" for x in "bw" for k in KINDS])


def _tree(node, f: Column) -> Column:
    """A regression tree as nested CASE expressions."""
    if node.getClass().getSimpleName() == "LeafNode":
        return F.lit(float(node.prediction()))
    split = node.split()
    return F.when(f[FEATURES[split.featureIndex()]] <= float(split.threshold()), _tree(node.leftChild(), f)).otherwise(_tree(node.rightChild(), f))


def _score(model, f: Column) -> Column:
    total = reduce(Column.__add__, [F.lit(float(w)) * _tree(t._java_obj.rootNode(), f) for t, w in zip(model.trees, model.treeWeights)])
    return 1 / (1 + F.exp(-2 * total))


def examples(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(features ..., label, n): the candidates of all documents, counted by feature vector and label."""
    # The outer form, so that no filter on the candidates is pushed down and computes them a second time.
    rows = with_candidates(docs.select(F.col(text_col).alias("text"))).select(F.explode_outer("__cands").alias("c")).where("c IS NOT NULL")
    return rows.select("c.f.*", "c.label").groupBy(*FEATURES, "label").agg(F.count("*").alias("n"))


def fit(docs: DataFrame, text_col: str = "text", precision: float = PRECISION):
    """(model, threshold per kind); None if there are not examples of both labels. A kind that cannot reach the precision has no threshold."""
    table = stored(examples(docs, text_col), "pii-examples")
    if table.select("label").distinct().count() < 2:
        return None
    table = table.coalesce(1)                          # bounded by the feature space, not by the data
    ready = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(table.withColumn("label", F.col("label").cast("double"))).withColumn("weight", F.col("n").cast("double"))
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, weightCol="weight", seed=7).fit(ready)
    f = F.struct(*FEATURES)
    scored = table.select("kind", "label", "n", _score(model, f).alias("p")).groupBy("kind", "p").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("label")).alias("good"))
    above = Window.partitionBy("kind").orderBy(F.desc("p"))
    cuts = (scored.select("kind", "p", F.sum("n").over(above).alias("n"), F.sum("good").over(above).alias("good"))
            .where(F.col("good") >= precision * F.col("n")).groupBy("kind").agg(F.min("p").alias("cut")))
    return model, {r.kind: r.cut for r in cuts.collect()}


def with_spans(docs: DataFrame, fitted, text_col: str = "text") -> DataFrame:
    """``docs`` with __base and __spans: all spans (kind, start, end) in order of kind and start."""
    out = with_candidates(docs, text_col)
    base = F.array_sort("__base")
    if fitted is None or not fitted[1]:
        return out.withColumn("__base", base).withColumn("__spans", base).drop("__cands", "__text")
    model, cuts = fitted
    limits = F.array(*[F.lit(float(cuts.get(i, 2.0))) for i in range(len(KINDS))])
    free = F.filter("__cands", lambda c: (c["label"] == 0) & ~F.exists("__base", lambda b: _meets(b, c)))
    out = out.withColumn("__free", free).withColumn("__scored", F.transform("__free", lambda c: F.struct(
        c["start"].alias("start"), c["end"].alias("end"), c["f"]["kind"].alias("kind"), _score(model, c["f"]).alias("p"))))
    out = out.withColumn("__add", F.array_sort(F.filter("__scored", lambda c: c["p"] >= F.get(limits, c["kind"]))))
    add = F.col("__add")

    def wins(c: Column) -> Column:
        # Against all others of the text: an overlap may lie any number of candidates away.
        better = lambda o: (o["p"] > c["p"]) | ((o["p"] == c["p"]) & ((o["kind"] < c["kind"]) | ((o["kind"] == c["kind"]) & (o["start"] < c["start"]))))
        return ~F.exists(add, lambda o: _meets(o, c) & better(o))

    added = F.transform(F.filter(add, wins), lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end")))
    return out.withColumn("__base", base).withColumn("__spans", F.array_sort(F.concat("__base", added))).drop("__cands", "__free", "__scored", "__add", "__text")


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def find(docs: DataFrame, fitted, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base counts by kind, digest of the base spans, and all spans, per document."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    n = [F.size(F.filter("__base", _of_kind(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return with_spans(own, fitted).select("doc_id", *n, F.sha2(_joined(F.col("__base")).cast("binary"), 256).alias("base_sha256"), _joined(F.col("__spans")).alias("spans"))


def redact(docs: DataFrame, fitted, text_col: str = "text") -> DataFrame:
    """``docs`` with every span of its text replaced by ``<kind>``; other columns and NULL texts as they were."""
    names = F.array(*[F.lit(f"<{k}>") for k in KINDS])
    own = wrapped(docs).withColumn("text", F.col("row").getField(text_col))     # no column of the caller's stands beside ours
    text = F.col("text")
    order = F.array_sort(F.transform("__spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def step(acc: Column, s: Column) -> Column:
        # A span that overlaps the one before only takes more text away.
        fresh = s["start"] >= acc["at"]
        more = F.when(fresh, F.concat(acc["out"], F.substr(text, acc["at"] + 1, s["start"] - acc["at"]), F.get(names, s["kind"]))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), more.alias("out"))

    whole = F.aggregate(order, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step,
                        lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1, F.length(text))))
    return unwrapped(with_spans(own, fitted), docs.columns, **{text_col: F.when(F.size("__spans") > 0, whole).otherwise(text)})
