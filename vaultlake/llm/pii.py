"""Personal data: base patterns, and further spans chosen by boosted trees.

* Base kinds (email, ip, card, phone) are matched in the whole text, leftmost and non-overlapping
  per kind; the patterns are written with possessive repetition and look-behind, so that matching
  takes linear time on long runs, with the same matches.  Positions come from the pieces between the
  matches.
* Generators of high recall propose spans (they may overlap): digits with separators, names at hosts
  also when spelled out, and groups of hex digits with colons or dots.
* Each proposal has features of its format and of the 24 characters on either side.  Gradient
  boosted trees (pyspark.ml, in the JVM) learn from at most `TRAIN_ROWS` proposals, sampled by hash,
  whether a base span covers them.  On all proposals of the other half of the documents, each
  generator's threshold is the least score from which on the share of covered ones is `PRECISION` or
  more; without such a score, or below `LEAST_CASES` proposals, the generator adds nothing.
* A proposal that overlaps no base span and scores at or above the threshold is added; added spans
  that overlap are merged, under the name of the one with the highest score.

Everything is DataFrame operations; the text is read once, what it gave is kept in the shared
checkpoint folder, and only spans are shuffled.  Overlaps are found by a join on cells of `CELL`
characters, so that a text with very many spans costs no more than in proportion.

Defined cases: null counts as empty and has no spans; base_sha256 is then that of the empty string.
Repeated rows are each returned, a null doc_id too.  Without proposals, or when all or none are
covered, nothing is added.  Without rows there are none.  Other columns are neither read nor returned.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vaultlake.llm.common import body, checkpointed

KINDS = ("email", "ip", "card", "phone")
#: The local part starts where its run of characters does, or where the last match has ended.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
#: Whole runs of 13 to 19 digits; shorter and longer runs fail as a whole.
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?+[0-9]){12,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
VALID_IP = rf"^{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}$"

GENERATORS = ("number_like", "email_like", "address_like")
NUMBER_LIKE = r"(?<![0-9A-Za-z])[+(]?[0-9](?:[\x20()./-]{0,2}+[0-9]){6,}+(?![A-Za-z])"
EMAIL_LIKE = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?+(?:@|[\[({]at[\])}])\x20?+[A-Za-z0-9-]++(?:\x20?+(?:\.|[\[({]dot[\])}])\x20?+[A-Za-z0-9-]++)*+"
ADDRESS_LIKE = r"(?<![0-9A-Za-z.:])[0-9A-Fa-f]{1,4}+(?:[.:]{1,2}[0-9A-Fa-f]{1,4}+){3,7}+(?![0-9A-Za-z])"
NEAR = 24
CELL = 64
CHUNK = 64
#: Words that often stand before personal data.
CUES = r"(?i)tel|phone|call|fax|mobil|card|visa|iban|account|konto|mail|contact|address|adress|host|\bip\b"

TRAIN_ROWS = 20_000
TREES, DEPTH, STEPS = 20, 4, 50
PRECISION = 0.98
LEAST_CASES = 20


def _matches(text: Column, pattern: str, gate: Column) -> Column:
    """Matches and the pieces before each, found only where `gate` holds."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.when(gate, F.struct(found.alias("m"), F.split(text, pattern, -1).alias("p")))


def _steps(found: Column) -> Column:
    """Array of (skip, t): the length of the piece before a match, and the match."""
    steps = F.zip_with(found["p"], found["m"], lambda p, m: F.struct(F.length(p).alias("skip"), m.alias("t")))
    # the last piece has no match and falls off
    return F.coalesce(F.filter(steps, lambda x: x["t"].isNotNull()), F.expr("cast(array() as array<struct<skip: int, t: string>>)"))


def _spans(steps: Column) -> Column:
    """Array of (s, e, t): start, end, text of the matches, in code points.  Appending copies an
    array, so the matches are taken in chunks.  `steps` has to be a stored column: it is read for
    each chunk."""
    chunks = F.transform(F.sequence(F.lit(0), F.size(steps) - 1, F.lit(CHUNK)), lambda i: F.slice(steps, i + 1, CHUNK))
    one = "array<struct<s: int, e: int, t: string>>"
    empty = F.expr(f"cast(array() as {one})")

    def step(acc, x):
        s = acc["at"] + x["skip"]
        e = s + F.length(x["t"])
        return F.struct(e.alias("at"), F.array_append(acc["out"], F.struct(s.alias("s"), e.alias("e"), x["t"].alias("t"))).alias("out"))

    def chunk(acc, c):
        end = F.aggregate(c, acc["at"], lambda at, x: at + x["skip"] + F.length(x["t"]))
        spans = F.aggregate(c, F.struct(acc["at"].alias("at"), empty.alias("out")), step, lambda a: a["out"])
        return F.struct(end.alias("at"), F.array_append(acc["out"], spans).alias("out"))

    none = F.expr(f"cast(array() as array<{one}>)")
    every = F.aggregate(chunks, F.struct(F.lit(0).alias("at"), none.alias("out")), chunk, lambda acc: F.flatten(acc["out"]))
    return F.when(F.size(steps) == 0, empty).otherwise(every)


def digits(t: Column) -> Column:
    return F.regexp_replace(t, "[^0-9]", "")


def luhn(t: Column) -> Column:
    """Whether the digits of t (at most 20 count) have a Luhn sum divisible by 10."""
    d = F.reverse(F.lpad(digits(t), 20, "0"))
    at = lambda i: F.substring(d, i + 1, 1).cast("int")
    return sum((at(i) if i % 2 == 0 else at(i) * 2 - F.when(at(i) > 4, 9).otherwise(0) for i in range(20)), F.lit(0)) % 10 == 0


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, base (array of k, s, e by kind and start) and proposed (array of g, s, e, t, before,
    after): all that is needed of the texts."""
    rows = docs.select("doc_id", body("text").alias("text"))
    text = F.col("text")
    rows = rows.withColumns({"digit": text.rlike("[0-9]"), "at": text.contains("@"), "group": text.rlike("[0-9A-Fa-f][.:][0-9A-Fa-f]")})
    spelled = text.contains("[at]") | text.contains("(at)") | text.contains("{at}")
    found = {
        "email": _matches(text, EMAIL, F.col("at")),
        "ip": _matches(text, IP, F.col("digit") & F.col("group")),
        "card": _matches(text, CARD, F.col("digit")),
        "phone": _matches(text, PHONE, F.col("digit") & text.contains("+")),
        "number_like": _matches(text, NUMBER_LIKE, F.col("digit")),
        "email_like": _matches(text, EMAIL_LIKE, F.col("at") | spelled),
        "address_like": _matches(text, ADDRESS_LIKE, F.col("digit") & F.col("group")),
    }
    rows = rows.select("doc_id", "text", *(c.alias(k) for k, c in found.items()))
    rows = rows.select("doc_id", "text", *(_steps(F.col(k)).alias(k) for k in found))
    rows = rows.select("doc_id", "text", *(_spans(F.col(k)).alias(k) for k in found))
    n = lambda x: F.length(digits(x["t"]))
    rows = rows.withColumns({
        "ip": F.filter("ip", lambda x: x["t"].rlike(VALID_IP)),
        "card": F.filter("card", lambda x: luhn(x["t"])),
        "phone": F.filter("phone", lambda x: (n(x) >= 9) & (n(x) <= 15)),
    })

    def of_kind(i):
        return lambda x: F.struct(F.lit(i).alias("k"), x["s"].alias("s"), x["e"].alias("e"))

    def proposal(i):
        return lambda x: F.struct(
            F.lit(i).alias("g"), x["s"].alias("s"), x["e"].alias("e"), x["t"].alias("t"),
            F.substring(text, F.greatest(x["s"] - NEAR, F.lit(0)) + 1, F.least(x["s"], F.lit(NEAR))).alias("before"),
            F.substring(text, x["e"] + 1, F.lit(NEAR)).alias("after"),
        )

    base = [F.transform(k, of_kind(i)) for i, k in enumerate(KINDS)]
    proposed = [F.transform(k, proposal(i)) for i, k in enumerate(GENERATORS)]
    return rows.select("doc_id", F.concat(*base).alias("base"), F.concat(*proposed).alias("proposed"))


def features() -> dict[str, Column]:
    t, before, after = F.col("x.t"), F.col("x.before"), F.col("x.after")
    count = lambda c, chars: F.length(c) - F.length(F.translate(c, chars, ""))
    out = {f"is_{g}": F.col("x.g") == i for i, g in enumerate(GENERATORS)}
    out |= {
        "length": F.length(t), "digits": F.length(digits(t)), "letters": F.regexp_count(t, F.lit("[A-Za-z]")),
        "spaces": count(t, " "), "dots": count(t, "."), "dashes": count(t, "-"), "colons": count(t, ":"), "brackets": count(t, "()"),
        "at_signs": count(t, "@"), "plus": t.startswith("+"), "groups": F.size(F.split(t, "[^0-9A-Za-z]+")),
        "longest": F.array_max(F.transform(F.split(t, "[^0-9A-Za-z]+"), F.length)),
        "distinct": F.size(F.array_distinct(F.split(t, ""))), "luhn": luhn(t),
        "octets": t.rlike(VALID_IP), "dotted_end": t.rlike(r"@[^@]*\.[A-Za-z]{2,}$"),
        "cue_before": before.rlike(CUES), "word_before": before.rlike(r"[^\W\d_]\s*$"), "digit_before": before.rlike(r"[0-9]\W?$"),
        "space_before": (before == "") | before.rlike(r"\s$"), "space_after": (after == "") | after.rlike(r"^\s"),
        "digit_after": after.rlike(r"^\W?[0-9]"), "upper_before": before.rlike(r"[A-Z][a-z]*\W*$"), "marks_near": F.regexp_count(F.concat(before, after), F.lit(r"[%#$&*!]")),
    }
    return {k: v.cast("double") for k, v in out.items()}


def _sample(seed: int, n: int, most: int) -> Column:
    """Marks about `most` of the n proposals, the same ones each time."""
    u = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "g", "s"), F.lit(1_000_000))
    return u < int(1_000_000 * min(1.0, most / max(n, 1)))


def _thresholds(scored: DataFrame) -> dict[int, float]:
    bins = scored.groupBy("g", F.floor(F.col("score") * STEPS).alias("bin")).agg(F.sum("label").alias("hits"), F.count("*").alias("n")).collect()
    out = {}
    for g in range(len(GENERATORS)):
        hits = n = 0
        for b in sorted((b for b in bins if b["g"] == g), key=lambda b: -b["bin"]):
            hits, n = hits + b["hits"], n + b["n"]
            if n >= LEAST_CASES and hits >= PRECISION * n:
                out[g] = b["bin"] / STEPS
    return out


def proposals(scanned: DataFrame) -> DataFrame:
    """One row per proposal: rid, doc_id, x, label (1: overlaps a base span), features."""
    every = scanned.select("rid", "doc_id", F.explode("proposed").alias("x"))
    cells = lambda s, e: F.explode(F.sequence(F.expr(f"{s} div {CELL}"), F.expr(f"({e} - 1) div {CELL}"))).alias("cell")
    mine = every.select("rid", F.col("x.g").alias("g"), F.col("x.s").alias("s"), F.col("x.e").alias("e"), cells("x.s", "x.e"))
    base = scanned.select("rid", F.explode("base").alias("b")).select("rid", F.col("b.s").alias("bs"), F.col("b.e").alias("be"), cells("b.s", "b.e"))
    covered = mine.join(base, ["rid", "cell"]).where("bs < e and s < be").select("rid", "g", "s").distinct().withColumn("label", F.lit(1.0))
    rows = every.withColumns({"g": F.col("x.g"), "s": F.col("x.s")}).join(covered, ["rid", "g", "s"], "left").fillna(0.0, ["label"])
    return checkpointed(
        rows.withColumns(features()).select(
            "rid", "doc_id", "g", "s", F.col("x.e").alias("e"), "label", F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(2)).alias("part"), *features()
        )
    )


def added_spans(scanned: DataFrame) -> DataFrame | None:
    """rid, added (array of g, s, e) of the rows with added spans; None if nothing can be learned."""
    rows = proposals(scanned)
    kinds = rows.groupBy("part").agg(F.count("*").alias("n"), F.sum("label").alias("hits")).collect()
    sizes = {r["part"]: r["n"] for r in kinds}
    if not any(r["part"] == 0 and 0 < r["hits"] < r["n"] for r in kinds) or 1 not in sizes:
        return None
    vector = VectorAssembler(inputCols=list(features()), outputCol="features")
    train = vector.transform(rows.where((F.col("part") == 0) & _sample(2, sizes[0], TRAIN_ROWS))).select("features", "label")
    train = train.coalesce(2).cache()
    if train.select("label").distinct().count() < 2:
        return None
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, maxBins=16, stepSize=0.2, seed=5).fit(train)
    train.unpersist()
    score = vector_to_array("probability")[1]
    tested = rows.where("part = 1")
    limits = _thresholds(model.transform(vector.transform(tested)).select("g", score.alias("score"), "label"))
    if not limits:
        return None
    limit = F.coalesce(*(F.when(F.col("g") == g, F.lit(v)) for g, v in limits.items()), F.lit(2.0))
    new = model.transform(vector.transform(rows.where("label = 0"))).select("rid", "g", "s", "e", score.alias("score")).where(F.col("score") >= limit)
    before = Window.partitionBy("rid").orderBy("s", "e", "g")
    reach = F.max("e").over(before.rowsBetween(Window.unboundedPreceding, -1))
    new = new.withColumn("apart", F.coalesce((F.col("s") >= reach).cast("int"), F.lit(1))).withColumn("island", F.sum("apart").over(before))
    merged = new.groupBy("rid", "island").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.max_by("g", F.struct("score", -F.col("g"))).alias("g"))
    return merged.groupBy("rid").agg(F.collect_list(F.struct("g", "s", "e")).alias("added"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def find_personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of `docs` (doc_id, text)."""
    scanned = checkpointed(scan(docs).withColumn("rid", F.monotonically_increasing_id()))
    added = added_spans(scanned)
    empty = F.expr("cast(array() as array<struct<g: int, s: int, e: int>>)")
    rows = scanned.select("rid", "doc_id", "base")
    rows = rows.withColumn("added", empty) if added is None else rows.join(added, "rid", "left").withColumn("added", F.coalesce("added", empty))
    named = lambda names, field: lambda x: F.struct(
        F.element_at(F.array(*map(F.lit, names)), x[field] + 1).alias("kind"), x["s"].alias("s"), x["e"].alias("e")
    )
    base = F.transform("base", named(KINDS, "k"))
    extra = F.transform(F.sort_array("added"), named(GENERATORS, "g"))
    count = lambda i: F.size(F.filter("base", lambda x: x["k"] == i)).cast("long")
    return rows.select(
        "doc_id", *(count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)),
        F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.concat(base, extra)).alias("spans"),
    )
