"""Personal data: base patterns by position, and information-theoretic sanitisation of the terms around them.

Base spans come from the text's pieces between matches, so every stage is built-in expressions over whole texts. Then each matched
value is a protected entity c, and the words of its texts are terms t. Over all distinct texts, with N of them, n(c) those with the
entity, n(t) those with the term and n(t,c) those with both, the term discloses the share

    r = PMI(t;c) / IC(c) = 1 + ln(n(t,c) / n(t)) / -ln(n(c) / N)

of the entity's information: 1 if the term never stands without it. Terms seen with an entity in `min_contexts` different texts
are removed from `remove` on and generalised (to their kind of word) from `generalise` on, wherever they stand in texts with that entity.
Pairs are counted in partial sums before any shuffle; n(t) is counted over every word of every distinct text.

Defined cases: a null text counts as empty, without spans; spans are half-open code point ranges; equal texts count once in every number, and
a text that differs in any character is another; terms are letters between base spans, three or more; a share equal to a threshold reaches
it; base spans of different kinds may overlap and all are listed, while sanitised text replaces their union; rows that share id and text
share their result; very long texts are searched whole; an empty table gives no rows; other columns are ignored, or kept as they are,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, materialize, once, release

#: Fixed values, in the order of listing. Written so that no match depends on backtracking over a repeated group; card matches of
#: under 16 digits are never valid, so the pattern leaves them out. Equal to the contract's patterns otherwise.
KINDS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){15,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a kind to be looked for at all.
HINTS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
TERM = "term"
TERMS = r"\p{L}{3,}"
_BYTE_PART = "0*(?:[0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"
SPANS = "array<struct<start:bigint,end:bigint,value:string>>"

#: Sides of a join are broadcast up to this many rows, counted first; beyond it the join shuffles.
MOST_BROADCAST = 100_000


def located(text: Column, pattern: str, only=None) -> Column:
    """All leftmost non-overlapping matches as (start, end, value), or those whose value `only` holds for."""
    start = F.struct(F.lit(0).cast("bigint").alias("pos"), F.array().cast(SPANS).alias("out"))

    def fold(pieces: Column, values: Column) -> Column:
        def step(a: Column, i: Column) -> Column:
            s = a["pos"] + F.length(F.get(pieces, i))
            v = F.get(values, i)
            more = lambda x: F.concat(a["out"], F.array(F.struct(x["s"].alias("start"), x["e"].alias("end"), v.alias("value"))))
            out = lambda x: more(x) if only is None else F.when(only(v), more(x)).otherwise(a["out"])
            return let(F.struct(s.alias("s"), (s + F.length(v)).alias("e")), lambda x: F.struct(x["e"].alias("pos"), out(x).alias("out")))

        return F.aggregate(F.transform(values, lambda _, i: i), start, step, lambda a: a["out"])

    return let(F.split(text, pattern, -1), lambda p: let(F.regexp_extract_all(text, F.lit(pattern), 0), lambda v: F.when(F.size(v) == 0, F.array().cast(SPANS)).otherwise(fold(p, v))))


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def weigh(d: Column, i: Column) -> Column:
        n = F.coalesce(d.try_cast("int"), F.lit(0))
        return F.when(i % 2 == 0, n).otherwise(n * 2 - F.when(n > 4, 9).otherwise(0))

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), weigh), F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(f"^{_BYTE_PART}(?:\\.{_BYTE_PART}){{3}}$")
    if kind == "card":
        return let(_digits(value), lambda d: F.length(d).between(16, 19) & _luhn(d))
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """A struct with the valid spans of each kind."""
    none = F.array().cast(SPANS)
    found = lambda t, k: F.when(t.rlike(HINTS[k]), F.filter(located(t, KINDS[k]), lambda x: _valid(k, x["value"]))).otherwise(none)
    return let(F.coalesce(text, F.lit("")), lambda t: F.struct(*[found(t, k).alias(k) for k in KINDS]))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, min_contexts: int = 3, remove: float = 0.97, generalise: float = 0.9, base_as: str = "base", terms_as: str = "terms") -> DataFrame:
    """The kept columns, `base` (struct of spans by kind) and `terms` (spans with action), for every row; both can have other names, and win over kept columns of theirs."""
    keep = [c for c in ([id_col] if keep is None else keep) if c.lower() not in (base_as.lower(), terms_as.lower())]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(id_col).alias("id"), text.alias("t"))
    base = rows.select("row", "id", F.xxhash64("t").alias("h"), once(base_spans(F.col("t"))).alias("base"))
    hits = materialize(_hits(rows), "pii-texts")
    entities = materialize(hits.select("h", F.explode("entities").alias("entity")).distinct(), "pii-entities")
    flagged = materialize(_disclosive(rows, hits, entities, min_contexts, remove, generalise), "pii-terms")
    if flagged.count() <= MOST_BROADCAST:
        flagged = F.broadcast(flagged)
    marks = entities.join(flagged, "entity").groupBy("h", "term").agg(F.max("action").alias("action"))
    marks = materialize(marks.groupBy("h").agg(F.map_from_entries(F.collect_list(F.struct("term", "action"))).alias("marks")), "pii-marks")  # one text's own terms
    if marks.count() <= MOST_BROADCAST:
        marks = F.broadcast(marks)
    found = located(F.col("t"), TERMS, lambda v: F.map_contains_key("marks", F.lower(v)))
    found = F.transform(found, lambda x: let(F.lower(x["value"]), lambda v: F.struct(x["start"].alias("start"), x["end"].alias("end"), v.alias("value"), F.element_at("marks", v).alias("action"))))
    spans = hits.join(marks, "h").select("id", "h", once(found).alias("terms")).where(F.size("terms") > 0)
    spans = spans.groupBy("id", "h").agg(F.first("terms").alias("terms"))  # of rows that repeat id and text
    spans = materialize(spans, "pii-spans")
    if spans.count() <= MOST_BROADCAST:
        spans = F.broadcast(spans)
    release(hits)
    out = base.alias("b").join(spans.alias("s"), F.col("b.id").eqNullSafe(F.col("s.id")) & (F.col("b.h") == F.col("s.h")), "left")
    none = F.array().cast("array<struct<start:bigint,end:bigint,value:string,action:string>>")
    return out.select("row.*", F.col("b.base").alias(base_as), F.coalesce("s.terms", none).alias(terms_as))


def _hits(rows: DataFrame) -> DataFrame:
    """The texts with entities: id, h, t (with blanks in place of the base spans) and their distinct entities."""
    hit = F.lit(False)
    for k in KINDS:
        hit = hit | F.col("t").rlike(KINDS[k])
    some = rows.select("id", once(F.col("t")).alias("t")).where(hit)
    some = some.select("id", "t", F.xxhash64("t").alias("h"), once(base_spans(F.col("t"))).alias("base"))
    named = lambda k: lambda x: F.struct(F.concat(F.lit(k + ":"), F.lower(x["value"])).alias("entity"), x["start"].cast("int").alias("s"), x["end"].cast("int").alias("e"))
    every = F.concat(*[F.transform(f"base.{k}", named(k)) for k in KINDS])
    found = some.select("id", "h", "t", once(every).alias("every")).where(F.size("every") > 0)
    blank = F.aggregate("every", F.col("t"), lambda t, x: F.overlay(t, F.repeat(F.lit(" "), x["e"] - x["s"]), x["s"] + 1, x["e"] - x["s"]))
    return found.select("id", "h", once(blank).alias("t"), F.array_distinct(F.transform("every", lambda x: x["entity"])).alias("entities"))


def _disclosive(rows: DataFrame, hits: DataFrame, entities: DataFrame, min_contexts: int, remove: float, generalise: float) -> DataFrame:
    """term, entity, action, n_tc, n_c, n_t of the pairs above the thresholds."""
    copies = materialize(rows.select(F.xxhash64("t").alias("h")).groupBy("h").agg(F.count("*").alias("copies")), "pii-copies")
    n_docs = copies.count()
    copies = copies.where("copies > 1")
    if copies.count() <= MOST_BROADCAST:
        copies = F.broadcast(copies)
    ic = F.greatest(-F.log(F.col("n_c") / F.lit(float(max(n_docs, 1)))), F.lit(1e-9))
    share = lambda both, n: 1 + F.log(F.least(F.col(both) / F.col(n), F.lit(1.0))) / ic
    live = entities.groupBy("entity").agg(F.count("*").alias("n_c")).where(F.col("n_c") >= min_contexts)
    live = materialize(entities.join(live, "entity").select("h", "entity", "n_c"), "pii-live")
    texts = live.select("h").distinct()
    if texts.count() <= MOST_BROADCAST:
        texts = F.broadcast(texts)
    # Distinct blanked texts first: copies have their words taken once.
    near = hits.join(texts, "h", "left_semi").select("h", "t").distinct()
    near = near.select("h", F.explode(F.array_distinct(F.transform(F.split("t", r"[^\p{L}]+"), lambda w: F.lower(w)))).alias("term")).where(F.length("term") >= 3)
    near = materialize(near, "pii-words")
    # The texts that hold a term and an entity are a lower bound of n(t), and n(c) is an upper one of n(t,c): pairs that fail with these fail for certain.
    most = live.agg(F.max(F.col("n_c") * F.exp((1 - generalise) * ic))).first()[0] or 0.0
    n_near = near.groupBy("term").agg(F.count("*").alias("n_near")).where((F.col("n_near") >= min_contexts) & (F.col("n_near") <= most + 1e-6))
    n_near = materialize(n_near, "pii-near")
    if n_near.count() <= MOST_BROADCAST:
        n_near = F.broadcast(n_near)
    pairs = near.join(n_near, "term").join(live, "h").where(share("n_c", "n_near") >= generalise)
    pairs = pairs.groupBy("term", "entity").agg(F.count("*").alias("n_tc"), F.first("n_near").alias("n_near"), F.first("n_c").alias("n_c"))
    pairs = materialize(pairs.where((F.col("n_tc") >= min_contexts) & (share("n_tc", "n_near") >= generalise)), "pii-pairs")
    terms = pairs.select("term").distinct()
    n_terms = terms.count()
    if n_terms == 0:
        return pairs.select("term", "entity", F.lit("remove").alias("action"), "n_tc", "n_c", F.col("n_near").alias("n_t"))
    if n_terms <= MOST_BROADCAST:
        terms = F.broadcast(terms)
    # A text in k copies gives k rows for each of its words: counted by k, and divided by it.
    words = rows.select(F.xxhash64("t").alias("h"), once(F.col("t")).alias("t")).join(copies, "h", "left").select(F.coalesce("copies", F.lit(1)).alias("copies"), F.explode(F.array_distinct(F.split(F.lower("t"), r"[^\p{L}]+"))).alias("term"))
    n_term = words.join(terms, "term", "left_semi").groupBy("term", "copies").agg(F.count("*").alias("rows"))
    n_term = n_term.groupBy("term").agg(F.sum(F.expr("rows div copies")).alias("n_all"))
    scored = pairs.join(n_term, "term", "left").withColumn("n_t", F.greatest(F.coalesce("n_all", F.lit(0)), "n_near"))
    return scored.where(share("n_tc", "n_t") >= generalise).select("term", "entity", F.when(share("n_tc", "n_t") >= remove, "remove").otherwise("generalise").alias("action"), "n_tc", "n_c", "n_t")


def listed(with_terms: bool) -> Column:
    """kind:start:end of all spans, by kind and start, comma-joined."""
    one = lambda k: lambda x: F.concat_ws(":", F.lit(k), x["start"].cast("string"), x["end"].cast("string"))
    parts = [F.transform(f"base.{k}", one(k)) for k in KINDS]
    if with_terms:
        parts.append(F.transform("terms", one(TERM)))
    return F.array_join(F.concat(*parts), ",")


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The columns of query op7 from find()'s."""
    counts = [F.size(f"base.{k}").cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select(id_col, *counts, F.sha2(listed(False), 256).alias("base_sha256"), listed(True).alias("spans"))


def sanitised(text: Column, base: Column, terms: Column) -> Column:
    """The text with base spans and removed terms replaced by their labels, and other terms by their kind of word; overlapping spans become one."""
    label = lambda name: (lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(name).alias("label")))
    kind = lambda v: F.when(v.rlike(r"^\p{Lu}"), "[NAME]").otherwise("[WORD]")
    every = F.concat(
        *[F.transform(base[k], label(f"[{k.upper()}]")) for k in KINDS],
        F.transform(terms, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.when(x["action"] == "remove", "[TERM]").otherwise(kind(F.substring(text, (x["start"] + 1).cast("int"), F.lit(1)))).alias("label"))),
    )
    typed = "array<struct<start:bigint,end:bigint,label:string>>"

    def join(done: Column, x: Column) -> Column:
        last = lambda f: F.get(done, F.size(done) - 1)[f]
        grown = F.struct(last("start").alias("start"), F.greatest(last("end"), x["end"]).alias("end"), last("label").alias("label"))
        return F.when((F.size(done) > 0) & (last("end") > x["start"]), F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(grown))).otherwise(F.concat(done, F.array(x)))

    def put(s: Column) -> Column:
        piece = lambda x, i: F.concat(F.substring(text, (F.coalesce(F.get(s, i - 1)["end"], F.lit(0)) + 1).cast("int"), (x["start"] - F.coalesce(F.get(s, i - 1)["end"], F.lit(0))).cast("int")), x["label"])
        tail = F.substring(text, (F.get(s, F.size(s) - 1)["end"] + 1).cast("int"), F.length(text))
        return F.concat(F.array_join(F.transform(s, piece), ""), tail)

    return let(every, lambda v: F.when(F.size(v) == 0, text).otherwise(let(F.aggregate(F.sort_array(v), F.array().cast(typed), join), put)))
