"""Operator 5, PII by information-theoretic sanitisation, in DataFrame functions only.

Base entities are found by patterns (email, ip, card, phone). How strongly a term reveals an entity is
estimated from the corpus: of n(t) documents with term t, n(e,t) have t inside the window of characters
around entity e, in m different texts, and p(e) is the share of different texts with e,

    p(e|t) = (m n(e,t) / n(t) + PRIOR p(e)) / (m + PRIOR),
    disclosure(e, t) = log2(p(e|t) / p(e)) / log2(1 / p(e)),

the pointwise mutual information as a share of the entity's information content; it nears 1 where t occurs
with e alone. Every pair that meets is scored, also of an entity in one text only. The prior weighs as much
as PRIOR texts (copies of one text are one piece of evidence), so that a word seen once beside a frequent
entity is not taken for a sign of it, while one seen once beside a rare entity is. Terms are generalised
from GENERALISE on and removed from REMOVE on, wherever they stand in the window of that entity. A term is
generalised to its first WIDER letters and "*", for all words that begin so, if the disclosure of these
together is surely less than GENERALISE, else to its kind: <NUMBER>, <CODE> (with digits) or <WORD>. A term is
a whole word of letters and digits, of any length; a word that the window's edge or the entity cuts is
none. Counts are over all documents, and combined in the map tasks. Matches and their
places come from one matching rule: split() gives the gaps between the matches of regexp_extract_all(). A
text of very many matches costs little more than its length (scanned(), pieces_of()).

Defined cases: null text counts as empty; repeated rows give equal rows; ids may be null or repeated
(nothing is keyed by them); an empty table gives an empty result; columns beside text are kept as they
are, except that n_chars follows a changed text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import read, work_table

KINDS = ("email", "ip", "card", "phone", "term")
WINDOW = 80
PRIOR = 1
GENERALISE, REMOVE = 0.85, 0.95
#: Characters of a term that its wider term keeps.
WIDER = 3

# Each pattern matches exactly what the plain one of the contract does. Runs are possessive and begin
# where a run can begin (or where the last match ended), so that long runs cost linear time.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){11}(?:[\x20-]?[0-9])*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without these has no match; contains() is much cheaper than a pattern.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
_PART = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
_LETTER = r"\p{L}\p{M}\p{N}"
_WORD = rf"[{_LETTER}]++"
_MATCH = "array<struct<start:int,end:int,value:string>>"
_MENTIONS = "array<struct<entity:string,start:int,end:int,left:string,right:string>>"


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def scanned(values: Column, op, block: int = 64) -> Column:
    """For each of the values (integers from 0 on) the op of all before it, 0 for the first: within blocks,
    and over blocks of blocks, so that the arrays which grow by an element at a time stay short."""

    def grown(part: Column, start: Column) -> Column:
        zero = F.struct(start.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(part, zero, lambda acc, x: F.struct(op(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

    def parts(xs: Column, size: int) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / size).cast("int")), lambda i: F.slice(xs, i * size + 1, F.lit(size)))

    def total(part: Column) -> Column:
        return F.aggregate(part, F.lit(0), op)

    def starts(sums: Column) -> Column:  # of blocks, by blocks of blocks
        return let(parts(sums, block), lambda groups: let(grown(F.transform(groups, total), F.lit(0)), lambda heads: F.flatten(F.zip_with(groups, heads, grown))))

    def whole(xs: Column) -> Column:
        return let(parts(xs, block), lambda blocks: F.flatten(F.zip_with(blocks, starts(F.transform(blocks, total)), grown)))

    return F.when(F.size(values) > 0, whole(values)).otherwise(F.array().cast("array<int>"))


def located(text: Column, pattern: str) -> Column:
    """All matches with their places (code points, end exclusive)."""
    found = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("values"), F.split(text, pattern, -1).alias("gaps"))

    def places(m: Column) -> Column:
        steps = F.zip_with(F.slice(m["gaps"], 1, F.size(m["values"])), m["values"], lambda g, v: F.length(g) + F.length(v))
        return let(scanned(steps, lambda a, b: a + b), lambda before: F.transform(m["values"], lambda v, i: let(F.get(before, i) + F.length(F.get(m["gaps"], i)), lambda start: F.struct(start.alias("start"), (start + F.length(v)).alias("end"), v.alias("value")))))

    return let(found, lambda m: F.when(F.size(m["values"]) > 0, places(m)).otherwise(F.array().cast(_MATCH)))


#: Characters of a piece of a text, and of the next piece that it repeats: more than any window.
PIECE, LAP = 1024, 1024


def pieces_of(text: Column) -> Column:
    """The text in pieces that overlap: a substring from a piece costs the same anywhere in a long text."""
    return F.transform(F.sequence(F.lit(0), F.floor(F.length(text) / PIECE).cast("int")), lambda i: F.substring(text, i * PIECE + 1, F.lit(PIECE + LAP)))


def cut(text: Column, pieces: Column, at: Column, size: Column) -> Column:
    """The `size` characters of the text from place `at` (from 0) on."""
    near = F.substring(F.get(pieces, F.floor(at / PIECE).cast("int")), at % PIECE + 1, size)
    return F.when(size <= LAP, near).otherwise(F.substring(text, at + 1, size))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    digits = F.reverse(_digits(value))

    def step(acc: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return acc + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), step) % 10 == 0


KEEP = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: v.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"),
    "card": lambda v: F.length(_digits(v)).between(12, 19) & _luhn(v),
    "phone": lambda v: F.length(_digits(v)).between(9, 15),
}


def base_matches(text: Column, kind: str) -> Column:
    """The kept matches of one kind."""
    need, none = NEEDS[kind], F.array().cast(_MATCH)
    may = F.contains(text, F.lit(need)) if need else text.rlike(PATTERNS[kind])
    return F.when(may, F.filter(located(text, PATTERNS[kind]), lambda m: KEEP[kind](m["value"]))).otherwise(none)


def _entity(kind: str, value: Column) -> Column:
    return F.concat(F.lit(kind + ":"), _digits(value) if kind in ("card", "phone") else F.lower(value))


def _span(kind: int):
    return lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end"))


def _mention(kind: str, text: Column, pieces: Column):
    """The entity, its place, and the text around it by position, whatever else is matched there: with one
    character more at either end, which shows whether a word is cut."""

    def mention(m: Column) -> Column:
        at = F.greatest(m["start"] - WINDOW - 1, F.lit(0))
        return F.struct(_entity(kind, m["value"]).alias("entity"), m["start"].alias("start"), m["end"].alias("end"), cut(text, pieces, at, m["start"] + 1 - at).alias("left"), cut(text, pieces, m["end"] - 1, F.lit(WINDOW + 2)).alias("right"))

    return mention


def with_base(docs: DataFrame, text: str, keep: list[Column]) -> DataFrame:
    """keep, the key of the text (h1, h2), base: spans (start, kind, end) in order, and mentions."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(*keep, whole.alias("_whole"), F.xxhash64(whole).alias("h1"), F.xxhash64(whole, F.lit(5)).alias("h2"), *[base_matches(whole, k).alias("_" + k) for k in KINDS[:-1]])
    spans = [F.transform("_" + k, _span(i)) for i, k in enumerate(KINDS[:-1])]

    def mentioned(pieces: Column) -> Column:
        return F.concat(*[F.transform("_" + k, _mention(k, F.col("_whole"), pieces)) for k in KINDS[:-1]])

    rows = rows.withColumn("_any", F.size(F.col("_email")) + F.size("_ip") + F.size("_card") + F.size("_phone") > 0)
    base = F.when(F.col("_any"), F.array_sort(F.concat(*spans))).otherwise(F.array().cast("array<struct<start:int,kind:int,end:int>>"))
    return rows.withColumns({"base": base, "mentions": F.when(F.col("_any"), let(pieces_of(F.col("_whole")), mentioned)).otherwise(F.array().cast(_MENTIONS))}).drop("_any", "_whole", *["_" + k for k in KINDS[:-1]])


def revealing_terms(docs: DataFrame, based: DataFrame, text: str, window: int = WINDOW, prior: float = PRIOR, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """h1, h2, terms: for each distinct text, the spans (start, end, remove, wider) of terms that reveal an
    entity that it mentions; wider replaces the term. based: a stored result of with_base()."""
    key = ["h1", "h2"]
    mention = based.where(F.size("mentions") > 0).groupBy(*key).agg(F.first("mentions").alias("m"), F.count("*").alias("docs")).select(*key, "docs", F.explode("m").alias("m")).select(*key, "docs", "m.*")
    found = lambda side, at: F.transform(located(F.col(side), _WORD), lambda w: F.struct(F.lower(w["value"]).alias("term"), (at + w["start"]).alias("start"), (at + w["end"]).alias("end")))
    left = F.filter(found("left", F.col("start") + 1 - F.length("left")), lambda w: (w["start"] >= F.col("start") - WINDOW) & (w["end"] <= F.col("start")))
    right = F.filter(found("right", F.col("end") - 1), lambda w: (w["start"] >= F.col("end")) & (w["end"] <= F.col("end") + WINDOW))
    near = work_table(mention.select(*key, "docs", "entity", F.explode(F.concat(left, right)).alias("w")).select(*key, "docs", "entity", "w.*"), "near")
    joint = near.select("entity", "term", "docs", *key).distinct().groupBy("entity", "term").agg(F.count("*").alias("texts"), F.sum("docs").alias("n_et"))
    entities = mention.select("entity", *key).distinct().groupBy("entity").agg(F.count("*").alias("n_e"))
    joint = work_table(joint.join(entities, "entity"), "joint")
    words = F.array_distinct(F.split(F.lower(F.coalesce(F.col(text).cast("string"), F.lit(""))), rf"[^{_LETTER}]+"))
    terms = work_table(docs.select(F.explode(words).alias("term")).groupBy("term").agg(F.count("*").alias("n_t")), "terms")
    share = F.col("n_e") / F.lit(based.select(*key).distinct().count())
    scored = joint.join(terms, "term").withColumn("p_e", share).where("p_e < 1")

    def disclosed(texts: str, n_et: str, n_t: str) -> Column:
        posterior = (F.col(texts) * F.col(n_et) / F.col(n_t) + prior * F.col("p_e")) / (F.col(texts) + prior)
        return 1 - F.log2(posterior) / F.log2("p_e")

    flagged = scored.withColumn("disclosure", disclosed("texts", "n_et", "n_t")).where(F.col("disclosure") >= generalise)
    # a wider term: all words with the same beginning, bounded from what is known of them: as many
    # documents as the most frequent of them has, and near the entity as many as all of them together
    flagged = flagged.withColumn("wide", F.when(F.length("term") > WIDER, F.substring("term", 1, WIDER)))
    widest = terms.where(F.length("term") > WIDER).groupBy(F.substring("term", 1, WIDER).alias("wide")).agg(F.max("n_t").alias("n_w"))
    near_e = joint.where(F.length("term") > WIDER).groupBy("entity", F.substring("term", 1, WIDER).alias("wide")).agg(F.sum("texts").alias("texts_w"), F.sum("n_et").alias("n_ew"))
    flagged = flagged.select("entity", "term", "disclosure", "p_e", "wide").join(widest, "wide", "left").join(near_e, ["entity", "wide"], "left")
    hides = disclosed("texts_w", "least_w", "n_w") < generalise
    flagged = flagged.withColumn("least_w", F.least("n_ew", "n_w")).select("entity", "term", "disclosure", F.when(hides, F.col("wide")).alias("wide"))
    spans = near.join(flagged, ["entity", "term"]).groupBy(*key, "start", "end").agg(F.max("disclosure").alias("disclosure"), F.first("term").alias("term"), F.max("wide").alias("wide"), F.min(F.col("wide").isNotNull()).alias("hides"))
    shape = F.when(F.col("term").rlike(r"^\p{N}+$"), "<NUMBER>").when(F.col("term").rlike(r"\p{N}"), "<CODE>").otherwise("<WORD>")
    wider = F.when(F.col("disclosure") >= remove, "").when(F.col("hides"), F.concat("wide", F.lit("*"))).otherwise(shape)
    return spans.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("start", "end", (F.col("disclosure") >= remove).alias("remove"), wider.alias("wider")))).alias("terms"))


def find(docs: DataFrame, text: str = "text", keep: list[str] | None = None, **params) -> DataFrame:
    """keep (of docs), h1, h2, base and terms: arrays of spans; terms is empty where none is revealing."""
    based = work_table(with_base(docs, text, [F.col(f"`{c}`") for c in keep or []]), "base")
    terms = work_table(revealing_terms(docs, based, text, **params), "terms")
    return based.drop("mentions").join(terms, ["h1", "h2"], "left").withColumn("terms", F.coalesce("terms", F.array().cast(terms.schema["terms"].dataType)))


def _replaced(text: Column, spans: Column) -> Column:
    """The text with spans (start, kind, end, tag), in order, replaced by their tags; spans that overlap are
    one, with the tag of the first, and that of the first base entity if a term comes before it."""
    largest = lambda a, b: F.greatest(a, b)
    is_base = lambda s: s["kind"] != KINDS.index("term")
    place = lambda i: (i + 1).cast("int")

    def written(pieces: Column, ends: Column, begins: Column, entities: Column) -> Column:
        def one(s: Column, i: Column) -> Column:
            at = F.get(ends, i)
            apart = s["start"] >= at
            begin = F.greatest(F.get(begins, i), F.when(apart, place(i)).otherwise(0))
            entity = is_base(s) & (F.get(entities, i) < begin)
            return F.when(apart, F.concat(cut(text, pieces, at, s["start"] - at), s["tag"])).when(entity, s["tag"]).otherwise("")

        last = F.array_max(F.transform(spans, lambda s: s["end"]))
        return F.concat(F.array_join(F.transform(spans, one), ""), F.substring(text, last + 1, F.length(text)))

    def by_ends(ends: Column) -> Column:
        # of the spans before: the largest end, the last that begins apart, the last base entity
        begins = scanned(F.transform(spans, lambda s, i: F.when(s["start"] >= F.get(ends, i), place(i)).otherwise(0)), largest)
        entities = scanned(F.transform(spans, lambda s, i: F.when(is_base(s), place(i)).otherwise(0)), largest)
        return let(pieces_of(text), lambda p: let(begins, lambda b: let(entities, lambda e: written(p, ends, b, e))))

    return let(scanned(F.transform(spans, lambda s: s["end"]), largest), by_ends)


def sanitise(docs: DataFrame, text: str = "text", **params) -> DataFrame:
    """docs with the spans in text replaced, see _replaced(): base entities by a tag, generalised terms by
    their wider term, removed terms by nothing. Base entities are found once."""
    names = [f"__{i}" for i in range(len(docs.columns))]  # whatever the columns are called
    own = names[docs.columns.index(text)]
    rows = docs.toDF(*names)
    based = work_table(with_base(rows, own, [F.col(c) for c in names]), "base")
    terms = work_table(revealing_terms(rows, based, own, **params), "terms")
    tag = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    spans = F.concat(
        F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), tag[s["kind"]].alias("tag"))),
        F.coalesce(F.transform("terms", lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index("term")).alias("kind"), s["end"].alias("end"), s["wider"].alias("tag"))), F.array().cast("array<struct<start:int,kind:int,end:int,tag:string>>")),
    )
    rows = based.drop("mentions").join(terms, ["h1", "h2"], "left")
    changed = F.size("base") > 0  # terms are found beside base entities only
    whole = F.col(own).cast("string")
    clean = F.when(changed, let(F.array_sort(spans), lambda found: _replaced(whole, found))).otherwise(whole)
    rows = rows.withColumns({"__clean": clean, "__changed": changed})
    out = {c: F.col(n) for c, n in zip(docs.columns, names, strict=True)}
    out[text] = F.col("__clean")
    if "n_chars" in out:
        out["n_chars"] = F.when(F.col("__changed"), F.length("__clean").cast(docs.schema["n_chars"].dataType)).otherwise(out["n_chars"])
    return rows.select(*[v.alias(c) for c, v in out.items()])


def _written(spans: Column) -> Column:
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat(name[s["kind"]], F.lit(":"), s["start"], F.lit(":"), s["end"])))


def op5_pii_sanitisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(read(spark, sf_dir, "documents"), keep=["doc_id"])
    terms = F.transform("terms", _span(KINDS.index("term")))
    is_kind = lambda i: lambda s: s["kind"] == i
    counts = [F.size(F.filter("base", is_kind(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS[:-1])]
    return found.select("doc_id", *counts, F.sha2(_written(F.col("base")), 256).alias("base_sha256"), _written(F.array_sort(F.concat("base", terms))).alias("spans"), F.size("terms").cast("long").alias("n_term"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document stays, its entities and revealing terms replaced."""
    return sanitise(docs)
