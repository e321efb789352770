"""Personal data by patterns and information-theoretic sanitisation. DataFrame functions only.

Base patterns find e-mail addresses, IP addresses, card numbers and phone numbers. The method then asks which other
terms give these entities away: for a term t in a document with an entity e, its disclosure is the pointwise mutual
information log(N c(t, e) / (n(t) n(e))) over e's own information log(N / n(e)), from document counts over the whole
corpus. At 1 the term occurs with e alone. A term is any word outside the entities, without what is no letter, mark or
digit at its ends, wherever it stands. Terms met with e in two or more different texts, and at or over GENERALISE,
become spans of kind `term` in every document that holds e: from REMOVE on they are removed, below generalised to
their first letter.

Null texts count as empty. Rows are told apart by doc_id and text, so rows without doc_id, or of one doc_id, have each
their own spans; rows that repeat one whole have the same, count as documents, and are not two texts. An empty table
gives no rows. Positions are code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.llm.common import documents, let, row_keys, saved, unused

KINDS = ("email", "ip", "card", "phone")
#: Kind -> pattern. They match what the plain patterns match, but look at each run of characters once: a match may
#: only begin where the run before it does (or where the last match ended), and repeated groups never give back.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9](?<![0-9][0-9])[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?<![0-9][0-9])(?<![0-9][\x20-][0-9])(?:[\x20-]?[0-9]){15,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without a match of this has none of the kind.
HINTS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
#: What is cut off the ends of a word.
EDGES = r"^[^\p{L}\p{M}\p{N}]++|(?<=[\p{L}\p{M}\p{N}])[^\p{L}\p{M}\p{N}]++$"
#: What stands between two words, edges included, from where a word ends.
BETWEEN = r"(?<=[\p{L}\p{M}\p{N}])[^\p{L}\p{M}\p{N}]*[\x20\x09-\x0D][^\p{L}\p{M}\p{N}]*+"
GENERALISE, REMOVE = 0.8, 0.9
#: Up to so many terms are sent to all executors.
SENT_TERMS = 200_000


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    def doubled(d: Column, i: Column) -> Column:
        x = d.cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return F.when(x > 9, x - 9).otherwise(x)

    ones = F.transform(F.filter(F.split(F.reverse(_digits(value)), ""), lambda d: d != ""), doubled)
    return F.aggregate(ones, F.lit(0), lambda a, b: a + b) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    n = F.length(_digits(value))
    if kind == "ip":
        part = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
        return value.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return (n >= 16) & (n <= 19) & F.when(n <= 19, _luhn(value)).otherwise(False)
    if kind == "phone":
        return (n >= 8) & (n <= 15)
    return F.lit(True)


def located(text: Column, pattern: str, made, kind: str) -> Column:
    """array<kind> of made(start, match) for all matches where it is not null: what stands between matches gives their places."""
    empty = F.array().cast(f"array<{kind}>")

    def place(m: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), 1, F.size(m))
        start = F.struct(F.lit(0).alias("at"), empty.alias("out"))

        def step(acc: Column, x: Column) -> Column:
            a = acc["at"] + F.length(x["gap"])
            out = let(made(a, x["value"]), lambda s: F.when(s.isNotNull(), F.concat(acc["out"], F.array(s))).otherwise(acc["out"]))
            return F.struct((a + F.length(x["value"])).alias("at"), out.alias("out"))

        return F.aggregate(F.arrays_zip(gaps.alias("gap"), m.alias("value")), start, step, lambda acc: acc["out"])

    return let(F.regexp_extract_all(text, F.lit(pattern), 0), lambda m: F.when(F.size(m) > 0, place(m)).otherwise(empty))


def base_spans(text: Column) -> Column:
    """array<struct<kind, start, end, value>> by kind as listed, then start."""
    span = "struct<kind:string,start:int,end:int,value:string>"

    def of_kind(kind: str) -> Column:
        made = lambda a, v: F.when(_valid(kind, v), F.struct(F.lit(kind).alias("kind"), a.alias("start"), (a + F.length(v)).alias("end"), v.alias("value")))
        return F.when(text.contains(HINTS[kind]) & text.rlike(PATTERNS[kind]), located(text, PATTERNS[kind], made, span)).otherwise(F.array().cast(f"array<{span}>"))

    parts = [of_kind(kind) for kind in KINDS]
    return F.concat(*parts)


def _terms(text: Column) -> Column:
    words = F.split(F.regexp_replace(text, EDGES, ""), BETWEEN)
    return F.array_distinct(F.transform(F.filter(words, lambda w: w != ""), F.lower))


def _blanked(text: Column, spans: Column) -> Column:
    """The text with a blank for each character of the spans."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        a = F.greatest(acc["at"], s["start"])
        added = F.concat(acc["out"], F.substring(text, acc["at"] + 1, a - acc["at"]), F.repeat(F.lit(" "), F.greatest(s["end"] - a, F.lit(0))))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), added.alias("out"))

    places = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    return F.aggregate(places, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def _entity(span: Column) -> Column:
    return F.concat_ws(":", span["kind"], F.lower(F.when(span["kind"].isin("card", "phone"), _digits(span["value"])).otherwise(span["value"])))


def may_hold() -> Column:
    """Whether a text matches any base pattern. Few do; only those go through the array expressions."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = [text.contains(HINTS[k]) & text.rlike(PATTERNS[k]) for k in KINDS]
    return found[0] | found[1] | found[2] | found[3]


def find_base(docs: DataFrame) -> DataFrame:
    """k1, k2, doc_id, copies, spans with entity, and the text without them (rest), for each different row that matches a pattern."""
    k1, k2 = row_keys()
    hits = docs.where(may_hold()).select(k1.alias("k1"), k2.alias("k2"), "doc_id", "text")
    hits = saved(hits.groupBy("k1", "k2").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), F.count("*").alias("copies")), "pii-texts")
    full = lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), _entity(s).alias("entity"))
    found = hits.select("k1", "k2", "doc_id", "copies", "text", F.transform(base_spans(F.col("text")), full).alias("spans"))
    return saved(found.select("k1", "k2", "doc_id", "copies", "spans", _blanked(F.col("text"), F.col("spans")).alias("rest")), "pii")


def _several(df: DataFrame, name: str) -> DataFrame:
    """Grouped rows (copies, where): the number of documents, where they are two different texts at least."""
    # the least and the greatest digest differ, which needs no set of them
    return df.agg(F.sum("copies").alias(name), F.min("where").alias("a"), F.max("where").alias("b")).where("a <> b").drop("a", "b")


def disclosing_terms(docs: DataFrame, base: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entity, term, disclosure) of all terms at or over GENERALISE, and (k1, k2, entity, term) of where such pairs may be met.

    A disclosure d of GENERALISE takes n(t) <= c(t, e) (N / n(e)) ** (1 - d), which is at most n(e) ** d * N ** (1 - d).
    Documents that hold any entity are few, and n(t) is at least the number of those with t. So terms of more of them
    than the most frequent entity allows, and those of one text, are not paired with entities; and only terms of pairs
    that may still reach GENERALISE by that number are counted over all documents.
    """
    n_docs = docs.count()
    digest = F.xxhash64("rest").alias("where")
    held = base.select("k1", "k2", "copies", digest, F.explode(F.array_distinct(F.transform("spans", lambda s: s["entity"]))).alias("entity"))
    entities = saved(_several(held.groupBy("entity"), "n_entity").where(F.col("n_entity") < n_docs), "entities")
    most = entities.agg(F.max("n_entity")).first()[0] or 0
    own = saved(base.select("k1", "k2", "copies", digest, F.explode(_terms(F.col("rest"))).alias("term")), "own-terms")
    rare = _several(own.groupBy("term"), "n_held").where(F.col("n_held") <= 1.0001 * most**GENERALISE * n_docs ** (1 - GENERALISE))
    pairs = own.join(rare.select("term"), "term").join(held.join(entities, "entity").select("k1", "k2", "entity"), ["k1", "k2"])
    pairs = saved(pairs, "pairs")
    most_of = 1.0001 * F.col("n_both") * F.pow(n_docs / F.col("n_entity"), F.lit(1 - GENERALISE))
    both = _several(pairs.groupBy("entity", "term"), "n_both").join(entities, "entity").join(rare, "term").where(F.col("n_held") <= most_of)
    both = saved(both.select("entity", "term", "n_both", "n_entity"), "terms")
    wanted = saved(both.select("term").distinct(), "wanted")
    wanted = F.broadcast(wanted) if wanted.limit(SENT_TERMS + 1).count() <= SENT_TERMS else wanted
    others = docs.where(~may_hold()).select(F.explode(_terms(F.coalesce("text", F.lit("")))).alias("term"), F.lit(1).cast("long").alias("copies"))
    n_term = others.unionByName(own.select("term", "copies")).join(wanted, "term").groupBy("term").agg(F.sum("copies").alias("n_term"))
    gain = F.log2(n_docs * F.col("n_both") / (F.col("n_term") * F.col("n_entity"))) / F.log2(F.lit(float(n_docs)) / F.col("n_entity"))
    rated = both.join(n_term, "term").select("entity", "term", gain.alias("disclosure")).where(F.col("disclosure") >= GENERALISE)
    return saved(rated, "disclosing"), pairs.select("k1", "k2", "entity", "term")


def _given_away(docs: DataFrame, base: DataFrame) -> DataFrame | None:
    """(k1, k2, terms) of the rows that hold an entity and terms that give it away; terms map to their disclosure."""
    rated, pairs = disclosing_terms(docs, base)
    if rated.isEmpty():
        return None
    per_row = pairs.join(rated, ["entity", "term"]).groupBy("k1", "k2", "term").agg(F.max("disclosure").alias("disclosure"))
    return saved(per_row.groupBy("k1", "k2").agg(F.map_from_entries(F.collect_list(F.struct("term", "disclosure"))).alias("terms")), "given-away")


def _term_spans(text: Column, terms: Column) -> Column:
    """Places of the given terms in a text, punctuation around them left out."""

    def made(at: Column, word: Column) -> Column:
        core = F.regexp_replace(word, EDGES, "")
        a = at + F.length(F.regexp_extract(word, r"^[^\p{L}\p{M}\p{N}]*", 0))
        d = F.element_at(terms, F.lower(core))
        return F.when(d.isNotNull(), F.struct(F.lit("term").alias("kind"), a.alias("start"), (a + F.length(core)).alias("end"), d.alias("disclosure")))

    return located(text, r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D]++", made, "struct<kind:string,start:int,end:int,disclosure:double>")


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, counts of base spans, base_sha256, spans and n_term for each row of docs."""
    base = find_base(docs)
    away = _given_away(docs, base)
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    listed = _listed(F.col("spans"))
    out = base.select("k1", "k2", "doc_id", "copies", "rest", *[count(k) for k in KINDS], F.sha2(listed, 256).alias("base_sha256"), listed.alias("listed"))
    if away is None:
        out = out.select("doc_id", "copies", *[f"n_{k}" for k in KINDS], "base_sha256", F.col("listed").alias("spans"), F.lit(0).cast("long").alias("n_term"))
    else:
        terms = F.when(F.col("terms").isNotNull(), _term_spans(F.col("rest"), F.col("terms")))
        out = out.join(away, ["k1", "k2"], "left").withColumn("t", terms)
        both = F.concat_ws(",", F.when(F.col("listed") != "", F.col("listed")), F.when(F.size("t") > 0, _listed(F.col("t"))))
        out = out.select("doc_id", "copies", *[f"n_{k}" for k in KINDS], "base_sha256", both.alias("spans"), F.coalesce(F.array_size("t"), F.lit(0)).cast("long").alias("n_term"))
    out = out.withColumn("copies", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("copies")
    zero = F.lit(0).cast("long")
    rest = docs.where(~may_hold()).select("doc_id", *[zero.alias(f"n_{k}") for k in KINDS], F.sha2(F.lit("").cast("binary"), 256).alias("base_sha256"), F.lit("").alias("spans"), zero.alias("n_term"))
    return out.unionByName(rest)


def sanitise(docs: DataFrame) -> DataFrame:
    """docs with base spans replaced by their kind ([EMAIL], ...) and disclosing terms removed or generalised; n_chars follows."""
    away = _given_away(docs, find_base(docs))
    text, cut = F.col("text"), "array<struct<start:int,end:int,by:string>>"
    named = lambda b: F.transform(b, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("by")))
    rows, own = docs.where(may_hold()), named(base_spans(text))
    if away is not None:
        c_k1, c_k2, c_terms, c_base = unused(docs, "_k1", "_k2", "_terms", "_base")
        k1, k2 = row_keys()
        rows = rows.withColumns({c_k1: k1, c_k2: k2}).join(away.select(F.col("k1").alias(c_k1), F.col("k2").alias(c_k2), F.col("terms").alias(c_terms)), [c_k1, c_k2], "left").withColumn(c_base, base_spans(text))
        by = lambda s: F.when(s["disclosure"] >= REMOVE, F.lit("[TERM]")).otherwise(F.concat(F.substring(text, s["start"] + 1, F.lit(1)), F.lit(".")))
        terms = F.transform(_term_spans(_blanked(text, F.col(c_base)), F.col(c_terms)), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), by(s).alias("by")))
        own = F.concat(named(F.col(c_base)), F.when(F.col(c_terms).isNotNull(), terms).otherwise(F.array().cast(cut)))

    def rebuilt(spans: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

        def step(acc: Column, s: Column) -> Column:
            fresh = s["start"] >= acc["at"]
            added = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), s["by"])
            return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, added).otherwise(acc["out"]).alias("out"))

        return F.aggregate(F.array_sort(spans), start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))

    out = rows.withColumn("text", let(own, lambda s: F.when(F.size(s) > 0, rebuilt(s)).otherwise(text)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns).unionByName(docs.where(~may_hold()))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(documents(spark, sf_dir))
