"""Personal data, with information-theoretic sanitisation [DataFrame functions only].

Base patterns find e-mail and IP addresses, payment cards and phone numbers: the protected entities.  The method
estimates from the whole corpus how strongly other terms reveal them.  A term is a word of NEAR words or fewer from
an entity.  With n(e), n(t) the documents that hold entity and term, and n(e, t) those where they stand together,

    disclosure(e, t) = log2(n(e, t) * N / (n(e) * n(t))) / log2(N / n(e)),

the pointwise mutual information over the entity's own information: 1 if the term tells the entity as surely as the
entity itself.  The evidence for a pair is the number of its different neighbourhoods, a neighbourhood being the words
on the left and the right; only pairs with SUPPORT of them count, so that copies of one passage are no evidence, and
further rows never take evidence away.  Terms of at least GENERALISE are spans wherever they occur; redacted()
generalises them to their class and removes those of at least REMOVE.  Texts and neighbourhoods are told apart by 64-bit
hashes; two of a billion texts share one with a chance of some per cent, which changes a count by one.

Entities and pairs are counted by group-by over the places of entities alone.  A term is held by at least the texts
that hold it near some entity, which bounds its score; only terms that pass by this bound are counted in all
documents, by one pass over their words joined to those terms (broadcast only below MAX_TERMS).

Defined cases: a null text counts as empty; repeated rows are scanned each on its own; a null doc_id is carried; an
empty table gives no rows; scan() reads no other columns, redacted() carries them unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import stored
from granary.llm.spans import FOUND, SPAN, apart, found, joined, named, ranked, replaced, searchable

_LOCAL, _HOST = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
#: Possessive, and tried at starts of runs or ends of matches alone: the same matches in linear time.
EMAIL = rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_HOST}++(?:\.{_HOST}++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone", "term")
NEAR, SUPPORT, GENERALISE, REMOVE = 4, 3, 0.9, 0.98
#: Candidate terms that may be broadcast; about 100 bytes each.
MAX_TERMS = 50_000
WORD = r"\p{L}[\p{L}\p{M}'-]{2,}+"


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(s: Column) -> Column:
    """Whether digits s pass the check sum that doubles every second digit from the right."""
    n = F.length(s)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(s, n + 1 - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def good_ip(s: Column) -> Column:
    short = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
    return F.forall(F.split(s, "\\."), lambda p: (F.length(short(p)) <= 3) & (F.substring(short(p), 1, 3).cast("int") <= 255))


def good_card(s: Column) -> Column:
    size = F.length(digits(s))
    return F.when(size.between(14, 19), luhn(digits(s))).otherwise(False)


def based(docs: DataFrame, text_col: str, prefix: str) -> DataFrame:
    """docs with {prefix}text and the four arrays of base matches."""
    t = F.col(f"{prefix}text")
    one = docs.withColumn(f"{prefix}text", searchable(F.col(text_col)))
    when = lambda mark, pattern: F.when(F.instr(t, mark) > 0, found(t, pattern)).otherwise(found(F.lit(""), pattern))
    return (
        one.withColumn(f"{prefix}email", when("@", EMAIL))
        .withColumn(f"{prefix}ip", F.filter(found(t, IP), lambda m: good_ip(m["s"])))
        .withColumn(f"{prefix}card", F.filter(F.filter(found(t, CARD), lambda m: F.length(m["s"]) >= 14), lambda m: good_card(m["s"])))
        .withColumn(f"{prefix}phone", F.filter(when("+", PHONE), lambda m: F.length(digits(m["s"])).between(10, 15)))
    )


def places(docs: DataFrame, text_col: str = "text", near: int = NEAR) -> DataFrame:
    """(entity, doc, left, right) for each place of an entity: the text's hash and the NEAR words before and after."""
    rows = based(docs.select(F.col(text_col).alias("text")), "text", "__")
    each = F.concat(*[F.transform(f"__{k}", lambda m, k=k: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.lit(k).alias("kind"), F.lower(m["s"]).alias("s"))) for k in KINDS[:4]])
    # no filter on the places: it would be pushed below, and texts be searched once for it and once for its rows
    rows = rows.select("__text", F.array_sort(each).alias("__each"))
    rows = rows.withColumn("__words", F.when(F.size("__each") > 0, found(F.col("__text"), WORD)).otherwise(F.array().cast(FOUND)))
    of = lambda c, name: F.transform(c, lambda m: m[name])
    # words that end before the place starts, and words that start before it ends
    before = ranked(of("__each", "start"), of("__words", "end"), True)
    until = ranked(of("__each", "end"), of("__words", "start"), False)
    rows = rows.withColumn("__before", before).withColumn("__until", until)
    e = rows.select("__text", "__words", F.explode(F.arrays_zip("__each", "__before", "__until")).alias("e"))
    p, q = F.col("e.__before"), F.col("e.__until")
    left = F.slice("__words", F.greatest(F.lit(1), p - near + 1), F.least(p, F.lit(near)))
    return e.select(
        F.concat(F.col("e.__each.kind"), F.lit(":"), F.col("e.__each.s")).alias("entity"),
        F.xxhash64("__text").alias("doc"),
        F.transform(left, lambda m: m["s"]).alias("left"),
        F.transform(F.slice("__words", q + 1, F.lit(near)), lambda m: m["s"]).alias("right"),
    )


def terms(docs: DataFrame, text_col: str = "text", near: int = NEAR, support: int = SUPPORT, least: float = GENERALISE) -> DataFrame:
    """(term, disclosure): words, lower-cased, and how strongly each reveals some entity, where that is at least
    least. Written to the shared folder."""
    sides = stored(places(docs, text_col, near), "places")
    counted = sides.select("entity", "doc", F.xxhash64("left", "right").alias("around"), F.explode(F.array_distinct(F.transform(F.concat("left", "right"), F.lower))).alias("term"))
    # texts and neighbourhoods count once, however many copies there are
    pairs = counted.groupBy("entity", "term").agg(F.countDistinct("doc").alias("net"), F.countDistinct("around").alias("around"))
    pairs = pairs.where(F.col("around") >= support)
    n = float(docs.agg(F.count_distinct(F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))).first()[0])
    n_entity = sides.groupBy("entity").agg(F.countDistinct("doc").alias("ne"))
    # texts that hold the term near any entity: no more than all that hold it, so the score can only fall from here
    n_near = counted.groupBy("term").agg(F.countDistinct("doc").alias("nt"))
    both = pairs.join(n_entity, "entity").join(n_near, "term").where(F.col("ne") < n)
    candidates = stored(both.where(disclosed(n) >= least).select("entity", "term", "net", "ne"), "pairs")
    names = candidates.select("term").distinct()
    n_names = names.count()
    if not n_names:
        return candidates.select("term", F.lit(0.0).alias("disclosure"))
    if n_names <= MAX_TERMS:
        names = F.broadcast(names)
    whole = docs.select(F.lower(searchable(F.col(text_col))).alias("t"))
    held = whole.select(F.xxhash64("t").alias("doc"), F.explode(F.array_distinct(F.regexp_extract_all("t", F.lit(WORD), F.lit(0)))).alias("term"))
    n_term = held.join(names, "term", "left_semi").groupBy("term").agg(F.countDistinct("doc").alias("nt"))
    out = candidates.join(n_term, "term").groupBy("term").agg(F.max(disclosed(n)).alias("disclosure"))
    return stored(out.where(F.col("disclosure") >= least), "terms")


def disclosed(n: float) -> Column:
    """disclosure from the columns net, ne and nt."""
    pmi = F.log2(F.col("net") * n / (F.col("ne").cast("double") * F.col("nt")))
    return pmi / F.log2(F.lit(n) / F.col("ne"))


def spanned(docs: DataFrame, revealing: DataFrame, text_col: str = "text", prefix: str = "__") -> DataFrame:
    """docs with {prefix}text, the base matches, {prefix}base and {prefix}spans (arrays of spans), {prefix}removed
    (those terms among the spans that are to be removed)."""
    c = lambda name: F.col(f"{prefix}{name}")
    rows = based(docs, text_col, prefix)
    rows = rows.withColumn(f"{prefix}base", F.concat(*[named(c(k), k, i) for i, k in enumerate(KINDS[:4])]).cast(SPAN))
    n_terms = revealing.count()
    if not n_terms:
        return rows.withColumn(f"{prefix}spans", c("base")).withColumn(f"{prefix}removed", F.array().cast("array<string>"))
    by = revealing.select(F.col("term").alias(f"{prefix}term"), (F.col("disclosure") >= REMOVE).alias(f"{prefix}gone"))
    if n_terms <= MAX_TERMS:
        by = F.broadcast(by)
    key = F.xxhash64(c("text"))
    lower = docs.select(searchable(F.col(text_col)).alias(f"{prefix}text"))
    held = lower.select(key.alias(f"{prefix}key"), F.explode(F.array_distinct(F.regexp_extract_all(F.lower(c("text")), F.lit(WORD), F.lit(0)))).alias(f"{prefix}term"))
    # a text's revealing terms: no more than its distinct words
    mine = held.join(by, f"{prefix}term").groupBy(f"{prefix}key").agg(F.collect_set(c("term")).alias(f"{prefix}terms"), F.collect_set(F.when(c("gone"), c("term"))).alias(f"{prefix}removed"))
    mine = stored(mine, "revealed")
    if mine.count() <= MAX_TERMS:  # else the texts are joined by a shuffle
        mine = F.broadcast(mine)
    rows = rows.withColumn(f"{prefix}key", key).join(mine, f"{prefix}key", "left")
    all_words = F.when(F.size(c("terms")) > 0, found(c("text"), WORD)).otherwise(found(F.lit(""), WORD))
    rows = rows.withColumn(f"{prefix}words", all_words)
    told = apart(F.filter(c("words"), lambda m: F.array_contains(c("terms"), F.lower(m["s"]))), c("base"))
    rows = rows.withColumn(f"{prefix}spans", F.concat(c("base"), named(told, KINDS[4], 4)).cast(SPAN))
    return rows.withColumn(f"{prefix}removed", F.coalesce(c("removed"), F.array().cast("array<string>")))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: int = SUPPORT, least: float = GENERALISE) -> DataFrame:
    """Per document: doc_id, n_email, n_ip, n_card, n_phone, n_term, base_sha256, spans."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = spanned(own, terms(own, support=support, least=least))
    count = lambda k: F.size(F.filter("__spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return rows.select("doc_id", *map(count, KINDS), F.sha2(joined(F.col("__base")), 256).alias("base_sha256"), joined(F.col("__spans")).alias("spans"))


def redacted(docs: DataFrame, revealing: DataFrame | None = None, text_col: str = "text") -> DataFrame:
    """docs, columns and types as they were: entities become [EMAIL], [IP], [CARD] or [PHONE], revealing terms
    [NAME] (written with a capital) or [TERM]; those to be removed vanish. revealing: from terms(), by default of docs."""
    prefix = "__pii_"
    c = lambda name: F.col(f"{prefix}{name}")
    rows = spanned(docs, terms(docs, text_col) if revealing is None else revealing, text_col, prefix)

    def put(span: Column, s: Column) -> Column:
        general = F.when(F.rlike(s, F.lit(r"^\p{Lu}")), F.lit("[NAME]")).otherwise(F.lit("[TERM]"))
        return F.when(span["kind"] != "term", F.concat(F.lit("["), F.upper(span["kind"]), F.lit("]"))).when(F.array_contains(c("removed"), F.lower(s)), F.lit("")).otherwise(general)

    new = F.when(F.size(c("spans")) > 0, replaced(c("text"), c("spans"), put)).otherwise(F.col(text_col))
    return rows.withColumn(text_col, new).select(*docs.columns)
