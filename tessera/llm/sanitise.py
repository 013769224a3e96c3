"""PII (3): pattern spans, and terms that disclose the entities they occur with, by corpus co-occurrence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import only, staged, table

KINDS = ("email", "ip", "card", "phone", "term")
#: Java patterns. Those of email and ip start only where a run of their first class does, or where the last match ended:
#: later starts in a run fail like its first, and long runs are read once. Loops are possessive where nothing follows.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be tried.
HINTS = {"email": r"@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){12}", "phone": r"\+[0-9]"}
OCTET = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
WORD = r"[\p{L}\p{N}]+"
#: Documents that a term must share with an entity, and the share of the entity's information from which it discloses it.
LEAST_DOCS, DISCLOSURE = 2, 0.9
#: From this share on a disclosing term is removed, below it is generalised.
REMOVE = 0.97
#: Share of a term's documents that a word must be in to be more general, and how many times as many documents it is in.
SUBSUMES, BROADER = 0.8, 2.0
#: Terms that are broadcast to the documents at most.
BROADCAST_TERMS = 500_000


def _luhn(digits: Column) -> Column:
    double = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 1, double(F.try_to_number(c, F.lit("9")).cast("int"))).otherwise(F.try_to_number(c, F.lit("9")).cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def _holds(kind: Column, match: Column) -> Column:
    """Whether a match is what its kind says."""
    digits = F.regexp_replace(match, "[^0-9]", "")
    return (
        F.when(kind == "ip", match.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$"))
        .when(kind == "card", F.length(digits).between(13, 19) & F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(False))
        .when(kind == "phone", F.length(digits).between(9, 15))
        .otherwise(True)
    )


def _cut(text: Column, kind: str, pattern: str | Column, hint: str | None) -> Column:
    """An array of (kind, at, gap, length, match) of the pattern's matches; gap: characters since the last one."""
    there = text.rlike(hint) if hint else F.lit(True)
    gaps = F.split(text, pattern, -1)
    # Matches and gaps are zipped first: what a lambda names from outside is evaluated anew for each element.
    zipped = F.arrays_zip(F.regexp_extract_all(text, pattern if isinstance(pattern, Column) else F.lit(pattern), F.lit(0)).alias("m"), gaps.alias("g"))
    one = lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("at"), F.length(x["g"]).alias("gap"), F.length(x["m"]).alias("length"), x["m"].alias("match"))
    return F.when(there, F.filter(F.transform(zipped, one), lambda x: x["match"].isNotNull())).otherwise(F.array().cast("array<struct<kind:string,at:int,gap:int,length:int,match:string>>"))


def _placed(rows: DataFrame, *keys: str) -> DataFrame:
    """Adds start and end, in code points, from the gaps and lengths of a document's matches."""
    so_far = Window.partitionBy(*keys).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.col("length")).over(so_far)
    return rows.withColumn("end", end.cast("int")).withColumn("start", F.col("end") - F.col("length"))


def _key(text: Column) -> Column:
    """Names a document by its id and text; rows with one key are the same in both."""
    return F.unhex(F.sha2(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), text), 256))


def _keyed(docs: DataFrame) -> DataFrame:
    """(dk, doc_id, text), null texts as empty ones."""
    text = F.coalesce("text", F.lit(""))
    return only(docs, "doc_id", "text").select(_key(text).alias("dk"), "doc_id", text.alias("text"))


def base_spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, spans): rows has (rid, doc_id, dk) per document, spans (rid, dk, kind, start, end, match)."""
    cuts = F.concat(*[_cut(F.col("text"), k, PATTERNS[k], HINTS[k]) for k in KINDS[:4]])
    rows = staged(_keyed(docs).select(F.monotonically_increasing_id().alias("rid"), "doc_id", "dk", cuts.alias("cuts")), "pii")
    each = rows.where(F.size("cuts") > 0).select("rid", "dk", F.inline("cuts"))
    placed = _placed(each, "rid", "kind").where(_holds(F.col("kind"), F.col("match")))
    return rows.select("rid", "doc_id", "dk"), staged(placed.select("rid", "dk", "kind", "start", "end", "match"), "pii-spans")


def _words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)))


def disclosing_terms(docs: DataFrame, spans: DataFrame, documents: int, least_docs: int = LEAST_DOCS, disclosure: float = DISCLOSURE) -> DataFrame:
    """(term, share): the terms that disclose some entity, by their documents all over the corpus.

    For an entity e and a word t of the same documents, wherever in them, share = 1 + log p(e|t) / log(1 / p(e)): 1 if all documents with t have e,
    0 if t tells nothing about e. Words count that occur with e in least_docs documents; shares from `disclosure` on
    disclose. Frequencies are of documents, over the whole corpus.
    """
    if not documents:
        return spans.select(F.col("match").alias("term"), F.lit(0.0).alias("share")).limit(0)
    entity = F.xxhash64("kind", F.when(F.col("kind") == "email", F.lower("match")).otherwise(F.regexp_replace("match", r"[^0-9.]", "")))
    held = spans.select("rid", "dk", entity.alias("e")).distinct()
    entities = held.groupBy("e").agg(F.count("*").alias("with_e")).where((F.col("with_e") >= least_docs) & (F.col("with_e") * 2 <= documents))
    held = staged(held.join(entities, "e"), "pii-entities")
    bits = F.greatest(F.log(F.lit(float(documents)) / F.col("with_e")), F.lit(1e-9))
    # As both <= with_e, a word in more documents than this can't disclose e.
    most = F.col("with_e") * F.exp((1 - disclosure) * bits) * (1 + 1e-9)
    # Words are counted before they meet entities, and only those rare enough do; terms that disclose are then looked up.
    highest = held.agg(F.max(most)).first()[0] or 0.0
    counted = only(docs, "text").select(F.explode(_words(F.coalesce("text", F.lit("")))).alias("term")).groupBy("term").agg(F.count("*").alias("with_t"))
    frequency = staged(counted.where((F.col("with_t") >= least_docs) & (F.col("with_t") <= highest)), "pii-words")
    # Rows that repeat a document count as often as entities do: words meet them by the document, entities by the row.
    there = _keyed(docs).join(held.select("dk").distinct(), "dk", "left_semi")
    near = there.select("dk", F.explode(_words(F.col("text"))).alias("term")).where(F.length("term") >= 3).join(frequency, "term").distinct()
    pairs = near.join(held.withColumn("most", most), "dk").where(F.col("with_t") <= F.col("most"))
    pairs = pairs.groupBy("e", "term", "with_e", "with_t").agg(F.count("*").alias("both")).where(F.col("both") >= least_docs)
    share = 1 + F.log(F.least(F.lit(1.0), F.col("both") / F.col("with_t"))) / bits
    revealing = pairs.withColumn("share", share).where(F.col("share") >= disclosure)
    return staged(revealing.groupBy("term").agg(F.max("share").alias("share")), "pii-terms")


def generalisations(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(term, general): for each term of found (dk, term, ...) the least frequent word that subsumes it, where one does.

    A word subsumes a term if it is in SUBSUMES of the term's documents or more, in BROADER times as many documents as
    the term at least, and discloses nothing itself; of equally frequent ones the first by code point.
    """
    terms = found.select("dk", "term").distinct()
    counts = terms.groupBy("term").agg(F.count("*").alias("docs"))
    there = _keyed(docs).join(terms.select("dk").distinct(), "dk", "left_semi").dropDuplicates(["dk"])
    words = there.select("dk", F.explode(_words(F.col("text"))).alias("general")).where((F.length("general") >= 3) & ~F.col("general").rlike("[0-9]"))
    pairs = terms.join(words, "dk").groupBy("term", "general").agg(F.count("*").alias("both")).join(counts, "term")
    pairs = pairs.where(F.col("both") >= SUBSUMES * F.col("docs")).join(terms.select(F.col("term").alias("general")).distinct(), "general", "left_anti")
    known = only(docs, "text").select(F.explode(_words(F.coalesce("text", F.lit("")))).alias("general"))
    frequency = known.join(pairs.select("general").distinct(), "general", "left_semi").groupBy("general").agg(F.count("*").alias("n"))
    fit = pairs.join(frequency, "general").where(F.col("n") >= BROADER * F.col("docs"))
    return fit.groupBy("term").agg(F.min(F.struct("n", "general"))["general"].alias("general"))


def term_spans(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(dk, kind, start, end, share, term) of every place of the terms, once for rows that repeat a document.

    Texts aren't shuffled where the terms are few enough to be broadcast: a document's words meet them in place, and
    each term that is there cuts the text on its own, so that only its places leave the task.
    """
    words = _keyed(docs).select("dk", "text", F.explode(_words(F.col("text"))).alias("term"))
    if terms.count() <= BROADCAST_TERMS:
        there = words.join(F.broadcast(terms), "term")
    else:
        there = words.select("dk", "term").join(terms, "term").distinct().join(_keyed(docs).select("dk", "text"), "dk")
    pattern = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])"), F.col("term"), F.lit(r"(?![\p{L}\p{N}])"))
    each = there.select("dk", "term", "share", F.inline(_cut(F.col("text"), "term", pattern, None))).dropDuplicates(["dk", "term", "at"])
    return _placed(each, "dk", "term").where(F.lower("match") == F.col("term")).select("dk", "kind", "start", "end", "share", "term")


def _found(docs: DataFrame, least_docs: int, disclosure: float, general: bool = False) -> DataFrame:
    """(doc_id, dk, b, t): the base spans and the term spans apart from them, as arrays of (k, start, end, share, term, general)."""
    rows, base = base_spans(docs)
    spans = term_spans(docs, disclosing_terms(docs, base, rows.count(), least_docs, disclosure))
    if general:
        spans = staged(spans, "pii-places")
    broader = generalisations(docs, spans.select("dk", "term").distinct()) if general else None
    spans = spans.join(broader, "term", "left") if general else spans.withColumn("general", F.lit(None).cast("string"))
    placed = rows.select("rid", "dk").join(spans, "dk").select("rid", "kind", "start", "end", "share", "term", "general")
    none = lambda t: F.lit(None).cast(t)
    every = base.select("rid", "kind", "start", "end", none("double").alias("share"), none("string").alias("term"), none("string").alias("general")).union(placed)
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int")
    lists = every.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct(rank.alias("k"), "start", "end", "share", "term", "general"))).alias("s"))
    empty = F.array().cast("array<struct<k:int,start:int,end:int,share:double,term:string,general:string>>")
    joined = rows.join(lists, "rid", "left").withColumn("s", F.coalesce("s", empty))
    joined = joined.withColumn("b", F.filter("s", lambda x: x["k"] <= 4))
    term_part = F.filter("s", lambda x: x["k"] == 5)
    apart = F.when(F.size("b") == 0, term_part).otherwise(F.filter(term_part, lambda x: ~F.exists("b", lambda y: (x["start"] < y["end"]) & (y["start"] < x["end"]))))
    return joined.select("doc_id", "dk", "b", apart.alias("t"))


def find_pii(docs: DataFrame, least_docs: int = LEAST_DOCS, disclosure: float = DISCLOSURE) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term.

    spans joins `kind:start:end` (code points, end exclusive) by comma, in the order of KINDS, then of start; the base
    kinds' part alone gives base_sha256. Term spans that touch a base span are left out. Null texts are empty; rows
    that repeat a document have equal results; an empty table gives an empty one.
    """
    names = F.array(*[F.lit(k) for k in KINDS])
    show = lambda a: F.concat_ws(",", F.transform(a, lambda x: F.concat_ws(":", F.element_at(names, x["k"]), x["start"].cast("string"), x["end"].cast("string"))))
    count = lambda n: F.size(F.filter("b", lambda x: x["k"] == n)).cast("long")
    found = _found(docs, least_docs, disclosure)
    return found.select("doc_id", *[count(i + 1).alias(f"n_{k}") for i, k in enumerate(KINDS[:4])], F.sha2(show(F.col("b")), 256).alias("base_sha256"), show(F.concat("b", "t")).alias("spans"), F.size("t").cast("long").alias("n_term"), F.transform("t", lambda x: x["share"] >= REMOVE).alias("term_removed"))


def sanitised(docs: DataFrame, least_docs: int = LEAST_DOCS, disclosure: float = DISCLOSURE, remove: float = REMOVE) -> DataFrame:
    """doc_id, text of every row, without what find_pii finds.

    Base spans become their kind in brackets. Terms with a share of `remove` or more go; the others become the word that
    subsumes them (generalisations), or `[TERM]` where none does. Spans that overlap an earlier one are merged into it.
    """
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    new = lambda x: F.when(x["k"] <= 4, F.element_at(names, x["k"])).when(x["share"] >= remove, F.lit("")).otherwise(F.coalesce(x["general"], F.lit("[TERM]")))
    spans = F.transform(F.concat("b", "t"), lambda x: F.struct(x["start"].alias("a"), x["end"].alias("b"), new(x).alias("new")))
    found = _found(docs, least_docs, disclosure, general=True).dropDuplicates(["dk"]).select("dk", F.array_sort(spans).alias("s"))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc: Column, x: Column) -> Column:
        fresh = F.concat(acc["out"], F.col("text").substr(acc["at"] + 1, x["a"] - acc["at"]), x["new"])
        return F.when(x["a"] >= acc["at"], F.struct(fresh.alias("out"), x["b"].alias("at"))).otherwise(F.struct(acc["out"].alias("out"), F.greatest(acc["at"], x["b"]).alias("at")))

    done = F.aggregate("s", start, step, lambda acc: F.concat(acc["out"], F.col("text").substr(acc["at"] + 1, F.length("text"))))
    return _keyed(docs).join(found, "dk").select("doc_id", done.alias("text"))


def op3_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """find_pii over the whole table of documents; see there for nulls, repeats and empty tables."""
    return find_pii(table(spark, sf_dir, "documents"))
