"""Personal data by patterns and by information-theoretic sanitisation. DataFrame functions only.

The plain patterns find protected entities (email, ip, card, phone). The method then asks what else gives an entity away: for
each term of a document that mentions an entity, corpus co-occurrence gives

    PMI(term; entity) = log2(n(term, entity) * N / (n(term) * n(entity)))
    IC(entity)        = log2(N / n(entity))

with n in documents out of N: n(term) counts documents with the term, n(term, entity) those with both, in whole texts. PMI
reaches IC when the term occurs only with the entity. A term is removed where PMI >= REMOVE * IC, and generalised where
PMI >= GENERALISE * IC, wherever it stands in the entity's documents outside plain spans. One document alone can't tell a term that
discloses from a chance one: where n(term, entity) is 1, n(term) counts ``UNSEEN`` more, so such terms are generalised, and in a
corpus of under 58 documents, where all are rare, kept. A term is a run of four letters or more; to generalise one is to leave its form alone, [NAME] for a
capitalised word, [ACRONYM] for capitals, [WORD] for others.

Scale: texts are read once for the patterns and once for term counts; counts are summed before they are shuffled, and only
documents with entities go further. Nothing is collected.

Defined results: a null or empty text has no spans; repeated rows (of one id and text) get the same spans and count as one document in N and in every n;
texts of any length are read whole, in time near their length however many spans they have; null ids are equal to each other; other columns are kept, and one named like an output column is replaced by it; an empty table gives an
empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spans
from .common import cut

KINDS = ("email", "ip", "card", "phone", "term")
TERM = 4

# The patterns of the plain kinds. A match starts where the previous one ended or where its first run of
# characters starts, which is where the leftmost match starts, and no text makes them backtrack over a long run.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
OCTETS = r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$"
LONG_CHAIN = r"[0-9](?:[\x20-]?[0-9]){11}"
WORD = r"\p{L}{4,}+"
# Fixed value: a letter that stands for every character of a plain span while terms are looked for, so that none is found that touches one.
MARK = "\ua015"

UNSEEN = 0.5
REMOVE = 1.0
GENERALISE = 0.9


def base_spans(text: Column) -> Column:
    """The plain kinds' spans by start, then kind; ``text`` is not null."""

    def card(s: Column) -> Column:
        digits = F.translate(s["match"], " -", "")
        return F.length(digits).between(12, 19) & F.call_function("luhn_check", digits)

    def phone(s: Column) -> Column:
        return F.length(F.regexp_replace(s["match"], "[^0-9]", "")).between(9, 15)

    email = F.when(F.contains(text, F.lit("@")), spans.find(text, EMAIL, 0)).otherwise(spans.none())
    ip = F.when(text.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"), F.filter(spans.find(text, IP, 1), lambda s: s["match"].rlike(OCTETS))).otherwise(spans.none())
    cards = F.when(text.rlike(LONG_CHAIN), F.filter(spans.find(text, CARD, 2), card)).otherwise(spans.none())
    phones = F.when(text.rlike(r"\+[0-9]"), F.filter(spans.find(text, PHONE, 3), phone)).otherwise(spans.none())
    return spans.ordered(email, ip, cards, phones)


def entity_name(span: Column) -> Column:
    """What makes two mentions the same entity: kind and value, without case and separators."""
    value = F.when(span["kind"] < 2, F.lower(span["match"])).otherwise(F.regexp_replace(span["match"], "[^0-9]", ""))
    return F.concat_ws(":", span["kind"].cast("string"), value)


def words(text: Column) -> Column:
    """The distinct terms of a text, in lower case."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.lower))


def disclosing(df: DataFrame, found: DataFrame, text: str, key: str) -> DataFrame:
    """Rows ``_key, _th, _more``: the term spans of each document that has any; their match is what replaces them.

    Entities of the same documents (told by a hash of these) score alike, so they count as one. A pair is made only where
    n(term, entity) <= n(entity) lets PMI reach GENERALISE * IC, which leaves out no pair that could be told.
    """
    docs = ["_key", "_th"]
    # ``found`` has a text only where a plain span is
    dirty = found.filter(F.size("_base") > 0).dropDuplicates(docs)
    entities = dirty.select(*docs, F.explode(F.array_distinct(F.transform("_base", entity_name))).alias("entity"))
    n_entity = entities.groupBy("entity").agg(F.count("*").alias("n_e"), F.bit_xor(F.xxhash64(*docs)).alias("same"))
    mentions = entities.join(n_entity, "entity").select(*docs, "same", "n_e").distinct()
    total, n_term = term_counts(df, found, text, key)
    content = F.log2(total / F.col("n_e"))
    told = dirty.select(*docs, F.explode(words(F.col("_text"))).alias("term")).join(n_term, "term")
    may = (content > 0) & (F.log2(total / F.col("n_t")) >= GENERALISE * content - 1e-9)
    pairs = cut(told.alias("l").join(mentions.alias("r"), [*same_document(), may]).select("l.*", "same", "n_e"))
    n_pair = pairs.groupBy("same", "n_e", "term", "n_t").agg(F.count("*").alias("n_te"))
    seen = F.col("n_t") + F.when(F.col("n_te") == 1, UNSEEN).otherwise(0.0)
    pmi = F.log2(F.col("n_te") * total / (seen * F.col("n_e")))
    scored = n_pair.filter(pmi >= GENERALISE * content).select("same", "n_e", "term", (pmi < REMOVE * content).alias("kept"))
    # a term that several entities tell is removed if one of them asks for that
    by = pairs.join(scored, ["same", "n_e", "term"]).groupBy(*docs, "term").agg(F.min("kept").alias("kept"))
    by = by.groupBy(*docs).agg(F.map_from_entries(F.collect_list(F.struct("term", "kept"))).alias("_by"))
    both = dirty.alias("l").join(by.alias("r"), same_document()).select("l.*", "_by")

    def put(s: Column) -> Column:
        kept = F.element_at("_by", F.lower(s["match"]))
        new = F.when(kept, form(s["match"])).when(~kept, "")
        return F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), new.alias("match"))

    free = spans.masked(F.col("_text"), F.col("_base"), MARK)
    return both.select(*docs, F.filter(F.transform(spans.find(free, WORD, TERM), put), lambda s: s["match"].isNotNull()).alias("_more"))


def form(word: Column) -> Column:
    return F.when(word.rlike(r"^\p{Lu}+$"), "[ACRONYM]").when(word.rlike(r"^\p{Lu}"), "[NAME]").otherwise("[WORD]")


def term_counts(df: DataFrame, found: DataFrame, text: str, key: str) -> tuple[int, DataFrame]:
    """The number of documents, and (term, n_t): the documents that hold each term. Rows of one id and text are one document.

    Rows are counted, which needs no exchange of documents; what repeated rows count too often is then taken off. Only their texts travel.
    """
    value = F.coalesce(F.col(text), F.lit(""))
    n_term = df.select(F.explode(words(value)).alias("term")).groupBy("term").agg(F.count("*").alias("n_t"))
    rows = found.groupBy("_key", "_th").agg(F.count("*").alias("n"))
    seen = rows.agg(F.count("*").alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
    if seen.rows > seen.documents:
        texts = df.select(F.col(key).alias("_key"), F.xxhash64(value).alias("_th"), value.alias("_text"))
        again = texts.alias("l").join(rows.filter("n > 1").alias("r"), same_document()).select("l.*", "n").dropDuplicates(["_key", "_th"])
        more = again.select(F.explode(words(F.col("_text"))).alias("term"), (F.col("n") - 1).alias("n")).groupBy("term").agg(F.sum("n").alias("n"))
        n_term = n_term.join(more, "term", "left").select("term", (F.col("n_t") - F.coalesce("n", F.lit(0))).alias("n_t"))
    return seen.documents, n_term


def sanitise(df: DataFrame, text: str = "text", key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """The documents' plain spans, and the term spans of those that have any.

    The first has ``_key``, ``_th`` (a hash of the text; equal keys with equal texts are one document) and ``_base``; the second
    ``_key``, ``_th`` and ``_more``. ``spans_of`` and ``redact`` put them together.
    """
    value = F.coalesce(F.col(text), F.lit(""))
    found = df.select(F.col(key).alias("_key"), F.xxhash64(value).alias("_th"), base_spans(value).alias("_base"), value.alias("_text"))
    found = cut(found.withColumn("_text", F.when(F.size("_base") > 0, F.col("_text"))))
    return found.drop("_text"), disclosing(df, found, text, key)


def same_document() -> list[Column]:
    return [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in ("_key", "_th")]


def on_document(left: DataFrame, right: DataFrame) -> DataFrame:
    """All columns of ``left`` and ``_more``, an empty array where ``right`` has none."""
    joined = left.alias("l").join(right.alias("r"), same_document(), "left")
    return joined.select("l.*", F.coalesce("r._more", spans.none()).alias("_more"))


def spans_of(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per input row: the key, ``base`` and ``all``: spans (start, kind, end, match) by start, kinds as in KINDS."""
    found, more = sanitise(df, text, key)
    return on_document(found, more).select(F.col("_key").alias(key), F.col("_base").alias("base"), spans.ordered("_base", "_more").alias("all"))


def redact(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``df`` with protected entities in ``text`` replaced by their kinds, and terms that disclose them generalised or removed.

    Documents without entities pass by the join and are not changed.
    """
    _, more = sanitise(df, text, key)
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS[:TERM]))
    value = F.coalesce(F.col(text), F.lit(""))
    # the row travels as one column, so that no name of its own can clash
    rows = df.select(F.struct(*df.columns).alias("_row"), F.col(key).alias("_key"), F.xxhash64(value).alias("_th"), base_spans(value).alias("_base"))
    clean = rows.filter(F.size("_base") == 0).select("_row.*")
    dirty = on_document(rows.filter(F.size("_base") > 0), more).withColumn("_all", spans.ordered("_base", "_more"))
    by = lambda s: F.when(s["kind"] == TERM, s["match"]).otherwise(F.element_at(names, s["kind"] + 1))
    new = spans.replaced(F.col("_row")[text], F.col("_all"), by)
    return clean.unionByName(dirty.select(*((new if c == text else F.col("_row")[c]).alias(c) for c in df.columns)))
