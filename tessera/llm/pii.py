"""Personal data: pattern spans, and information-theoretic sanitisation of the terms around them. DataFrame functions
only.

Pattern spans are e-mail addresses, IP addresses, payment cards and telephone numbers. A protected entity is the value of
such a span. The corpus tells how strongly a term reveals it: over all lines of all texts, with n lines in total, n(e)
that hold the entity, n(t) that hold the term and n(e, t) that hold both, the entity's information is
IC(e) = log2(n / n(e)), and the term discloses PMI(e, t) = log2(n * n(e, t) / (n(e) * n(t))) of it. A term that stands in
one line with an entity and discloses at least ``GENERALISE`` of IC(e) is replaced by its word class, from ``REMOVE`` on
it is removed. Few lines are weak evidence, so a term is judged as soon as its lines show with ``CONFIDENCE`` that it
discloses that much: PMI / IC >= g says that the entity stands in at least q = (n(e) / n) ** (1 - g) of the term's lines, and
a share of k in m lines is above q by more than chance if exp(-m * KL(k / m || q)) <= 1 - ``CONFIDENCE`` (Chernoff; for k = m
that is the exact binomial bound). k counts independent lines, and m is scaled with it: a line that occurs again in copies
tells nothing new, and neither does another line of the same text, which repeats its own rare words. One line is
enough where the entity carries log2(1 / (1 - ``CONFIDENCE``)) / (1 - g) bits (13.3, an entity in one of 10 000 lines), lines
of two texts are from half as many bits on.

Lines are split at ``\\n``; no pattern reaches over one. Terms are runs of digits, Latin letters and non-ASCII characters,
without case; a term of ASCII characters alone has at least three of them. Offsets are code points.

The patterns are written with possessive repetition, which gives the same matches as the plain form and runs in linear
time without recursion, whatever the text. A pattern is run only where a simpler one, which every valid match contains, is
found. Places of matches are prefix sums, added up in blocks, so that their cost does not grow with the square of their number.

Data flow: clean texts are not shuffled. Distinct texts that may hold an entity are cut into lines, and the distinct lines
with entities (small next to the corpus) are written once. Entities that stand in just the same lines share all counts, so
they are one class: a line of many entities that occur nowhere else is one class and its words, not one row for each pair.
One pass over the corpus counts the lines of every term, and all lines, combined in the tasks before they are shuffled.
Classes meet the terms of their own lines only, by (class, term).

Defined cases: null and empty texts have no spans (a sanitised null stays null); repeated rows get equal results; spans
that overlap are reported each, and replaced as one.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import common as C

GENERALISE = 0.75
REMOVE = 0.95
CONFIDENCE = 0.9
MIN_ASCII_CHARS = 3

KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a valid match of each kind.
_NEEDS = {
    "email": r"[A-Za-z0-9._%+-]@[A-Za-z0-9-]++\.[A-Za-z0-9-]",
    "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]",
    "card": r"[0-9](?:[\x20-]?[0-9]){11}",
    "phone": r"\+[0-9][\x20().0-9-]{8}",
}
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]++"
_NOT_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_BLOCK = 256
_SPANS = "array<struct<start:int,rank:int,kind:string,end:int,value:string>>"


def with_prefix_sums(df: DataFrame, sizes: Column, out_col: str) -> DataFrame:
    """``df`` with, for each whole number of the array ``sizes``, the sum of those before it. Blocks of ``_BLOCK`` are added up by
    themselves, then their totals, so that appending to an array never copies a long one. What a lambda uses often is a
    column first."""
    none = F.array().cast("array<int>")
    own, cut, plain = C.free_name(df.columns, "sizes"), C.free_name(df.columns, "blocks"), df.columns

    def within(block: Column, base: Column) -> Column:
        start = F.struct(base.alias("at"), none.alias("out"))
        return F.aggregate(block, start, lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])

    held = df.select("*", sizes.alias(own)).select(*[F.col(f"`{c}`") for c in plain], _blocks(F.col(own)).alias(cut))
    totals = F.transform(F.col(cut), lambda block: F.aggregate(block, F.lit(0), lambda a, x: a + x))
    return held.select(*[F.col(f"`{c}`") for c in plain], F.flatten(F.zip_with(F.col(cut), within(totals, F.lit(0)), within)).alias(out_col))


def _blocks(array: Column) -> Column:
    """A column of an array, cut into blocks."""
    numbers = F.sequence(F.lit(0), F.floor((F.size(array) - 1) / F.lit(_BLOCK)).cast("int"))
    return F.when(F.size(array) > 0, F.transform(numbers, lambda b: F.slice(array, b * F.lit(_BLOCK) + 1, F.lit(_BLOCK)))).otherwise(F.slice(F.array(array), 1, 0))


def _steps(text: Column, pattern: str) -> Column:
    """The leftmost non-overlapping matches, with the characters since the one before."""
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(values)), values, lambda g, v: F.struct(F.length(g).alias("gap"), v.alias("value")))


def with_places(df: DataFrame, steps: dict[str, str]) -> DataFrame:
    """The columns of ``_steps`` that ``steps`` names replaced by array<struct<start, end, value>>, under the names it gives."""
    for name, out in steps.items():
        before = C.free_name([*df.columns, out], "before")
        df = with_prefix_sums(df, F.transform(F.col(name), lambda s: s["gap"] + F.length(s["value"])), before)
        placed = F.zip_with(F.col(name), F.col(before), lambda s, b: F.struct((b + s["gap"]).alias("start"), (b + s["gap"] + F.length(s["value"])).alias("end"), s["value"].alias("value")))
        df = df.select(*[F.col(f"`{c}`") for c in df.columns if c not in (name, before)], placed.alias(out))
    return df


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    back = F.reverse(digits)

    def add(acc, i):
        d = F.substring(back, i + 1, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return acc + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


_VALID = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: v.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?:\.|$)){4}$"),
    "card": lambda v: F.when(F.length(_digits(v)).between(12, 19), _luhn(_digits(v))).otherwise(False),
    "phone": lambda v: F.length(_digits(v)).between(9, 15),
}


def with_spans(docs: DataFrame, text_col: str, out_col: str) -> DataFrame:
    """``docs`` with the sorted pattern spans: array<struct<start, rank, kind, end, value>>. Each kind's matches are a column of
    their own first, so that no pattern is evaluated twice."""
    order = docs.columns
    names = {k: C.free_name([*order, out_col], f"found_{k}") for k in KINDS}
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    empty = F.array().cast("array<struct<gap:int,value:string>>")
    matches = docs.select("*", *[F.when(text.rlike(_NEEDS[k]), _steps(text, PATTERNS[k])).otherwise(empty).alias(names[k]) for k in KINDS])

    placed = with_places(matches, {n: f"{n}_at" for n in names.values()})

    def valid(kind: str) -> Column:
        kept = F.filter(F.col(f"{names[kind]}_at"), lambda s: _VALID[kind](s["value"]))
        return F.transform(kept, lambda s: F.struct(
            s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), F.lit(kind).alias("kind"), s["end"].alias("end"), s["value"].alias("value"),
        ))

    return placed.select(*[F.col(f"`{c}`") for c in order], F.array_sort(F.concat(*[valid(k) for k in KINDS])).alias(out_col))


#: The ``_NEEDS`` of addresses and cards in one scan.
_NUMBERS = r"[0-9](?:\.[0-9]++\.[0-9]++\.[0-9]|(?:[\x20-]?[0-9]){11})"


def may_hold(text: Column) -> Column:
    """Whether a text holds what some valid match needs (null: no). The signs of mail and telephone are looked for first."""
    whole = F.coalesce(text, F.lit(""))
    return (F.contains(whole, F.lit("@")) & whole.rlike(_NEEDS["email"])) | (F.contains(whole, F.lit("+")) & whole.rlike(_NEEDS["phone"])) | whole.rlike(_NUMBERS)


def _replaced(text: Column, spans: Column, shown: Callable[[Column], Column]) -> Column:
    """The text with ``shown(span)`` in the place of each span of a sorted column of them; what overlaps is replaced as one, by
    the first. A block of spans is put together by itself, so that the whole is copied once for each block."""

    def add(acc, s):
        fresh, from_here = s["start"] >= acc["at"], acc["at"] - acc["base"]
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"), acc["base"].alias("base"), acc["piece"].alias("piece"),
            F.when(fresh, F.concat(acc["out"], F.substring(acc["piece"], from_here + 1, s["start"] - acc["at"]), shown(s))).otherwise(acc["out"]).alias("out"),
        )

    def add_block(acc, block):  # the block's stretch of the text is looked up once
        last = F.array_max(F.transform(block, lambda s: s["end"]))
        start = F.struct(acc["at"].alias("at"), acc["at"].alias("base"), F.substring(text, acc["at"] + 1, F.greatest(last - acc["at"], F.lit(0))).alias("piece"), F.lit("").alias("out"))
        return F.aggregate(block, start, add, lambda part: F.struct(part["at"].alias("at"), F.concat(acc["out"], part["out"]).alias("out")))

    return F.aggregate(_blocks(spans), F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), add_block, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def _entity(s: Column) -> Column:
    """The entity's name: kind and value without case and punctuation of numbers."""
    return F.concat(s["kind"], F.lit(":"), F.when(s["kind"].isin("card", "phone"), _digits(s["value"])).otherwise(F.lower(s["value"])))


def _text_key(text: Column) -> Column:
    return F.sha2(text, 256)


def _is_term(word: Column) -> Column:
    return (F.length(word) >= MIN_ASCII_CHARS) | (F.octet_length(word) > F.length(word))


def _terms(text: Column) -> Column:
    words = F.split(F.lower(text), _NOT_WORD, -1)
    return F.array_distinct(F.filter(words, _is_term))


def entity_lines(docs: DataFrame, text_col: str) -> DataFrame:
    """(text_key, copies, line_start, line_id, line, entities, terms) of every line that holds an entity, of every distinct text;
    ``terms`` are those of the line without its entities, each once."""
    texts = docs.select(F.col(f"`{text_col}`").alias("text")).where(may_hold(F.col("text"))).groupBy(_text_key(F.col("text")).alias("text_key")).agg(
        F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"),
    )
    started = with_prefix_sums(texts.select("text_key", "copies", F.split("text", "\n", -1).alias("lines")), F.transform("lines", lambda x: F.length(x) + 1), "starts")
    each = started.select("text_key", "copies", F.explode(F.zip_with("lines", "starts", lambda x, at: F.struct(x.alias("line"), at.alias("line_start")))).alias("l")).select("text_key", "copies", "l.*")
    # written before the filter, which Spark would otherwise push down with the whole expression of the spans
    spanned = C.cut(with_spans(each.where(may_hold(F.col("line"))), "line", "spans")).where(F.size("spans") > 0)
    masked = _replaced(F.col("line"), F.col("spans"), lambda s: F.lit(" "))
    return spanned.select(
        "text_key", "copies", "line_start", F.xxhash64("line").alias("line_id"), "line", F.array_distinct(F.transform("spans", _entity)).alias("entities"), _terms(masked).alias("terms"),
    )


def _contents(lines: DataFrame) -> DataFrame:
    """(line_id, n, in_text, entities, terms) of every distinct line: n occurrences in all texts, one of which is ``in_text``."""
    return lines.groupBy("line_id").agg(
        F.sum("copies").alias("n"), F.min(F.xxhash64("text_key")).alias("in_text"), F.first("entities").alias("entities"), F.first("terms").alias("terms"),
    )


def entity_classes(contents: DataFrame) -> DataFrame:
    """(line_id, entity, n_entity): the classes of entities in each line. Entities of a class stand in the same lines; the least
    one names it."""
    held = contents.select("line_id", "n", F.explode("entities").alias("member"))
    marks = held.groupBy("member").agg(
        F.bit_xor(F.xxhash64("line_id", F.lit(1))).alias("mark1"), F.bit_xor(F.xxhash64("line_id", F.lit(2))).alias("mark2"), F.count(F.lit(1)).alias("lines"),
        F.sum("n").alias("n_entity"),
    )
    named = marks.groupBy("mark1", "mark2", "lines").agg(F.min("member").alias("entity"), F.first("n_entity").alias("n_entity"))
    return held.join(named, held["member"] == named["entity"]).select("line_id", "entity", "n_entity")


def disclosing_terms(docs: DataFrame, contents: DataFrame, classes: DataFrame, text_col: str = "text", generalise: float = GENERALISE, confidence: float = CONFIDENCE) -> DataFrame:
    """(entity, term, disclosed) of the terms that disclose at least ``generalise`` of a class of entities with ``confidence``."""
    terms = contents.select("line_id", "n", "in_text", F.explode("terms").alias("term"))
    joint = C.cut(classes.join(terms, "line_id").groupBy("entity", "term").agg(
        F.sum("n").alias("n_joint"), F.countDistinct("in_text").alias("support"), F.first("n_entity").alias("n_entity"),
    ))
    # one pass over the corpus: the lines of every term, and all lines (as the term of no characters)
    lines = docs.select(F.explode(F.split(F.col(f"`{text_col}`"), "\n", -1)).alias("line")).where(F.col("line").rlike(_WORD))
    n_term = lines.select(F.explode(F.concat(F.array(F.lit("")), _terms(F.col("line")))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_term"))
    asked = joint.select("term").distinct().union(docs.sparkSession.sql("select ''"))
    n_term = C.cut(n_term.join(asked, "term", "left_semi"))
    total = n_term.where("term = ''").agg(F.sum("n_term")).first()[0] or 1
    n = F.lit(float(total))
    # an entity that stands in every line carries no information
    counts = joint.where(F.col("n_entity") < n).join(n_term, "term").select(
        "entity", "term", "support", (F.col("n_joint") / F.greatest("n_term", "n_joint")).alias("seen"), (F.col("n_entity") / n).alias("p_entity"),
    )
    told = counts.select("entity", "term", "support", "seen", "p_entity", (1 - F.log2("seen") / F.log2("p_entity")).alias("disclosed"))
    return told.where((F.col("disclosed") >= generalise) & (_evidence(generalise) >= -math.log(1 - confidence))).select("entity", "term", "disclosed")


def _evidence(generalise: float) -> Column:
    """m * KL(seen || q) of the module's text, with m = support / seen. Where ``seen`` is 1 the second part is 0."""
    seen, ln_q = F.col("seen"), F.ln("p_entity") * (1 - generalise)
    rest = F.when(seen < 1, (1 - seen) * (F.ln(1 - seen) - F.ln(1 - F.exp(ln_q)))).otherwise(0.0)
    return F.col("support") / seen * (seen * (F.ln(seen) - ln_q) + rest)


def term_spans(docs: DataFrame, text_col: str = "text", generalise: float = GENERALISE, remove: float = REMOVE, confidence: float = CONFIDENCE) -> DataFrame:
    """(text_key, terms): by text, the spans of its disclosing terms, as ``with_spans`` has them; kind ``term``, value the
    replacement."""
    lines = C.cut(entity_lines(docs, text_col))
    contents = C.cut(_contents(lines))
    classes = C.cut(entity_classes(contents))
    told = disclosing_terms(docs, contents, classes, text_col, generalise, confidence)
    # the terms of a line meet those that its classes tell, then its words meet the terms told of it
    own = classes.join(contents.select("line_id", F.explode("terms").alias("term")), "line_id").select("line_id", "entity", "term")
    shares = own.join(told, ["entity", "term"]).groupBy("line_id", "term").agg(F.max("disclosed").alias("share"))
    words = with_places(lines.select("text_key", "line_start", "line_id", _steps(F.col("line"), _WORD).alias("steps")), {"steps": "words"}).select(
        "text_key", "line_start", "line_id", F.explode(F.filter("words", lambda w: _is_term(w["value"]))).alias("w"),
    ).select(
        "text_key", "line_id", F.lower("w.value").alias("term"), (F.col("line_start") + F.col("w.start")).alias("start"), (F.col("line_start") + F.col("w.end")).alias("end"),
    )
    klass = F.when(F.col("term").rlike("^[0-9]+$"), "[NUMBER]").otherwise("[WORD]")
    spans = words.join(shares, ["line_id", "term"]).select(
        "text_key",
        F.struct(
            "start", F.lit(len(KINDS)).alias("rank"), F.lit("term").alias("kind"), "end", F.when(F.col("share") >= remove, "").otherwise(klass).alias("value"),
        ).alias("s"),
    )
    return spans.groupBy("text_key").agg(F.array_sort(F.collect_list("s")).alias("terms"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame, id_cols: list[str], text_col: str = "text", **limits) -> DataFrame:
    """``id_cols`` with ``base`` (pattern spans) and ``spans`` (all spans), underscores in front of a name that is taken. Rows
    that can't hold a span are not joined with anything."""
    narrow = docs.select(F.struct(*[F.col(f"`{c}`") for c in id_cols]).alias("row"), F.col(f"`{text_col}`").alias("text"))
    none = F.array().cast(_SPANS)
    clean = narrow.where(~may_hold(F.col("text"))).select("row", none.alias("base"), none.alias("spans"))
    based = with_spans(narrow.where(may_hold(F.col("text"))), "text", "base").withColumn("text_key", _text_key(F.col("text"))).drop("text")
    dirty = based.join(term_spans(docs, text_col, **limits), "text_key", "left").select("row", "base", F.array_sort(F.concat("base", F.coalesce("terms", none))).alias("spans"))
    return clean.unionByName(dirty).select(*[F.col("row")[c].alias(c) for c in id_cols], F.col("base").alias(C.free_name(id_cols, "base")), F.col("spans").alias(C.free_name(id_cols, "spans")))


def sanitise(docs: DataFrame, text_col: str = "text", **limits) -> DataFrame:
    """All rows and columns, with every span replaced: pattern spans by their kind in brackets, terms by their word class
    or by nothing. Only the texts that may hold a span are shuffled."""
    order = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in order]).alias("row"), F.col(f"`{text_col}`").alias("text"))
    clean = packed.where(~may_hold(F.col("text"))).select(*[F.col("row")[c].alias(c) for c in order])
    based = with_spans(packed.where(may_hold(F.col("text"))), "text", "base").withColumn("text_key", _text_key(F.col("text")))
    dirty = based.join(term_spans(docs, text_col, **limits), "text_key", "left")
    text = F.col("text")
    every = F.array_sort(F.concat("base", F.coalesce("terms", F.array().cast(_SPANS))))
    marked = dirty.withColumn("every", every)
    whole = _replaced(text, F.col("every"), lambda s: F.when(s["kind"] == "term", s["value"]).otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))))
    return clean.unionByName(marked.select(*[whole.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in order]))


def digest(docs: DataFrame) -> DataFrame:
    got = find(docs, ["doc_id"])
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return got.select("doc_id", *[count(k) for k in KINDS], F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))
