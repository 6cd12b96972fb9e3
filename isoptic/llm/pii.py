"""Personal data, and the terms that give it away, in the JVM alone.

Patterns find addresses and numbers. Each value is a protected entity; terms of
the documents that mention it are counted with it over all documents, and a term
whose pointwise mutual information with the entity is a large enough part of the
entity's own information discloses it, and is generalised wherever it occurs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .skew import SALTS, hinted, salted_join
from .store import keep
from .text import unused

#: Part of an entity's information that a term may give away, and documents that
#: must agree on it.
ALPHA, SUPPORT = 0.8, 2
KINDS = ("email", "ip", "card", "phone", "term")
TERM = "\\p{L}{4,}"
#: The same in a text where NUL stands for a letter that isn't the term's.
FREE = "(?<![\\p{L}\\x00])\\p{L}{4,}+(?![\\p{L}\\x00])"
# What a pattern's first part can't begin inside of is said by looking back, so
# that long runs are tried once; \G lets a match follow another directly.
EMAIL = "(?:\\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+"
IP = "(?:\\G|(?<![0-9]))[0-9]++(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)"
# A chain of digits is taken whole or not at all, so its length can be asked for here.
CARD = "(?<![0-9])(?<![0-9][\\x20-])[0-9](?:[\\x20-]?[0-9]){13,18}+(?![\\x20-]?[0-9])"
PHONE = "\\+[0-9][\\x20().0-9-]+[0-9]"


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _luhn(v: Column) -> Column:
    d = F.reverse(_digits(v))
    each = F.transform(
        F.sequence(F.lit(1), F.length(d)),
        lambda i: (lambda x: F.when(i % 2 == 1, x).otherwise(x * 2 - F.when(x > 4, 9).otherwise(0)))(F.substring(d, i, F.lit(1)).cast("int")),
    )
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def _let(value: Column, f) -> Column:
    """``f`` of a value that is made once, where ``f`` has it in inner functions."""
    return F.transform(F.array(value), f)[0]


def _matches(text: Column, pattern: str, made) -> Column:
    """``made(start, match)`` of every match of a pattern. A place is the sum of what
    comes before it, in parts of about the root of their number."""
    add = lambda a: F.aggregate(a, F.lit(0), lambda n, x: n + x)
    cut = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern).alias("parts"))
    steps = lambda z: F.transform(z["found"], lambda v, i: F.length(F.get(z["parts"], i)) + F.when(i > 0, F.length(F.get(z["found"], i - 1))).otherwise(0))
    most = lambda z: F.greatest(F.size(z["found"]), F.lit(1))
    wide = lambda z: F.struct(z["found"].alias("found"), steps(z).alias("steps"), F.ceil(F.sqrt(most(z))).cast("int").alias("w"))
    summed = lambda z: F.struct(z["found"].alias("found"), z["steps"].alias("steps"), z["w"].alias("w"), F.transform(F.sequence(F.lit(0), most(z) - 1, z["w"]), lambda a: add(F.slice(z["steps"], a + 1, z["w"]))).alias("sums"))
    start = lambda z, i: add(F.slice(z["sums"], F.lit(1), F.floor(i / z["w"]).cast("int"))) + add(F.slice(z["steps"], i - i % z["w"] + 1, i % z["w"] + 1))
    each = lambda z: F.transform(z["found"], lambda v, i: _let(start(z, i), lambda s: made(s, v)))
    return _let(cut, lambda z: _let(wide(z), lambda y: _let(summed(y), each)))


def _spans(kind: str, text: Column, pattern: str, holds) -> Column:
    """[{k, s, e, v}] of the matches that hold."""
    one = lambda s, v: F.struct(F.lit(KINDS.index(kind)).alias("k"), s.alias("s"), (s + F.length(v)).alias("e"), v.alias("v"))
    return F.filter(_matches(text, pattern, one), lambda x: holds(x["v"]))


def _replaced(text: Column, spans: Column, new) -> Column:
    """The text with ``new(span)`` in place of each of ``spans`` ([{s, e, ...}], by start,
    none within another). It is cut before every so many spans, about the root of their
    number, and then within those parts, so that no place is counted from the text's start for
    each span."""

    def cut(z: Column) -> Column:
        n = F.size(z["spans"])
        at = lambda i: F.get(z["spans"], i)
        end = lambda i: F.when(i < n, at(i)["s"]).otherwise(F.length(z["text"]))

        def part(a: Column) -> Column:
            begin = at(a)["s"]
            after = lambda own: F.array_join(F.transform(F.sequence(a, F.least(a + z["w"], n) - 1), lambda i: F.concat(new(at(i)), F.substring(own, at(i)["e"] - begin + 1, end(i + 1) - at(i)["e"]))), "")
            return _let(F.substring(z["text"], begin + 1, end(F.least(a + z["w"], n)) - begin), after)

        return F.concat(F.substring(z["text"], F.lit(1), at(F.lit(0))["s"]), F.array_join(F.transform(F.sequence(F.lit(0), n - 1, z["w"]), part), ""))

    both = F.struct(text.alias("text"), spans.alias("spans"), F.ceil(F.sqrt(F.greatest(F.size(spans), F.lit(1)))).cast("int").alias("w"))
    return _let(both, lambda z: F.when(F.size(z["spans"]) > 0, cut(z)).otherwise(z["text"]))


NONE = "array<struct<k:int,s:int,e:int,v:string>>"


def _ip_ok(v: Column) -> Column:
    return F.forall(F.split(v, "\\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "").rlike("^(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))


def base_spans(text: Column) -> Column:
    """All base spans of a text, by kind and start."""
    digit = text.rlike("[0-9]")
    n = lambda v: F.length(_digits(v))
    asked = (
        ("email", EMAIL, text.contains("@"), lambda v: F.lit(True)),
        ("ip", IP, digit, _ip_ok),
        ("card", CARD, digit, _luhn),
        ("phone", PHONE, text.contains("+") & digit, lambda v: (n(v) >= 10) & (n(v) <= 15)),
    )
    none = F.array().cast(NONE)
    return F.concat(*[F.when(may, _spans(k, text, p, ok)).otherwise(none) for k, p, may, ok in asked])


def _placed(text: Column, pattern: str) -> Column:
    """The matches of a pattern, lower-cased and hashed: [{s, e, t}]."""
    return _matches(text, pattern, lambda s, v: F.struct(s.alias("s"), (s + F.length(v)).alias("e"), F.xxhash64(F.lower(v)).alias("t")))


def _hidden(text: Column, base: Column) -> Column:
    """The text with base spans blanked; NUL where a letter was at their edge. Those of
    one kind don't overlap, and blanks are as long as the spans."""
    edge = lambda x: F.when(x.rlike("\\p{L}"), F.lit("\0")).otherwise(F.lit(" "))
    blank = lambda b: F.concat(edge(F.substring(b["v"], 1, 1)), F.repeat(F.lit(" "), b["e"] - b["s"] - 2), edge(F.substring(b["v"], -1, 1)))
    kind = lambda k: lambda b: b["k"] == k
    out = F.replace(text, F.lit("\0"), F.lit(" "))
    for k in range(KINDS.index("term")):
        out = _replaced(out, F.filter(base, kind(k)), blank)
    return out


def _terms(text: Column, base: Column) -> Column:
    """Every term of a text that overlaps no base span: [{s, e, t}]."""
    return F.when(F.size(base) > 0, _placed(_hidden(text, base), FREE)).otherwise(_placed(text, TERM))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", alpha: float = ALPHA, support: int = SUPPORT, salts: int = SALTS) -> DataFrame:
    """``id``, ``th`` (the text's hash) and ``spans`` ([{k, s, e}], by start and
    kind) of each of ``docs``; ``k`` counts ``KINDS``, code points from 0.

    A term of four letters or more that overlaps no mention discloses an entity
    if both share at least ``support`` documents and PMI(entity; term) >=
    ``alpha`` * information(entity), with probabilities by document over the
    whole corpus. ``spans`` has every occurrence of such a term, in whatever
    document. A null text is empty and has no spans. Rows that repeat an id with
    the same text are one document; with another text, two. A null id is an id
    like others. Other columns are ignored; an empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("th"), text.alias("t"))
    hashed = lambda x: F.transform(x, lambda v: F.xxhash64(F.lower(v)))
    mentions = F.array_distinct(F.transform("base", lambda b: F.xxhash64(b["k"], F.lower(b["v"]))))
    base = keep(
        rows.withColumn("base", base_spans(F.col("t"))).select(
            "id",
            "th",
            F.transform("base", lambda b: F.struct(b["k"], b["s"], b["e"])).alias("base"),
            F.when(F.size("base") > 0, mentions).alias("m"),
            # Terms of the text, and those that overlap no base span.
            F.array_distinct(hashed(F.regexp_extract_all("t", F.lit(TERM), F.lit(0)))).alias("terms"),
            F.when(F.size("base") > 0, F.array_distinct(hashed(F.regexp_extract_all(_hidden(F.col("t"), F.col("base")), F.lit(FREE), F.lit(0))))).alias("free"),
        ),
        "base",
    )
    n = base.count()
    mention = base.where("m is not null").select("id", "th", F.explode("m").alias("c")).distinct()
    df_c = mention.groupBy("c").agg(F.count(F.lit(1)).alias("df_c"))
    # Entities of fewer documents share no term with as many as ``support``.
    many = keep(df_c.where((F.col("df_c") >= support) & (F.col("df_c") < n)), "entities")
    own = base.where("m is not null").select("id", "th", F.explode("m").alias("c"), F.col("free").alias("t"))
    whole = own.join(hinted(many.select("c")), "c").dropDuplicates(["id", "th", "c"])
    joint = keep(whole.select("c", F.explode("t").alias("t")).groupBy("c", "t").agg(F.count(F.lit(1)).alias("both")).where(F.col("both") >= support), "joint")
    # Where they are at all, of terms that any entity shares documents with.
    there = keep(base.select("id", "th", F.explode("terms").alias("t")).join(hinted(keep(joint.select("t").distinct(), "joint-terms")), "t", "left_semi"), "there")
    df_t = there.groupBy("t").agg(F.count(F.lit(1)).alias("df_t"))
    enough = F.log2(F.lit(float(n)) * F.col("both") / (F.col("df_c") * F.col("df_t"))) >= alpha * F.log2(F.lit(float(n)) / F.col("df_c"))
    # A term that many entities have, and an entity of many terms, meet in parts.
    counted = salted_join(salted_join(joint, many, ["c"], ["t"], how="inner", salts=salts), df_t, ["t"], ["c"], how="inner", salts=salts)
    risky = hinted(keep(counted.where(enough).select("t").distinct(), "risky-terms"))

    # Only the texts that have any are searched for where they are.
    has = there.join(risky, "t", "left_semi").select(F.col("id").alias("_i"), F.col("th").alias("_t")).distinct()
    here = F.col("id").eqNullSafe(F.col("_i")) & (F.col("th") == F.col("_t"))
    asked = rows.join(hinted(keep(has, "with-terms")), here, "left_semi").withColumn("base", base_spans(F.col("t")))
    word = asked.select("id", "th", F.explode(_terms(F.col("t"), F.col("base"))).alias("x")).select("id", "th", "x.t", "x.s", "x.e").join(risky, "t", "left_semi")
    found = word.groupBy("id", "th").agg(F.collect_set(F.struct(F.lit(KINDS.index("term")).alias("k"), "s", "e")).alias("found")).withColumnsRenamed({"id": "_i", "th": "_t"})
    order = lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"))
    every = F.array_sort(F.transform(F.concat("base", F.coalesce("found", F.array().cast("array<struct<k:int,s:int,e:int>>"))), order))
    return base.select("id", "th", "base").join(found, here, "left").select("id", "th", every.alias("spans"))


def count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["k"] == KINDS.index(kind))).cast("long")


def written(spans: Column | str) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(F.array(*[F.lit(k) for k in KINDS]), x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with each of ``spans`` of ``text_col`` generalised to its kind,
    such as [EMAIL]; a span that begins within another is part of it. A null text
    stays null; columns may have any name."""
    i, t, spans = unused(docs.columns, "i", "t", "spans")
    found = find(docs, id_col, text_col, **options).dropDuplicates(["id", "th"]).select(F.col("id").alias(i), F.col("th").alias(t), F.col("spans").alias(spans))
    text = F.coalesce(F.col(text_col), F.lit(""))
    tag = lambda x: F.concat(F.lit("["), F.upper(F.get(F.array(*[F.lit(k) for k in KINDS]), x["k"])), F.lit("]"))
    # Of spans, those that don't begin within what came before.
    kept = F.array().cast("array<struct<s:int,k:int,e:int>>")
    step = lambda a, x: F.struct(F.greatest(a["at"], x["e"]).alias("at"), F.when(x["s"] < a["at"], a["out"]).otherwise(F.concat(a["out"], F.array(x))).alias("out"))
    apart = F.aggregate(spans, F.struct(F.lit(0).alias("at"), kept.alias("out")), step, lambda a: a["out"])
    clean = _let(apart, lambda z: _replaced(text, z, tag))
    joined = docs.join(found, F.col(id_col).eqNullSafe(F.col(i)) & (F.xxhash64(text) == F.col(t)), "left")
    return joined.select(*[F.when(F.col(c).isNotNull(), clean).alias(c) if c == text_col else F.col(c) for c in docs.columns])
