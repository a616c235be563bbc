"""Dictionary entries in JSON lines -> names and derivation edges.

One pass: lines are parsed against a fixed schema, entries about given names are kept, and each gives its names and edges
by four rules as arrays of structs in first-seen order; one shuffle merges them by key. All native but composing letters.
What later steps refer to often (a parsed entry, an entry's steps, a term's bare text) is made once a row: see once and let.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma import schema
from stemma.functions.text import CODE_OF_LANGUAGE, EDGE, SPACE, collapsed, lookup, page_url, trimmed
from stemma.functions.unicode import composed

#: Template names and phrases that mark an entry.
NAME_TEMPLATES = ("given name", "given name of")
INHERITED = ("inh", "inherited", "bor", "borrowed", "der", "derived")
ABOUT = f"(?i){EDGE}given names?(?![A-Za-z0-9_])"
OF_NAME = r"of (?:the )?(?:male |female |unisex )?(?:given )?name\s+([^.,;]+)"
DIMINUTIVE, VARIANT = f"(?i){EDGE}diminutive {OF_NAME}", f"(?i){EDGE}(?:variant|form) {OF_NAME}"
CODE = "(?i)^[a-z]{2,3}(-[a-z0-9]+)?$"
NAME = "struct<key:string,lang_code:string,label:string,language:string,gender:string,source_url:string>"
EDGE_ROW = "struct<child:string,parent:string,relation_type:string>"


def once(df: DataFrame, made: Column, name: str, *more: str) -> DataFrame:
    """df's columns more and made, which is computed once for a row: conditions and expressions over it don't repeat it, as
    they aren't moved across an explode."""
    return df.select(*more, F.explode(F.array(made)).alias(name))


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then of a value that it refers to more than once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def read(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a JSON-lines file, gz by suffix; blank and malformed lines are skipped. A gz file is one split, so its
    lines are dealt out before they are parsed."""
    lines = placed(spark.read.text(path))
    return parse(lines.repartition(spark.sparkContext.defaultParallelism) if path.endswith(".gz") else lines)


#: Where a line of a file comes from.
ORIGIN = {"file": "_metadata.file_path", "block": "_metadata.file_block_start"}


def placed(lines: DataFrame) -> DataFrame:
    """(value, at) of lines as files give them, or with ORIGIN's columns; at is their place by file and offset, however the
    files are split."""
    origin = [F.col(n if n in lines.columns else path).alias(n) for n, path in ORIGIN.items()]
    return lines.select("value", F.struct(*origin, F.monotonically_increasing_id().alias("line")).alias("at"))


def parse(lines: DataFrame) -> DataFrame:
    """(entry) from lines (value); a line that isn't a JSON object gives no row."""
    parsed = F.from_json("value", schema.LEXICAL_ENTRY + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    at = ["at"] if "at" in lines.columns else []
    return once(lines.where(F.trim("value") != ""), parsed, "entry", *at).where("entry IS NOT NULL AND entry._bad IS NULL").select("entry", *at)


def counts(lines: DataFrame) -> DataFrame:
    """(lines, given_names): all lines, malformed ones too, and the entries about given names."""
    n = lines.agg(F.count(F.lit(1)).alias("lines"))
    return n.join(parse(lines).where(is_given_name(F.col("entry"))).agg(F.count(F.lit(1)).alias("given_names")))


def _list(c: Column, kind: str = "array<string>") -> Column:
    return F.coalesce(c, F.array().cast(kind))



_T = "array<struct<name:string,args:map<string,string>,expansion:string>>"
_SENSES = schema.LEXICAL_ENTRY.split("senses ")[1].split(", categories")[0]
_DESCENDANTS = schema.LEXICAL_ENTRY.split("descendants ")[1].split(", senses")[0]
_KIND = {"glosses": "array<string>", "raw_glosses": "array<string>", "categories": "array<string>", "links": "array<array<string>>", "head_templates": _T}


def _of_senses(entry: Column, name: str) -> Column:
    return F.flatten(F.transform(F.coalesce(entry["senses"], F.array().cast(_SENSES)), lambda s: _list(s[name], _KIND[name])))


def glosses(entry: Column) -> Column:
    """Each sense's glosses, then its raw glosses."""
    return F.flatten(F.transform(F.coalesce(entry["senses"], F.array().cast(_SENSES)), lambda s: F.concat(_list(s["glosses"]), _list(s["raw_glosses"]))))


def name_templates(entry: Column) -> Column:
    every = F.concat(_list(entry["head_templates"], _T), _of_senses(entry, "head_templates"))
    return F.filter(every, lambda t: t["name"].isin(*NAME_TEMPLATES))


def is_given_name(entry: Column) -> Column:
    about = lambda x: F.coalesce(x.rlike(ABOUT), F.lit(False))
    linked = F.transform(_of_senses(entry, "links"), lambda x: F.get(x, F.lit(0)))
    texts = F.concat(_list(entry["categories"]), _of_senses(entry, "categories"), glosses(entry), linked)
    return (F.size(name_templates(entry)) > 0) | F.exists(texts, about)


def gender(entry: Column) -> Column:
    """By the glosses' phrases; a template's second argument overrides, the last one wins."""
    said = F.lower(F.array_join(glosses(entry), " "))
    phrase = lambda g: said.rlike(f"{EDGE}{g} given name(?![A-Za-z0-9_])")
    by_gloss = F.when(phrase("female"), "female").when(phrase("male"), "male").when(phrase("unisex"), "unisex")
    given = F.transform(name_templates(entry), lambda t: F.lower(trimmed(F.get(F.split(F.coalesce(F.try_element_at(t["args"], F.lit("2")), F.try_element_at(t["args"], F.lit("gender")), F.lit("")), ","), F.lit(0)))))
    return F.coalesce(F.try_element_at(F.filter(given, lambda g: g.isin("male", "female", "unisex")), F.lit(-1)), by_gloss)


def segment(raw: Column, fallback: Column) -> Column:
    """A term as (lang_code, label): `code:term`, or a bare term in the fallback language; null for blanks, dashes and
    names of languages. Labels aren't composed yet."""
    made = lambda c, t: F.struct(c.alias("lang_code"), collapsed(t).alias("label"))

    def coded(bare: Column, at: Column) -> Column:
        """The term behind a code, if there is one."""
        code, term = F.lower(trimmed(F.substring(bare, F.lit(1), at - 1))), trimmed(F.substring(bare, at + 1, F.char_length(bare)))
        return let(F.struct(code.alias("c"), term.alias("t")), lambda x: F.when(x["c"].rlike(CODE) & (x["t"] != ""), made(x["c"], x["t"])))

    def of(bare: Column) -> Column:
        at = F.instr(bare, ":")
        language = lookup(CODE_OF_LANGUAGE, F.lower(bare)).isNotNull() | bare.rlike("^[A-Z][a-z]+( [A-Z][a-z]+)* languages?$")
        return F.coalesce(F.when(at.between(2, 12), coded(bare, at)), F.when(~language, made(fallback, bare)))

    def term(text: Column) -> Column:
        return F.when(text != "-", let(trimmed(F.regexp_replace(text, "(?i)<[a-z]+:[^>]*>", "")), lambda bare: F.when(bare != "", of(bare))))

    return let(trimmed(raw), term)


def numbered(args: Column, base: str) -> Column:
    """The values of base, base2, ... base12 that aren't empty."""
    keys = [base, *(f"{base}{i}" for i in range(2, 13))]
    return F.filter(F.array(*(F.try_element_at(args, F.lit(k)) for k in keys)), lambda v: v.isNotNull() & (v != ""))


def chain(value: Column) -> Column:
    """The steps of `younger < older < oldest`."""
    return F.filter(F.transform(F.split(value, f"{SPACE}+<{SPACE}+"), trimmed), lambda s: s != "")


_TERM = "struct<lang_code:string,label:string>"
_STEP = f"struct<child:{_TERM},parent:{_TERM},relation_type:string,lone:boolean>"


def _step(child: Column, parent: Column, kind: str, lone: bool = False) -> Column:
    return F.struct(child.cast(_TERM).alias("child"), parent.cast(_TERM).alias("parent"), F.lit(kind).alias("relation_type"), F.lit(lone).alias("lone"))


def rule_templates(entry: Column, me: Column, code: Column) -> Column:
    """Head templates: chains of origin, and lists of what the name is a short form or a variant of."""
    def of_chain(value: Column) -> Column:
        def linked(terms: Column) -> Column:
            ends = F.transform(F.slice(terms, 1, 1), lambda t: _step(me, t, "derived_from"))
            links = F.zip_with(F.slice(terms, F.lit(1), F.greatest(F.size(terms) - 1, F.lit(0))), F.slice(terms, F.lit(2), F.greatest(F.size(terms) - 1, F.lit(0))), lambda y, o: _step(y, o, "derived_from"))
            return F.concat(ends, links)

        return let(F.filter(F.transform(chain(value), lambda s: segment(s, code)), lambda t: t.isNotNull()), linked)

    def of_list(args: Column, base: str, kind: str) -> Column:
        parts = F.flatten(F.transform(numbered(args, base), lambda v: F.split(v, ",")))
        terms = F.filter(F.transform(parts, lambda s: segment(s, code)), lambda t: t.isNotNull())
        return F.transform(terms, lambda t: _step(me, t, kind))

    def of_template(t: Column) -> Column:
        return F.concat(F.flatten(F.transform(numbered(t["args"], "from"), of_chain)), of_list(t["args"], "dimof", "diminutive_of"), of_list(t["args"], "varof", "variant_of"))

    return F.flatten(F.transform(name_templates(entry), of_template))


def rule_etymology(entry: Column, me: Column, code: Column) -> Column:
    """Inherited, borrowed and derived terms; a suffix's base is what the name is a short form of."""
    def of_template(t: Column) -> Column:
        arg = lambda k: trimmed(F.coalesce(F.try_element_at(t["args"], F.lit(k)), F.lit("")))
        source, term, name = F.lower(arg("2")), arg("3"), F.lower(t["name"])
        good = name.isin(*INHERITED) & source.rlike(CODE) & (term != "") & ~term.startswith("*")
        parent = F.when(good, F.struct(source.alias("lang_code"), collapsed(term).alias("label")))
        base = F.when((name == "suffix") & (arg("2") != ""), segment(arg("2"), code))
        return F.array(_step(me, parent, "derived_from"), _step(me, base, "diminutive_of"))

    steps = F.flatten(F.transform(_list(entry["etymology_templates"], _T), of_template))
    return F.filter(steps, lambda s: s["parent"].isNotNull())


def rule_glosses(entry: Column, me: Column, code: Column) -> Column:
    """`diminutive of the male given name X`, `variant of the given name X`."""
    def of_gloss(g: Column) -> Column:
        hit = lambda r: segment(F.nullif(F.regexp_extract(g, r, 1), F.lit("")), code)
        return F.array(_step(me, hit(DIMINUTIVE), "diminutive_of"), _step(me, hit(VARIANT), "variant_of"))

    return F.filter(F.flatten(F.transform(glosses(entry), of_gloss)), lambda s: s["parent"].isNotNull())


def rule_descendants(entry: Column, me: Column) -> Column:
    """Listed descendants derive from this entry."""
    rows = F.filter(F.coalesce(entry["descendants"], F.array().cast(_DESCENDANTS)), lambda d: (trimmed(F.coalesce(d["word"], F.lit(""))) != "") & (F.coalesce(d["lang_code"], F.lit("")) != ""))
    return F.transform(rows, lambda d: _step(F.struct(F.lower(d["lang_code"]).alias("lang_code"), collapsed(d["word"]).alias("label")), me, "derived_from"))


def transform(entries: DataFrame) -> DataFrame:
    """(ordinal, key, lang_code, label, language, gender, source_url, entry_url, steps) for each entry about a given name;
    steps: the edges in order of rules, as (child, parent, relation_type) of (lang_code, label) pairs."""
    entry = F.col("entry")
    kept = entries.where(is_given_name(entry) & (trimmed(F.coalesce(entry["word"], F.lit(""))) != ""))
    code = F.lower(F.coalesce(entry["lang_code"], F.lit("en")))
    rows = kept.withColumns({"ordinal": F.col("at") if "at" in entries.columns else F.monotonically_increasing_id(), "lang_code": code, "label": collapsed(composed(entry["word"]))})
    me = F.struct("lang_code", "label").cast(_TERM)
    code = F.col("lang_code")
    steps = F.concat(*(c.cast(f"array<{_STEP}>") for c in (rule_templates(entry, me, code), rule_etymology(entry, me, code), rule_glosses(entry, me, code), rule_descendants(entry, me))))
    spoken = F.transform(F.coalesce(entry["descendants"], F.array().cast(_DESCENDANTS)), lambda d: F.struct(F.lower(d["lang_code"]).alias("lang_code"), collapsed(d["word"]).alias("label"), d["lang"].alias("language")))
    made = F.struct("ordinal", "lang_code", "label", entry["lang"].alias("language"), gender(entry).alias("gender"), page_url(trimmed(entry["word"])).alias("entry_url"), steps.alias("steps"), spoken.alias("spoken"))
    return once(once(rows, F.struct("lang_code", "label"), "own", "entry", "ordinal").select("entry", "ordinal", "own.*"), made, "made").select("made.*")


def _key(code: Column, label: Column) -> Column:
    return F.concat(F.lower(code), F.lit(":"), F.lower(label))


def edges(transformed: DataFrame) -> DataFrame:
    """(child, parent, relation_type, source_url): the first of each, without loops."""
    rows = transformed.select("ordinal", "entry_url", F.posexplode("steps").alias("place", "s")).select(
        "ordinal", "place", "entry_url", "s.relation_type", F.col("s.child.lang_code").alias("cc"), composed(F.col("s.child.label")).alias("cl"), F.col("s.parent.lang_code").alias("pc"), composed(F.col("s.parent.label")).alias("pl"))
    keyed = rows.select("ordinal", "place", "relation_type", "entry_url", _key(F.col("cc"), F.col("cl")).alias("child"), _key(F.col("pc"), F.col("pl")).alias("parent"))
    keyed = once(keyed, F.struct(*keyed.columns), "row").select("row.*").where("child <> parent")
    return keyed.groupBy("child", "parent", "relation_type").agg(F.min_by("entry_url", F.struct("ordinal", "place")).alias("source_url"))


def names(transformed: DataFrame) -> DataFrame:
    """(key, lang_code, label, language, gender, source_url): the first row of a key wins; language and gender come from
    the first row that has one."""
    own = transformed.select("ordinal", F.lit(-1).alias("place"), "lang_code", "label", "language", "gender", F.col("entry_url").alias("source_url"))
    steps = transformed.select("ordinal", F.posexplode("steps").alias("place", "s"), "spoken")
    ends = steps.select("ordinal", (F.col("place") * 2).alias("place"), F.col("s.child").alias("t"), "spoken").union(steps.select("ordinal", (F.col("place") * 2 + 1).alias("place"), F.col("s.parent").alias("t"), "spoken"))
    spoken = F.get(F.filter("spoken", lambda d: (d["lang_code"] == F.col("t.lang_code")) & (d["label"] == F.col("t.label"))), F.lit(0))["language"]
    met = ends.select("ordinal", "place", "t.lang_code", composed(F.col("t.label")).alias("label"), spoken.alias("language"), F.lit(None).cast("string").alias("gender"))
    rows = own.union(met.withColumn("source_url", page_url(F.col("label"))).select(own.columns)).withColumn("key", _key(F.col("lang_code"), F.col("label")))
    order = F.struct("ordinal", "place")
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), order)).alias(c)
    return rows.groupBy("key").agg(F.min_by(F.struct("lang_code", "label", "source_url"), order).alias("w"), first("language"), first("gender")).select("key", "w.lang_code", "w.label", "language", "gender", "w.source_url")
