"""Custom sensitive words (B11-B14) as tables.

A word table has one row per word: ``word``, ``word_category`` (company,
competitor, project, custom) and ``ordinal``, its place in its list.  The
operators are ordinary joins and projections over such tables, so the words
may come from anywhere, a dimension table for instance; ``word_rules`` turns
them into a rule table of case-insensitive literals for the normal
detection path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scrubline import fixed as FX
from scrubline.functions.stored import global_rank
from scrubline.operators.rules import RULE_SCHEMA, Rule, collect_rules

LISTS = ("company", "competitor", "project", "custom")


def word_table(spark: SparkSession, **lists) -> DataFrame:
    """A word table from lists by category, e.g. ``project=["x", "y"]``."""
    unknown = set(lists) - set(LISTS)
    if unknown:
        raise ValueError(f"unknown word categories: {sorted(unknown)}")
    one = spark.createDataFrame([tuple(list(lists.get(c, ())) for c in LISTS)], ", ".join(f"{c} array<string>" for c in LISTS))
    parts = [one.select(F.posexplode(c).alias("ordinal", "word")).select("word", F.lit(c).alias("word_category"), "ordinal") for c in LISTS]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def words_from(df: DataFrame, col: str, category: str = "custom") -> DataFrame:
    """The distinct values of a column as a word table, in their own order."""
    words = normalize_words(df.select(F.col(col).alias("word"), F.lit(category).alias("word_category"), F.lit(0).alias("ordinal")))
    return global_rank(words.drop("ordinal"), "word", out="ordinal").select("word", "word_category", F.col("ordinal").cast("int").alias("ordinal"))


def normalize_words(words: DataFrame) -> DataFrame:
    """Trimmed, lower case, once per category (first place kept);
    null and blank words drop out."""
    w = F.lower(F.trim(F.col("word")))
    return (words.select(w.alias("word"), "word_category", "ordinal").where("word <> ''")
            .groupBy("word", "word_category").agg(F.min("ordinal").alias("ordinal")))


def add_words(words: DataFrame, new: DataFrame) -> DataFrame:
    """B13 add: normalised new words that their list lacks come after its
    last; a new company replaces the old one.  One grouping of the union; new
    words are numbered by a range sort, and four lists are looked up."""
    both = words.select("word", "word_category", "ordinal", F.lit(0).alias("new")).unionByName(
        normalize_words(new).select("word", "word_category", "ordinal", F.lit(1).alias("new")))
    once = both.groupBy("word", "word_category").agg(F.min("new").alias("new"), F.min_by("ordinal", "new").alias("ordinal"))
    old = once.where("new = 0").select("word", "word_category", "ordinal")
    added = global_rank(once.where("new = 1").select("word", "word_category", "ordinal"), "word_category", "ordinal", "word")
    first = added.groupBy("word_category").agg(F.min("rank").alias("first"))
    last = old.groupBy("word_category").agg(F.max("ordinal").alias("last"))
    k = F.col("rank") - F.col("first")
    at = F.when(F.col("word_category") == "company", k).otherwise(F.coalesce("last", F.lit(-1)) + 1 + k)
    added = added.join(F.broadcast(first), "word_category").join(F.broadcast(last), "word_category", "left").select("word", "word_category", at.cast("int").alias("ordinal"))
    replaced = F.broadcast(first.where("word_category = 'company'").select("word_category"))
    return old.join(replaced, "word_category", "left_anti").select("word", "word_category", "ordinal").unionByName(added)


def remove_words(words: DataFrame, gone: DataFrame) -> DataFrame:
    """B13 remove: an anti join; any company row clears the company."""
    g = normalize_words(gone)
    left = words.join(g.select("word", "word_category"), ["word", "word_category"], "left_anti")
    return left.join(g.where("word_category = 'company'").select("word_category").distinct(), "word_category", "left_anti").select(*words.columns)


def word_stats(words: DataFrame) -> DataFrame:
    """One row with the size of each list and the total."""
    n = lambda c: F.count_if(F.col("word_category") == c)
    return words.agg(n("company").alias("company"), n("competitor").alias("competitors"), n("project").alias("projects"),
                     n("custom").alias("custom"), F.count("*").alias("total"))


def word_replacement(word: Column, category: Column, strategy: str) -> Column:
    """B14 as a column.  'competitor' picks one of the fixed names by a hash
    of the word, so equal words get equal names in any task."""
    if strategy == "custom":
        return F.regexp_replace(F.regexp_replace(F.regexp_replace(word, "[A-Z]", "X"), "[a-z]", "x"), "[0-9]", "0")
    if strategy == "competitor":
        names = F.array(*[F.lit(n) for n in FX.COMPETITOR_NAMES])
        pick = F.get(names, F.pmod(F.xxhash64(word), F.lit(len(FX.COMPETITOR_NAMES))).cast("int"))
        return F.when(category == "company", pick).otherwise(F.concat(F.lit("["), F.upper(category), F.lit("_REDACTED]")))
    if strategy == "generic":
        table = F.create_map(*[x for k, v in FX.GENERIC_WORD_REPLACEMENT.items() for x in (F.lit(k), F.lit(v))])
        return F.coalesce(F.try_element_at(table, category), F.lit(FX.REDACTED))
    return F.lit(FX.REDACTED)


def word_rules(words: DataFrame, strategy: str = "generic") -> DataFrame:
    """A rule table (RULE_SCHEMA) with one literal rule per word, in
    the order company, competitors, projects, words."""
    cat, word = F.col("word_category"), F.col("word")
    labels = FX.WORD_RULE_LABELS
    def pick(field):
        out = None
        for c in LISTS:
            v = F.lit(labels[c][field])
            out = F.when(cat == c, v) if out is None else out.when(cat == c, v)
        return out
    listed = F.array(*[F.lit(c) for c in LISTS])
    rid = F.when(cat == "company", pick("id")).otherwise(F.concat(pick("id"), F.lit("_"), F.col("ordinal").cast("string")))
    name = F.when(cat == "company", pick("name")).otherwise(F.concat(pick("name"), F.lit(": "), word))
    fixed = {"id": rid, "type": F.lit("literal"), "pattern": word, "replacement": word_replacement(word, cat, strategy),
             "category": pick("category"), "enabled": F.lit(True), "name": name, "description": pick("description"),
             "case_sensitive": F.lit(False), "ordinal": F.col("rank") + 10_000}
    ranked = global_rank(words.where(F.array_contains(listed, cat)).withColumn("__list", F.array_position(listed, cat)), "__list", "ordinal", "word")
    return ranked.select(*[fixed.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in RULE_SCHEMA.fields])


def word_rule_list(lists: dict[str, list[str]], strategy: str = "generic") -> list[Rule]:
    """B11 for a few words given as lists by category: the rules of
    ``word_rules``, made without a Spark job (the competitor strategy hashes
    as Spark does: use a table for it)."""
    if strategy == "competitor":
        raise ValueError("the competitor strategy needs a word table")
    out = []
    for cat in LISTS:
        label = FX.WORD_RULE_LABELS[cat]
        for i, w in enumerate(lists.get(cat, ())):
            mask = "".join("X" if "A" <= c <= "Z" else "x" if "a" <= c <= "z" else "0" if "0" <= c <= "9" else c for c in w)
            repl = mask if strategy == "custom" else FX.GENERIC_WORD_REPLACEMENT.get(cat, FX.REDACTED) if strategy == "generic" else FX.REDACTED
            own = cat == "company"
            out.append(Rule(id=label["id"] if own else f"{label['id']}_{i}", type="literal", pattern=w, replacement=repl, category=label["category"],
                            name=label["name"] if own else f"{label['name']}: {w}", description=label["description"], case_sensitive=False, ordinal=10_000 + len(out)))
    return out


def with_custom_words(rules: list[Rule], words: DataFrame | dict | None, strategy: str = "generic") -> list[Rule]:
    """A rule list with the rules of a word table or of lists by
    category, added once.  This compiles a rule a word, which suits a few
    hundred (MAX_RULES at most); a table of any size goes to ``detect`` and
    ``sanitize`` as ``words``."""
    if words is None:
        return list(rules)
    have = {r.id for r in rules}
    new = word_rule_list(words, strategy) if isinstance(words, dict) else collect_rules(word_rules(words, strategy))
    return list(rules) + [r for r in new if r.id not in have]


def rules_with_words(rules: DataFrame, words: DataFrame, strategy: str = "generic") -> DataFrame:
    """B8 on tables: the union, a word rule replacing one of the same id."""
    new = word_rules(words, strategy)
    return rules.join(new.select("id"), "id", "left_anti").select(*rules.columns).unionByName(new.select(*rules.columns))

