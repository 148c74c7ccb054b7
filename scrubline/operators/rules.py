"""Rule tables: schema, defaults, validation, filters, ranking, CRUD.

A rule set is an ordinary DataFrame with :data:`RULE_SCHEMA`; ``ordinal``
is the position in the set (it breaks ranking ties, as array order does in
the original).  Table operators (B1-B16) are DataFrame transformations.
To *apply* rules, the (small, bounded) rule table is read once on the
driver and compiled into column expressions; see ``operators.detect``.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scrubline import fixed as FX
from scrubline.functions.stored import global_rank
from scrubline.operators.patterns import BUILTINS

RULE_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("pattern", T.StringType()),
    T.StructField("flags", T.StringType()),
    T.StructField("replacement", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("enabled", T.BooleanType()),
    T.StructField("priority", T.IntegerType()),
    T.StructField("name", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("case_sensitive", T.BooleanType()),
    T.StructField("ordinal", T.IntegerType()),
    T.StructField("profile", T.StringType()),
])

# Upper bound on a rule set compiled into one plan (rule sets are
# configuration; this keeps the driver-side compile step bounded).
MAX_RULES = 5000


@dataclass(frozen=True)
class Rule:
    id: str | None
    type: str | None
    pattern: str | None
    replacement: str | None = None
    category: str | None = "custom"
    enabled: bool | None = True
    name: str | None = None
    description: str | None = None
    flags: str | None = None
    priority: int | None = None          # declared but never read (B7)
    case_sensitive: bool | None = None   # None: case-sensitive (only False folds case)
    ordinal: int = 0
    profile: str | None = None

    def as_row(self) -> tuple:
        return (self.id, self.type, self.pattern, self.flags, self.replacement, self.category, self.enabled,
                self.priority, self.name, self.description, self.case_sensitive, self.ordinal, self.profile)


def default_rules() -> list[Rule]:
    """The 60 default rules."""
    return [Rule(id=i, type=t, pattern=p, replacement=r, category=c, enabled=True, name=n, description=d, ordinal=k)
            for k, (i, t, p, r, c, n, d) in enumerate(FX.DEFAULT_RULES)]


def rules_df(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    return spark.createDataFrame([r.as_row() for r in rules], RULE_SCHEMA)


def default_rules_df(spark: SparkSession) -> DataFrame:
    return rules_df(spark, default_rules())


def collect_rules(df: DataFrame) -> list[Rule]:
    """Read a rule table to the driver to compile it (bounded by MAX_RULES)."""
    rows = df.orderBy("ordinal").limit(MAX_RULES + 1).collect()
    if len(rows) > MAX_RULES:
        raise ValueError(f"rule set larger than {MAX_RULES} rules")
    names = df.columns
    out = []
    for k, r in enumerate(rows):
        d = r.asDict()
        out.append(Rule(**{f: d.get(f) for f in ("id", "type", "pattern", "replacement", "category", "enabled", "name",
                                                  "description", "flags", "priority", "case_sensitive", "profile")
                           if f in names}, ordinal=d.get("ordinal", k) if d.get("ordinal") is not None else k))
    return out


# ---------------------------------------------------------------- B1

def validate_rules(df: DataFrame) -> DataFrame:
    """B1: adds ``validation struct<is_valid, errors array<string>, warnings>``.

    All checks are column expressions except the regex compile check: the
    distinct regex patterns pass the driver one partition at a time, and the
    ones that do not compile come back as a table to join.
    """
    spark = df.sparkSession
    pats = df.where(F.col("type") == "regex").select("pattern", "flags").distinct()
    bad = [(r["pattern"], r["flags"]) for r in pats.toLocalIterator() if not _java_compiles(spark, r["pattern"], r["flags"])]
    wrong = spark.createDataFrame(bad, "__p string, __f string").withColumn("__bad", F.lit(True))
    cols = list(df.columns)
    df = df.join(wrong, (F.col("type") == "regex") & F.col("pattern").eqNullSafe(F.col("__p")) & F.col("flags").eqNullSafe(F.col("__f")), "left")
    bad_regex = F.col("__bad").isNotNull()
    errors = F.filter(F.array(
        F.when(F.col("type").isNull() | ~F.col("type").isin(*FX.RULE_TYPES), F.lit(FX.ERR_TYPE)),
        F.when(F.col("pattern").isNull() | (F.col("pattern") == ""), F.lit(FX.ERR_PATTERN)),
        F.when(F.col("category").isNull() | ~F.col("category").isin(*FX.RULE_CATEGORIES), F.lit(FX.ERR_CATEGORY)),
        F.when(F.col("enabled").isNull(), F.lit(FX.ERR_ENABLED)),
        F.when(bad_regex, F.concat(F.lit(FX.ERR_REGEX), F.lit("does not compile"))),
    ), lambda e: e.isNotNull())
    return df.withColumn("validation", F.struct(
        (F.size(errors) == 0).alias("is_valid"), errors.alias("errors"),
        F.array().cast("array<string>").alias("warnings"))).select(*cols, "validation")


def _java_compiles(spark: SparkSession, pattern: str | None, flags: str | None) -> bool:
    """Compile a (translated) pattern with the JVM's regex engine."""
    from scrubline.functions.regex import RegexSyntaxError, to_java
    if pattern is None:
        return False
    try:
        java = to_java(pattern, flags or "").pattern
    except (RegexSyntaxError, ValueError):
        return False
    jvm = spark.sparkContext._jvm
    try:
        jvm.java.util.regex.Pattern.compile(java)
        return True
    except Exception:  # py4j wraps PatternSyntaxException
        return False


# ---------------------------------------------------------------- B2-B7

def enabled_rules(df: DataFrame) -> DataFrame:
    """B2: keep rules whose ``enabled`` is true."""
    return df.where(F.coalesce(F.col("enabled"), F.lit(False)))


def filter_rules(df: DataFrame, category: str | None = None, rule_type: str | None = None,
                 search: str | None = None) -> DataFrame:
    """Category / type equality and case-insensitive search in name,
    pattern or description; empty arguments do not filter."""
    out = df
    if category:
        out = out.where(F.col("category") == category)
    if rule_type:
        out = out.where(F.col("type") == rule_type)
    if search:
        q = search.lower()
        hit = F.lit(False)
        for c in ("name", "pattern", "description"):
            hit = hit | F.coalesce(F.lower(F.col(c)).contains(q), F.lit(False))
        out = out.where(hit)
    return out


def display_name(name: Column, pattern: Column) -> Column:
    """``name || pattern``."""
    return F.coalesce(F.nullif(name, F.lit("")), pattern)


def rule_stats(df: DataFrame) -> DataFrame:
    """Total, enabled, disabled, builtin, custom (one row, one pass)."""
    en = F.coalesce(F.col("enabled"), F.lit(False))
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(en).alias("enabled"),
        F.count_if(~en).alias("disabled"),
        F.count_if(F.col("type") == "builtin").alias("builtin"),
        F.count_if(F.coalesce(F.col("type") != "builtin", F.lit(True))).alias("custom"),
    )


def type_priority_col(t: Column) -> Column:
    m = F.create_map(*[x for k, v in FX.TYPE_PRIORITY.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(m, t), F.lit(FX.UNKNOWN_PRIORITY))


def builtin_priority_col(p: Column) -> Column:
    m = F.create_map(*[x for k, v in FX.BUILTIN_PRIORITY.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(m, p), F.lit(FX.UNKNOWN_PRIORITY))


def global_priority_col(t: Column, p: Column) -> Column:
    """B7 as a column: kv 1000, literal 2000, builtin 3000 + table, regex 4000."""
    tp = type_priority_col(t) * 1000
    return F.when(t == "builtin", tp + builtin_priority_col(p)).otherwise(tp)


def rank_rules(df: DataFrame) -> DataFrame:
    """Rank by type priority, then builtin priority (builtins only),
    then input order (id for rules of one place).  The order is global, so it
    is a range sort; see ``functions.stored.global_rank``."""
    t = F.col("type")
    key2 = F.when(t == "builtin", builtin_priority_col(F.col("pattern"))).otherwise(F.lit(0))
    keyed = df.withColumn("global_priority", global_priority_col(t, F.col("pattern"))).withColumn("__type", type_priority_col(t)).withColumn("__own", key2)
    return global_rank(keyed, "__type", "__own", "ordinal", "id").drop("__type", "__own").select(*df.columns, F.col("rank").cast("int").alias("rank"), "global_priority")


def rank_rule_list(rules: list[Rule]) -> list[Rule]:
    """B6 on the driver-side rule list (enabled rules, stable order)."""
    def key(r: Rule):
        tp = FX.TYPE_PRIORITY.get(r.type, FX.UNKNOWN_PRIORITY)
        bp = FX.BUILTIN_PRIORITY.get(r.pattern, FX.UNKNOWN_PRIORITY) if r.type == "builtin" else 0
        return (tp, bp)
    return sorted([r for r in rules if r.enabled], key=key)


# ---------------------------------------------------------------- B10

def upsert_rule(df: DataFrame, rule: Rule) -> DataFrame:
    """B10 add/update keyed by id: drop any rule with the id, append the new
    one (at the end when new, in place when it replaces)."""
    spark = df.sparkSession
    if rule.id is None:
        raise ValueError("rule id required (generate one before upserting)")
    old = df.where(F.col("id") == rule.id).select("ordinal").limit(1).collect()
    if old:
        rule = replace(rule, ordinal=old[0]["ordinal"])
    else:
        mx = df.agg(F.max("ordinal")).collect()[0][0]
        rule = replace(rule, ordinal=(mx + 1) if mx is not None else 0)
    new = rules_df(spark, [rule]).select(*df.columns)
    return df.join(new.select("id"), "id", "left_anti").select(*df.columns).unionByName(new)


def delete_rule(df: DataFrame, rule_id: str) -> DataFrame:
    """B10 delete by id."""
    return df.where(~F.col("id").eqNullSafe(F.lit(rule_id)))


def toggle_rule(df: DataFrame, rule_id: str) -> DataFrame:
    """B10 toggle: flip ``enabled`` of the rule with this id."""
    return df.withColumn("enabled", F.when(F.col("id") == rule_id, ~F.coalesce(F.col("enabled"), F.lit(False)))
                         .otherwise(F.col("enabled")))


# ---------------------------------------------------------------- B15

#: A profile is the rows of a rule table that carry its name; the profile
#: table holds one row per profile.
PROFILE_SCHEMA = "profile string, created timestamp, last_modified timestamp, current boolean"
DEFAULT_PROFILE = "default"


def profile_rules(rules: DataFrame, name: str = DEFAULT_PROFILE) -> DataFrame:
    """The rules of one profile (rules without a profile are the default's)."""
    return rules.where(F.coalesce(F.col("profile"), F.lit(DEFAULT_PROFILE)) == name)


def save_profile(rules: DataFrame, profiles: DataFrame, name: str, new: DataFrame, at) -> tuple[DataFrame, DataFrame]:
    """The two tables with profile ``name`` holding the rules ``new``; a
    profile that exists keeps its creation time."""
    other = rules.where(F.coalesce(F.col("profile"), F.lit(DEFAULT_PROFILE)) != name)
    out = other.unionByName(new.withColumn("profile", F.lit(name)).select(*rules.columns))
    old = profiles.where(F.col("profile") == name)
    one = profiles.sparkSession.createDataFrame([(name, at)], "profile string, at timestamp").join(
        old.select("profile", "created", "current"), "profile", "left")
    row = one.select("profile", F.coalesce("created", "at").alias("created"), F.col("at").alias("last_modified"),
                     F.coalesce("current", F.lit(False)).alias("current"))
    return out, profiles.where(F.col("profile") != name).unionByName(row)


def delete_profile(rules: DataFrame, profiles: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """The two tables without profile ``name``; the default one stays, and
    becomes the current one if the deleted one was."""
    if name == DEFAULT_PROFILE:
        raise ValueError("the default profile cannot be deleted")
    left = profiles.where(F.col("profile") != name)
    gone = profiles.where((F.col("profile") == name) & F.col("current")).select(F.lit(DEFAULT_PROFILE).alias("profile"), F.lit(True).alias("__up"))
    left = left.join(gone, "profile", "left").withColumn("current", F.coalesce("__up", F.col("current"))).drop("__up")
    return rules.where(F.coalesce(F.col("profile"), F.lit(DEFAULT_PROFILE)) != name), left.select("profile", "created", "last_modified", "current")


def select_profile(profiles: DataFrame, name: str) -> DataFrame:
    """The profile table with ``name`` as the current profile."""
    return profiles.withColumn("current", F.col("profile") == name)


def current_profile(profiles: DataFrame) -> DataFrame:
    """The current profile's row (the default's if none is marked)."""
    marked = profiles.agg(F.max("current").alias("__any"))  # one row
    return (profiles.join(F.broadcast(marked)).where(F.when(F.col("__any"), F.col("current")).otherwise(F.col("profile") == DEFAULT_PROFILE))
            .drop("__any"))
