"""Classification by ordered rules, fuzzy names and paths. Rules are data: the first that fits names the row."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklens.functions.numbers import col


def _plain(name: str | Column) -> Column:
    return F.regexp_replace(F.lower(col(name)), r"\s+", "")


def resolve(available: DataFrame, name: str, wanted: str) -> DataFrame:
    """The best of the available names for a wanted one: equal, equal without spaces and case, as a prefix, inside; then the same without what is in parentheses."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(col(name)), r"\([^)]*\)", ""), r"\s+", "")
    w = F.lit("".join(wanted.lower().split()))
    rule = F.when(col(name) == wanted, 0).when(_plain(name) == w, 1).when(_plain(name).startswith(w), 2).when(_plain(name).contains(w), 3).when(bare == w, 4).when(bare.contains(w), 5)
    return available.withColumn("rule", rule).where("rule is not null").orderBy("rule", F.char_length(name), name).limit(1)


def resolve_columns(columns: Sequence[str], aliases: Mapping[str, Sequence[str]]) -> dict[str, str]:
    """Column names for canonical ones, from lists of aliases; raises KeyError for those that none fits."""
    plain = {"".join(c.lower().split()): c for c in reversed(columns)}
    found = {k: next((plain[a] for a in ("".join(x.lower().split()) for x in (k, *names)) if a in plain), None) for k, names in aliases.items()}
    if missing := [k for k, v in found.items() if v is None]:
        raise KeyError(f"no column for {', '.join(missing)}")
    return found


def ordered(rules: Sequence[tuple[Column, object]], otherwise: object = None) -> Column:
    out = None
    for test, name in rules:
        out = F.when(test, F.lit(name)) if out is None else out.when(test, F.lit(name))
    return out.otherwise(F.lit(otherwise))


def token_rule(text: str | Column, tokens: Sequence[str], otherwise: str = "unknown") -> Column:
    """The first token that stands in the text without letters around it."""
    return ordered([(F.upper(col(text)).rlike(f"(^|[^A-Z]){t.upper()}([^A-Z]|$)"), t) for t in tokens], otherwise)


def deepest_term(df: DataFrame, key: str, path: str, terms: DataFrame, most: int = 10_000) -> DataFrame:
    """(key, term): the longest term in the deepest path segment that holds any. terms (term) is a dimension of at most `most` rows."""
    n = terms.count()
    if n > most:
        raise ValueError(f"{n} terms are more than {most}")
    seg = df.select(key, F.posexplode(F.split(path, "[/\\\\]")).alias("depth", "segment"))
    hit = seg.join(F.broadcast(terms), F.upper("segment").contains(F.upper("term")))
    best = F.max(F.struct("depth", F.char_length("term").alias("size"), "term"))
    return hit.groupBy(key).agg(best.alias("b")).select(key, "b.term")


def missing_required(required: Sequence[str], present: str | Column) -> Column:
    """Required names that an array lacks, comma-joined; empty if none."""
    return F.array_join(F.array_except(F.array(*[F.lit(r) for r in required]), col(present)), ",")


def capabilities(names: str | Column, patterns: Mapping[str, str]) -> dict[str, Column]:
    def any_like(pattern: str) -> Column:
        return F.exists(col(names), lambda x: F.lower(x).rlike(pattern))

    return {k: any_like(p) for k, p in patterns.items()}


def sections(lines: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """(key, section, name, value): blank lines end a section; within it name=value, the first of a name holds."""
    w = Window.partitionBy(key).orderBy(order)
    blank = F.trim(text) == ""
    s = lines.withColumn("section", F.sum(F.when(blank, 1).otherwise(0)).over(w)).where(~blank & F.col(text).contains("="))
    parts = F.split(text, "=", 2)
    s = s.withColumns({"name": F.trim(F.get(parts, 0)), "value": F.trim(F.get(parts, 1))})
    return s.groupBy(key, "section", "name").agg(F.min_by("value", order).alias("value"))


def lookup(df: DataFrame, column: str, dim: DataFrame, name: str, most: int = 100_000) -> DataFrame:
    """df with a column from a dimension (column, name) of at most ``most`` rows; unknown values raise when the rows are computed."""
    n = dim.count()
    if n > most:
        raise ValueError(f"a dimension of {n} rows is larger than {most}")
    j = df.join(F.broadcast(dim.select(column, F.col(name).alias("_found"))), column, "left")
    unknown = F.raise_error(F.concat(F.lit(f"unknown {column}: "), F.coalesce(F.col(column).cast("string"), F.lit("null"))))
    return j.withColumn(name, F.coalesce("_found", unknown.cast("string"))).drop("_found")


def mappings(df: DataFrame, key: str, entries: str, pattern: str) -> DataFrame:
    """(key, name, channel, known): entries of a map column whose name or value fits the pattern; channel is its first group."""
    e = df.select(key, F.explode(entries).alias("name", "value"))
    hit = F.coalesce(F.nullif(F.regexp_extract("name", pattern, 1), F.lit("")), F.nullif(F.regexp_extract("value", pattern, 1), F.lit("")))
    return e.withColumn("channel", hit).where("channel is not null").select(key, "name", "channel", (F.trim("value") != "").alias("known"))


def validity(has_spec: Column, megabytes: Column, channels: Column, least_megabytes: float = 0.1, least_channels: int = 50) -> Column:
    """The first gate that a run fails: no_spec, tiny_txt, few_channels; empty if none. Sizes at a limit fail."""
    return ordered([(~F.coalesce(has_spec, F.lit(False)), "no_spec"), (megabytes <= least_megabytes, "tiny_txt"), (channels <= least_channels, "few_channels")], "")


def contact_outcome(nearest: Column, at_first: Column, contact: float, crush: float, slow: float, near: float) -> Column:
    """How a run ended: stopped at contact (not pressed in, slow at the first contact), passed, near, or clear.

    nearest: smallest distance; at_first: speed at the first contact, null if there was none.
    """
    stopped = at_first.isNotNull() & (F.abs(nearest) <= crush) & (at_first <= slow)
    return F.when(nearest.isNull(), None).when(nearest > near, "clear").when(nearest > contact, "near").when(stopped, "contact_and_stopped").otherwise("passed")


def screen_class(quiet_status: Column, in_window: Column, before: Column, first_active: Column, signature: Column, judged: Column, quiet: float, late: float, light: float) -> Column:
    """Class of a screened event, by what the run's status says and what its command channel does.

    quiet_status: the status says that no command was given; in_window and before: the largest
    command in the event's window and ahead of it; first_active: seconds to the first command; judged: whether the signature is final.
    """
    plain = F.when(~judged & signature.endswith("no_force"), "signature_without_force").otherwise(signature)
    told = F.when(in_window > quiet, "command_against_status").otherwise(plain)
    joined = F.when(first_active > late, "joined_in_window").otherwise("commanded_window")
    touched = F.when(before <= light, "light_touch_before").otherwise("large_pulse_before")
    return F.when(quiet_status, told).when(in_window > quiet, joined).when(before > quiet, touched).otherwise(plain)


def light(text: str | Column) -> Column:
    """night before day, by the word anywhere in the text; empty if neither."""
    t = F.lower(col(text))
    return ordered([(t.contains("night"), "night"), (t.contains("day"), "day")], "")


def mapping_status(label: Column, context: Column, sounds: Sequence[str]) -> Column:
    """What a mapped channel means: by its own label, by its run's context, or not confirmed."""
    return ordered([(F.lower(label).rlike("|".join(sounds)), "by_label"), (context, "by_context")], "unconfirmed")


def varying(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, kinds) of the columns that hold more than one value; null counts as one. One aggregate, no distinct counts."""
    two = [F.struct(F.lit(c).alias("column"), (F.min(F.col(c).cast("string")).eqNullSafe(F.max(F.col(c).cast("string"))) & ((F.count(c) == 0) | (F.count(c) == F.count("*")))).alias("same")) for c in columns]
    return df.agg(F.array(*two).alias("a")).select(F.explode("a").alias("x")).where("not x.same").select("x.column")
