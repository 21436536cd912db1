"""Causal graphs: rules over ordered pairs of events, heuristics that weaken links, metadata.

A rule is a condition over the aliases a and b, and a registry of rules is a list. A rule whose codes must agree names the
keys that its first event reaches and that its second one offers: its pairs are made by an equi join on scope and key.
Rules of the same keys share a join, and a rule without keys is joined on the scope with the events that can be its
second one."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import floor_days


@dataclass(frozen=True)
class Test:
    """condition: of the pair. reach, offers: arrays of keys of an event as the first and as the second of a pair, offers
    being the code alone if it isn't given. second: what the second event must be by itself."""

    condition: Column
    reach: Column | None = None
    offers: Column | None = None
    second: Column | None = None


@dataclass(frozen=True)
class Rule:
    """explanation: a text over the aliases a and b."""

    rule_id: str
    test: Test | Column
    confidence: float
    explanation: Column | None = None
    legal_basis: str | None = None

    @property
    def parts(self) -> Test:
        return self.test if isinstance(self.test, Test) else Test(self.test)


def links(events: DataFrame, scope: list[str], rules: list[Rule], place: str = "pos", more: dict[str, Column] | None = None) -> DataFrame:
    """(scope, event_a, event_b, ts_a, ts_b, code_a, code_b, more, rule_id, confidence, explanation, legal_basis): one row for each
    rule that holds for a before b. more: columns over the aliases a and b."""
    groups: dict[tuple, list[Rule]] = {}
    for r in rules:
        t = r.parts
        keys = (str(t.reach), str(t.offers)) if t.reach is not None else (None, str(t.second))
        groups.setdefault(keys, []).append(r)
    kept = [F.col(f"a.{c}").alias(c) for c in scope] + [F.col(f"{x}.{c}").alias(f"{n}_{x}") for n, c in (("event", "event_id"), ("ts", "ts"), ("code", "code")) for x in "ab"]
    kept += [c.alias(n) for n, c in (more or {}).items()]
    found = None
    for own in groups.values():
        t = own[0].parts
        a, b = events, events
        if t.reach is not None:
            a = events.withColumn("__key", F.explode(F.array_distinct(t.reach)))
            b = events.withColumn("__key", F.explode(F.array_distinct(t.offers)) if t.offers is not None else F.col("code"))
        elif t.second is not None:
            b = events.where(t.second)
        on = F.col(f"a.{place}") < F.col(f"b.{place}")
        for c in [*scope, *(["__key"] if t.reach is not None else [])]:
            on = on & (F.col(f"a.{c}") == F.col(f"b.{c}"))
        made = F.array_compact(F.array(*[F.when(r.parts.condition, _link(r)) for r in own]))
        rows = a.alias("a").join(b.alias("b"), on).select(*kept, F.explode(made).alias("__r")).select("*", "__r.*").drop("__r")
        if t.offers is not None:  # a pair may meet at several keys
            rows = rows.dropDuplicates([*scope, "event_a", "event_b", "rule_id"])
        found = rows if found is None else found.unionByName(rows)
    return found


def _link(rule: Rule) -> Column:
    text = rule.explanation if rule.explanation is not None else F.lit(None)
    return F.struct(F.lit(rule.rule_id).alias("rule_id"), F.lit(rule.confidence).cast("double").alias("confidence"), text.cast("string").alias("explanation"), F.lit(rule.legal_basis).cast("string").alias("legal_basis"))


def once(links_df: DataFrame, scope: list[str]) -> DataFrame:
    """Each link of a rule between two events once, the most confident."""
    w = Window.partitionBy(*scope, "event_a", "event_b", "rule_id").orderBy(F.col("confidence").desc())
    return links_df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def in_order(links_df: DataFrame, scope: list[str], rule_ids: list[str]) -> DataFrame:
    """Links by the date of their first event, then by their events, then in the order of the rules."""
    rank = F.array_position(F.array(*[F.lit(r) for r in rule_ids]), F.col("rule_id"))
    return links_df.orderBy(*scope, F.col("ts_a").asc_nulls_last(), "event_a", "event_b", rank)


def days_apart() -> Column:
    return floor_days(F.col("a.ts"), F.col("b.ts"))


def _own_code() -> Column:
    return F.array("code")


def same_code() -> Test:
    """The same code in a later document."""
    return Test((F.col("a.code") == F.col("b.code")) & (F.col("a.ts") < F.col("b.ts")), _own_code())


def conflict(days: int) -> Test:
    """The same code, too far apart in either order."""
    return Test((F.col("a.code") == F.col("b.code")) & (F.abs(days_apart()) > days), _own_code())


def later_than(days: int, event_type: str) -> Test:
    second = F.col("event_type") == event_type
    return Test(days_apart() > days, second=second)


def confirms(event_type: str) -> Test:
    t = same_code()
    return Test((F.col("b.event_type") == event_type) & t.condition, t.reach)


def next_codes(code: Column, table: list[tuple[str, str]]) -> Column:
    """The codes that may follow a code, by a table of pairs."""
    after: dict[str, list[str]] = {}
    for x, y in table:
        after.setdefault(x, []).append(y)
    known = F.create_map(*[v for x, ys in after.items() for v in (F.lit(x), F.array(*[F.lit(y) for y in ys]))])
    return F.try_element_at(known, code)


def progression(table: list[tuple[str, str]]) -> Test:
    """The codes of a and b are a pair of the table."""
    return Test(F.col("a.ts") < F.col("b.ts"), next_codes(F.col("code"), table))


def presumption(found: DataFrame, table: DataFrame, activity: str, code: str) -> DataFrame:
    """Rows of found whose activity holds the table's fragment and whose code holds its code fragment. The table is a
    dimension of some hundred rows: its distinct code fragments are looked for in the distinct codes, and its activities
    in the distinct activities, so rows are only joined by equality."""
    own = found.withColumn("__activity", F.lower(F.col(activity))).withColumn("__code", F.col(code))
    pairs = [(r[0], r[1]) for r in table.select("activity", "fragment").distinct().collect()]
    codes = own.select("__code").distinct().withColumn("__fragments", held(F.col("__code"), [f for _, f in pairs]))
    acts = own.select("__activity").distinct().withColumn("__reach", reached(F.col("__activity"), pairs))
    both = own.join(acts, "__activity").join(codes, "__code").where(F.arrays_overlap("__reach", "__fragments"))
    return both.select(*found.columns)


def held(text: Column, fragments: list[str]) -> Column:
    """Those of the fragments that a text holds."""
    known = F.array(*[F.lit(f) for f in dict.fromkeys(fragments)]).cast("array<string>")
    return F.filter(known, lambda f: F.contains(text, f))


def reached(activity: Column, pairs: list[tuple[str, str]]) -> Column:
    """The code fragments of those pairs (activity, fragment) whose activity the given one holds."""
    known = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(f).alias("f")) for a, f in pairs]).cast("array<struct<a:string,f:string>>")
    return F.array_distinct(F.transform(F.filter(known, lambda p: F.contains(activity, p["a"])), lambda p: p["f"]))


def conflicting_values(events: DataFrame, by: list[str], value: str) -> DataFrame:
    """Groups with two or more distinct values that aren't blank."""
    clean = F.nullif(F.lower(F.trim(value)), F.lit(""))
    return events.groupBy(*by).agg((F.count_distinct(clean) >= 2).alias("conflicting"))


def gaps(events: DataFrame, by: list[str], ts: str, days: int) -> DataFrame:
    """Groups whose consecutive events lie more than so many days apart somewhere."""
    w = Window.partitionBy(*by).orderBy(ts)
    apart = events.withColumn("__gap", floor_days(F.lag(ts).over(w), F.col(ts)))
    return apart.groupBy(*by).agg(F.max("__gap").alias("max_gap"), F.coalesce(F.max(F.col("__gap") > days), F.lit(False)).alias("has_gap"))


def _mean(column: str) -> Column:
    """Mean to four places of values with two. They are added as whole hundredths, so the sum has no order."""
    hundredths = F.sum(F.floor(F.col(column) * 100 + 0.5).cast("long"))
    return F.floor(hundredths * F.lit(100.0) / F.count(column) + 0.5) / F.lit(10000.0)


def metadata(links_df: DataFrame, by: list[str]) -> DataFrame:
    strength = lambda lo, hi: F.count_if((F.col("confidence") >= lo) & (F.col("confidence") < hi))
    return links_df.groupBy(*by).agg(
        F.count("*").alias("total_links"), _mean("confidence").alias("mean_confidence"), F.count_if(F.col("confidence") == 0.0).alias("n_conflict"),
        strength(0.8, 9.0).alias("n_strong"), strength(0.6, 0.8).alias("n_medium"), F.count_if((F.col("confidence") > 0) & (F.col("confidence") < 0.6)).alias("n_weak"),
    )
