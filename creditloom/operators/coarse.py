"""Coarse classing: merge base classes by weight of evidence and apply the result.

Fitting takes one job for the edges and one for the counts of every feature's
base classes. Counts add up, so all merge steps are decided on them, and the
data is not read again. A feature gives its decisions and the place of each
base class; the classes of every step follow from these in Spark. Which class
belongs to which group is one table, and what a group is called is another.
"""

from __future__ import annotations

import json
import math
from bisect import bisect, insort
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass
from functools import cached_property

from pyspark.ml.feature import OneHotEncoder
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from creditloom import constants as K
from creditloom.functions import names as N
from creditloom.functions import scalars as S
from creditloom.operators import binning as B
from creditloom.operators import prefix as R
from creditloom.operators import woe as W
from creditloom.session import cut_lineage, lookup_join


@dataclass(frozen=True)
class FeatureSpec:
    """How one feature is classed and merged."""

    name: str
    kind: str = "discrete"  # or "continuous"
    bins: int = 50
    monotonic: bool = False
    min_obs: float = K.MIN_SHARE_OBS
    min_good: float = K.MIN_SHARE_GOOD
    min_bad: float = K.MIN_SHARE_BAD
    min_woe: float = K.MIN_WOE_STEP
    min_rate: float = K.MIN_GOOD_RATE_STEP
    max_merges: int = K.MAX_MERGES

    def __post_init__(self):
        if self.kind not in ("discrete", "continuous"):
            raise ValueError(f"{self.name}: kind must be 'discrete' or 'continuous'")


def default_specs(df: DataFrame) -> tuple[list[FeatureSpec], dict[str, str], list[str]]:
    """Specs of the default-probability features found in ``df``.

    Also gives business name → column used, and the names without a column.
    """
    specs, mapping, absent = [], {}, []
    for name in [*K.DISCRETE_FEATURES, *K.CONTINUOUS_FEATURES]:
        column = next((c for c in K.COLUMN_ALIASES.get(name, [name]) if c in df.columns), None)
        if column is None:
            absent.append(name)
            continue
        mapping[name] = column
        if name in K.CONTINUOUS_FEATURES:
            bins, monotonic = K.CONTINUOUS_FEATURES[name]
            specs.append(FeatureSpec(column, "continuous", bins, monotonic))
        else:
            specs.append(FeatureSpec(column))
    return specs, mapping, absent


# --- merge decisions on counts ---------------------------------------------------------

# A base class with its place (``bin`` set), or the decision taken at a step.
PLAN_SCHEMA = "feature string, bin string, at int, merge_left int, merge_right int, reason string"
# Features of up to so many classes are decided on the driver, from their counts alone; wider ones stay tables.
DRIVER_CLASSES = 1_000

SMALL, CLOSE, BROKEN = "small class", "neighbours too similar", "monotonic order broken"
Decision = tuple[int | None, int | None, str]


@dataclass(frozen=True)
class Totals:
    n: int
    good: int


@dataclass
class Group:
    """Merged base classes: their numbers of loans, names, and the least of their places."""

    id: int
    n: int
    good: int
    members: list[str]
    totals: Totals

    def __post_init__(self):
        t = self.totals
        self.share = self.n / (t.n or 1)
        self.share_good = self.good / (t.good or 1)
        self.share_bad = (self.n - self.good) / ((t.n - t.good) or 1)
        self.rate = self.good / self.n
        # Groups are ordered by this ratio, whose logarithm is the weight of evidence.
        self.ratio = (self.share_good + K.WOE_EPSILON) / (self.share_bad + K.WOE_EPSILON)
        self.woe = math.log(self.ratio)
        self.label = " | ".join(self.members)

    @property
    def key(self) -> tuple[float, str]:
        return self.ratio, self.label

    def is_small(self, spec: FeatureSpec) -> bool:
        return self.share < spec.min_obs or self.share_good < spec.min_good or self.share_bad < spec.min_bad

    def smallness(self) -> tuple:
        return self.n, min(self.share_good, self.share_bad), -abs(self.woe)

    def is_close(self, other: Group, spec: FeatureSpec) -> bool:
        return abs(self.woe - other.woe) < spec.min_woe or abs(self.rate - other.rate) < spec.min_rate

    def merged(self, other: Group) -> Group:
        return Group(min(self.id, other.id), self.n + other.n, self.good + other.good,
                     sorted(self.members + other.members), self.totals)


def next_merge(groups: Sequence[Group], spec: FeatureSpec) -> tuple[int, int, str] | None:
    """Positions to merge next in an ordered list of groups, or None.

    Order of the rules: smallest unstable class to its nearest neighbour, then
    the closest pair, then the first break of a wanted monotonic order.
    """
    if len(groups) < 2:
        return None
    small = [i for i, g in enumerate(groups) if g.is_small(spec)]
    if small:
        at = min(small, key=lambda i: (groups[i].smallness(), i))
        sides = [i for i in (at - 1, at + 1) if 0 <= i < len(groups)]
        other = min(sides, key=lambda i: abs(groups[at].woe - groups[i].woe))
        return min(at, other), max(at, other), SMALL
    pairs = range(1, len(groups))
    close = [i for i in pairs if groups[i - 1].is_close(groups[i], spec)]
    if close:
        at = min(close, key=lambda i: (abs(groups[i].woe - groups[i - 1].woe), i))
        return at - 1, at, CLOSE
    if spec.monotonic and spec.kind == "continuous" and len(groups) >= 3:
        rising = groups[-1].woe >= groups[0].woe
        for i in pairs:
            step = groups[i].woe - groups[i - 1].woe
            if (step < 0) if rising else (step > 0):
                return i - 1, i, BROKEN
    return None


class Numbers:
    """Running numbers of groups: a merge gives the right group the left one's, and later groups move down by one."""

    def __init__(self) -> None:
        self.gone: list[int] = []

    def merge(self, a: Group, b: Group) -> tuple[int, int]:
        left, right = sorted((a.id, b.id))
        pair = left - bisect(self.gone, left), right - bisect(self.gone, right)
        insort(self.gone, right)
        return pair


def done(step: int, spec: FeatureSpec) -> Decision:
    """The last decision, which merges nothing."""
    return None, None, "nothing to merge" if step < spec.max_merges else "merge limit reached"


def merge_decisions(counts: Sequence[tuple[str, int, int]], spec: FeatureSpec) -> list[Decision]:
    """``(left group, right group, reason)`` of each merge step of one feature.

    ``counts`` has ``(bin, n_obs, n_good)`` of the classes seen in training, in base order.
    """
    totals = Totals(sum(n for _, n, _ in counts), sum(g for _, _, g in counts))
    groups = [Group(i, n, good, [b], totals) for i, (b, n, good) in enumerate(counts)]
    numbers, decisions = Numbers(), []
    for step in range(spec.max_merges + 1):
        if spec.kind == "discrete":
            groups.sort(key=lambda g: g.key)
        choice = next_merge(groups, spec) if step < spec.max_merges else None
        if choice is None:
            return [*decisions, done(step, spec)]
        left, right, reason = choice
        decisions.append((*numbers.merge(groups[left], groups[right]), reason))
        groups[left] = groups[left].merged(groups.pop(right))
    raise AssertionError("the last step merges nothing")


def base_order(counts: Sequence[tuple[str, int, int]], kind: str, missing: str) -> list[tuple[str, int, int]]:
    if kind == "discrete":
        return sorted(counts)
    return sorted(counts, key=lambda c: math.inf if c[0] == missing else int(c[0]))


class WideFeature:
    """Merge steps of a feature with very many classes, which stay a table ordered by weight of evidence.

    At most ``max_merges`` merges can touch a few classes each. The smallest
    unstable classes and the closest neighbours are therefore taken from the
    table once, enough of them for all steps; after that a step reads single
    rows by their place: the neighbours of a class, and where a merged group
    belongs. The driver holds these rows and the merged groups, however
    many classes there are.
    """

    def __init__(self, classes: DataFrame, spec: FeatureSpec, totals: Totals) -> None:
        self.spec, self.totals = spec, totals
        self.table = classes.where(F.col("feature") == spec.name)
        self.rows: dict[int, Group] = {}
        self.touched: set[int] = set()
        self.merged: dict[int, tuple[Group, int]] = {}  # by id: the group, and the last place before it
        self.last = self.table.agg(F.max("pos")).first()[0]
        limit = spec.max_merges
        small = self.table.where("small").orderBy("n_obs", "rare", F.desc(F.abs("woe")), "pos").limit(2 * limit + 1)
        close = self.table.where("close").orderBy("step", "pos").limit(5 * limit + 1)
        self.small = [self._keep(r) for r in small.collect()]
        self.close = [self._keep(r) for r in close.collect()]
        near = {p + d for p in [*self.small, *self.close] for d in (-2, -1, 1, 2)}
        self._fetch(near)

    def _keep(self, row: Row) -> int:
        self.rows[row["pos"]] = Group(row["at"], row["n_obs"], row["n_good"], [row["bin"]], self.totals)
        return row["pos"]

    def _fetch(self, places: set[int]) -> None:
        missing = [p for p in places if 0 <= p <= self.last and p not in self.rows]
        if missing:
            for row in self.table.where(F.col("pos").isin(missing)).collect():
                self._keep(row)

    def _untouched(self, place: int, step: int) -> int | None:
        """Nearest place from ``place`` on that no merge has touched."""
        while 0 <= place <= self.last:
            if place not in self.touched:
                return place
            place += step
        return None

    def _between(self, low: int | None, high: int | None) -> list[Group]:
        """The untouched classes at two places and the merged groups between them, in order."""
        self._fetch({p for p in (low, high) if p is not None})
        ends = [self.rows[p] for p in (low, high) if p is not None]
        inside = [g for g, before in self.merged.values()
                  if (low is None or before >= low) and (high is None or before < high)]
        return sorted([*ends, *inside], key=lambda g: g.key)

    def _around(self, before: int) -> list[Group]:
        """Consecutive groups between the untouched classes at or below ``before`` and above it."""
        return self._between(self._untouched(before, -1), self._untouched(before + 1, 1))

    def _smallest(self) -> tuple[Group, list[Group]] | None:
        """The smallest unstable group, and the groups around it."""
        untouched = next((p for p in self.small if p not in self.touched), None)
        found = [(g.smallness(), g.key, g, before) for g, before in self.merged.values() if g.is_small(self.spec)]
        if untouched is not None:
            g = self.rows[untouched]
            found.append((g.smallness(), g.key, g, None))
        if not found:
            return None
        *_, group, before = min(found, key=lambda f: f[:2])
        if before is not None:
            return group, self._around(before)
        low, high = self._untouched(untouched - 1, -1), self._untouched(untouched + 1, 1)
        return group, sorted({g.id: g for g in [*self._between(low, untouched), *self._between(untouched, high)]}.values(), key=lambda g: g.key)

    def _choice(self) -> tuple[Group, Group, str] | None:
        if self.last + 1 - len(self.touched) + len(self.merged) < 2:
            return None
        smallest = self._smallest()
        if smallest:
            group, chain = smallest
            at = next(i for i, g in enumerate(chain) if g.id == group.id)
            sides = [chain[i] for i in (at - 1, at + 1) if 0 <= i < len(chain)]
            return group, min(sides, key=lambda g: abs(group.woe - g.woe)), SMALL
        befores = {before for _, before in self.merged.values()}
        pairs = [(self.rows[p - 1], self.rows[p]) for p in self.close
                 if p not in self.touched and p - 1 not in self.touched and p - 1 not in befores]
        pairs = pairs[:1]  # the closest of those that no merge has changed
        for before in befores | self.touched:
            chain = self._around(before)
            pairs += [(a, b) for a, b in zip(chain, chain[1:]) if a.is_close(b, self.spec)]
        if not pairs:
            return None
        return *min(pairs, key=lambda p: (abs(p[1].woe - p[0].woe), p[1].key)), CLOSE

    def _take(self, group: Group) -> None:
        if group.id in self.merged:
            del self.merged[group.id]
        else:
            self.touched.add(next(p for p, g in self.rows.items() if g is group))

    def decisions(self) -> list[Decision]:
        numbers, decisions = Numbers(), []
        for step in range(self.spec.max_merges + 1):
            choice = self._choice() if step < self.spec.max_merges else None
            if choice is None:
                return [*decisions, done(step, self.spec)]
            a, b, reason = choice
            decisions.append((*numbers.merge(a, b), reason))
            self._take(a)
            self._take(b)
            group = a.merged(b)
            below = (F.col("ratio") < group.ratio) | ((F.col("ratio") == group.ratio) & (F.col("bin") < group.label))
            before = self.table.where(below).agg(F.max("pos")).first()[0]
            self.merged[group.id] = group, -1 if before is None else before
        raise AssertionError("the last step merges nothing")


def ordered_classes(counts: DataFrame, specs: Sequence[FeatureSpec]) -> DataFrame:
    """Classes of discrete features with their places by name (``at``) and by weight of evidence (``pos``), and rule flags.

    Places come from a range partitioning, so that no task holds a whole
    feature; flags of neighbours look over the edges of the tasks.
    """
    spark = counts.sparkSession
    totals = counts.groupBy("feature").agg(F.sum("n_obs").alias("_n"), F.sum("n_good").alias("_good"))
    limits = spark.createDataFrame(
        [(s.name, s.min_obs, s.min_good, s.min_bad, s.min_woe, s.min_rate) for s in specs],
        "feature string, min_obs double, min_good double, min_bad double, min_woe double, min_rate double")
    facts = totals.join(limits, "feature")  # one row per feature

    def share(part: Column, whole: Column) -> Column:
        return part / F.greatest(whole, F.lit(1))

    good = share(F.col("n_good"), F.col("_good"))
    bad = share(F.col("n_obs") - F.col("n_good"), F.col("_n") - F.col("_good"))
    rows = R.numbered(counts, ["bin"], keys=["feature"], name="at").join(F.broadcast(facts), "feature").select(
        "feature", "bin", "n_obs", "n_good", F.col("at").cast("int").alias("at"), "min_woe", "min_rate",
        ((good + K.WOE_EPSILON) / (bad + K.WOE_EPSILON)).alias("ratio"), F.least(good, bad).alias("rare"),
        ((share(F.col("n_obs"), F.col("_n")) < F.col("min_obs")) | (good < F.col("min_good")) | (bad < F.col("min_bad"))).alias("small"),
    ).withColumn("woe", F.ln("ratio"))
    placed = R.numbered(rows, ["ratio", "bin"], keys=["feature"], name="pos", previous=["woe", "n_obs", "n_good"])
    step = F.abs(F.col("woe") - F.col("previous_woe"))
    turn = F.abs(F.col("n_good") / F.col("n_obs") - F.col("previous_n_good") / F.col("previous_n_obs"))
    return placed.select(
        "feature", "bin", "n_obs", "n_good", "at", "pos", "ratio", "rare", "woe", "small", step.alias("step"),
        F.coalesce((step < F.col("min_woe")) | (turn < F.col("min_rate")), F.lit(False)).alias("close"))


def plan_merges(counts: DataFrame, specs: Sequence[FeatureSpec], missing: str = K.MISSING, *,
                driver_classes: int = DRIVER_CLASSES) -> DataFrame:
    """Places of the base classes and merge decisions of all features.

    The classes of a feature come to the driver if they are few, as those of
    numbers always are; of a wider feature only what its merges touch does.
    """
    spark = counts.sparkSession
    sizes = {r["feature"]: r for r in counts.groupBy("feature").agg(
        F.count(F.lit(1)).alias("classes"), F.sum("n_obs").alias("n"), F.sum("n_good").alias("good")).collect()}
    present = [s for s in specs if s.name in sizes]
    wide = [s for s in present if s.kind == "discrete" and sizes[s.name]["classes"] > driver_classes]
    narrow = [s for s in present if s not in wide]
    found: dict[str, list[tuple[str, int, int]]] = {s.name: [] for s in narrow}
    for row in counts.where(F.col("feature").isin(list(found))).collect():
        found[row["feature"]].append((row["bin"], row["n_obs"], row["n_good"]))
    rows: list[tuple] = []
    for spec in narrow:
        ordered = base_order(found[spec.name], spec.kind, missing)
        rows += [(spec.name, None, step, *made) for step, made in enumerate(merge_decisions(ordered, spec))]
        rows += [(spec.name, b, at, None, None, None) for at, (b, *_) in enumerate(ordered)]
    if not wide:
        return spark.createDataFrame(rows, PLAN_SCHEMA)
    classes = cut_lineage(ordered_classes(counts.where(F.col("feature").isin([s.name for s in wide])), wide), "ordered-classes")
    for spec in wide:
        size = sizes[spec.name]
        steps = WideFeature(classes, spec, Totals(size["n"], size["good"])).decisions()
        rows += [(spec.name, None, step, *made) for step, made in enumerate(steps)]
    nothing = F.lit(None)
    places = classes.select("feature", "bin", "at", nothing.cast("int").alias("merge_left"), nothing.cast("int").alias("merge_right"),
                            nothing.cast("string").alias("reason"))
    return places.union(spark.createDataFrame(rows, PLAN_SCHEMA))


def merge_steps(plan: DataFrame, last_only: bool = False) -> DataFrame:
    """``(feature, step, bin, grp, merge_left, merge_right, reason)`` of every merge step, or of the last."""
    # At most ``max_merges`` + 1 decisions and one row per feature.
    decisions = plan.where("bin IS NULL").groupBy("feature").agg(
        F.sort_array(F.collect_list(F.struct("at", "merge_left", "merge_right", "reason"))).alias("_made"))
    last = F.size("_made") - 1
    step = last if last_only else F.explode(F.sequence(F.lit(0), last))
    rows = plan.where("bin IS NOT NULL").select("feature", "bin", "at").join(decisions, "feature").withColumn("step", step)
    grp = F.aggregate(
        F.slice("_made", F.lit(1), F.col("step")), F.col("at"),
        lambda g, m: F.when(g == m["merge_right"], m["merge_left"]).when(g > m["merge_right"], g - 1).otherwise(g))
    made = F.get("_made", F.col("step"))
    return rows.select("feature", "step", "bin", grp.alias("grp"), made["merge_left"].alias("merge_left"),
                       made["merge_right"].alias("merge_right"), made["reason"].alias("reason"))


# --- fitted classing -----------------------------------------------------------------------

@dataclass
class Classing:
    """Fitted coarse classes of a set of features.

    ``members`` (feature, bin, grp), ``named`` (feature, grp, label, woe),
    ``counts`` and ``plan`` are tables in the shared folder. The driver holds
    what the specifications bound: edges and groups of numeric bins, and one
    fallback per text feature.
    """

    specs: list[FeatureSpec]
    edges: dict[str, list[float]]
    members: DataFrame
    named: DataFrame
    counts: DataFrame | None = None
    plan: DataFrame | None = None
    missing: str = K.MISSING

    @property
    def features(self) -> list[str]:
        return [s.name for s in self.specs]

    @property
    def groups(self) -> DataFrame:
        """``(feature, bin, grp, label, woe)``: each base class with its group's name, which is as long as its classes."""
        return self.members.join(self.named, ["feature", "grp"]).select("feature", "bin", "grp", "label", "woe")

    @cached_property
    def _numeric(self) -> dict[str, list]:
        found: dict[str, list] = {f: [] for f in self.edges}
        for row in self.groups.where(F.col("feature").isin(list(self.edges))).collect():
            found[row["feature"]].append(row)
        return found

    @cached_property
    def _spare(self) -> dict[str, Row]:
        """Class that an unseen text takes: that of NULLs, else the smallest known."""
        order = F.struct(F.col("bin") != self.missing, "bin")
        first = self.members.where(~F.col("feature").isin(list(self.edges))).groupBy("feature").agg(
            F.min_by("grp", order).alias("grp"))
        rows = self.named.join(F.broadcast(first), ["feature", "grp"])  # one row per feature
        return {r["feature"]: r for r in rows.collect()}

    @cached_property
    def _lookup_bytes(self) -> dict[str, tuple[int, int]]:
        """Bytes of each feature's base classes, and of its group names, as ``measured_bytes`` counts them."""
        classes = self.members.groupBy("feature").agg(F.sum(F.octet_length("bin") + 80).alias("classes"))
        names = self.named.groupBy("feature").agg(F.sum(F.octet_length("label") + 64).alias("names"))
        return {r["feature"]: (r["classes"], r["names"]) for r in classes.join(names, "feature").collect()}

    @cached_property
    def group_numbers(self) -> dict[str, int]:
        """Number of the groups of each feature that training saw; they are numbered from 0."""
        seen = self.named.where("woe IS NOT NULL").groupBy("feature").agg(F.max("grp").alias("last")).collect()
        return {f: 0 for f in self.features} | {r["feature"]: r["last"] + 1 for r in seen}

    @cached_property
    def _labels(self) -> dict[str, list[tuple[int, str]]]:
        """``(group, label)`` of the groups seen in training: one per indicator column."""
        found: dict[str, list[tuple[int, str]]] = {f: [] for f in self.features}
        seen = self.named.where("woe IS NOT NULL")
        for row in seen.orderBy("feature", "grp").collect():
            found[row["feature"]].append((row["grp"], row["label"]))
        return found

    def of(self, feature: str) -> list:
        """Rows ``(feature, bin, grp, label, woe)`` of a numeric feature's bins."""
        return self._numeric[feature]

    def labels(self, feature: str) -> list[str]:
        """Final group labels seen in training, in group order."""
        return [label for _, label in self._labels[feature]]

    def group_counts(self, all_steps: bool = False) -> DataFrame:
        """Counts per group, at the end or at every merge step."""
        return (
            merge_steps(self.plan, not all_steps).join(self.counts, ["feature", "bin"])
            .groupBy("feature", "step", "grp", "merge_left", "merge_right", "reason")
            # A group has at most ``max_merges`` + 1 base classes.
            .agg(F.sum("n_obs").alias("n_obs"), F.sum("n_good").alias("n_good"),
                 F.sort_array(F.collect_list("bin")).alias("members"))
        )

    def report(self) -> DataFrame:
        """Final WoE/IV report of all features in one table."""
        names = self.named.select("feature", "grp", F.col("label").alias("bin"))
        return self._ordered_report(self.group_counts().join(names, ["feature", "grp"]), ("feature",))

    def history(self) -> DataFrame:
        """WoE/IV report at every merge step, with what was merged and why."""
        grouped = self.group_counts(all_steps=True).withColumn("bin", F.array_join("members", " | "))
        tables = self._ordered_report(grouped, ("feature", "step"))
        decisions = grouped.select(
            "feature", "step", "bin", "grp",
            F.coalesce((F.col("grp") == F.col("merge_left")) | (F.col("grp") == F.col("merge_right")),
                       F.lit(False)).alias("merged_next"), "reason")
        return tables.join(decisions, ["feature", "step", "bin"])

    def comparison(self) -> DataFrame:
        """Report before the first merge and after the last, stacked."""
        history = self.history()
        last = self.plan.where("bin IS NULL").groupBy("feature").agg(F.max("at").alias("last"))
        return history.join(F.broadcast(last), "feature").where(  # one row per feature
            (F.col("step") == 0) | (F.col("step") == F.col("last"))
        ).withColumn("stage", F.when(F.col("step") == F.col("last"), "final").otherwise("initial")).drop("last")

    def _ordered_report(self, grouped: DataFrame, keys: tuple) -> DataFrame:
        continuous = [s.name for s in self.specs if s.kind == "continuous"]
        # Continuous features keep their group order, discrete ones go by WoE.
        order = F.when(F.col("feature").isin(continuous), F.col("grp")).otherwise(0)
        return W.woe_table(grouped.withColumn("_order", order), keys=keys, order_by="_order")

    # --- application -------------------------------------------------------------------

    def group_edges(self, feature: str) -> list[float]:
        """Edges of the merged groups of a continuous feature."""
        grp_of = {r["bin"]: r["grp"] for r in self.of(feature)}
        edges = self.edges[feature]
        inner = [edges[i] for i in range(1, len(edges) - 1) if grp_of.get(str(i)) != grp_of.get(str(i - 1))]
        return [edges[0], *inner, edges[-1]]

    def _with_groups(self, df: DataFrame, labels: bool = True) -> DataFrame:
        """Adds number, WoE and label (unless left out) of every feature's final group: ``<feature>__g``, ``__w``, ``__l``.

        Numbers are cut at the merged edges, so a group is found by binary
        search. Texts are joined to their classes, and these to the names: each
        table is broadcast below a limit on its measured bytes, and beyond it
        joined with salts, so that a class that many rows share is split.
        """
        cuts = {}
        for f in self.edges:
            merged = self.group_edges(f) if f in df.columns else []
            # A single group needs no cut; the stage wants at least one.
            if merged:
                cuts[f] = merged if len(merged) > 2 else [merged[0], 0.0, merged[-1]]
        placed = B.with_bin_ids(df, cuts, "__cut") if cuts else df
        columns: dict[str, Column] = {}
        plain = ("string", "tinyint", "smallint", "int", "bigint", "float", "double", "boolean", "date", "timestamp")
        salt = F.struct(*[F.col(f"`{n}`") for n, kind in df.dtypes if kind in plain or kind.startswith("decimal")])
        for feature in [f for f in self.features if f in df.columns]:
            if feature in self.edges:
                rows = {r["bin"]: r["grp"] for r in self.of(feature)}
                grp_by_cut = [rows.get(str(i), 0) for i in self._first_bins(feature)]
                if len(cuts[feature]) > len(grp_by_cut) + 1:
                    grp_by_cut *= 2
                number = F.get(F.array(*[F.lit(g) for g in grp_by_cut]), F.col(f"{feature}__cut"))
                number = F.coalesce(number, F.lit(rows[self.missing]))
                columns |= {f"{feature}__g": number, f"{feature}__l": self._by_group(feature, "label", number),
                            f"{feature}__w": self._by_group(feature, "woe", number)}
                continue
            spare, (class_bytes, name_bytes) = self._spare[feature], self._lookup_bytes[feature]
            base, number = f"{feature}__base", f"{feature}__known"
            known = self.members.where(F.col("feature") == feature).join(
                self.named.where(F.col("feature") == feature).select("grp", "woe"), "grp").select(
                F.col("bin").alias(base), F.col("grp").alias(number), F.col("woe").alias(f"{feature}__known_woe"), F.lit(True).alias(f"{feature}__seen"))
            placed = lookup_join(placed.withColumn(base, S.base_class(feature, self.missing)), known, base, salt_by=salt, size=class_bytes)
            columns[f"{feature}__g"] = F.coalesce(number, F.lit(spare["grp"]))
            columns[f"{feature}__w"] = F.when(F.col(f"{feature}__seen"), F.col(f"{feature}__known_woe")).otherwise(F.lit(spare["woe"]))
            if labels:
                names = self.named.where(F.col("feature") == feature).select(
                    F.col("grp").alias(number), F.col("label").alias(f"{feature}__known_label"))
                placed = lookup_join(placed, names, number, salt_by=salt, size=name_bytes)
                columns[f"{feature}__l"] = F.coalesce(f"{feature}__known_label", F.lit(spare["label"]))
        return placed.select(*df.columns, *[c.alias(n) for n, c in columns.items()])

    def _first_bins(self, feature: str) -> list[int]:
        """First base bin of each merged group, in order."""
        edges, merged = self.edges[feature], self.group_edges(feature)
        return [edges.index(e) for e in merged[:-1]]

    def _by_group(self, feature: str, field_: str, number: Column) -> Column:
        """``field_`` of a numeric feature's group as a lookup by group number."""
        values = {r["grp"]: r[field_] for r in self.of(feature)}
        kind = "double" if field_ == "woe" else "string"
        return F.get(F.array(*[F.lit(values.get(g)).cast(kind) for g in range(max(values) + 1)]), number)

    def transform(self, df: DataFrame, output: str = "both") -> DataFrame:
        """Adds ``<feature>_grp`` and/or ``<feature>_woe`` for every fitted feature.

        An unseen category takes the class of NULLs if training had one, else
        the smallest known class.
        """
        if output not in ("group", "woe", "both"):
            raise ValueError("output must be 'group', 'woe' or 'both'")
        columns: list[Column] = []
        for feature in [f for f in self.features if f in df.columns]:
            if output != "woe":
                columns.append(F.col(f"{feature}__l").alias(f"{feature}_grp"))
            if output != "group":
                columns.append(F.col(f"{feature}__w").alias(f"{feature}_woe"))
        return self._with_groups(df, output != "woe").select(*df.columns, *columns)

    def indicator_names(self) -> dict[str, list[tuple[str, str]]]:
        """Per feature the (column name, group label) of its indicators."""
        pairs = [(f, label) for f in self.features for label in self.labels(f)]
        unique = N.unique_names([f"{f}_{N.indicator_suffix(label)}" for f, label in pairs])
        named: dict[str, list[tuple[str, str]]] = {}
        for (f, label), column in zip(pairs, unique):
            named.setdefault(f, []).append((column, label))
        return named

    def indicators(self, df: DataFrame, keep: Sequence[str] = ("id", "good_bad")) -> DataFrame:
        """One 0/1 column per final group, the same for any frame."""
        flags = []
        for feature, pairs in self.indicator_names().items():
            if feature in df.columns:
                flags += [
                    F.when(F.col(f"{feature}__g") == g, 1).otherwise(0).alias(column)
                    for (g, _), (column, _) in zip(self._labels[feature], pairs)
                ]
        return self._with_groups(df, labels=False).select(*keep, *flags)

    def indicator_vectors(self, df: DataFrame, keep: Sequence[str] = ("id", "good_bad"), suffix: str = "_ind") -> DataFrame:
        """One sparse vector ``<feature>_ind`` per feature, with a 1 at the place of the row's final group.

        Vectors are as long as training has groups; a row of a class that
        training did not see, and that takes no other class, has none set. No
        name and no label is needed, so a feature may have any number of groups.
        """
        features = [f for f in self.features if f in df.columns and self.group_numbers[f]]
        sizes = [self.group_numbers[f] for f in features]
        placed = self._with_groups(df, labels=False).select(
            *keep, *[F.least(F.col(f"{f}__g"), F.lit(n)).cast("double").alias(f"{f}__place") for f, n in zip(features, sizes)])
        encoder = OneHotEncoder(inputCols=[f"{f}__place" for f in features], outputCols=[f"{f}{suffix}" for f in features], dropLast=True)
        # The last place stands for no group; it is the one that the encoder leaves out.
        widest = df.sparkSession.createDataFrame([tuple(map(float, sizes))], ", ".join(f"`{f}__place` double" for f in features))
        return encoder.fit(widest).transform(placed).select(*keep, *[f"{f}{suffix}" for f in features])

    def indicator_table(self) -> DataFrame:
        """``(feature, grp, label, name)`` of every place of the indicator vectors, as a table."""
        name = F.concat(F.col("feature"), F.lit("_"), N.indicator_suffix_col(F.col("label")))
        return self.named.where("woe IS NOT NULL").select("feature", "grp", "label", name.alias("name"))

    # --- storage -----------------------------------------------------------------------

    def save(self, spark: SparkSession, path: str, style: str = "half_open") -> None:
        """Writes ``bins``, ``members``, ``groups`` (their names) and ``specs`` tables below ``path``."""
        B.bins_frame(spark, self.edges, style).write.mode("overwrite").parquet(f"{path}/bins")
        self.members.write.mode("overwrite").parquet(f"{path}/members")
        self.named.write.mode("overwrite").parquet(f"{path}/groups")
        specs = [(i, json.dumps(asdict(s))) for i, s in enumerate(self.specs)]
        spark.createDataFrame(specs, "position int, spec string").coalesce(1).write.mode(
            "overwrite").parquet(f"{path}/specs")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "Classing":
        edges: dict[str, list[float]] = {}
        for row in spark.read.parquet(f"{path}/bins").orderBy("feature", "bin_id").collect():
            edges.setdefault(row["feature"], [row["lo"]]).append(row["hi"])
        members, named = spark.read.parquet(f"{path}/members"), spark.read.parquet(f"{path}/groups")
        specs = spark.read.parquet(f"{path}/specs").orderBy("position").collect()
        return Classing([FeatureSpec(**json.loads(r["spec"])) for r in specs], edges, members, named)


def group_label(members: Sequence[str], spec: FeatureSpec, edges: Sequence[float] | None,
                missing: str = K.MISSING, style: str = "half_open") -> str:
    """Name of a merged group: the hull of its intervals, or its classes joined."""
    if spec.kind == "discrete":
        return " | ".join(members)
    numbers = sorted(int(m) for m in members if m != missing)
    parts = []
    if numbers:
        parts.append(B.interval_label(edges[numbers[0]], edges[numbers[-1] + 1], style))
    if len(numbers) < len(members):
        parts.append(missing)
    return " | ".join(parts)


MEMBERS = "feature string, bin string, grp int"
NAMED = "feature string, grp int, label string, woe double"


def _numeric_groups(final: list[tuple[str, int, int, int]], spec: FeatureSpec, edges: Sequence[float], missing: str,
                    style: str) -> tuple[list[tuple], list[tuple]]:
    """Members and names of a numeric feature's groups from ``(bin, grp, n_obs, n_good)``.

    Bins empty in training join the left one; NULLs that training lacks are a group without a weight.
    """
    grp_of = {b: g for b, g, _, _ in final}
    totals = Totals(sum(n for *_, n, _ in final), sum(good for *_, good in final))
    woe = {}
    for g in set(grp_of.values()):
        n, good = (sum(row[k] for row in final if row[1] == g) for k in (2, 3))
        woe[g] = Group(g, n, good, [], totals).woe
    seen = sorted(int(b) for b in grp_of if b != missing)
    if seen:
        for i in range(len(edges) - 1):
            grp_of.setdefault(str(i), grp_of[str(max((s for s in seen if s < i), default=seen[0]))])
    if missing not in grp_of:
        grp_of[missing] = max(woe, default=-1) + 1
    bins: dict[int, list[str]] = {}
    for b, g in grp_of.items():
        bins.setdefault(g, []).append(b)
    return ([(spec.name, b, g) for b, g in grp_of.items()],
            [(spec.name, g, group_label(m, spec, edges, missing, style), woe.get(g)) for g, m in bins.items()])


def name_groups(final: DataFrame, specs: Sequence[FeatureSpec], edges: Mapping[str, Sequence[float]], missing: str,
                style: str) -> tuple[DataFrame, DataFrame]:
    """Tables of members and names of the final groups in ``final(feature, bin, grp, n_obs, n_good)``.

    A text group is named by its classes, once; numeric groups are as few as their edges.
    """
    spark = final.sparkSession
    numeric = {s.name: s for s in specs if s.kind == "continuous"}
    rows: dict[str, list[tuple]] = {f: [] for f in numeric}
    is_numeric = F.col("feature").isin(list(numeric))
    for r in final.where(is_numeric).collect():
        rows[r["feature"]].append((r["bin"], r["grp"], r["n_obs"], r["n_good"]))
    members, named = [], []
    for feature, spec in numeric.items():
        for to, found in zip((members, named), _numeric_groups(rows[feature], spec, edges[feature], missing, style)):
            to += found
    texts = final.where(~is_numeric)
    totals = texts.groupBy("feature").agg(F.sum("n_obs").alias("_n"), F.sum("n_good").alias("_good"))
    # A group has at most ``max_merges`` + 1 base classes.
    grouped = texts.groupBy("feature", "grp").agg(
        F.sum("n_obs").alias("n"), F.sum("n_good").alias("good"), F.array_join(F.sort_array(F.collect_list("bin")), " | ").alias("label"))
    good = F.col("good") / F.greatest("_good", F.lit(1))
    bad = (F.col("n") - F.col("good")) / F.greatest(F.col("_n") - F.col("_good"), F.lit(1))
    weighed = grouped.join(F.broadcast(totals), "feature").select(  # one row per feature
        "feature", "grp", "label", F.ln((good + K.WOE_EPSILON) / (bad + K.WOE_EPSILON)).alias("woe"))
    return (texts.select("feature", "bin", "grp").union(spark.createDataFrame(members, MEMBERS)),
            weighed.union(spark.createDataFrame(named, NAMED)))


def fit_classing(train: DataFrame, specs: Sequence[FeatureSpec], target: str = "good_bad", *,
                 good_value=1, exact_edges: bool = False, edges: Mapping[str, Sequence[float]] | None = None,
                 missing: str = K.MISSING, label_style: str = "half_open", driver_classes: int = DRIVER_CLASSES) -> Classing:
    """Fit bins, merges and weights of all features.

    Given ``edges`` replace the quantile edges of their features. The needed
    columns are written once to the shared folder, for edges and counts to read;
    then the counts, so neither the merge steps nor any report reads rows again.
    """
    for name in [*[s.name for s in specs], target]:
        if name not in train.columns:
            raise ValueError(f"column {name!r} is not in the training frame")
    train = cut_lineage(train.select(*{s.name: 0 for s in specs} | {target: 0}), "classing-rows")
    edges = {f: list(e) for f, e in (edges or {}).items()}
    to_cut = {s.name: s.bins for s in specs if s.kind == "continuous" and s.name not in edges}
    if to_cut:
        edges.update(B.numeric_edges(train, to_cut, exact=exact_edges))
    discrete = [s.name for s in specs if s.kind == "discrete"]
    classes = B.base_classes(train, discrete, edges, keep=[target], missing=missing)
    counted = W.class_counts(classes, {s.name: s.name for s in specs}, target, good_value)
    counts = cut_lineage(counted, "class-counts")
    plan = cut_lineage(plan_merges(counts, specs, missing, driver_classes=driver_classes), "merge-plan")
    final = merge_steps(plan, last_only=True).join(counts, ["feature", "bin"]).select(
        "feature", "bin", "grp", "n_obs", "n_good")
    members, named = name_groups(cut_lineage(final, "final-classes"), specs, edges, missing, label_style)
    return Classing(list(specs), edges, cut_lineage(members, "members"), cut_lineage(named, "groups"), counts, plan, missing)
