"""Split search: score every threshold single, pair and triple of a joint histogram.

Two thresholds cut the plane into the quadrants LL, LH, HL, HH (L below, H at or above).
A gain does not change when inside and outside swap, so every two-literal rule is one
of five regions: a quadrant, or the diagonal X = LH + HL. Three thresholds give eight
octants and the odd-parity region X. One scan of the cells scores all of them, and a
rule family is only a choice of how to write a region as a rule.
"""

from __future__ import annotations

from itertools import islice, product

from pyspark.sql import Column, DataFrame, functions as F

from rulespire.functions.rules import AFFINE, ANTIHORN, ANY, BEST, CONJUI, HORN, SQUARE2CNF, Literal, Rule
from rulespire.functions.scores import entropy, gain_left, gain_ratio, information_gain, penalized_gain
from rulespire.operators.histograms import class_counts
from rulespire.operators.profile import unpivot
from rulespire.operators.scan import prefix_sums


def regions_of(arity: int) -> list[str]:
    return ["".join(p) for p in product("LH", repeat=arity)] + (["X"] if arity > 1 else [])


def region_counts(cells: DataFrame, keys: list[str], axes: list[str], step: int = 1, regions: list[str] | None = None) -> DataFrame:
    """(keys, axes, tp, tn, region, ip, ineg) for every cut combination and region.

    Axis value b stands for the cut between bin b and bin b + 1. ``step`` > 1 keeps every
    step-th cut of each axis.
    """
    from rulespire.operators.dense import all_regions

    return all_regions(cells, keys, axes, regions or regions_of(len(axes)), step)


def score_counts(df: DataFrame, arity: Column | int, min_leaf: int) -> DataFrame:
    """Keep counts with both sides >= min_leaf; add raw ``gain`` and penalized ``score``."""
    inside = F.col("ip") + F.col("ineg")
    n = F.col("tp") + F.col("tn")
    kept = df.filter((inside >= min_leaf) & (n - inside >= min_leaf))
    gain = information_gain(F.col("tp"), F.col("tn"), F.col("ip"), F.col("ineg"))
    # what is left of no gain is below 0; naming the gain once keeps the pushed filter small enough to be compiled
    return kept.withColumn("gain", gain).withColumn("score", gain_left(F.col("gain"), arity, n)).filter(F.col("score") > 0)


def best_per(df: DataFrame, keys: list[str], order: list[str], digits: int = 12) -> DataFrame:
    """Best-scored row per key: rounded score, then the ``order`` columns ascending.

    One aggregation with map-side combine - no window, so a key may have any number of
    candidates.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    entry = F.struct((-F.round("score", digits)).alias("__rank"), *order, *rest)
    return df.groupBy(*keys).agg(F.min(entry).alias("__m")).select(*keys, *[f"__m.{c}" for c in [*order, *rest]])


def one_d_scores(cuts: DataFrame, min_leaf: int) -> DataFrame:
    """Single-test scores from ``local_cuts`` output (region L = below the threshold)."""
    return score_counts(
        cuts.withColumnsRenamed({"cum_pos": "ip", "cum_neg": "ineg", "tot_pos": "tp", "tot_neg": "tn"}), 1, min_leaf
    )


def feature_scores(cuts: DataFrame, keys: list[str], min_leaf: int, use_ratio: bool = False) -> DataFrame:
    """Best single-cut gain (or ratio) of every (keys..., feature); 0 when nothing qualifies."""
    left = F.col("cum_pos") + F.col("cum_neg")
    n = F.col("tot_pos") + F.col("tot_neg")
    fn = gain_ratio if use_ratio else information_gain
    g = fn(F.col("tot_pos"), F.col("tot_neg"), F.col("cum_pos"), F.col("cum_neg"))
    ok = (left >= min_leaf) & (n - left >= min_leaf)
    return cuts.groupBy(*keys).agg(F.greatest(F.max(F.when(ok, g)), F.lit(0.0)).alias("feature_score")).na.fill({"feature_score": 0.0})


def mutual_information(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Plug-in mutual information (bits) of bin and label; cells has one row per bin."""
    h = entropy(F.sum("pos"), F.sum("neg"))
    inner = F.sum((F.col("pos") + F.col("neg")) * entropy(F.col("pos"), F.col("neg")))
    n = F.sum(F.col("pos") + F.col("neg"))
    return cells.groupBy(*keys).agg(F.greatest(h - inner / n, F.lit(0.0)).alias("feature_score"))


# Which region is written how: family -> (operator, regions allowed by polarity).
def forms(region: str) -> list[tuple[str, str]]:
    """(family, combine) forms of a region."""
    if region == "X":
        return [(AFFINE, "xor")]
    lows, highs = region.count("L"), region.count("H")
    out = []
    if lows <= 1 or len(region) == 1:
        out.append((HORN, "or"))
    if highs <= 1 or len(region) == 1:
        out.append((ANTIHORN, "or"))
    return out + [(CONJUI, "and")]


def searched_families(requested: str, allow_affine: bool) -> set[str]:
    """Families whose searches run for a requested language."""
    if requested == ANY:
        return {HORN, ANTIHORN, CONJUI, AFFINE}
    if requested == BEST:
        return {HORN, ANTIHORN, CONJUI} | ({AFFINE} if allow_affine else set())
    return {requested}


def regions_for(families: set[str], arity: int) -> list[str]:
    return [r for r in regions_of(arity) if any(f in families for f, _ in forms(r))]


def rule_of(region: str, family: str, feats: list[int], cuts: list[float], gain: float = 0.0) -> Rule:
    """Write a region as a rule of the family.

    AND rules and XOR name the region itself; OR rules name its complement.
    """
    combine = dict(forms(region))[family]
    if combine == "xor":
        lits = [Literal(f, "GE", t) for f, t in zip(feats, cuts)]
    else:
        keep = combine == "and"
        lits = [Literal(f, "GE" if (s == "H") == keep else "LT", t) for f, t, s in zip(feats, cuts, region)]
    return Rule.of(combine, family, *lits, gain=gain)


def polarity_text(region: Column, combine: str) -> Column:
    """GE/LT list of the literals of a region's OR or AND form."""
    hi, lo = ("GE", "LT") if combine == "and" else ("LT", "GE")
    spelled = F.transform(F.split(region, ""), lambda s: F.when(s == "H", hi).otherwise(lo))
    return F.array_join(spelled, ",")


def rule_counts(df: DataFrame, truth: Column, keys: list[str], y: str = "y") -> DataFrame:
    """Class counts inside and overall for one rule: tp, tn, ip, ineg."""
    pos, neg = F.col(y) == 1, F.col(y) != 1
    return df.groupBy(*keys).agg(
        F.count_if(pos).cast("double").alias("tp"), F.count_if(neg).cast("double").alias("tn"),
        F.count_if(pos & truth).cast("double").alias("ip"), F.count_if(neg & truth).cast("double").alias("ineg"),
    )


def score_rule(df: DataFrame, rule: Rule, cols: list[Column], min_leaf: int, y: str = "y") -> DataFrame:
    """Gain and penalized score of a given, checked rule; score -1 below the leaf minimum."""
    rule.check()
    c = rule_counts(df, rule.column(cols), [], y)
    inside, n = F.col("ip") + F.col("ineg"), F.col("tp") + F.col("tn")
    gain = information_gain(F.col("tp"), F.col("tn"), F.col("ip"), F.col("ineg"))
    ok = (inside >= min_leaf) & (n - inside >= min_leaf)
    return c.withColumn("gain", F.when(ok, gain).otherwise(F.lit(-1.0))).withColumn(
        "score", penalized_gain(F.col("gain"), rule.arity, n))


def compare_counts(df: DataFrame, pairs: list[tuple[str, str]], keys: list[str], y: str = "y") -> DataFrame:
    """Counts of x_i <= x_j for every named pair in one pass: (keys, fi, fj, ip, ineg, tp, tn)."""
    entry = F.array(*[
        F.struct(F.lit(a).alias("fi"), F.lit(b).alias("fj"), (F.col(a) <= F.col(b)).alias("le")) for a, b in pairs
    ])
    long = df.select(*keys, y, F.explode(entry).alias("e"))
    return rule_counts(long, F.col("e.le"), [*keys, "e.fi", "e.fj"], y)


def interaction_scan(bits: DataFrame, features: list[str], y: str = "y", top: int = 50, w: str | None = None) -> DataFrame:
    """Joint gain of every pair of two-valued columns and its synergy over the better single.

    Rows with equal bits are added up first, so the pair explosion runs on distinct
    bit patterns.
    """
    packed = bits.groupBy(*features, y).agg(F.sum(F.col(w) if w else F.lit(1.0)).alias("w"))
    # two generators instead of one literal per pair keep the generated code small
    first = packed.select(y, "w", F.array(*features).alias("b"), F.posexplode(F.array(*features)).alias("i", "bi"))
    later = F.slice("b", F.col("i") + 2, F.greatest(F.size("b") - F.col("i") - 1, F.lit(0)))
    long = first.select(y, "w", "i", "bi", F.posexplode(later).alias("p", "bj"))
    pos = F.when(F.col(y) == 1, F.col("w")).otherwise(F.lit(0.0))
    name = lambda c: F.get(F.array(*[F.lit(f) for f in features]), c)
    cells = long.groupBy("i", (F.col("i") + 1 + F.col("p")).alias("j"), "bi", "bj").agg(
        F.sum(pos).alias("pos"), F.sum(F.col("w") - pos).alias("neg")).withColumns({"fi": name(F.col("i")), "fj": name(F.col("j"))})
    def left(cond, side):
        return F.sum(F.when(cond, F.col(side)).otherwise(F.lit(0.0)))
    n = F.sum(F.col("pos") + F.col("neg"))
    joint = entropy(F.sum("pos"), F.sum("neg")) - F.sum((F.col("pos") + F.col("neg")) * entropy(F.col("pos"), F.col("neg"))) / n
    hi_i, hi_j = F.col("bi") == 1, F.col("bj") == 1
    ga = information_gain(F.sum("pos"), F.sum("neg"), left(hi_i, "pos"), left(hi_i, "neg"))
    gb = information_gain(F.sum("pos"), F.sum("neg"), left(hi_j, "pos"), left(hi_j, "neg"))
    out = cells.groupBy("fi", "fj").agg(joint.alias("joint_gain"), F.greatest(ga, gb, F.lit(0.0)).alias("single_gain"))
    out = out.withColumn("synergy", F.col("joint_gain") - F.col("single_gain"))
    keep = (F.col("synergy") > 1e-6) | (F.col("joint_gain") > 1.1 * F.col("single_gain"))
    order = [F.desc(F.round("joint_gain", 9)), F.desc(F.round("synergy", 9)), F.asc("fi"), F.asc("fj")]
    return out.filter(keep).orderBy(*order).limit(top)


def clause_pairs(n_clauses: int, features: list[frozenset], limit: int) -> list[tuple[int, int]]:
    """First ``limit`` pairs of ranked clauses that do not use the same feature set."""
    every = ((a, s - a) for s in range(1, 2 * n_clauses - 2) for a in range(max(0, s - n_clauses + 1), (s + 1) // 2))
    return list(islice(((a, b) for a, b in every if features[a] != features[b]), limit))


def exact_stump(df: DataFrame, features: list[str], min_leaf: int, y: str = "y") -> DataFrame:
    """Best single test over the midpoints of all neighbouring values of all features, as one row.

    feature, threshold, ip, ineg (rows below), tp, tn, gain, score. Values are counted and added up in ordered buckets.
    """
    long = unpivot(df, features, [y]).withColumn("value", F.col("value") + F.lit(0.0))
    counts = class_counts(long, ["feature", "value"], y)
    cuts = prefix_sums(counts, ["feature"], "value", ["pos", "neg"]).filter(F.col("next_value").isNotNull())
    cuts = cuts.select("feature", "value", ((F.col("value") + F.col("next_value")) / 2).alias("threshold"),
                       F.col("cum_pos").alias("ip"), F.col("cum_neg").alias("ineg"), F.col("tot_pos").alias("tp"), F.col("tot_neg").alias("tn"))
    place = F.array_position(F.array(*[F.lit(f) for f in features]), F.col("feature"))
    return best_per(score_counts(cuts, 1, min_leaf).withColumns({"place": place, "k": F.lit(0)}), ["k"], ["place", "value"], digits=9).drop("k", "place", "value")
