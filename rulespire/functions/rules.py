"""Rules: threshold tests combined with OR, AND, XOR or an AND of two-literal ORs.

Two views of the same thing:

* ``Literal`` / ``Rule`` live on the driver (a model has hundreds of them) and turn
  into plain Column expressions over the rows;
* rule *tables* carry ``lits array<struct<clause,feature,op,threshold>>`` and are
  labelled, validated and printed with array functions, many trees in one query.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from itertools import product

from pyspark.sql import Column, functions as F

HORN, ANTIHORN, CONJUI, AFFINE, SQUARE2CNF = "Horn", "AntiHorn", "ConjUI", "Affine", "Square2CNF"
ANY, BEST = "Any", "BestPerNode"
FAMILIES = (HORN, ANTIHORN, CONJUI, AFFINE, SQUARE2CNF)
FAMILY_RANK = {name: i for i, name in enumerate(FAMILIES)}

LITS_TYPE = "array<struct<clause:int,feature:int,op:string,threshold:double>>"


@dataclass(frozen=True)
class Literal:
    """``x[feature] op value`` where value is a threshold or another column."""

    feature: int
    op: str  # GE | LT for thresholds; GE | LT | LE | GT against feature2
    threshold: float = 0.0
    feature2: int | None = None

    def column(self, cols: list[Column]) -> Column:
        left = cols[self.feature]
        right = F.lit(self.threshold) if self.feature2 is None else cols[self.feature2]
        return {"GE": left >= right, "LT": left < right, "LE": left <= right, "GT": left > right}[self.op]

    def negate(self) -> "Literal":
        flipped = {"GE": "LT", "LT": "GE", "LE": "GT", "GT": "LE"}[self.op]
        return Literal(self.feature, flipped, self.threshold, self.feature2)

    def interval(self) -> tuple[float, float]:
        """Half-open interval of allowed values."""
        if self.feature2 is not None:
            raise ValueError("a column-against-column test has no interval")
        return (self.threshold, float("inf")) if self.op == "GE" else (float("-inf"), self.threshold)

    @property
    def positive(self) -> bool:
        return self.op in ("GE", "GT")

    def text(self, names: list[str] | None = None) -> str:
        name = (lambda i: names[i]) if names else (lambda i: f"x[{i}]")
        sign = {"GE": ">=", "LT": "<", "LE": "<=", "GT": ">"}[self.op]
        right = f"{self.threshold:g}" if self.feature2 is None else name(self.feature2)
        return f"{name(self.feature)} {sign} {right}"


@dataclass(frozen=True)
class Rule:
    """A split. ``clauses`` has one clause for or/and/xor and several for cnf."""

    combine: str  # or | and | xor | cnf
    clauses: tuple[tuple[Literal, ...], ...]
    family: str
    gain: float = field(default=0.0, compare=False)

    @staticmethod
    def of(combine: str, family: str, *lits: Literal, gain: float = 0.0) -> "Rule":
        return Rule(combine, (tuple(lits),), family, gain)

    @property
    def literals(self) -> list[Literal]:
        return [lit for clause in self.clauses for lit in clause]

    @property
    def arity(self) -> int:
        return len(self.clauses) if self.combine == "cnf" else len(self.literals)

    @property
    def features(self) -> list[int]:
        out = {lit.feature for lit in self.literals}
        out |= {lit.feature2 for lit in self.literals if lit.feature2 is not None}
        return sorted(out)

    def column(self, cols: list[Column]) -> Column:
        """Truth of the rule. A NULL feature is an unknown one and SQL's three-valued
        logic then answers true, false or NULL exactly as far as the known ones decide."""
        if self.combine == "cnf":
            return reduce(Column.__and__, [reduce(Column.__or__, [l.column(cols) for l in c]) for c in self.clauses])
        parts = [lit.column(cols) for lit in self.literals]
        step = {"or": Column.__or__, "and": Column.__and__, "xor": Column.__ne__}[self.combine]
        return reduce(step, parts)

    def branch(self, taken: bool) -> list[list[Literal]]:
        """The branch as alternatives, each a conjunction of literals."""
        lits = self.literals
        if self.combine == "cnf":
            if taken:
                return [list(pick) for pick in product(*self.clauses)]
            return [[lit.negate() for lit in clause] for clause in self.clauses]
        if self.combine == "xor":
            picks = product((True, False), repeat=len(lits))
            return [
                [l if on else l.negate() for l, on in zip(lits, pick)]
                for pick in picks
                if (sum(pick) % 2 == 1) == taken
            ]
        if (self.combine == "or") == taken:
            return [[lit if taken else lit.negate()] for lit in lits]
        return [[lit if taken else lit.negate() for lit in lits]]

    def narrowed(self, bounds: dict[int, tuple[float, float]]) -> dict[int, tuple[float, float]]:
        """Intervals [lo, hi) of a path after the rule's false branch: every literal is taken as false.

        XOR rules and tests against columns bound nothing. The true branch keeps the bounds as they are.
        """
        out = dict(bounds)
        for l in self.literals if self.combine != "xor" else ():
            if l.feature2 is None:
                lo, hi = out.get(l.feature, (float("-inf"), float("inf")))
                out[l.feature] = (lo, min(hi, l.threshold)) if l.op == "GE" else (max(lo, l.threshold), hi)
        return out

    def check(self) -> "Rule":
        """Refuse a rule that breaks the shape of its family."""
        problem = shape_problem(self)
        if problem:
            raise ValueError(problem)
        return self

    def label(self) -> str:
        return _label(self)

    def text(self, names: list[str] | None = None) -> str:
        if self.combine == "cnf":
            return " ∧ ".join("(" + " ∨ ".join(l.text(names) for l in c) + ")" for c in self.clauses)
        glue = {"or": " ∨ ", "and": " ∧ ", "xor": " ⊕ "}[self.combine]
        return glue.join(l.text(names) for l in self.literals)

    def to_row(self) -> dict:
        lits = [
            {"clause": i, "feature": l.feature, "op": l.op, "threshold": float(l.threshold), "feature2": l.feature2}
            for i, c in enumerate(self.clauses)
            for l in c
        ]
        return {"combine": self.combine, "family": self.family, "lits": lits}

    @staticmethod
    def from_row(row: dict) -> "Rule":
        groups: dict[int, list[Literal]] = {}
        for l in row["lits"]:
            groups.setdefault(l["clause"], []).append(Literal(l["feature"], l["op"], l["threshold"], l["feature2"]))
        clauses = tuple(tuple(groups[k]) for k in sorted(groups))
        return Rule(row["combine"], clauses, row["family"], row.get("gain") or 0.0)


def shape_problem(rule: Rule) -> str | None:
    """First broken shape condition of a rule, or None."""
    if not 1 <= rule.arity <= 3:
        return "a rule has 1 to 3 literals or clauses"
    wanted = {HORN: "or", ANTIHORN: "or", CONJUI: "and", AFFINE: "xor", SQUARE2CNF: "cnf"}.get(rule.family)
    if wanted and rule.combine != wanted:
        return f"{rule.family} combines with {wanted}, not {rule.combine}"
    plain = [l for l in rule.literals if l.feature2 is None]
    n_pos = sum(l.positive for l in plain)
    if rule.family == HORN and n_pos > 1:
        return "Horn allows one positive literal"
    if rule.family == ANTIHORN and len(plain) - n_pos > 1:
        return "AntiHorn allows one negative literal"
    if rule.family == AFFINE and rule.arity < 2:
        return "Affine needs two literals"
    if rule.combine == "cnf":
        if any(len(c) != 2 for c in rule.clauses):
            return "Square2CNF clauses have two literals"
        if len(plain) != len(rule.literals):
            return "Square2CNF takes threshold literals only"
    return None


def _label(rule: Rule) -> str:
    """Pattern label of a driver-side rule; same vocabulary as ``pattern_label``."""
    if any(l.feature2 is not None for l in rule.literals):
        return "COMPARE_LE" if rule.arity == 1 else "COMPARE_BINARY"
    signs = tuple(l.positive for l in rule.literals)
    if rule.combine == "cnf":
        twin = any(c[0] == c[1] for c in rule.clauses)
        return "SQ2CNF_DEGEN" if twin else "SQ2CNF_2C2L"
    if rule.combine == "xor":
        return f"AFF_{len(signs)}D"
    if rule.family == CONJUI:
        if len(signs) == 1:
            return "CONJ_UI_1L"
        return f"CONJ_UI_{len(signs)}D_" + ("ALL" if len(set(signs)) == 1 else "MIX")
    odd = rule.family != ANTIHORN  # the sign that may occur once
    head = "" if odd else "AH_"
    if len(signs) == 1:
        return head + ("1L_POS" if signs[0] else "1L_NEG")
    special = [i for i, s in enumerate(signs) if s == odd]
    common, single = ("NEG", "POS") if odd else ("POS", "NEG")
    tail = f"ALL_{common}" if not special else f"{single}_{special[0]}"
    return f"{head}{len(signs)}L_{tail}"


# --- rule tables -----------------------------------------------------------------


def positives(lits: Column) -> Column:
    return F.size(F.filter(lits, lambda l: l.op == "GE"))


def pattern_label(family: Column, combine: Column, lits: Column) -> Column:
    """Pattern label of every rule of a table."""
    n, pos = F.size(lits), positives(lits)
    sign_list = F.transform(lits, lambda l: l.op == "GE")
    first_pos = F.array_position(sign_list, F.lit(True)) - 1
    first_neg = F.array_position(sign_list, F.lit(False)) - 1
    uniform = (pos == 0) | (pos == n)
    pairs = F.filter(lits, lambda l: F.size(F.filter(lits, lambda m: m == l)) > 1)
    nstr = n.cast("string")
    horn = (
        F.when(n == 1, F.when(pos == 1, "1L_POS").otherwise("1L_NEG"))
        .when(pos == 0, F.concat(nstr, F.lit("L_ALL_NEG")))
        .otherwise(F.concat(nstr, F.lit("L_POS_"), first_pos.cast("string")))
    )
    anti = (
        F.when(n == 1, F.when(pos == 1, "AH_1L_POS").otherwise("AH_1L_NEG"))
        .when(pos == n, F.concat(F.lit("AH_"), nstr, F.lit("L_ALL_POS")))
        .otherwise(F.concat(F.lit("AH_"), nstr, F.lit("L_NEG_"), first_neg.cast("string")))
    )
    conj = F.when(n == 1, "CONJ_UI_1L").otherwise(
        F.concat(F.lit("CONJ_UI_"), nstr, F.lit("D_"), F.when(uniform, "ALL").otherwise("MIX"))
    )
    return (
        F.when(combine == "cnf", F.when(F.size(pairs) > 0, "SQ2CNF_DEGEN").otherwise("SQ2CNF_2C2L"))
        .when(combine == "xor", F.concat(F.lit("AFF_"), nstr, F.lit("D")))
        .when(family == CONJUI, conj)
        .when(family == ANTIHORN, anti)
        .otherwise(horn)
    )


def rule_problem(family: Column, combine: Column, lits: Column) -> Column:
    """Broken shape condition of every rule of a table, '' when well formed."""
    n, pos = F.size(lits), positives(lits)
    clause_ids = F.array_distinct(F.transform(lits, lambda l: l.clause))
    bad_clause = F.exists(clause_ids, lambda c: F.size(F.filter(lits, lambda l: l.clause == c)) != 2)
    count = F.when(combine == "cnf", F.size(clause_ids)).otherwise(n)
    return (
        F.when((count < 1) | (count > 3), "arity")
        .when((family == HORN) & (pos > 1), "horn_polarity")
        .when((family == ANTIHORN) & (n - pos > 1), "antihorn_polarity")
        .when((combine == "cnf") & bad_clause, "clause_size")
        .when((family == AFFINE) & (combine != "xor"), "operator")
        .when((combine == "xor") & (family != AFFINE), "operator")
        .otherwise("")
    )


def literal_text(l: Column) -> Column:
    sign = F.when(l.op == "GE", " >= ").otherwise(" < ")
    return F.concat(F.lit("x["), l.feature.cast("string"), F.lit("]"), sign, F.format_string("%.4f", l.threshold))


def negated(l: Column) -> Column:
    flipped = F.when(l.op == "GE", "LT").otherwise("GE")
    return F.struct(l.clause.alias("clause"), l.feature.alias("feature"), flipped.alias("op"), l.threshold.alias("threshold"))


def rule_text(combine: Column, lits: Column) -> Column:
    """Infix text of every rule of a table."""
    clause_ids = F.array_sort(F.array_distinct(F.transform(lits, lambda l: l.clause)))
    clause_text = F.transform(
        clause_ids,
        lambda c: F.concat(
            F.lit("("),
            F.array_join(F.transform(F.filter(lits, lambda l: l.clause == c), literal_text), " | "),
            F.lit(")"),
        ),
    )
    flat = F.transform(lits, literal_text)
    return (
        F.when(combine == "cnf", F.array_join(clause_text, " & "))
        .when(combine == "and", F.array_join(flat, " & "))
        .when(combine == "xor", F.array_join(flat, " ^ "))
        .otherwise(F.array_join(flat, " | "))
    )


def implication_text(lits: Column) -> Column:
    """OR rule as ``body -> head``: negative literals move to the body, flipped."""
    heads = F.filter(lits, lambda l: l.op == "GE")
    body = F.filter(lits, lambda l: l.op == "LT")
    body_text = F.array_join(F.transform(body, lambda l: literal_text(negated(l))), " & ")
    head_text = literal_text(F.get(heads, F.lit(0)))
    return (
        F.when(F.size(heads) == 0, F.concat(body_text, F.lit(" -> false")))
        .when(F.size(body) == 0, F.concat(F.lit("true -> "), head_text))
        .otherwise(F.concat(body_text, F.lit(" -> "), head_text))
    )


def features_used(lits: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(lits, lambda l: l.feature)))


def literal_interval(l: Column) -> Column:
    lo = F.when(l.op == "GE", l.threshold).otherwise(F.lit(float("-inf")))
    hi = F.when(l.op == "GE", F.lit(float("inf"))).otherwise(l.threshold)
    return F.struct(l.feature.alias("feature"), lo.alias("lo"), hi.alias("hi"))
