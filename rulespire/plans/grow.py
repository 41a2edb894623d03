"""Level-synchronous growth: a constant number of jobs per level for the open nodes of
all trees.

Rows never move. They are cached as column blocks and every pass routes them through the
splits found so far, so a level needs no checkpoint and a lost executor only repeats its
blocks. Shuffles carry count arrays per (node, feature) and (node, tuple of features).
The driver holds nodes, thresholds of the top features and one winner per node and
region; open nodes are searched in lots, so that this and a task's arrays stay bounded.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from rulespire.config import FitConfig
from rulespire.functions.hashing import unit_hash
from rulespire.functions.rules import AFFINE, ANTIHORN, ANY, BEST, CONJUI, FAMILY_RANK, HORN, SQUARE2CNF, Literal, Rule
from rulespire.functions.scores import information_gain
from rulespire.operators.binning import clean_edges, density_edges, equal_width_edges, interior, quantile_edges, supervised_edges
from rulespire.operators.dense import best_cuts, entropy_of, region_scores
from rulespire.operators.neighbours import feature_information
from rulespire.operators.profile import unpivot
from rulespire.operators.prune import prune
from rulespire.operators.sampling import stratified_split
from rulespire.operators.search import clause_pairs, forms, interaction_scan, regions_for, regions_of, rule_of, searched_families
from rulespire.plans import tensors as T
from rulespire.plans.encode import Encoded, encode
from rulespire.plans.model import Node, TreeModel

#: Cells of the arrays that a task holds at once.
CELLS = 1 << 23
#: Rows from which a hold-out is set aside for pruning.
PRUNE_ROWS = 500
#: Cuts of a lot of open nodes that are ranked in the driver; more are ranked in tasks.
FEW_CUTS = 1 << 18
CUT_COLUMNS = ["slot", "f", "threshold", "cut_code", "cum_pos", "cum_neg", "tot_pos", "tot_neg"]


@dataclass
class Candidate:
    score: float
    gain: float
    rule: Rule  # thresholds as values
    code_rule: Rule  # thresholds as codes, for features that have one per value
    ip: float
    ineg: float

    def order(self) -> tuple:
        lits = self.rule.literals
        return (-round(self.score, 12), self.rule.arity, FAMILY_RANK.get(self.rule.family, 9),
                [l.feature for l in lits], [l.threshold for l in lits])


@dataclass
class OpenNode:
    """Search state of one node: ranked features and their cuts."""

    node: Node
    scores: dict[int, float] = field(default_factory=dict)
    ranked: list[int] = field(default_factory=list)
    cuts: dict[int, list[tuple[float, float]]] = field(default_factory=dict)  # feature -> [(code or threshold, threshold)]
    candidates: list[Candidate] = field(default_factory=list)
    bounds: dict[int, tuple[float, float]] = field(default_factory=dict)  # path interval per feature
    path: tuple = ()  # rules and sides above the node
    twins: list["OpenNode"] = field(default_factory=list)  # nodes of other trees that hold the same rows; they are counted once

    @property
    def group(self) -> list["OpenNode"]:
        return [self, *self.twins]

    def off(self) -> set[int]:
        """Features whose path interval is empty; they are not searched."""
        return {f for f, (lo, hi) in self.bounds.items() if lo >= hi}


def fit_tree(df: DataFrame, label: str, features: list[str], cfg: FitConfig = FitConfig(), weight: str | None = None, row_key: str | None = None) -> TreeModel:
    """Fit one rule tree on a table; with ``cfg.prune_holdout`` a part of the rows (told apart by ``row_key``) prunes it."""
    if cfg.strict_family and cfg.family == ANY:
        raise ValueError("strict family mode needs one family, not Any")
    held = None
    if cfg.prune_holdout and row_key and df.count() >= PRUNE_ROWS:
        split = stratified_split(df, [label], row_key, cfg.prune_holdout, cfg.seed, purpose="prune")
        df, held = split.filter("not is_test"), split.filter("is_test")
    enc = encode(df, label, features, cfg.max_codes, weight, keep=features if cfg.allow_compare else (), exact=True, cache=False)
    model = Grower(enc, cfg, edges=fixed_edges(df, label, features, cfg), root_scores=root_scores(df, label, features, cfg)).run()
    return prune(model, held, label, cfg.prune_alpha) if held is not None else model


def fixed_edges(df: DataFrame, label: str, features: list[str], cfg: FitConfig) -> list[np.ndarray] | None:
    """Inner edges per feature, found before growth; None where every node finds its own."""
    if cfg.binning == "local":
        return None
    make = {"quantile": quantile_edges, "width": equal_width_edges, "density": density_edges, "supervised": supervised_edges}[cfg.binning]
    long = unpivot(df, features, [label]).withColumnRenamed(label, "y")
    rows = make(long, ["feature"], cfg.n_bins).select("feature", interior(clean_edges(F.col("edges"))).alias("e")).collect()  # features x bins numbers
    by = {r["feature"]: np.array(r["e"]) for r in rows}
    return [by.get(f, np.empty(0)) for f in features]


def root_scores(df: DataFrame, label: str, features: list[str], cfg: FitConfig) -> dict[int, float] | None:
    """Scores of the features at the root estimated from neighbours; None where those of its bins rank them."""
    if cfg.root_score == "bins" or cfg.use_gain_ratio:
        return None
    return {features.index(r["feature"]): r["feature_score"] for r in feature_information(df, label, features).collect()}  # one number per feature


def stop_reason(cfg: FitConfig, n_pos: float, n_neg: float, depth: int) -> str:
    """Stop rules that need no search, in their fixed order."""
    n = n_pos + n_neg
    if depth >= cfg.max_depth:
        return "MAX_DEPTH"
    if n < cfg.min_samples_split:
        return "MIN_SPLIT"
    if n_pos == 0 or n_neg == 0:
        return "PURE"
    if max(n_pos, n_neg) / n >= cfg.purity:
        return "PURITY"
    return ""


def gain_reason(cfg: FitConfig, gain: float, depth: int) -> str:
    if gain < cfg.min_gain:
        return "MIN_GAIN"
    if gain - cfg.complexity_penalty * depth < 0:
        return "COMPLEXITY"
    return ""


class Grower:
    """Grows ``n_trees`` trees at once. ``subsets[t]`` limits the features of tree t;
    with ``weights`` the rows carry an array column of per-tree weights.

    ``cfgs`` gives trees their own family and choice of searches (the other settings are those of ``cfg``) and ``masks``
    their place in the weights. Trees with the same mask hold the same rows as long as their rules agree; such nodes are
    counted once. ``blocks`` are rows that were packed before; the caller keeps them.
    """

    def __init__(self, enc: Encoded, cfg: FitConfig, n_trees: int = 1, subsets: list[list[int]] | None = None, weights: str | None = None,
                 edges: list[np.ndarray] | None = None, root_scores: dict[int, float] | None = None,
                 cfgs: list[FitConfig] | None = None, masks: list[int] | None = None, blocks: DataFrame | None = None):
        self.edges, self.root_scores = edges, root_scores
        self.cfgs, self.masks = cfgs or [cfg] * n_trees, masks
        self.enc, self.cfg, self.n_trees, self.weights = enc, cfg, n_trees, weights
        self.d = len(enc.features)
        self.subsets = subsets
        self.spark = enc.df.sparkSession
        self.families = [searched_families(c.family, c.allow_affine) for c in self.cfgs]
        self.model = TreeModel(enc.features, meta={"config": cfg, "finer_than_codes": [f for f, v in zip(enc.features, enc.values) if v is None]})
        self.code_rules: dict[tuple[int, int], Rule] = {}
        self.raw = {enc.features.index(f): k for k, f in enumerate(enc.raw)}
        self.wide = frozenset(f for f, v in enumerate(enc.values) if v is None)
        self.given, self.blocks = blocks is not None, blocks
        self.held: list[DataFrame] = []
        self.extra_pairs: list[tuple[int, int]] = []

    # -- rows of the open nodes ------------------------------------------------------

    def router(self, open_nodes: list[OpenNode]) -> T.Router:
        slots = {(o.node.tree_id, o.node.node_id): i for i, o in enumerate(open_nodes)}
        return T.Router(self.code_rules, slots, self.raw, self.wide, self.masks)

    def _lots(self, todo: list[OpenNode], cells) -> list[list[OpenNode]]:
        """Open nodes whose arrays fit into a task together; ``cells(o)`` is the size of those of one node."""
        lots, held = [], 0
        for o in todo:
            size = cells(o)
            if not lots or held + size > CELLS:
                lots.append([])
                held = 0
            lots[-1].append(o)
            held += size
        return lots

    def _tuple_cells(self, o: OpenNode) -> int:
        sizes = {a: [len(self._grid(a)(o, f)) + 1 for f in self._tuple_features([o], a)[0]] for a in (2, 3)}
        return sum(math.prod(c) for a in (2, 3) if a <= self.cfg.max_arity for c in combinations(sizes[a], a))

    # -- level ------------------------------------------------------------------------

    def run(self) -> TreeModel:
        cfg, trees = self.cfg, range(self.n_trees)
        if not self.given:
            self.blocks = T.pack(self.enc.df, self.enc.raw, self.weights)
        try:
            places = self.masks or list(trees)
            sums = T.totals(self.blocks, max(places) + 1)
            level = [OpenNode(self._node(t, 1, *sums[places[t]])) for t in trees]
            if cfg.use_interactions:
                self.extra_pairs = self._interactions()
            while level:
                todo = [o for o in level if not o.node.stop_reason]
                heads = self._heads(todo)
                for lot in self._lots(heads, lambda o: max(sum(map(self.enc.codes, range(self.d))), self.d * self.cfg.n_bins)):
                    self._cuts(lot)
                for lot in self._lots(heads, self._tuple_cells):
                    self._search(lot)
                level = [child for o in todo for child in self._close(o)]
        finally:
            self._release()
            if not self.given:
                self.blocks.unpersist()
        return self.model

    def _heads(self, todo: list[OpenNode]) -> list[OpenNode]:
        """One node of all that hold the same rows; it carries the others."""
        if self.masks is None or self.cfg.look_ahead:
            return todo
        heads: dict[tuple, OpenNode] = {}
        for o in todo:
            head = heads.setdefault((self.masks[o.node.tree_id], o.path), o)
            if head is not o:
                head.twins.append(o)
        return list(heads.values())

    def _node(self, tree: int, node: int, pos: float, neg: float) -> Node:
        proba = (pos + self.cfg.laplace) / (pos + neg + 2 * self.cfg.laplace)
        n = Node(tree, node, pos, neg, proba, requested=self.cfgs[tree].family)
        n.stop_reason = stop_reason(self.cfg, pos, neg, n.depth)
        self.model.nodes[(tree, node)] = n
        return n

    def _close(self, o: OpenNode) -> list[OpenNode]:
        node, cfg = o.node, self.cfg
        if not o.candidates:
            node.stop_reason = "NO_SPLIT"
            return []
        best = min(o.candidates, key=Candidate.order) if not cfg.look_ahead else o.candidates[0]
        family = self.cfgs[node.tree_id].family
        if cfg.strict_family and family != BEST and best.rule.family != family:
            node.stop_reason = "OTHER_FAMILY"
            return []
        node.stop_reason = gain_reason(cfg, best.score, node.depth)
        if node.stop_reason:
            return []
        node.rule = best.rule
        self.code_rules[(node.tree_id, node.node_id)] = best.code_rule
        kids = [(0, best.ip, best.ineg, o.bounds), (1, node.n_pos - best.ip, node.n_neg - best.ineg, best.rule.narrowed(o.bounds))]
        # a single test is the same in every family
        step = best.code_rule.clauses, best.code_rule.combine if len(best.code_rule.literals) > 1 else ""
        return [OpenNode(self._node(node.tree_id, 2 * node.node_id + side, p, n), scores=dict(o.scores), bounds=dict(b), path=(*o.path, (side, *step))) for side, p, n, b in kids]

    def _search(self, todo: list[OpenNode]) -> None:
        cfg = self.cfg
        self._score_tuples(todo)
        if cfg.allow_compare and any(self._wants(w, T.EXTRA) for o in todo for w in o.group):
            self._score_compare(todo)
        if cfg.look_ahead:
            self._look_ahead(todo)

    def _wants(self, o: OpenNode, kind: int) -> bool:
        """Whether the tree of a node searches a kind of tuples."""
        cfg, families = self.cfgs[o.node.tree_id], self.families[o.node.tree_id]
        if kind == T.CLAUSES:
            return SQUARE2CNF in families
        if kind == T.TRIPLES:
            return bool(families & {HORN, ANTIHORN, CONJUI, AFFINE}) and cfg.search_3d and cfg.max_arity >= 3
        plain = {HORN, ANTIHORN} if kind == T.EXTRA else {HORN, ANTIHORN, CONJUI, AFFINE}
        return bool(families & plain) and cfg.search_2d and cfg.max_arity >= 2

    # -- features, cuts and single tests ------------------------------------------------

    def _fresh_scores(self, o: OpenNode) -> bool:
        return o.node.depth == 0 or (o.node.depth <= 2 and o.node.n >= 100)

    def _all_cuts(self, todo: list[OpenNode]) -> DataFrame | pd.DataFrame:
        """slot, f, threshold, cut_code, cum_pos, cum_neg, tot_pos, tot_neg: exact node-local cuts of all features.

        At most open nodes x features x bins rows; up to ``FEW_CUTS`` they are fetched, more stay a Spark table.
        """
        router, n_bins = self.router(todo), self.cfg.n_bins
        features = [[f for f in (self.subsets[o.node.tree_id] if self.subsets else range(self.d)) if f not in o.off()] for o in todo]
        if self.edges is not None:
            fixed = T.Fixed(self.edges, self.enc.values, self.raw, features)
            cuts = T.merged(T.count(self.blocks, router, fixed, 2), 2, fixed.cuts, T.CUTS)
            return cuts.toPandas()[CUT_COLUMNS] if sum(map(len, features)) * n_bins <= FEW_CUTS else cuts.select(*CUT_COLUMNS)
        codes = [self.enc.codes(f) for f in range(self.d)]
        parts = T.count(self.blocks, router, T.Histogram(codes, self.wide, self.raw, features), 2)
        cutter = T.Cutter(self.enc.values, n_bins)
        cuts = T.merged(parts, 2, cutter, T.CUTS, ("sum", "min", "max") if self.wide else ("sum",))

        def inside(picks: list[dict]) -> DataFrame:
            large = [(k, p) for k, p in enumerate(picks) if p["kind"] == T.PICK and p["rows"] > T.VALUES]
            return T.resolve(T.inside_counts(self.blocks, router, T.Inside(picks, self.raw, n_bins, self.enc.cuts), large), picks, cutter)

        return self._few_cuts(cuts, inside) if sum(map(len, features)) * n_bins <= FEW_CUTS else self._many_cuts(cuts, inside)

    @staticmethod
    def _few_cuts(cuts: DataFrame, inside) -> pd.DataFrame:
        found, few = [cuts.toPandas()], []
        picks = found[0][found[0]["kind"] != T.CUT]
        while len(picks):
            got = inside([p | {"nxt": None if pd.isna(p["nxt"]) else p["nxt"]} for p in picks.to_dict("records")]).toPandas()
            few.append(got[got["kind"] == T.FEW])
            found.append(got)
            picks = got[got["kind"] == T.PICK]
        found = pd.concat(found)
        found = found[found["kind"] == T.CUT]
        if few and len(few[0]):
            # features of few values after all: their midpoints replace their quantiles
            known = set(zip(few[0]["slot"], few[0]["f"]))
            found = pd.concat([found[[k not in known for k in zip(found["slot"], found["f"])]], few[0]])
        return found[CUT_COLUMNS]

    def _many_cuts(self, cuts: DataFrame, inside) -> DataFrame:
        if self.wide:
            cuts, few = self._hold(cuts), None
            picks = [r.asDict() for r in cuts.filter(F.col("kind") != T.CUT).collect()]  # at most open nodes x wide features x bins
            while picks:
                got = self._hold(inside(picks))
                if any(p["kind"] == T.FEW for p in picks):
                    few = got.filter(F.col("kind") == T.FEW)
                cuts = cuts.unionByName(got.filter(F.col("kind") != T.FEW))
                picks = [r.asDict() for r in got.filter(F.col("kind") == T.PICK).collect()]
            cuts = cuts.filter(F.col("kind") == T.CUT)
            if few is not None:
                cuts = cuts.join(few.select("slot", "f").distinct(), ["slot", "f"], "left_anti").unionByName(few)
        return cuts.select(*CUT_COLUMNS)

    def _hold(self, df: DataFrame) -> DataFrame:
        """Keep a small table that is read twice."""
        self.held.append(df.persist())
        return df

    def _release(self) -> None:
        while self.held:
            self.held.pop().unpersist()

    def _cuts(self, todo: list[OpenNode]) -> None:
        cfg = self.cfg
        cuts = self._all_cuts(todo)
        # inherited scores: features allowed by the parent's ranking
        extra = sorted({f for p in self.extra_pairs for f in p})
        plan: list[tuple[bool, list[int]]] = []
        for o in todo:
            fresh = self._fresh_scores(o)
            plan.append((fresh, extra if fresh else sorted(o.scores, key=lambda f: (-o.scores[f], f))[: cfg.top_k] + extra))
        by_information = todo[0].node.depth == 0 and not cfg.use_gain_ratio
        given = self.root_scores if by_information else None

        def rank(pdf: pd.DataFrame) -> pd.DataFrame:
            return _ranked(pdf, *plan[int(pdf["slot"].iloc[0])], cfg, by_information, given)

        if isinstance(cuts, pd.DataFrame):
            ranked = [rank(part) for _, part in cuts.groupby("slot")]
            got = pd.concat(ranked).to_dict("records") if ranked else []
        else:
            schema = "slot int, f int, cut_code int, threshold double, feature_score double, score double, gain double, ip double, ineg double, first boolean, keep boolean"
            # a node has at most features x n_bins cuts
            got = cuts.groupBy("slot").applyInPandas(rank, schema).toPandas().to_dict("records")
        self._release()
        singles = []
        for r in got:
            o = todo[r["slot"]]
            t = float(r["threshold"])
            test = t if r["f"] in self.wide else r["cut_code"]
            if r["first"] and r["score"] > 0:
                singles.append((o, r, test, t))
            if not r["keep"]:
                continue
            o.cuts.setdefault(r["f"], []).append((test, t))
            if self._fresh_scores(o):
                o.scores[r["f"]] = r["feature_score"]
        for o in todo:
            for f in o.cuts:
                o.cuts[f].sort()
            o.ranked = sorted(o.cuts, key=lambda f: (-o.scores.get(f, 0.0), f))
            for w in o.twins:
                w.cuts, w.scores, w.ranked = o.cuts, dict(o.scores), o.ranked
        for o, r, test, t in singles:
            for w in o.group:
                if self.cfgs[w.node.tree_id].search_1d or CONJUI in self.families[w.node.tree_id]:
                    self._add(w, "L", [r["f"]], [test], [t], r)

    def _add(self, o: OpenNode, region: str, feats: list[int], codes: list[int], values: list[float], r) -> None:
        for family, combine in forms(region):
            if family not in self.families[o.node.tree_id]:
                continue
            if family == AFFINE and self.cfg.strict_family and any(len(o.cuts[f]) > 1 for f in feats):
                continue
            rule = rule_of(region, family, feats, values, r["score"]).check()
            code_rule = rule_of(region, family, feats, codes)
            inside = combine != "or"
            ip = r["ip"] if inside else o.node.n_pos - r["ip"]
            ineg = r["ineg"] if inside else o.node.n_neg - r["ineg"]
            o.candidates.append(Candidate(r["score"], r["gain"], rule, code_rule, ip, ineg))

    # -- pairs and triples ----------------------------------------------------------------

    def _tuple_features(self, todo: list[OpenNode], arity: int) -> list[list[int]]:
        """Features of every open node whose combinations are searched."""
        cfg = self.cfg
        limit = cfg.pair_features(self.d) if arity == 2 else cfg.triple_features(self.d)
        return [sorted(o.ranked[: min(limit, cfg.top_k)]) for o in todo]

    def _bins(self, o: OpenNode, fs: list[int], grid, arity: int) -> T.Grid:
        """Bins of the features ``fs`` of a node and their tuples."""
        tables, sizes = [], []
        for f in fs:
            tests = np.array([c for c, _ in grid(o, f)])
            tables.append(tests if f in self.wide else np.searchsorted(tests, np.arange(self.enc.codes(f)), "right"))
            sizes.append(len(tests) + 1)
        return T.Grid(fs, tables, sizes, list(combinations(range(len(fs)), arity)))

    def _grid(self, arity: int):
        """Cuts used for a tuple size: triples take every step-th one."""
        def cuts_of(o: OpenNode, f: int) -> list[tuple[int, float]]:
            cuts = o.cuts[f]
            step = max(1, (len(cuts) + 1) // self.cfg.max_bins_3d) if arity == 3 else 1
            return [c for i, c in enumerate(cuts) if (i + 1) % step == 0]
        return cuts_of

    def _coarse(self, o: OpenNode, f: int) -> list[tuple[float, float]]:
        """Cuts used in clauses."""
        nb = len(o.cuts[f]) + 1
        step = max(1, nb // self.cfg.cnf_thresholds)
        return [o.cuts[f][i - 1] for i in range(step, nb, step)]

    def _score_tuples(self, todo: list[OpenNode]) -> None:
        """Best regions of all pairs and triples and all gainful clauses, from one pass."""
        cfg = self.cfg
        grids: dict[tuple[int, int], T.Grid] = {}
        cuts_of = {T.PAIRS: self._grid(2), T.TRIPLES: self._grid(3), T.EXTRA: self._grid(2), T.CLAUSES: self._coarse}
        for slot, o in enumerate(todo):
            for kind, arity in ((T.PAIRS, 2), (T.TRIPLES, 3)):
                if any(self._wants(w, kind) for w in o.group):
                    grids[(kind, slot)] = self._bins(o, self._tuple_features([o], arity)[0], cuts_of[kind], arity)
            if self.extra_pairs and any(self._wants(w, T.EXTRA) for w in o.group):
                fs = sorted({f for p in self.extra_pairs for f in p if f in o.cuts})
                extra = self._bins(o, fs, cuts_of[T.EXTRA], 2)
                wanted = {tuple(sorted(p)) for p in self.extra_pairs}
                extra.tuples = [(i, j) for i, j in extra.tuples if (fs[i], fs[j]) in wanted]
                grids[(T.EXTRA, slot)] = extra
            if any(self._wants(w, T.CLAUSES) for w in o.group):
                grids[(T.CLAUSES, slot)] = self._bins(o, sorted(o.ranked[: cfg.cnf_features]), self._coarse, 2)
        grids = {k: g for k, g in grids.items() if g.tuples}
        if not grids:
            return
        # what the trees of a node search, by (kind, slot)
        regions = {(kind, slot): regions_for(set().union(*[self.families[w.node.tree_id] for w in todo[slot].group if self._wants(w, kind)]), 3 if kind == T.TRIPLES else 2)
                   for kind, slot in grids if kind != T.CLAUSES}
        sizes = {k: g.sizes for k, g in grids.items()}
        min_leaf = cfg.min_samples_leaf

        def finish(key: tuple, arrays: list[np.ndarray]) -> list[tuple]:
            kind, slot, *places = key
            shape = [sizes[(kind, slot)][k] for k in places if k >= 0]
            both = arrays[0].reshape(*shape, 2)
            counts = [both[..., 1], both[..., 0]]
            pad = [-1] * (3 - len(shape))
            if kind != T.CLAUSES:
                return [(*key, region, *r[: len(shape)], *pad, *r[len(shape) :]) for region, *r in best_cuts(counts, regions[(kind, slot)], min_leaf)]
            out = []
            if min(shape) > 1:
                for region, score, gain, ip, ineg in region_scores(counts, [r for r in regions_of(2) if r != "X"], min_leaf, 1):
                    out += [(*key, region, int(i), int(j), -1, float(score[i, j]), float(gain[i, j]), float(ip[i, j]), float(ineg[i, j])) for i, j in np.argwhere(score > 0)]
            return out

        parts = T.count(self.blocks, self.router(todo), T.Tuples(grids, self.raw, self.wide), 5)
        schema = "kind int, slot int, i int, j int, k int, region string, bi int, bj int, bk int, score double, gain double, ip double, ineg double"
        # tuples x regions of the lot's nodes, and their coarse clauses
        found = T.merged(parts, 5, finish, schema).toPandas().to_dict("records")
        best: dict[tuple, dict] = {}
        clauses: dict[int, list] = {}
        for r in found:
            if r["kind"] == T.CLAUSES:
                clauses.setdefault(r["slot"], []).append(r)
                continue
            order = (-round(r["score"], 12), *(r[c] for c in ("i", "j", "k", "bi", "bj", "bk")))
            key = r["kind"], r["slot"], r["region"]
            if key not in best or order < best[key][0]:
                best[key] = order, r
        for (kind, slot, region), (_, r) in sorted(best.items()):
            o, fs = todo[slot], grids[(kind, slot)].features
            used = [(fs[r[p]], r[b]) for p, b in zip("ijk", ("bi", "bj", "bk")) if r[p] >= 0]
            picks = [cuts_of[kind](o, f)[b] for f, b in used]
            for w in o.group:
                if self._wants(w, kind):
                    self._add(w, region, [f for f, _ in used], [c for c, _ in picks], [t for _, t in picks], r)
        if clauses:
            self._score_cnf(todo, {slot: self._clauses(todo[slot], grids[(T.CLAUSES, slot)].features, rs) for slot, rs in clauses.items()})

    def _score_compare(self, todo: list[OpenNode]) -> None:
        """x_i <= x_j for the node's pairs."""
        pairs = {slot: list(combinations(self._tuple_features([o], 2)[0], 2)) for slot, o in enumerate(todo)}
        raw, min_leaf = self.raw, self.cfg.min_samples_leaf

        def truths(ps: list[tuple[int, int]]):
            return lambda b, rows: [b.x[raw[i]][rows] <= b.x[raw[j]][rows] for i, j in ps]

        totals = {slot: (o.node.n_pos, o.node.n_neg) for slot, o in enumerate(todo)}

        def finish(key: tuple, arrays: list[np.ndarray]) -> list[tuple]:
            (slot,) = key
            n = len(pairs[slot])
            neg, pos = (a.diagonal() for a in arrays[0].reshape(2, n, n))
            return _best_row(slot, pos, neg, *totals[slot], 1, min_leaf)

        counter = T.Together({slot: truths(ps) for slot, ps in pairs.items() if ps})
        found = T.merged(T.count(self.blocks, self.router(todo), counter, 1), 1, finish, _BEST_ROW)
        for r in found.collect():
            o = todo[r["slot"]]
            i, j = pairs[r["slot"]][r["p"]]
            for w in o.group:
                if self._wants(w, T.EXTRA):
                    family = HORN if HORN in self.families[w.node.tree_id] else ANTIHORN
                    rule = Rule.of("or", family, Literal(i, "LE", 0.0, j), gain=r["score"])
                    w.candidates.append(Candidate(r["score"], r["gain"], rule, rule, r["ip"], r["ineg"]))

    # -- two-clause rules -------------------------------------------------------------------

    def _clauses(self, o: OpenNode, fs: list[int], rows: list[dict]) -> list[list[tuple]]:
        """Clauses (feature, operator, test, threshold) of a node by rank."""
        out = []
        for r in rows:
            used = [fs[r["i"]], fs[r["j"]]]
            picks = [self._coarse(o, f)[b] for f, b in zip(used, (r["bi"], r["bj"]))]
            clause = [(f, "LT" if s == "H" else "GE", c, t) for f, (c, t), s in zip(used, picks, r["region"])]
            out.append((round(r["score"], 12), clause))
        out.sort(key=lambda e: (-e[0], e[1]))
        return [clause for _, clause in out]

    def _score_cnf(self, todo: list[OpenNode], clauses: dict[int, list[list[tuple]]]) -> None:
        """(a or b) and (c or d): rank clauses by their own gain, then try pairs of them.

        The truths of the kept clauses are multiplied with each other, which counts all pairs at once.
        """
        cfg, min_leaf = self.cfg, self.cfg.min_samples_leaf
        kept: dict[int, tuple[list, list[tuple[int, int]]]] = {}
        for slot, cl in clauses.items():
            pairs = clause_pairs(len(cl), [frozenset(l[0] for l in c) for c in cl], cfg.cnf_candidates)
            if pairs:
                used = sorted({k for pair in pairs for k in pair})
                kept[slot] = [cl[k] for k in used], [(used.index(a), used.index(b)) for a, b in pairs]
        if not kept:
            return
        router = self.router(todo)

        def truths(top: list):
            def of(b: T.Block, rows) -> list[np.ndarray]:
                above = {(f, c): router.literal(b, Literal(f, "GE", c), rows) for f, c in {(f, c) for clause in top for f, _, c, _ in clause}}
                return [np.logical_or.reduce([above[(f, c)] if op == "GE" else ~above[(f, c)] for f, op, c, _ in clause]) for clause in top]

            return of

        totals = {slot: (o.node.n_pos, o.node.n_neg) for slot, o in enumerate(todo)}
        pairs = {slot: tuple(np.array(ps).T) for slot, (_, ps) in kept.items()}
        n_clauses = {slot: len(top) for slot, (top, _) in kept.items()}

        def finish(key: tuple, arrays: list[np.ndarray]) -> list[tuple]:
            (slot,) = key
            neg, pos = (a[pairs[slot]] for a in arrays[0].reshape(2, n_clauses[slot], n_clauses[slot]))
            return _best_row(slot, pos, neg, *totals[slot], 2, min_leaf)

        counter = T.Together({slot: truths(top) for slot, (top, _) in kept.items()})
        for r in T.merged(T.count(self.blocks, router, counter, 1), 1, finish, _BEST_ROW).collect():
            top, ps = kept[r["slot"]]
            pick = [top[i] for i in ps[r["p"]]]
            rule = Rule("cnf", tuple(tuple(Literal(f, op, t) for f, op, _, t in c) for c in pick), SQUARE2CNF, r["score"]).check()
            code = Rule("cnf", tuple(tuple(Literal(f, op, c) for f, op, c, _ in cl) for cl in pick), SQUARE2CNF)
            for w in todo[r["slot"]].group:
                if self._wants(w, T.CLAUSES):
                    w.candidates.append(Candidate(r["score"], r["gain"], rule, code, r["ip"], r["ineg"]))

    # -- look-ahead ---------------------------------------------------------------------------

    def _look_ahead(self, todo: list[OpenNode]) -> None:
        """Re-rank the best candidates by gain plus the best next single test of both sides."""
        cfg = self.cfg
        picked = {slot: sorted(o.candidates, key=Candidate.order)[: cfg.look_ahead_top] for slot, o in enumerate(todo) if o.candidates}
        if not picked:
            return
        router, min_leaf = self.router(todo), cfg.min_samples_leaf
        grids = {slot: self._bins(todo[slot], sorted(todo[slot].ranked[: cfg.top_k]), self._grid(1), 1) for slot in picked}
        sizes = {slot: g.sizes for slot, g in grids.items()}

        def finish(key: tuple, arrays: list[np.ndarray]) -> list[tuple]:
            best, at, n = 0.0, 0, 0.0
            for size in sizes[key[0]]:
                neg, pos = arrays[0][at : at + 2 * size].reshape(size, 2).T
                at, n = at + 2 * size, float(neg.sum() + pos.sum())
                gain, ok = _gains(np.cumsum(pos), np.cumsum(neg), pos.sum(), neg.sum(), min_leaf)
                best = max(best, float(gain[ok].max(initial=0.0)))
            return [(*key, best, n)]

        counter = T.Sides(grids, {slot: [c.code_rule for c in cs] for slot, cs in picked.items()}, router)
        bonus: dict[tuple, float] = {}
        for r in T.merged(T.count(self.blocks, router, counter, 3), 3, finish, "slot int, cand int, side int, g double, n double").collect():
            share = r["g"] * r["n"] / todo[r["slot"]].node.n
            bonus[(r["slot"], r["cand"])] = bonus.get((r["slot"], r["cand"]), 0.0) + share
        for slot, top in picked.items():
            ranked = sorted(enumerate(top), key=lambda e: (-round(e[1].score + cfg.look_ahead_gamma * bonus.get((slot, e[0]), 0.0), 12), e[0]))
            todo[slot].candidates = [c for _, c in ranked]

    def _interactions(self) -> list[tuple[int, int]]:
        """Pairs whose joint median split says more than either single one.

        Medians and single gains of all features come from one histogram; pairs are only
        formed inside the candidate pool, so the work does not grow with d squared.
        """
        df, pos = self.enc.df, F.when(F.col("y") == 1, F.col("w")).otherwise(F.lit(0.0))
        hist = df.select("y", "w", F.posexplode("c").alias("f", "code")).groupBy("f", "code").agg(F.sum(pos).alias("pos"), F.sum(F.col("w") - pos).alias("neg"))
        whole, n = W.partitionBy("f"), F.col("pos") + F.col("neg")
        cum = hist.withColumns({"cum": F.sum(n).over(whole.orderBy("code").rowsBetween(W.unboundedPreceding, 0)), "tot": F.sum(n).over(whole)})
        mid = F.min(F.when(F.col("cum") * 2 > F.col("tot"), F.col("code"))).over(whole)  # codes of one feature
        halves = cum.withColumn("mid", mid).withColumn("hi", F.col("code") >= F.col("mid"))
        side = lambda c: F.sum(F.when(F.col("hi"), F.col(c)).otherwise(F.lit(0.0)))
        per = halves.groupBy("f", "mid").agg(side("pos").alias("ip"), side("neg").alias("ineg"), F.sum("pos").alias("tp"), F.sum("neg").alias("tn"))
        gain = information_gain(F.col("tp"), F.col("tn"), F.col("ip"), F.col("ineg"))
        u = unit_hash(self.cfg.seed, "extra", F.col("f"))
        rows = per.select("f", "mid", F.round(gain, 12).alias("g"), u.alias("u")).collect()  # one row per feature
        top = max(30, int(3 * self.d**0.5))
        ranked = sorted(rows, key=lambda r: (-r["g"], r["f"]))
        extra = sorted(ranked[top:], key=lambda r: (r["u"], r["f"]))[: max(10, top // 3)]
        pool = sorted(ranked[:top] + extra, key=lambda r: r["f"])
        names = [f"b{r['f']}" for r in pool]
        bits = df.select("y", "w", *[(F.col("c")[r["f"]] >= r["mid"]).cast("int").alias(f"b{r['f']}") for r in pool])
        found = interaction_scan(bits, names, w="w").select("fi", "fj").collect()
        return [tuple(sorted((int(r["fi"][1:]), int(r["fj"][1:])))) for r in found]


_BEST_ROW = "slot int, p int, score double, gain double, ip double, ineg double"


def _gains(ip: np.ndarray, ineg: np.ndarray, tp: float, tn: float, min_leaf: int) -> tuple[np.ndarray, np.ndarray]:
    """Information gains of splits given by the counts inside, and which leave enough rows on both sides."""
    inside, n = ip + ineg, tp + tn
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = entropy_of(np.array(tp), np.array(tn)) - inside / n * entropy_of(ip, ineg) - (n - inside) / n * entropy_of(tp - ip, tn - ineg)
    ok = (inside >= min_leaf) & (n - inside >= min_leaf) & (inside > 0) & (inside < n)
    return np.maximum(gain, 0.0), ok


def _best_row(slot: int, ip: np.ndarray, ineg: np.ndarray, tp: float, tn: float, arity: int, min_leaf: int) -> list[tuple]:
    """The first of the best splits as one row, if its penalized gain is positive."""
    gain, ok = _gains(ip, ineg, tp, tn, min_leaf)
    n = tp + tn
    score = np.round(np.where(ok, gain - (arity + 1.0) * np.log(max(n, 2.0)) / (2.0 * n), -1.0), 12)
    p = int(np.argmax(score))
    return [(slot, p, float(score[p]), float(gain[p]), float(ip[p]), float(ineg[p]))] if score[p] > 0 else []


def _ranked(cuts: pd.DataFrame, fresh: bool, wanted: list[int], cfg: FitConfig, by_information: bool,
            given: dict[int, float] | None = None) -> pd.DataFrame:
    """Cuts of a node's best features, and its best single cut; one row per distinct split of the rows."""
    cuts = cuts.sort_values(["f", "threshold"], kind="stable").drop_duplicates(["f", "cum_pos", "cum_neg"], ignore_index=True)
    f, cp, cn = (cuts[c].to_numpy() for c in ("f", "cum_pos", "cum_neg"))
    tp, tn = cuts["tot_pos"].to_numpy(), cuts["tot_neg"].to_numpy()
    n, left = tp + tn, cp + cn
    whole = entropy_of(tp, tn)
    gain = np.maximum(whole - left / n * entropy_of(cp, cn) - (n - left) / n * entropy_of(tp - cp, tn - cn), 0.0)
    ok = (left >= cfg.min_samples_leaf) & (n - left >= cfg.min_samples_leaf) & (left > 0) & (left < n)
    score = np.where(ok & (gain > 0), gain - 2.0 * np.log(np.maximum(n, 2.0)) / (2.0 * n), -1.0)
    score[score <= 0] = -1.0
    start = np.flatnonzero(np.concatenate([[True], f[1:] != f[:-1]]))
    if given is not None:
        per = np.array([given[k] for k in f[start].tolist()])
    elif by_information:  # plug-in mutual information of label and bin
        head = np.zeros(len(f), bool)
        head[start] = True
        p, q = (np.diff(c, prepend=0.0) + np.where(head, np.concatenate([[0.0], c[:-1]]), 0.0) for c in (cp, cn))
        last = np.append(start[1:], len(f)) - 1
        rest = np.add.reduceat((p + q) * entropy_of(p, q), start)
        lp, lq = (tp - cp)[last], (tn - cn)[last]
        per = np.maximum(whole[start] - (rest + (lp + lq) * entropy_of(lp, lq)) / n[start], 0.0)
    else:
        use = gain
        if cfg.use_gain_ratio:
            info = entropy_of(left, n - left)
            with np.errstate(divide="ignore", invalid="ignore"):
                use = np.where(gain <= 0, -1.0, np.where(info <= 1e-10, gain, gain / info))
        per = np.maximum.reduceat(np.where(ok, np.maximum(use, 0.0), 0.0), start)
    names = f[start]
    ranks = np.empty(len(names), int)
    ranks[np.lexsort((names, -np.round(per, 12)))] = np.arange(1, len(names) + 1)
    kept = np.isin(names, wanted) | (fresh & (ranks <= cfg.top_k))
    of = np.cumsum(np.concatenate([[True], f[1:] != f[:-1]])) - 1
    first = np.zeros(len(f), bool)
    first[np.argmax(np.round(score, 12))] = True  # the first of the best, by feature and threshold
    out = pd.DataFrame({"slot": cuts["slot"], "f": f, "cut_code": cuts["cut_code"], "threshold": cuts["threshold"], "feature_score": per[of],
                        "score": score, "gain": gain, "ip": cp, "ineg": cn, "first": first, "keep": kept[of]})
    return out[out["keep"] | out["first"]]
