"""The profile of a table: roles, relations, groupings, contexts, shapes and techniques."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame

from assay.plans import columns as C
from assay.plans import distributions as D
from assay.plans import groupings as G
from assay.plans import relations as R
from assay.plans import structure as S

TOP_CANDIDATES = 10
EXTENDED_MAX_GROUPS = 3 * G.MAX_GROUPS


@dataclass
class Profile:
    """Profile rows on the driver; ``tables`` gives them back as DataFrames."""
    row_count: int
    columns: list[S.Column]
    relations: list[dict] = field(default_factory=list)
    dimensions: list[S.Dimension] = field(default_factory=list)
    hierarchy: list[str] = field(default_factory=list)
    contexts: list[S.Context] = field(default_factory=list)
    candidates: list[dict] = field(default_factory=list)
    recommended: dict | None = None
    extended: dict | None = None
    shapes: dict[str, dict] = field(default_factory=dict)
    statistics: dict[str, dict] = field(default_factory=dict)
    techniques: list[dict] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)

    def with_role(self, *roles: str) -> list[str]:
        return [c.name for c in self.columns if c.role in roles]

    def tables(self, spark) -> dict[str, DataFrame]:
        """The profile as one table per kind of record."""
        text = {
            "column_profile": ([(c.name, c.dtype, c.role, c.purpose, c.cardinality,
                                 c.cardinality_ratio, c.null_fraction, c.samples)
                                for c in self.columns],
                               "name string, dtype string, role string, purpose string, "
                               "cardinality bigint, cardinality_ratio double, "
                               "null_fraction double, sample_values array<string>"),
            "column_relationship": ([(r["col_a"], r["col_b"], r["relationship"], r["strength"])
                                     for r in self.relations],
                                    "col_a string, col_b string, relationship string, "
                                    "strength double"),
            "dimension": ([(d.name, d.columns, d.cardinality, d.purpose, d.parent, d.samples)
                           for d in self.dimensions],
                          "name string, columns array<string>, cardinality bigint, "
                          "purpose string, parent string, sample_values array<string>"),
            "analysis_context": ([(c.name, c.description, c.group_by, c.compare_across,
                                   c.hold_fixed, c.expected_groups, c.use_case)
                                  for c in self.contexts],
                                 "name string, description string, group_by array<string>, "
                                 "compare_across string, hold_fixed array<string>, "
                                 "expected_groups bigint, use_case string"),
            "grouping_candidate": ([(g["columns"], g["group_count"], g["min_group_size"],
                                     g["median_group_size"], g["size_cv"],
                                     g["rows_covered_pct"], g["score"])
                                    for g in self.candidates],
                                   "columns array<string>, group_count bigint, "
                                   "min_group_size bigint, median_group_size double, "
                                   "size_cv double, rows_covered_pct double, score double"),
            "distribution_profile": ([(n, s["skewness"], s["kurtosis"], s["normality_stat"],
                                       s["normality_pvalue"], s["normality_test"], s["is_normal"],
                                       s["modality"], s["n_modes"], s["suggested_transform"])
                                      for n, s in self.shapes.items()],
                                     "name string, skewness double, kurtosis double, "
                                     "normality_stat double, normality_pvalue double, "
                                     "normality_test string, is_normal boolean, modality string, "
                                     "n_modes int, suggested_transform string"),
            "technique": ([(t["technique"], t["columns"], t["priority"], t["rationale"])
                           for t in self.techniques],
                          "technique string, columns array<string>, priority string, "
                          "rationale string"),
        }
        return {k: spark.createDataFrame(rows, schema) for k, (rows, schema) in text.items()}

    def to_json(self) -> str:
        """Compact form as JSON text."""
        return json.dumps(asdict(self), default=str, sort_keys=True)


def _as_key_scores(df: DataFrame, keys, profile_args: dict, **kw) -> dict[frozenset, dict]:
    """Scores by set of key columns: the order of a key does not change its groups."""
    unique = list({frozenset(k): tuple(k) for k in reversed(keys)}.values())[::-1]
    if not unique:
        return {}
    rows = G.evaluate_groupings(df, unique, **profile_args, **kw).collect()
    return {frozenset(r["columns"]): r.asDict() for r in rows}


def _choose_override(df, wanted, extend, facts, args, out: Profile) -> None:
    """Requested key first, then its usable part; ``extend`` adds a finer key beside it."""
    names = {c.name: c for c in facts}
    missing = [c for c in wanted if c not in names]
    sparse = [c for c in wanted if c in names
              and names[c].null_fraction > G.CANDIDATE_NULL_CEILING]
    plain = {k: v for k, v in args.items() if k not in ("measures", "ordinal")}
    if not missing:
        full = _as_key_scores(df, [tuple(wanted)], plain).get(frozenset(wanted))
        if full:
            out.recommended = full
            trial = list(wanted)
            for col in extend:
                if col not in names or col in wanted:
                    continue
                if names[col].null_fraction >= G.CANDIDATE_NULL_CEILING:
                    continue
                longer = tuple([*trial, col])
                found = _as_key_scores(df, [longer], plain, max_groups=EXTENDED_MAX_GROUPS)
                if frozenset(longer) in found:
                    trial, out.extended = list(longer), found[frozenset(longer)]
                else:
                    out.warnings.append(f"extension column {col} gives too many groups")
            return
    usable = tuple(c for c in wanted if c not in missing and c not in sparse)
    if usable and len(usable) < len(wanted):
        part = _as_key_scores(df, [usable], plain).get(frozenset(usable))
        if part:
            out.recommended = part
            out.warnings.append(f"requested key {list(wanted)} used in part: {list(usable)}")
            return
    reasons = [f"columns not found: {missing}"] * bool(missing)
    reasons += [f"columns mostly null: {sparse}"] * bool(sparse)
    out.warnings.append(f"requested key {list(wanted)} rejected: "
                        + ("; ".join(reasons) or "too few or too many groups"))


def profile(df: DataFrame, mode: str = "roles_only", *, group_by: Sequence[str] = (),
            extend_by: Sequence[str] = (), approx_error: float | None = None,
            max_null_fraction: float = 1.0) -> Profile:
    """Profile a table; ``mode="full"`` adds distributions and techniques.

    ``group_by`` overrides the grouping choice. The number of jobs does not depend
    on the number of rows or columns.
    """
    rows = C.column_roles(df, approx_error, exact_counts=approx_error is None).orderBy("ordinal").collect()
    facts = [S.Column(r["name"], r["dtype"], r["role"], r["cardinality"] or 0,
                      r["cardinality_ratio"], r["null_fraction"]) for r in rows]
    total = rows[0]["row_count"] if rows else 0
    out = Profile(total, facts)
    if not total:
        return out
    card = {c.name: c.cardinality for c in facts}
    discrete = [c.name for c in facts if c.role in S.DISCRETE]
    related = [c.name for c in facts if c.role in (*S.DISCRETE, "identifier", "metadata_text")
               and c.cardinality < R.RELATIONSHIP_MAX_CARDINALITY
               and c.null_fraction <= max_null_fraction]
    if discrete:
        top: dict[str, list] = {}
        for r in C.value_counts(df, discrete, 10).orderBy("name", "position").collect():
            top.setdefault(r["name"], []).append(r["value"])
        for c in facts:
            c.samples = top.get(c.name, [])
    if len(related) > 1:
        out.relations = [r.asDict() for r in R.relationships(df, related, card).collect()]
    for c in facts:
        c.purpose = S.first_purpose(c)
    small = [c for c in discrete if card[c] < R.RELATIONSHIP_MAX_CARDINALITY]
    cv = {r["name"]: r["size_cv"] for r in C.level_size_cv(df, small).collect()} if small else {}
    S.refine_purposes(facts, out.relations, cv, max_null_fraction)

    measures = out.with_role("continuous_measurement")
    args = {"measures": measures, "ordinal": out.with_role("ordinal_stage"), "total_rows": total,
            "null_fraction": {c.name: c.null_fraction for c in facts}}
    usable = [c.name for c in facts if c.role in S.DISCRETE
              and c.null_fraction < G.CANDIDATE_NULL_CEILING]
    keys = G.candidate_keys(usable)
    scores = _as_key_scores(df, [*keys, *S.composition_keys(facts)], args)
    purpose = {c.name: c.purpose for c in facts}
    ranked = []
    for k in keys:
        found = scores.get(frozenset(k))
        if found:
            m = G.purpose_multiplier({purpose[c] for c in k})
            ranked.append({**found, "score": found["score"] if m == 1.0 else
                           round(min(found["score"] * m, 1.0), 4)})
    ranked.sort(key=lambda g: -g["score"])
    out.candidates = ranked[:TOP_CANDIDATES]
    if group_by:
        _choose_override(df, group_by, extend_by, facts, args, out)
    if out.recommended is None:
        best = S.compose_grouping(
            facts, lambda k: scores[frozenset(k)]["score"] if frozenset(k) in scores else None)
        out.recommended = scores[frozenset(best)] if best else (ranked[0] if ranked else None)

    out.dimensions = S.dimensions(facts, out.relations, max_null_fraction)
    out.hierarchy = S.hierarchy(out.dimensions, facts, out.relations)
    plan = S.context_plan(out.dimensions, out.hierarchy)
    if plan:
        wanted = list(dict.fromkeys(tuple(c.group_by) for c, _ in plan))
        counts = {wanted[r["key_id"]]: r["groups"]
                  for r in G.count_distinct_keys(df, wanted).collect()}
        for ctx, least in plan:
            ctx.expected_groups = counts.get(tuple(ctx.group_by), 0)
            if ctx.expected_groups >= least:
                out.contexts.append(ctx)
    if mode == "full" and measures:
        out.statistics = {r["name"]: r.asDict() for r in C.continuous_stats(df, measures).collect()}
        out.shapes = {r["name"]: r.asDict() for r in D.distribution_profile(df, measures).collect()}
        groups = out.recommended["group_count"] if out.recommended else None
        out.techniques = S.recommend_techniques(
            measures, out.with_role("ordinal_stage"), out.shapes, groups)
        modal = [n for n in measures if n in out.shapes and out.shapes[n]["n_modes"] >= 2]
        for name in modal[:3] if out.dimensions else []:
            out.contexts.append(S.Context(
                f"subgroup_exploration_{name}",
                f"{name} is {out.shapes[name]['modality']}: look for a hidden split",
                list(out.recommended["columns"]) if out.recommended else [], name, [],
                out.shapes[name]["n_modes"], "subgroup_exploration"))
    return out


def write_profile(spark, found: Profile, folder: str) -> None:
    """Save every profile table as JSON under ``folder``."""
    for name, frame in found.tables(spark).items():
        frame.write.mode("overwrite").json(f"{folder}/{name}")

