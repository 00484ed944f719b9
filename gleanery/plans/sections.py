"""The seven sections of a study's report; every number in the prose comes from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

from gleanery.plans import report, stats

MOST = 50


class Results:
    """Result tables by name; what is missing is left out of a section, not an error."""

    def __init__(self, tables: dict[str, DataFrame | None]):
        self.tables = tables
        self.held: dict[str, tuple[list[str], list]] = {}
        self.longer: set[str] = set()

    def rows(self, name: str) -> list:
        """At most MOST rows of a result table."""
        df = self.tables.get(name)
        if df is None:
            return []
        if name not in self.held:
            rows = df.limit(MOST + 1).collect()
            if len(rows) > MOST:
                self.longer.add(name)
            self.held[name] = (df.columns, rows[:MOST])
        return self.held[name][1]

    def shown(self, name: str, title: str, columns: list[str] | None = None) -> list[str]:
        rows = self.rows(name)
        if not rows:
            return []
        columns = [c for c in columns or self.held[name][0] if c in self.held[name][0]]
        more = [f"_The first {MOST} rows._"] if name in self.longer else []
        return [f"### {title}", report.table(columns, [[r[c] for c in columns] for r in rows]), *more]


def _section(title: str, *parts: list[str] | str) -> str:
    flat = [x for p in parts for x in ([p] if isinstance(p, str) else p) if x]
    return "\n\n".join([f"## {title}", *(flat or ["_not available_"])])


def data(r: Results) -> str:
    audit, note = r.rows("cleaning"), ""
    if audit:
        first, last = audit[0]["rows"], audit[-1]["rows"]
        note = f"Of {first:,} raw reviews {last:,} pass every cleaning step ({100 * last / max(first, 1):.1f} %)."
    return _section("Data", note, r.shown("cleaning", "Rows left after each step", ["step", "rows"]), r.shown("descriptives", "Categories"), r.shown("provenance_checks", "What the sampling supports"))


def leakage(r: Results) -> str:
    score, note = {x["model"][:1]: x["pr_auc"] for x in r.rows("leakage")}, ""
    if {"A", "B", "C", "D"} <= set(score):
        effects = {"history that knows the future": score["A"] - score["C"], "the random split": score["A"] - score["B"]}
        note = f"From the leaky protocol to the honest one PR-AUC goes from {score['A']:.4f} to {score['D']:.4f}. {report.leakage_note(effects)}"
    return _section("Leakage", note, r.shown("leakage", "Four conditions", ["model", "n", "base_rate", "pr_auc", "pr_auc_lift", "roc_auc"]))


def ablation(r: Results) -> str:
    rows = r.rows("ablation")
    best = max(rows[1:], key=lambda x: x["marginal_pr_auc"], default=None)
    note = f"After the first block, {best['model']} adds most ({best['marginal_pr_auc']:+.4f})." if best else ""
    return _section("Feature blocks", note, r.shown("ablation", "Blocks in order", ["step", "model", "n_features", "pr_auc", "pr_auc_lift", "marginal_pr_auc"]))


def models(r: Results) -> str:
    rows = sorted(r.rows("models"), key=lambda x: -x["pr_auc"])
    note = f"The best is {rows[0]['model']}: PR-AUC {rows[0]['pr_auc']:.4f}, {rows[0]['pr_auc'] / max(rows[0]['base_rate'], 1e-9):.2f} times the base rate {rows[0]['base_rate']:.4f}." if rows else ""
    return _section("Models", note, r.shown("models", "Models and single columns", ["model", "features", "base_rate", "pr_auc", "pr_auc_lift", "roc_auc", "lift_10", "f1", "ndcg"]), r.shown("regression", "Regression on log votes"), r.shown("zero_share", "Reviews without a vote"))


def moderation(r: Results) -> str:
    tests = [f"- {x['term']}: {x['coefficient']:+.5f}, p {x['p_value']:.2g}: {x['hypothesis']}" for x in r.rows("interaction") if x["hypothesis"]]
    effects = r.shown("interaction", "Pooled model with interactions", ["term", "coefficient", "std_error", "z", "p_value", "odds_ratio", "effect_at_mean", "effect_error"])
    return _section("Product type", r.shown("category_models", "A model for each category", ["model", "n", "base_rate", "pr_auc", "pr_auc_lift"]), r.shown("constructs", "Mean coefficients by product type"), effects, "\n".join(tests))


def fairness(r: Results) -> str:
    gini = r.rows("concentration")
    note = f"The Gini coefficient of votes is {gini[0]['gini']:.4f}; one review in a hundred holds {100 * gini[0]['top1_share']:.1f} % of them." if gini and gini[0]["gini"] is not None else ""
    return _section("Exposure and ranking", note, r.shown("arrival", "By order of arrival"), r.shown("rankings", "The top of three rankings"), r.shown("segments", "Segments of reviewers", ["segment", "isolated", "reviewers", "pct_of_reviewers", "pct_of_votes", "vote_capture_ratio"]), r.shown("graph", "The graph of reviewers and products"), r.shown("centrality", "Rank against activity"))


def replication(r: Results) -> str:
    counts = ", ".join(f"{x['claims']} {x['verdict']}" for x in r.rows("verdict_counts"))
    note = f"A claim holds if its term has the registered sign at p < {stats.ALPHA} and moves the chance by {100 * stats.MIN_EFFECT:g} point or more. Verdicts: {counts}." if counts else ""
    return _section("Registered claims", note, r.shown("registry", "Claims", ["id", "claim", "source", "rows", "items", "term", "expected"]), r.shown("replication", "Estimates", ["id", "expected", "coefficient", "std_error", "p_value", "effect_at_mean", "verdict"]))


SECTIONS = [data, leakage, ablation, models, moderation, fairness, replication]


def report_of(tables: dict[str, DataFrame | None], title: str = "Results") -> str:
    """The report as Markdown."""
    results = Results(tables)
    return report.document(title, [make(results) for make in SECTIONS])
