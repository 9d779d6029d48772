"""Report tables as small frames, and their rendering on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixed import CONFIRMED_GAP, GROUPS, MODERATE_AUROC, STRONG_AUROC, VERDICTS_EXPLOITED, VERDICTS_SEPARABLE, WEAK_GAP
from .evaluate import wide


def table(acc: DataFrame) -> DataFrame:
    """grp, domain (null: overall), the three accuracies and the gap."""
    return wide(acc).withColumn("gap", F.col("neutralized") - F.col("adversarial"))


def chart(gaps: DataFrame) -> DataFrame:
    """domain (null: overall), a bar for each group; domains are the treatment's, a control that lacks one is 0."""
    of = lambda g: F.max(F.when(F.col("grp") == g, F.col("gap")))
    return gaps.groupBy("domain").agg(of("treatment").alias("treatment"), of("control").alias("control")).where(F.col("treatment").isNotNull()).select("domain", "treatment", F.coalesce("control", F.lit(0.0)).alias("control"))


def lines(rows: DataFrame, line: str, *order: str) -> DataFrame:
    """One row: the lines in order, joined by line feeds. For report tables, whose rows are few by construction."""
    numbered = F.array_sort(F.collect_list(F.struct(*order, F.col(line).alias("line_"))))
    return rows.agg(F.array_join(F.transform(numbered, lambda x: x["line_"]), "\n").alias("report"))


def three(x: float | None) -> str:
    """Three decimals of the exact binary value; nan for what is missing."""
    return f"{float('nan') if x is None else x:.3f}"


def separability_verdict(auroc: float) -> str:
    return VERDICTS_SEPARABLE["strong" if auroc >= STRONG_AUROC else "moderate" if auroc >= MODERATE_AUROC else "none"].format(auroc=auroc)


def exploitation_verdict(treatment: float, control: float) -> str:
    diff = treatment - control
    return VERDICTS_EXPLOITED["confirmed" if diff > CONFIRMED_GAP else "weak" if diff > WEAK_GAP else "none"].format(t=treatment, c=control, diff=diff)


def _grid(head: list[str], rows: list[list[str]]) -> list[str]:
    line = lambda cells: "| " + " | ".join(cells) + " |"
    return [line(head), "|" + "---|" * len(head), *map(line, rows)]


def markdown(classifiers: list[dict], results: list[dict]) -> str:
    """The report from rows of (split, gbm_auroc, logreg_auroc, n_samples) in order and from rows of ``table``."""
    overall = next((r for r in classifiers if r["split"] == "overall"), None)
    if overall is None:
        raise LookupError("no classifier row for split 'overall'")
    of = {(r["grp"], r["domain"]): r for r in results}
    cells = ["original", "neutralized", "adversarial", "gap"]
    domains = {g: sorted(d for h, d in of if h == g and d is not None) for g in GROUPS}
    return "\n".join([
        "# Audit report\n",
        "## Phase 1: separability\n",
        separability_verdict(overall["gbm_auroc"]) + "\n",
        *_grid(["Split", "GBM AUROC", "LogReg AUROC", "N"], [[r["split"], three(r["gbm_auroc"]), three(r["logreg_auroc"]), str(r["n_samples"])] for r in classifiers]),
        "\n## Phase 2: exploitation\n",
        exploitation_verdict(of["treatment", None]["gap"], of["control", None]["gap"]) + "\n",
        "### Overall\n",
        *_grid(["Group", "Original", "Neutralized", "Adversarial", "Exploitation gap"], [[g, *[three(of[g, None][c]) for c in cells]] for g in GROUPS]),
        "\n### By domain\n",
        *_grid(["Group", "Domain", "Original", "Neutralized", "Adversarial", "Exploitation gap"], [[g, d, *[three(of[g, d][c]) for c in cells]] for g in GROUPS for d in domains[g]]),
    ])


def draw(bars: list[dict], path: str) -> bool:
    """Bars of ``chart`` as a picture; False where no plotting library is installed."""
    try:
        import matplotlib
    except ImportError:
        return False
    matplotlib.use("Agg")
    from matplotlib import pyplot

    names = [b["domain"] or "overall" for b in bars]
    figure, axes = pyplot.subplots()
    for k, g in enumerate(GROUPS):
        axes.bar([i + 0.4 * k for i in range(len(names))], [b[g] for b in bars], 0.4, label=g)
    axes.set_xticks([i + 0.2 for i in range(len(names))], names)
    axes.set_ylabel("Artifact exploitation gap")
    axes.legend()
    figure.savefig(path, bbox_inches="tight")
    pyplot.close(figure)
    return True
