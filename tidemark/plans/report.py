"""Reports: Markdown, HTML and charts from small collected frames."""

from __future__ import annotations

import html
import re

from pyspark.sql import DataFrame


def pct(x: float) -> str:
    return f"{x * 100:.1f}%"


def table(headers: list[str], rows: list[list]) -> list[str]:
    return ["| " + " | ".join(headers) + " |", "|" + "---|" * len(headers), *("| " + " | ".join(str(c) for c in r) + " |" for r in rows)]


def quality_report(funnel: DataFrame, rates: DataFrame, categories: DataFrame, coverage: DataFrame, source: str) -> str:
    """Data quality: the funnel, null rates, categories and date coverage."""
    steps = funnel.orderBy("step").collect()
    span = coverage.first()
    lines = ["# Data Quality", "", f"- **Source:** {source}", f"- **Rows:** {steps[0]['before']:,} raw, {steps[-1]['after']:,} clean", f"- **Dates:** {span['first_date']} to {span['last_date']}, {span['n_months']} months", "", "## Funnel", ""]
    lines += table(["Step", "Before", "After", "Dropped", "%"], [[r["label"], f"{r['before']:,}", f"{r['after']:,}", f"{r['dropped']:,}", f"{r['pct_dropped']:.1f}"] for r in steps])
    lines += ["", "## Null rates", "", *table(["Column", "Null rate"], [[r["column"], pct(r["null_rate"] or 0)] for r in rates.collect()])]
    lines += ["", "## Categories", "", *table(["Category", "Rows", "Share"], [[r["value"], f"{r['n']:,}", pct(r["share"])] for r in categories.limit(50).collect()])]
    return "\n".join(lines) + "\n"


def themes_report(summary: DataFrame) -> str:
    lines = ["# Themes", ""]
    for r in summary.collect():
        lines += [f"## {r['label']}", "", f"- **Records:** {r['n_docs']:,} ({pct(r['share'])})", f"- **Keywords:** {', '.join(r['keywords'])}"]
        lines += [f"> {text[:200]}" for text in (r["examples"] if "examples" in summary.columns else [])] + [""]
    return "\n".join(lines) + "\n"


def run_report(summary: DataFrame, dry_run: bool) -> str:
    s = summary.first().asDict()
    rows = [[k.replace("_", " "), f"{v:,.4f}" if isinstance(v, float) else f"{v:,}" if v is not None else "n/a"] for k, v in s.items()]
    return "\n".join(["# Extraction Run", "", f"- **Mode:** {'dry run' if dry_run else 'live'}", "", *table(["Measure", "Value"], rows)]) + "\n"


def evaluation_report(evaluated: DataFrame, best: str, n: int, dry_run: bool) -> str:
    names = ["variant", "acc_sentiment_label", "acc_issue_category", "acc_severity", "acc_is_actionable", "mae_sentiment_score"]
    rows = [[r[c] if c == "variant" else f"{r[c]:.3f}" for c in names] for r in evaluated.orderBy("variant").collect()]
    return "\n".join(["# Prompt Variants", "", f"- **Gold records:** {n}", f"- **Mode:** {'dry run' if dry_run else 'live'}", f"- **Winner:** **{best}**", "", *table(names, rows)]) + "\n"


def model_report(metrics: dict) -> str:
    lines = ["# Predictive Model", "", f"- **Target:** {metrics['target']}, base rate {pct(metrics['base_rate'])}", f"- **Train:** {metrics['n_train']:,}, **test:** {metrics['n_test']:,}", ""]
    rows = [[name, *(f"{metrics[name][k]:.3f}" if metrics[name][k] is not None else "n/a" for k in ("roc_auc", "pr_auc", "brier"))] for name in ("boosting", "logistic")]
    lines += table(["Model", "ROC-AUC", "PR-AUC", "Brier"], rows)
    lines += ["", "## Importance", "", *table(["Feature", "Loss of ROC-AUC"], [[f["feature"], f"{f['importance']:.4f}"] for f in metrics.get("importance", [])])]
    return "\n".join(lines) + "\n"


def statistics_report(payload: dict) -> str:
    lines = ["# Statistics", "", f"- **Design sample:** {payload['design_n']:,} for ±{pct(payload['margin'])} at {pct(payload['confidence'])}", ""]
    for kind in ("prevalence", "change", "sentiment"):
        found = [f for f in payload["findings"] if f["kind"] == kind]
        lines += [f"## {kind.title()}", "", *(f"- {f['interpretation']}" for f in found), ""]
    return "\n".join(lines) + "\n"


def headlines(findings: list[dict], metrics: dict | None) -> list[str]:
    """One line each for prevalence, change, the model and mood, as far as there is something to say."""
    by_kind = {kind: [f for f in findings if f["kind"] == kind] for kind in ("prevalence", "change", "sentiment")}
    theme = next(iter(sorted(by_kind["prevalence"], key=lambda f: -f["estimate"])), None)
    mover = next(iter(sorted((f for f in by_kind["change"] if f.get("significant")), key=lambda f: f["p_corrected"])), None)
    mood = next((f for f in by_kind["sentiment"] if f["label"].endswith(": negative")), None)
    auc = ((metrics or {}).get("boosting") or {}).get("roc_auc")
    lines = [
        theme and f"**{theme['label']}** is the theme of {pct(theme['estimate'])} of records (between {pct(theme['ci_low'])} and {pct(theme['ci_high'])}).",
        f"{dict(emerging='📈', fading='📉').get(mover['direction'], '')} **{mover['label']}**: {mover['direction']}, corrected p {mover['p_corrected']:.3f}." if mover else "Between the two periods no theme's share changed significantly.",
        auc is not None and f"On records after the split the outcome model's ROC-AUC is {auc:.3f}.",
        mood and f"{pct(mood['estimate'])} of analysed records are negative.",
    ]
    return [line for line in lines if line]


def insight_report(payload: dict, metrics: dict | None, charts: dict[str, bool]) -> str:
    findings = payload["findings"]
    lines = ["# Insight Report", "", "## Headlines", "", *(f"- {h}" for h in headlines(findings, metrics)), ""]
    for name, made in charts.items():
        if made:
            lines += [f"![{name}]({name}.png)", ""]
    for kind, title in (("prevalence", "Themes"), ("change", "Changes"), ("sentiment", "Sentiment")):
        found = [f for f in findings if f["kind"] == kind]
        if found:
            lines += [f"## {title}", "", *table(["Finding", "Estimate", "95% CI"], [[f["label"], pct(f["estimate"]), f"{pct(f['ci_low'])}–{pct(f['ci_high'])}"] for f in found]), ""]
    if metrics:
        lines += ["## Model", "", *model_report(metrics).splitlines()[2:], ""]
    return "\n".join(lines) + "\n"


def to_html(markdown: str, title: str) -> str:
    """Headings, tables, lists, images and paragraphs of the reports above."""
    out, open_block = [], ""

    def inline(s: str) -> str:
        s = html.escape(s, quote=False)
        s = re.sub(r"!\[([^\]]*)\]\(([^)]*)\)", r'<img alt="\1" src="\2">', s)
        return re.sub(r"\*\*(.+?)\*\*", r"<strong>\1</strong>", s)

    def switch(kind: str) -> None:
        nonlocal open_block
        if open_block != kind:
            if open_block:
                out.append(f"</{open_block}>")
            if kind:
                out.append(f"<{kind}>")
            open_block = kind

    for line in markdown.splitlines():
        heading = re.match(r"(#{1,3}) (.*)", line)
        if line.startswith("|"):
            if re.fullmatch(r"\|[-:| ]+\|", line):
                continue
            cell = "td" if open_block == "table" else "th"
            switch("table")
            out.append("<tr>" + "".join(f"<{cell}>{inline(c.strip())}</{cell}>" for c in line.strip("|").split("|")) + "</tr>")
        elif line.startswith("- "):
            switch("ul")
            out.append(f"<li>{inline(line[2:])}</li>")
        else:
            switch("")
            if heading:
                level = len(heading[1])
                out.append(f"<h{level}>{inline(heading[2])}</h{level}>")
            elif line.strip():
                out.append(f"<p>{inline(line)}</p>")
    switch("")
    return f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{html.escape(title)}</title></head><body>\n' + "\n".join(out) + "\n</body></html>\n"


def draw(path: str, kind: str, rows: list[dict]) -> bool:
    """One chart; false where the plotting library is not installed or there is nothing to draw."""
    try:
        import matplotlib

        matplotlib.use("Agg")
        import matplotlib.pyplot as plt
    except ImportError:
        return False
    if not rows:
        return False
    fig, ax = plt.subplots(figsize=(9, 5))
    if kind == "prevalence":
        for theme in sorted({r["theme_id"] for r in rows}):
            own = sorted((r for r in rows if r["theme_id"] == theme), key=lambda r: r["year_month"])
            ax.plot([r["year_month"] for r in own], [r["share"] for r in own], label=str(theme))
            ax.fill_between([r["year_month"] for r in own], [r["low"] for r in own], [r["high"] for r in own], alpha=0.15)
        ax.legend()
    else:
        ax.barh([r["label"] for r in rows][::-1], [r["value"] for r in rows][::-1], xerr=[r.get("error", 0) for r in rows][::-1])
    fig.tight_layout()
    fig.savefig(path)
    plt.close(fig)
    return True
