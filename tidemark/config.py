"""Configuration: dataclasses filled from YAML; only settings that some operator reads."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, fields, is_dataclass
from pathlib import Path
from typing import Any


# Names and defaults of the settings.


@dataclass
class Columns:
    text_column: str = "Consumer complaint narrative"
    date_column: str = "Date received"
    category_column: str = "Product"
    subcategory_column: str | None = "Sub-product"
    outcome_column: str | None = "Consumer disputed?"
    timely_column: str | None = "Timely response?"
    id_column: str = "Complaint ID"
    company_column: str | None = None
    group_columns: list[str] = field(default_factory=list)


@dataclass
class Paths:
    raw_csv: str = "data/raw/complaints.csv"
    sample_csv: str = "data/sample/sample.csv"
    gold_csv: str = "data/sample/gold.csv"
    processed_dir: str = "data/processed"
    reports_dir: str = "reports"
    prompts_dir: str | None = None


@dataclass
class Ingest:
    min_tokens: int = 5
    dedup_exact: bool = True
    dedup_near: bool = True
    strip_company: bool = True


@dataclass
class Embed:
    backend: str = "hashing"
    model_name: str = ""
    hashing_dim: int = 256
    cache: bool = True


@dataclass
class Themes:
    algorithm: str = "kmeans"
    n_clusters: int = 8
    outlier_quantile: float = 0.05
    min_cluster_size: int = 15
    min_samples: int = 10
    n_components: int = 5
    n_representative_docs: int = 5
    top_n_keywords: int = 10


@dataclass
class Llm:
    model: str = ""
    api_key_env: str = "EXTRACTION_API_KEY"
    url: str = ""
    prompt_version: str = "v3"
    max_concurrency: int = 8
    max_records: int = 2000
    max_spend_usd: float = 5.0
    max_attempts: int = 5
    backoff_base_seconds: float = 1.0
    backoff_max_seconds: float = 30.0
    input_cost_per_1k: float = 0.001
    output_cost_per_1k: float = 0.005
    controlled_vocab: list[str] = field(default_factory=lambda: ["unauthorized_activity", "billing_dispute", "fees_and_charges", "credit_reporting_error", "account_access", "rewards_and_offers", "customer_service", "other"])


@dataclass
class Predict:
    target: str = "timely_response"
    backend: str = "gbt"
    boosting_iterations: int = 300
    importance_repeats: int = 5
    test_fraction: float = 0.25
    threshold: float = 0.5
    embedding_pca_components: int = 16


@dataclass
class Stats:
    confidence_level: float = 0.95
    margin_of_error: float = 0.03
    proportion_ci_method: str = "wilson"
    bootstrap_iterations: int = 2000
    fdr_alpha: float = 0.05
    min_theme_count_for_test: int = 30


@dataclass
class Report:
    output_md: str = "reports/insight_report.md"
    output_html: str | None = None
    top_n_themes: int = 10


@dataclass
class Config:
    seed: int = 42
    columns: Columns = field(default_factory=Columns)
    paths: Paths = field(default_factory=Paths)
    ingest: Ingest = field(default_factory=Ingest)
    embed: Embed = field(default_factory=Embed)
    themes: Themes = field(default_factory=Themes)
    llm: Llm = field(default_factory=Llm)
    predict: Predict = field(default_factory=Predict)
    stats: Stats = field(default_factory=Stats)
    report: Report = field(default_factory=Report)


def _fill(kind: type, values: dict[str, Any]) -> Any:
    """A dataclass from a mapping; keys it does not have are ignored, nested sections of its own too."""
    made = kind()
    flat = dict(values)
    for value in values.values():
        if isinstance(value, dict) and not any(f.name in values and is_dataclass(getattr(made, f.name)) for f in fields(made)):
            flat |= value
    for f in fields(made):
        if f.name in flat:
            now = getattr(made, f.name)
            setattr(made, f.name, _fill(type(now), flat[f.name] or {}) if is_dataclass(now) else flat[f.name])
    return made


def load_config(path: str | Path) -> Config:
    """Read a YAML file; relative paths are resolved against the file's project (the parent of its folder)."""
    import yaml

    path = Path(path)
    if not path.exists():
        raise FileNotFoundError(f"no configuration at {path}")
    values = yaml.safe_load(path.read_text(encoding="utf-8")) or {}
    config = _fill(Config, {**values, **({"seed": values["project"]["seed"]} if "seed" in (values.get("project") or {}) else {})})
    root = path.resolve().parent.parent if path.parent.name == "config" else path.resolve().parent
    for section in (config.paths, config.report):
        for f in fields(section):
            value = getattr(section, f.name)
            if isinstance(value, str) and "/" in value and "://" not in value and not os.path.isabs(value):
                setattr(section, f.name, str(root / value))
    return config


def load_dotenv(path: str | Path) -> dict[str, str]:
    """Set KEY=VALUE lines of a file in the environment, where not set already; returns what was set."""
    done: dict[str, str] = {}
    path = Path(path)
    for line in path.read_text(encoding="utf-8").splitlines() if path.exists() else []:
        line = line.strip()
        if not line or line.startswith("#") or "=" not in line:
            continue
        key, _, value = line.removeprefix("export ").partition("=")
        key, value = key.strip(), value.strip()
        if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'":
            value = value[1:-1]
        if key and key not in os.environ:
            os.environ[key] = done[key] = value
    return done
