"""Configuration: one frozen record of plain values; YAML sections override fields."""

from __future__ import annotations

import dataclasses
import os
import re
from collections.abc import Mapping
from dataclasses import dataclass, field

from gleanworks.functions import vocab

# Default keywords and weights.
TITLE_SIGNAL = (
    "ai", "ml", "machine learning", "llm", "genai", "generative", "agent", "applied scientist", "forward deployed", "fde", "engineer",
    "developer", "architect", "automation", "solutions", "data scientist"
)
TITLE_EXCLUDE = (
    "intern", "internship", "recruiter", "sales", "account executive", "marketing", "customer success", "support engineer",
    "people partner", "talent", "controller", "accountant", "office manager"
)
TITLE_PENALTY = {
    "research scientist": 8, "quantitative researcher": 8, "machine learning researcher": 7, "ai researcher": 6,
    "member of technical staff": 6
}
AGENCY_PENALTY = {
    "staff augmentation": 15, "staffing agency": 15, "staffing firm": 15, "our client": 12, "multiple clients": 12, "talent solutions": 12,
    "consulting firm": 10, "consultancy": 10, "contract-to-hire": 10, "staffing": 8, "recruiter": 8, "c2c": 8
}
APPLIED_DOOR = (
    "forward deployed", "forward-deployed", "fde", "solutions engineer", "solutions architect", "applied ai", "deployment engineer",
    "customer engineer"
)
FIT_WEIGHTS = {
    "forward deployed": 4, "fde": 4, "applied ai": 4, "ai engineer": 3, "ml engineer": 3, "solutions engineer": 3,
    "solutions architect": 3, "automation engineer": 3, "platform engineer": 2, "applied scientist": 2, "developer": 1,
    "agentic": 4, "multi-agent": 4, "agent": 3, "orchestration": 3, "rag": 4, "retrieval-augmented": 4, "retrieval": 3,
    "knowledge base": 3, "llm": 3, "large language model": 3, "genai": 3, "generative ai": 3, "machine learning": 2,
    "foundation model": 2, "ai-first": 3, "ai-native": 3, "ai-powered": 2, "ai": 1, "embeddings": 2, "vector": 2,
    "evals": 2, "evaluation": 1, "prompt engineering": 2, "fine-tuning": 1, "claude": 2, "anthropic": 2,
    "model context protocol": 3, "mcp": 2, "openai": 1, "langchain": 1, "python": 1, "typescript": 1, "react": 1,
    "founding": 5, "founding engineer": 5, "first ai engineer": 5, "greenfield": 3, "0 to 1": 3, "zero to one": 3,
    "own the ai": 4, "internal tooling": 4, "internal tools": 4, "remote": 4, "work from anywhere": 4, "remotely": 3,
    "senior": 1, "lead": 1, "staff": 1,
}


TITLE_QUERIES = (
    "AI Engineer", "Applied AI Engineer", "Machine Learning Engineer", "Forward Deployed Engineer", "LLM Engineer", "Software Engineer LLM"
)


# How deep a walk of each source goes at most.
@dataclass(frozen=True)
class Depth:
    smartrecruiters_max_pages: int = 10
    workday_max_pages: int = 25
    workday_fetch_details: bool = True
    workday_detail_workers: int = 8
    rippling_fetch_details: bool = True
    himalayas_max_pages: int = 10
    himalayas_browse_pages: int = 50
    themuse_max_pages: int = 5
    hn_threads: int = 2


@dataclass(frozen=True)
class Judge:
    """The optional second opinion: where it is asked, and for how many rows."""

    enabled: bool = False
    provider: str = ""
    model: str = ""
    api_key_env: str = ""
    base_url: str = ""
    rerank_top_n: int = 25


# The defaults by which results must agree.
@dataclass(frozen=True)
class Config:
    title_queries: tuple[str, ...] = TITLE_QUERIES
    title_signal: tuple[str, ...] = TITLE_SIGNAL
    exclude_titles: tuple[str, ...] = TITLE_EXCLUDE
    fit_weights: dict[str, int] = field(default_factory=lambda: dict(FIT_WEIGHTS))
    title_penalty: dict[str, int] = field(default_factory=lambda: dict(TITLE_PENALTY))
    agency_penalty: dict[str, int] = field(default_factory=lambda: dict(AGENCY_PENALTY))
    applied_door: tuple[str, ...] = APPLIED_DOOR
    frontier_penalty: int = 10
    local_bonus: int = 10
    score_len_b: float = 0.75
    score_k1: float = 1.2
    avg_jd_tokens: int = 1600
    blob_score_cap: int = 60
    title_score_cap: int = 12
    agency_penalty_cap: int = 15
    tier_strong: int = 30
    tier_look: int = 22
    fuzzy_title_threshold: int = 90
    fuzzy_title_sort_floor: int = 82
    remote_only: bool = True
    location: str = "remote"
    radius_miles: int = 0
    exclude_locations: tuple[str, ...] = vocab.EXCLUDED_PLACES
    allowed_scopes: tuple[str, ...] = ()
    max_age_days: int = 60
    stale_after_days: int = 30
    min_score: int = 22
    depth_sources: tuple[str, ...] | None = None
    breadth_sources: tuple[str, ...] | None = None
    adzuna_app_id_env: str = "ADZUNA_APP_ID"
    adzuna_app_key_env: str = "ADZUNA_APP_KEY"
    adzuna_pages: int = 3
    serpapi_key_env: str = "SERPAPI_KEY"
    serpapi_max_searches_per_run: int = 12
    serpapi_reserve: int = 25
    google_jobs_pages: int = 1
    usajobs_results_per_page: int = 500
    usajobs_max_pages: int = 3
    funnel_auto_grow: bool = True
    funnel_max_new_per_run: int = 25
    funnel_max_probes_per_run: int = 50
    llm: Judge = field(default_factory=Judge)
    harvest_depth: Depth = field(default_factory=Depth)


#: Keys of the file that are named otherwise than the field, by section.
NAMES = {
    "profile": {"signal_titles": "title_signal"},
    "scoring": {
        "title_penalties": "title_penalty", "agency_penalties": "agency_penalty", "length_norm_b": "score_len_b",
        "body_cap": "blob_score_cap", "title_cap": "title_score_cap"
    },
    "sources": {"ats": "depth_sources", "boards": "breadth_sources"},
    "tiers": {"strong": "tier_strong", "worth_a_look": "tier_look"},
    "adzuna": {"app_id_env": "adzuna_app_id_env", "app_key_env": "adzuna_app_key_env", "pages": "adzuna_pages"},
    "google_jobs": {
        "key_env": "serpapi_key_env", "pages": "google_jobs_pages", "max_searches_per_run": "serpapi_max_searches_per_run",
        "reserve": "serpapi_reserve"
    },
    "usajobs": {"results_per_page": "usajobs_results_per_page", "max_pages": "usajobs_max_pages"},
    "funnel": {"auto_grow": "funnel_auto_grow", "max_probes_per_run": "funnel_max_probes_per_run", "max_new_per_run": "funnel_max_new_per_run"},
}
#: Fields that the environment may set, under the field's name in capitals; the file goes before it.
FROM_ENVIRONMENT = (
    "adzuna_pages", "serpapi_max_searches_per_run", "serpapi_reserve", "google_jobs_pages", "usajobs_results_per_page", "usajobs_max_pages"
)
#: Fields that decide where a request goes, or which secret goes with it.
REDIRECTS = {
    "llm.base_url": ("llm", "base_url"), "llm.api_key_env": ("llm", "api_key_env"), "sources.google_jobs.key_env": ("serpapi_key_env",),
    "sources.adzuna.app_key_env": ("adzuna_app_key_env",)
}


def _from_environment(kind: type, names: tuple[str, ...], environ: Mapping[str, str]) -> dict:
    """Whole numbers and truth values that the environment states; what isn't one counts as unset."""
    found, default = {}, kind()
    for name in names:
        said = environ.get(name.upper())
        if said is None:
            continue
        if isinstance(getattr(default, name), bool):
            found[name] = said.strip().lower() not in ("0", "false", "no", "off", "")
        elif re.fullmatch(r"\s*-?\d+\s*", said):
            found[name] = int(said)
    return found


def legal_scope(token: str) -> bool:
    up = str(token).upper()
    return bool(re.fullmatch("[A-Z]{2}(-[A-Z0-9]{1,3})?", up)) or up in {r.upper() for r in vocab.REGIONS} | {"TIMEZONE", "UNSTATED", "ANY"}


def load(text: str, environ: Mapping[str, str] | None = None) -> tuple[Config, list[str]]:
    """Read YAML over the defaults and the environment: unset keys keep those, a scalar for a list is a list of one.

    Warnings name keys that aren't known, scalars that were mended, scopes that no posting can carry, and text that
    isn't YAML at all (then all is default)."""
    import yaml

    environ = os.environ if environ is None else environ
    warnings: list[str] = []
    try:
        doc = yaml.safe_load(text)
    except yaml.YAMLError as e:
        doc, warnings = None, [f"not read as YAML: {type(e).__name__}"]
    values = _from_environment(Config, FROM_ENVIRONMENT, environ)
    depth = _from_environment(Depth, tuple(f.name for f in dataclasses.fields(Depth)), environ)
    judge: dict = {}
    default = Config()
    known = {f.name for f in dataclasses.fields(Config)} - {"llm", "harvest_depth"}

    def inside(own: dict, kind: type, section: str, body: dict) -> None:
        names = {f.name for f in dataclasses.fields(kind)}
        own.update({k: v for k, v in body.items() if k in names and v is not None})
        warnings.extend(f"unknown key {section}.{k}" for k in body if k not in names)

    def take(section: str, key: str, value: object) -> None:
        name = NAMES.get(section, {}).get(key, key)
        if isinstance(value, dict) and key == "harvest_depth":
            inside(depth, Depth, key, value)
        elif isinstance(value, dict) and key in NAMES:
            for k, v in value.items():
                take(key, k, v)
        elif name not in known:
            warnings.append(f"unknown key {key}")
        elif value is not None:
            if isinstance(getattr(default, name), tuple) or name in ("depth_sources", "breadth_sources"):
                if isinstance(value, str):
                    warnings.append(f"{key} should be a list") if name == "allowed_scopes" else None
                    value = [value]
                value = tuple(value)
            if name == "allowed_scopes" and (odd := [x for x in value if not legal_scope(x)]):
                warnings.append(f"{key} has unrecognised {odd}: no posting carries those")
            values[name] = value

    for section, body in (doc if isinstance(doc, dict) else {}).items():
        if section == "llm" and isinstance(body, dict):
            inside(judge, Judge, section, body)
        elif isinstance(body, dict):
            for key, value in body.items():
                take(section, key, value)
        elif body is not None:
            take("", section, body)
    return Config(**values, llm=Judge(**judge), harvest_depth=Depth(**depth)), warnings


def without_redirects(cfg: Config) -> tuple[Config, list[str]]:
    """For a file that was found rather than named: keys that redirect requests are default again; their names, never values."""
    default, ignored = Config(), []
    for name, path in REDIRECTS.items():
        own, usual = cfg, default
        for part in path:
            own, usual = getattr(own, part), getattr(usual, part)
        if own == usual:
            continue
        ignored.append(name)
        cfg = dataclasses.replace(cfg, llm=dataclasses.replace(cfg.llm, **{path[1]: usual})) if len(path) == 2 else dataclasses.replace(cfg, **{path[0]: usual})
    return cfg, ignored
