"""Options as plain data, from nested dicts as a YAML or JSON file gives them; unknown keys are ignored."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any

from patternmill.schema import BATCH_FILES, CANDIDATE_CAP, DEFAULT_TTL, EXCLUDED_REPOS, IGNORED_DIRS, KEYWORD_WEIGHT, MODELS, SEMANTIC_WEIGHT, TTL


@dataclass(frozen=True)
class BatchConfig:
    """How files are ingested. Without analyze chunks go in as they are."""

    batch_size: int = BATCH_FILES
    delay: float = 0.0
    max_retries: int = 3
    retry_delay: float = 1.0
    analyze: bool = True
    min_quality: int = 5

    def __post_init__(self):
        if self.batch_size < 1 or self.max_retries < 1:
            raise ValueError("batch_size and max_retries must be 1 or more")


@dataclass(frozen=True)
class CacheConfig:
    """How long and how many entries a cache holds, and where it is kept."""

    enabled: bool = True
    max_size: int = 1000
    default_ttl: float = DEFAULT_TTL
    ttl: dict[str, float] = field(default_factory=lambda: dict(TTL))

    def __post_init__(self):
        if self.max_size < 1:
            raise ValueError("a cache holds one entry at least")

    def ttl_of(self, kind: str) -> float:
        return float(self.ttl.get(kind, self.default_ttl))


@dataclass(frozen=True)
class SearchConfig:
    """The parts of the hybrid score."""

    enabled: bool = True
    semantic_weight: float = SEMANTIC_WEIGHT
    keyword_weight: float = KEYWORD_WEIGHT
    candidate_cap: int | None = CANDIDATE_CAP


@dataclass(frozen=True)
class EmbeddingConfig:
    """The model and its vectors; a size that is given holds, then the model's, then 384."""

    model: str = "BAAI/bge-base-en-v1.5"
    vector_size: int | None = None

    def dimensions(self) -> int:
        return self.vector_size or MODELS.get(self.model, 384)


@dataclass(frozen=True)
class RepoConfig:
    """Which repositories are listed."""

    include_private: bool = True
    include_orgs: bool = True
    excluded: list[str] = field(default_factory=lambda: list(EXCLUDED_REPOS))


@dataclass(frozen=True)
class Config:
    """S13."""

    batch: BatchConfig = BatchConfig()
    cache: CacheConfig = CacheConfig()
    search: SearchConfig = SearchConfig()
    embedding: EmbeddingConfig = EmbeddingConfig()
    repos: RepoConfig = RepoConfig()
    ignored_dirs: list[str] = field(default_factory=lambda: list(IGNORED_DIRS))


#: Where a settings file keeps each option: section, part and key as the file has them.
SETTINGS = {
    "batch": {"batch_size": "batch.batch_size", "delay": "batch.delay_between_batches", "max_retries": "batch.max_retries", "retry_delay": "batch.retry_delay", "min_quality": "llm.min_quality_score"},
    "cache": {"enabled": "github.cache.enabled", "max_size": "github.cache.max_size"},
    "search": {"enabled": "search.hybrid_enabled", "semantic_weight": "search.semantic_weight", "keyword_weight": "search.keyword_weight", "candidate_cap": "search.candidate_cap"},
    "embedding": {"model": "embeddings.model", "vector_size": "embeddings.vector_size"},
    "repos": {"include_private": "github.include_private", "include_orgs": "github.include_orgs", "excluded": "github.excluded_repos"},
}
KINDS = {"batch": BatchConfig, "cache": CacheConfig, "search": SearchConfig, "embedding": EmbeddingConfig, "repos": RepoConfig}
TTL_KEYS = {"repos": "ttl_repo_list", "repo": "ttl_repo_list", "tree": "ttl_file_tree", "content": "ttl_file_content"}


def _at(values: dict[str, Any], path: str) -> tuple[bool, Any]:
    for part in path.split("."):
        if not isinstance(values, dict) or part not in values:
            return False, None
        values = values[part]
    return True, values


def from_settings(values: dict[str, Any] | None) -> Config:
    """The options in a settings file's dict; what it lacks keeps its default."""
    values = values or {}
    made: dict[str, Any] = {}
    for section, keys in SETTINGS.items():
        told = {name: held for name, path in keys.items() if (held := _at(values, path))[0]}
        made[section] = {name: value for name, (_, value) in told.items()}
    found, provider = _at(values, "llm.provider")
    if found:
        made["batch"]["analyze"] = provider != "mock"
    found, cache = _at(values, "github.cache")
    if found and isinstance(cache, dict):
        made["cache"]["ttl"] = {kind: float(cache.get(key, TTL[kind])) for kind, key in TTL_KEYS.items()}
    options: dict[str, Any] = {section: KINDS[section](**own) for section, own in made.items()}
    found, ignored = _at(values, "discovery.ignored_dirs")
    if found and ignored is not None:
        options["ignored_dirs"] = list(ignored)
    return Config(**options)


def from_file(path: str) -> Config:
    """A settings file on the driver, JSON or (where a YAML reader is installed) YAML."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith((".yaml", ".yml")):
        import yaml

        return from_settings(yaml.safe_load(text))
    return from_settings(json.loads(text))
